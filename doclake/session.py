"""The settings that results depend on, and those that suit large inputs."""

from pyspark.sql import SparkSession

#: chunkBase64String off: base64() without line ends. Rows with contents are large, so batches that go to Python have a bound in bytes.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(name: str = "doclake", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
