"""Questions to documents, many at a time: retrieval, images, context, prompt."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import embed, generate
from ..sources import objects, store
from . import elements, search

SYSTEM = "You answer questions from the given context. If the answer is not in the context, say so."
ILLUSTRATED = ("image", "table")


def prompt_text(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit(" Answer from the context (texts and images) alone."))


def index_status(questions: DataFrame, points: DataFrame, storable: DataFrame) -> DataFrame:
    """questions with indexed, and status success; a file without points is indexed if it can be (records of it are in storable), else an error."""
    has = points.select("file_hash").distinct().withColumn("has", F.lit(True))
    can = storable.select("file_hash").distinct().withColumn("can", F.lit(True))
    out = questions.join(has, "file_hash", "left").join(can, "file_hash", "left")
    indexed = F.coalesce("has", F.lit(False)) | F.coalesce("can", F.lit(False))
    return out.withColumn("indexed", indexed).withColumn("status", F.when(indexed, "success").otherwise("error")).drop("has", "can")


def index_missing(questions: DataFrame, points: DataFrame, results: DataFrame, images: DataFrame, embedder: Callable[[Column], Column] = embed.embed_text, save: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions with status and indexed, points with those of the files that were missing).

    A question's file without points is looked up in results (elements of parse results, with file_hash): what is there becomes
    records, which are embedded as points and saved, so that the next question finds them. A file that isn't there, or gives no record, is an
    error. Only asked and missing files are read on. save: a folder for the new points, one of its own each time (see saved_points).
    """
    known, missing = _known(questions, points)
    return _indexed(questions, points, known, results.join(missing, "file_hash", "left_semi"), images, embedder, save)


def _known(questions: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked files that have points, those that have none). The former are written, since both the missing files and the status come from
    them: what points are made of is gone through once."""
    asked = questions.select("file_hash").distinct()
    known = shared.written(asked.join(points.select("file_hash").distinct(), "file_hash", "left_semi"), "known")
    return known, asked.join(known, "file_hash", "left_anti")


def _indexed(questions: DataFrame, points: DataFrame, known: DataFrame, results: DataFrame, images: DataFrame, embedder: Callable[[Column], Column], save: str | None) -> tuple[DataFrame, DataFrame]:
    """index_missing with results of missing files alone."""
    found = elements.explode_records(results, images)
    columns = [c for c in points.columns if c not in ("seq", "vector", "text")]
    seq = F.when(F.col("part") == "main", 0).when(F.col("part") == "caption", 1).otherwise(2).cast("long")
    new = found.select(*columns, seq.alias("seq"), F.col("content").alias("text"), embedder(F.col("content")).alias("vector"))
    new = shared.written(new.select(*points.columns), "indexed", f"{save}/{uuid.uuid4().hex}" if save else None)
    return index_status(questions, known, new), points.unionByName(new)


def index_from_store(questions: DataFrame, points: DataFrame, root: str, images: DataFrame, embedder: Callable[[Column], Column] = embed.embed_text, save: str | None = None, folder: str = "results") -> tuple[DataFrame, DataFrame]:
    """index_missing, whose parse results come from an object store: of each missing file the result's key is looked up in the listing below
    `folder`, its JSON read and taken apart into elements. Results of files that have points, or aren't asked for, are not read."""
    known, missing = _known(questions, points)
    there = objects.with_prefix(store.listing(questions.sparkSession, root), f"{folder}/")
    keys = objects.result_of_hash(there, missing, folder)
    # The hash comes from the key, not from a join: contents of all missing files would meet the keys in one broadcast.
    read = store.contents(keys, root).select(objects.hash_of_result(F.col("path"), folder).alias("file_hash"), F.col("content").cast("string").alias("value"))
    # Written: records ask for images' elements apart, so objects would be read twice; and a task has one Python worker at a time, not two.
    found = shared.written(elements.explode_elements(objects.parse_results(read)), "elements")
    return _indexed(questions, points, known, found, images, embedder, save)


def saved_points(points: DataFrame, save: str) -> DataFrame:
    """points with those that index_missing saved. A file that two runs indexed at once has its points once: ids are the same."""
    spark = points.sparkSession
    if not shared.exists(spark, save):
        return points
    own = spark.read.option("recursiveFileLookup", "true").schema(points.schema).parquet(save)
    return points.unionByName(own.dropDuplicates(["file_hash", "element_index", "seq"]))


#: Places of an element that a point's number has room for; numbers of a file go to blocks by ranges of so many.
_SEQ, _CHUNK = 4, 4096


def answers(questions: DataFrame, points: DataFrame, limit: int = 10, embedder: Callable[[Column], Column] = embed.embed_text) -> DataFrame:
    """The best points of each question's own file: question_id, question, rank, score and the points' payload.

    points: file_hash, element_index, seq (below 4), vector, text, element_type and whatever payload else. Blocks of a file's vectors meet
    blocks of its questions; what is found, and no more, then gets its payload by an equi-join.
    """
    number = F.col("element_index") * _SEQ + F.col("seq")
    # Written, since they are read three times: for their range, their blocks and their text.
    asked = shared.written(questions.select(F.col("question_id").alias("query_id"), "question", "file_hash", embedder(F.col("question")).alias("query")), "asked")
    vectors_ = points.select("file_hash", number.alias("point_id"), "vector")
    found = search.knn_per_key(vectors_, asked.select("query_id", "file_hash", "query"), "file_hash", limit, chunk=F.floor(F.col("point_id") / _CHUNK))
    # A vector without a length has no score.
    own = found.where("score is not null").join(asked.drop("query"), "query_id").withColumn("element_index", F.floor(F.col("point_id") / _SEQ)).withColumn("seq", F.col("point_id") % _SEQ)
    own = own.select(F.col("query_id").alias("question_id"), "question", "file_hash", "element_index", "seq", "score", "rank")
    return own.join(points.drop("vector"), ["file_hash", "element_index", "seq"])


def attach_images(found: DataFrame, images: DataFrame) -> DataFrame:
    """answers with image_base64 where an image or table has a stored picture; img_path, content in images, paths unique."""
    pictures = images.select(F.col("img_path").alias("picture_path"), F.base64("content").alias("image_base64"))
    # Answers without a picture get a key of their own that no path has (none begins with NUL), since nulls would all meet in one task.
    none = F.concat(F.lit("\0"), F.xxhash64("question_id", "rank").cast("string"))
    wanted = F.coalesce(F.when(F.col("element_type").isin(*ILLUSTRATED), F.col("img_path")), none)
    return found.withColumn("wanted_", wanted).join(pictures, F.col("wanted_") == F.col("picture_path"), "left").drop("wanted_", "picture_path")


def contexts(found: DataFrame) -> DataFrame:
    """Per question the texts of its answers, best first, empty ones left out; no row without answers."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    texts = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t != "")
    return found.groupBy("question_id").agg(F.first("question").alias("question"), F.array_join(texts, "\n\n").alias("context"), F.count("*").alias("n_answers"))


def prompts(found: DataFrame) -> DataFrame:
    """Per question its message: system text, pictures in the order of scores, then context and question if there is context."""
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("url"))
    none = F.lit(None).cast("string")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", "image_base64")))
    rows = found.groupBy("question_id").agg(F.first("question").alias("question"), ordered.alias("a"))
    pictures = F.transform(F.filter("a", lambda x: x["image_base64"].isNotNull()), lambda x: part("image_url", none, F.concat(F.lit("data:image/jpeg;base64,"), x["image_base64"])))
    context = F.array_join(F.filter(F.transform("a", lambda x: x["text"]), lambda t: t != ""), "\n\n")
    rows = rows.withColumn("context", context)
    last = F.when(F.col("context") != "", F.array(part("text", F.col("context"), none), part("text", prompt_text(F.col("question")), none))).otherwise(F.array().cast("array<struct<type:string,text:string,url:string>>"))
    return rows.select("question_id", "question", F.concat(F.array(part("text", F.lit(SYSTEM), none)), pictures, last).alias("messages"))


def asked(questions: DataFrame, found: DataFrame, use_llm: bool = True, model=generate.first_line) -> DataFrame:
    """question_id, question, n_answers, context and, if asked for, answer and error; found: answers with their pictures."""
    if use_llm:
        found = shared.written(found, "answers")  # contexts and prompts read it
    out = questions.select("question_id", "question").join(contexts(found).drop("question"), "question_id", "left")
    if use_llm:
        out = out.join(generate.llm_answer(prompts(found), "question_id", model=model), "question_id", "left")
    return out.withColumn("n_answers", F.coalesce("n_answers", F.lit(0)))


def ask(questions: DataFrame, points: DataFrame, images: DataFrame, limit: int = 10, use_llm: bool = True, model=generate.first_line) -> DataFrame:
    """Questions answered from the points of their files, end to end."""
    return asked(questions, attach_images(answers(questions, points, limit), images), use_llm, model)
