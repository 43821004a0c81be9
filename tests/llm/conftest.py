import pytest

#: Texts that operators meet: nothing, blanks, line ends, long ones, ties, copies, other scripts.
PASSAGE = "the quick brown fox jumps over the lazy dog and then runs far away from all of the other animals in the wood near by"
TEXTS = [
    None,
    "",
    " \t\n ",
    "\n\n",
    "a",
    "İstanbul ß ﬁ é á   x",
    PASSAGE,
    PASSAGE,
    "other words first. " + PASSAGE + " other words last.",
    PASSAGE.upper(),
    "=" * 700,
    "ab" * 400,
    "one line that repeats itself\nshort\none line that repeats itself\n  ONE LINE that repeats itself\t",
    "no line of mine\r\none line that repeats itself\r",
    "0123456789 " * 30,
    " ".join(f"word{k}" for k in range(3000)),
    " ".join(f"word{k}" for k in range(2999)) + " changed",
    "日本語のテキスト " * 40,
    "x" * 5000,
    "$$$ %%% ### &&& *** " * 20,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every sort, a repeated row, a null id and columns whose names clash."""
    rows = [(k, t, None if k % 5 == 4 else ("en", "fr")[k % 2], "s", len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [(6, PASSAGE, "en", "s", len(PASSAGE)), (None, PASSAGE + " end", "en", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n_lines", "drops", "key", "score", "spans", "items", "part", "k", "fp", "piece"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
