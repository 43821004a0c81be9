"""Every registered query against its SQL, or at least its schema."""

import contextlib

import pytest
from tools import rows

from doclake.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    found = registry.queries()[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(found) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(found) > 0


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["question_id", "question", "context", "n_answers", "answer", "error"]
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").count()


def test_every_document_is_asked(spark, tmp_path):
    """Ids far beyond the first 200 too, and a document of very many lines."""
    texts = [(k * 1000 + 7, f"title{k} about thing{k}\n\nplain words\nmore of thing{k}") for k in range(60)] + [(10**9, "\n".join(f"line{k}" for k in range(3000))), (10**9 + 1, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.question_id: r for r in registry.queries()["ask_document"](spark, str(tmp_path)).collect()}
    assert set(found) == {i for i, t in texts if t}
    for i, t in texts[:-1]:
        assert found[i].question == t.split("\n")[0] and 0 < found[i].n_answers <= 5
    assert len({r.question_id for r in registry.queries()["llm_answer"](spark, str(tmp_path)).collect()}) == 61


def test_files_of_equal_contents_are_their_own(spark, tmp_path):
    """Of files with the same text one has nothing, one has points, one is indexed; each gets its own status and number of points."""
    import duckdb

    texts = [(64 * k + d, f"title {d}\nline {d}") for k in range(7) for d in range(3)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = registry.queries()["ask_from_store"](spark, str(tmp_path)).toPandas()
    assert rows(found) == rows(con.sql(SQL["ask_from_store"]).df())
    assert sorted(found.n_points) == [0, 0, 0, 6, 6, 6, 6]


def test_rest_stands_alone():
    """Nothing outside the training-data subpackage imports it."""
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(from|import)\s+[\w.]*\bllm\b", path.read_text()), path


def test_missing_requirements_leave_the_rest(monkeypatch):
    """If what the training-data part needs can't be imported, the other queries are there."""
    import importlib

    import __spark_entry__

    whole = importlib.import_module

    def broken(name, *rest):
        if name.startswith("doclake.llm") or name == "corpus_pipeline":
            raise ImportError("no xxhash")
        return whole(name, *rest)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="left out") if __spark_entry__._there("doclake.llm") else contextlib.nullcontext():
        found = __spark_entry__.queries()
    assert set(found) == set(registry.queries())
