"""Quirks on rows made by hand, and rules against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from doclake.functions import embed, generate
from doclake.operators import catalog, elements, graph, ingest, overlay, qa, vectors
from doclake.sources import html, objects, store
from doclake.streaming import ingest as stream


def one(df):
    return [tuple(r) for r in df.collect()]


def made(spark, entries):
    wrapped = json.dumps({"results": {"result": {"results": {"content_list": entries}}}})
    return elements.explode_elements(objects.parse_results(spark.createDataFrame([("h", wrapped)], "file_hash string, value string")))


def test_entries_that_are_no_objects_keep_their_place(spark):
    found = made(spark, [1, "x", None, {"type": "text", "text": "a"}, [2], {"text": "b"}])
    assert one(found.select("element_index", "type", "text")) == [(3, "text", "a"), (5, None, "b")]


@pytest.mark.parametrize("value", ["", "{broken", '{"results": {}}', '{"results": {"result": {"results": {"content_list": []}}}}'])
def test_no_elements(spark, value):
    assert objects.parse_results(spark.createDataFrame([("h", value)], "file_hash string, value string")).select(F.size("content_list")).first()[0] == 0


def test_records_of_each_kind(spark):
    found = made(
        spark,
        [
            {"type": "text", "text": " ", "text_level": None},
            {"type": "text", "text": ""},
            {"type": "text", "text": "t", "text_level": 1},
            {"type": "text", "text": "s", "text_level": 3},
            {"type": "image", "img_path": "there", "image_caption": ["a", "b"], "image_footnote": []},
            {"type": "image", "img_path": "missing", "image_caption": ["c"]},
            {"type": "table", "table_caption": ["x"], "table_footnote": ["y"]},
            {"type": "equation", "latex": "e=1", "text": "no"},
            {"type": "discarded", "text": "gone"},
            {"type": "list", "text": "l"},
        ],
    )
    images = spark.createDataFrame([("there",)], "img_path string")
    got = one(elements.explode_records(found, images).orderBy("element_index", "seq").select("element_index", "part", "element_type", "content"))
    assert got == [
        (0, "main", "text", "Text:  "),
        (2, "main", "title", "Title: t"),
        (3, "main", "text", "Text (level 3): s"),
        (4, "main", "image", "Image: there"),
        (4, "caption", "image_caption", "Image Caption: a b"),
        (6, "caption", "table_caption", "Table Caption: x"),
        (6, "footnote", "table_footnote", "Table Footnote: y"),
        (6, "main", "table", "Table: "),
        (7, "main", "equation", "Equation: e=1"),
        (9, "main", "list", '{"type":"list","text":"l"}'),
    ]


def test_boxes(spark):
    spec = '[{"bbox": [1, 2, 3, 4], "color": "red", "label": "a"}, {"bbox": [1]}, 7]'
    df = spark.createDataFrame([(spec,), ("[{oops",), (None,)], "s string").select(overlay.parse_boxes(F.col("s")).alias("b"))
    assert [len(r.b) for r in df.collect()] == [1, 0, 0]
    box = spark.range(1).select(overlay.scale_box(F.array(*(F.lit(float(x)) for x in (50, 100, 950, 999))), F.lit(612), F.lit(792)).alias("b")).first().b
    assert box == [int(50 / 1000 * 612) * 2, int(100 / 1000 * 792) * 2, int(950 / 1000 * 612) * 2, int(999 / 1000 * 792) * 2]
    texts = spark.createDataFrame([("x" * 100,), ("x" * 101,)], "t string").select(overlay.short(F.col("t"), 100).alias("t"))
    assert [len(r.t) for r in texts.collect()] == [100, 103]


def test_vector_literals_and_zero_vectors(spark):
    df = spark.createDataFrame([("1,2,x,4",), ("1,2,3",), (" 1, 2,3,4e0",)], "s string")
    vector, status = vectors.parse_vector(F.col("s"), 4)
    assert one(df.select(vector, status)) == [(None, "bad_number"), (None, "bad_size"), ([1.0, 2.0, 3.0, 4.0], "ok")]
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "point_id long, vector array<float>")
    assert [r.point_id for r in vectors.knn(points, [2.0, 0.0], 3).collect()] == [2, 3, 1]
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, query array<float>")
    for distance in vectors.DISTANCES:
        blocks = one(vectors.knn_blocks(points, asked, 2, distance).orderBy("rank").select("point_id"))
        assert blocks == one(vectors.knn(points, [2.0, 0.0], 2, distance).select("point_id"))


def test_vector_size_is_checked(spark):
    records = spark.createDataFrame([("h", 1)], "file_hash string, element_index long")
    saved = vectors.save_embeddings(records, records.withColumn("vector", F.array(F.lit(1.0).cast("float"))), ["file_hash", "element_index"], "c", 2)
    with pytest.raises(Exception, match="vector size"):
        saved.collect()


def _stack(labels):
    out, stack = [], []
    for k, label in enumerate(labels):
        if label in graph.CONTENT:
            out.append(stack[-1] if stack else -1)
        else:
            stack = [k]
            out.append(-1)
    return out


def _stack_levels(levels):
    out, stack = [], []
    for k, level in enumerate(levels):
        while stack and level is not None and stack[-1][1] >= level:
            stack.pop()
        out.append(stack[-1][0] if stack else -1)
        if level is not None:
            stack.append((k, level))
    return out


def test_parents_equal_a_stack(spark):
    rng = random.Random(5)
    docs = [[rng.choice(["text", "title", "equation", "image", "table", "list"]) for _ in range(rng.randrange(12))] for _ in range(150)]
    rows = [(d, k, label) for d, own in enumerate(docs) for k, label in enumerate(own)]
    got = {(r.doc_id, r.dst): r.src for r in graph.parent_edges(spark.createDataFrame(rows, "doc_id long, node_id long, label string")).collect()}
    assert got == {(d, k): p for d, own in enumerate(docs) for k, p in enumerate(_stack(own))}
    docs = [[rng.choice([None, 1, 2, 3, 4]) for _ in range(rng.randrange(12))] for _ in range(150)]
    rows = [(d, k, level) for d, own in enumerate(docs) for k, level in enumerate(own)]
    got = {(r.doc_id, r.dst): r.src for r in graph.parent_edges_by_level(spark.createDataFrame(rows, "doc_id long, node_id long, level int")).collect()}
    assert got == {(d, k): p for d, own in enumerate(docs) for k, p in enumerate(_stack_levels(own))}


def test_paths(spark):
    df = spark.createDataFrame([("pdfs/h_a_b.pdf/x.pdf",), ("pdfs/h_a_b.pdf",), ("pdfs/h",)], "path string")
    assert one(catalog.parsed(df).select("file_hash", "file_name")) == [("h", "x.pdf"), ("h", "a_b.pdf"), ("unknown", "h")]
    assert [r[0] for r in df.select(ingest.object_name(F.lit("a b/ü*~+c"))).limit(1).collect()] == ["a%20b/%C3%BC%2A~%2Bc"]


def test_uploads_are_checked(spark):
    rows = [(1, None, b"x"), (2, "a.txt", b"x"), (3, "a/b.pdf", b"x"), (4, "a.PDF", b""), (5, "a.PDF", b"x"), (6, "b.pdf", b"x")]
    found = ingest.validate(spark.createDataFrame(rows, "arrival long, filename string, content binary"))
    assert [r.reason for r in found.orderBy("arrival").collect()] == ["no_name", "not_pdf", "path_in_name", "empty", None, None]
    good = ingest.dedupe(ingest.with_hash(found.where("status = 'ok'").drop("status", "reason")))
    assert one(good.orderBy("arrival").select("status")) == [("success",), ("already_processed",)]


def test_page_slices(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "doc_id long, page_idx long")
    assert sorted(one(html.slice_pages(df, 1))) == [(1, 5), (2, 0)]
    assert sorted(one(html.slice_pages(df, 7, 9))) == [(1, 0), (1, 5), (2, 0)]


def test_html_function_equals_expression(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    spark.udtf.register("parse_document", html.parser())
    pages.createOrReplaceTempView("html_pages")
    got = spark.sql("select page_id, element_index, text, text_level from html_pages, lateral parse_document(html)")
    want = html.elements(pages).select("page_id", F.col("element_index").cast("int"), "text", "text_level")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_models_plug_in(spark):
    texts = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    client = embed.client_udf(lambda: lambda batch: [[len(t), 1.0] for t in batch])
    assert one(texts.select("id", client("text"))) == [(1, [1.0, 1.0]), (2, [0.0, 1.0])]

    def broken(_):
        raise ValueError("no")

    prompts = spark.createDataFrame([(1, [("text", "hi", None)])], "question_id long, messages array<struct<type:string,text:string,url:string>>")
    assert one(generate.llm_answer(prompts, "question_id", model=broken)) == [(1, None, "ValueError: no")]
    assert one(generate.llm_answer(prompts, "question_id")) == [(1, "hi", None)]


def test_questions_without_answers(spark, sf):
    asked = spark.createDataFrame([(1, "what", "nowhere")], "question_id long, question string, file_hash string")
    points = spark.createDataFrame([("h", 0, 0, "Text: what", "text", None, 0, [0.0] * 64)], "file_hash string, element_index long, seq long, text string, element_type string, img_path string, page_idx long, vector array<float>")
    images = spark.createDataFrame([], "img_path string, content binary")
    assert one(qa.ask(asked, points, images)) == [(1, "what", None, 0, None, None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"d{k}.pdf", bytes([65 + k % 3])) for k in range(9)]
    df = spark.createDataFrame(rows, "filename string, content binary")
    for k in range(3):
        df.where(F.col("filename").isin([r[0] for r in rows[3 * k : 3 * k + 3]])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    own = spark.readStream.schema("filename string, content binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("arrived", F.lit(0))
    stream.run(own, f"{tmp_path}/files", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/files")
    assert got.count() == 3 and got.select("file_hash").distinct().count() == 3
    stream.run(own, f"{tmp_path}/files", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/files").count() == 3


def test_files_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one")
    (tmp_path / "in" / "b.txt").write_bytes(b"two")
    stream.run(stream.arrivals(spark, f"{tmp_path}/in"), f"{tmp_path}/files", f"{tmp_path}/state").awaitTermination()
    assert one(spark.read.parquet(f"{tmp_path}/files").select("filename", "size")) == [("a.pdf", 3)]
    assert [r.path for r in store.listing(spark, f"{tmp_path}/in").orderBy("path").collect()] == ["a.pdf", "b.txt"]


def test_parents_with_tolerance(spark):
    """The stack rule against a plain walk; a tolerance isn't the nearest smaller key."""
    import random

    from doclake.operators import graph

    rng = random.Random(1)
    rows = [(d, k, rng.choice([None, *range(9)])) for d in range(30) for k in range(40)]
    want = set()
    for d in range(30):
        stack = []
        for _, k, key in rows[40 * d : 40 * d + 40]:
            while key is not None and stack and key <= stack[-1][1] + 1:
                stack.pop()
            want.add((d, "PARENT", stack[-1][0] if stack else -1, k))
            if key is not None:
                stack.append((k, key))
    df = spark.createDataFrame(rows, "doc_id long, node_id long, key int").repartition(3)
    assert {tuple(r) for r in graph.parent_edges_by_key(df).collect()} == want
    few = spark.createDataFrame([(1, 0, 1), (1, 1, 4), (1, 2, 5), (1, 3, 4)], "doc_id long, node_id long, key int")
    assert [r.src for r in graph.parent_edges_by_key(few).orderBy("dst").collect()] == [-1, 0, 0, 0]


def test_near_points_keep_their_distance(spark):
    from doclake.operators import vectors

    points = spark.createDataFrame([(1, [1e6, 0.0]), (2, [1e6 + 0.001, 0.0])], "point_id long, vector array<double>")
    found = vectors.knn_blocks(points, points.selectExpr("point_id as query_id", "vector as query"), 2, "EUCLID")
    assert {r.score for r in found.where("query_id <> point_id").collect()} == {0.001}


def test_clients_embed_in_batches(spark):
    """A client gets up to so many texts a call, and its failure is the job's."""
    import pytest
    from pyspark.sql import functions as F

    from doclake.functions import embed

    def make():
        def client(texts):
            assert len(texts) <= 7
            return [[float(len(t)), float(len(texts))] for t in texts]

        return client

    df = spark.range(20, numPartitions=1).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    found = df.select("text", embed.client_udf(make, batch=7)(F.col("text")).alias("v")).collect()
    assert all(r.v[0] == len(r.text) for r in found) and {r.v[1] for r in found} == {7.0, 6.0}

    def broken():
        def client(texts):
            raise RuntimeError("no service")

        return client

    with pytest.raises(Exception, match="no service"):
        df.select(embed.client_udf(broken)(F.col("text"))).collect()


def _stack_keys(keys, tolerance):
    out, stack = [], []
    for k, key in enumerate(keys):
        while key is not None and stack and not key > stack[-1][1] + tolerance:
            stack.pop()
        out.append(stack[-1][0] if stack else -1)
        if key is not None:
            stack.append((k, key))
    return out


def test_stack_rule_over_slices(spark):
    """3,000 random lists, some of which are cut by slices, against the plain stack."""
    rng = random.Random(4)
    docs = [[rng.choice([None, None, rng.random() * 9, rng.randrange(6)]) for _ in range(rng.choice([0, 1, 5, 12, 400 if k % 100 == 0 else 3]))] for k in range(3000)]
    rows = [(d, k, None if key is None else float(key)) for d, own in enumerate(docs) for k, key in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, node_id long, key double").repartition(5)
    for tolerance in (0.0, 1.0):
        got = {(r.doc_id, r.dst): r.src for r in graph.parent_edges_by_key(df, tolerance=tolerance).collect()}
        assert got == {(d, k): p for d, own in enumerate(docs) for k, p in enumerate(_stack_keys(own, tolerance))}


def test_stack_rule_of_one_long_document(spark):
    """A million nodes of one document, over several tasks; headers of the first slice stay open to the last."""
    n = 1_000_000
    key = lambda k: 0.0 if k == 5 else 2.0 if k == 6 else None if k * 7919 % 13 else float(4 + k * 104729 % 31)
    x = F.when(F.col("id") == 5, 0.0).when(F.col("id") == 6, 2.0).when(F.col("id") * 7919 % 13 != 0, None).otherwise((4 + F.col("id") * 104729 % 31).cast("double"))
    df = spark.range(n).select(F.lit("one").alias("doc_id"), F.col("id").alias("node_id"), x.alias("key"))
    found = graph.parent_edges_by_key(df)
    got = found.select("dst", "src").toArrow()
    parents = dict(zip(got["dst"].to_pylist(), got["src"].to_pylist()))
    want = _stack_keys(map(key, range(n)), 1.0)
    assert len(parents) == n and all(parents[k] == p for k, p in enumerate(want)) and 6 in want[-1000:]
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_paths_of_broken_chains(spark):
    """Depths follow edges, whatever the nodes' numbers; what hangs on a missing node or a circle isn't reached."""
    chain = [("a", "ORDER", -1, 40), ("a", "ORDER", 40, 7), ("a", "ORDER", 7, 9), ("a", "ORDER", 8, 3), ("a", "ORDER", 3, 4), ("a", "PARENT", 4, 5), ("b", "ORDER", 1, 2), ("b", "ORDER", 2, 1), ("b", "ORDER", -1, 0)]
    chain += [("long", "ORDER", k - 1, k) for k in range(300)]
    edges = spark.createDataFrame(chain, "doc_id string, rel string, src long, dst long").repartition(3)
    want = {("a", 40, 1), ("a", 7, 2), ("a", 9, 3), ("b", 0, 1)} | {("long", k, k + 1) for k in range(300)}
    assert {tuple(r) for r in graph.order_path(edges).collect()} == want
    assert graph.order_path(edges.limit(0)).collect() == []


def most_in_a_task(spark, df):
    """Rows of the largest partition, where nothing is broadcast and small partitions aren't put together."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        return max(r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_elements_without_a_path_stay_apart(spark):
    rows = [{"type": "text", "text": f"t{k}"} for k in range(2000)] + [{"type": "image", "img_path": f"p{k}"} for k in range(200)]
    own = made(spark, rows).repartition(4, "element_index")
    images = spark.createDataFrame([(f"p{k}",) for k in range(0, 200, 2)], "img_path string")
    found = elements.explode_records(own, images)
    assert found.count() == 2100 and most_in_a_task(spark, found) < 1000


def test_answers_without_a_picture_stay_apart(spark):
    rows = [(k, r, "image" if r == 1 and k % 2 else "text", f"p{k % 50}" if r == 1 else None) for k in range(500) for r in range(1, 5)]
    found = spark.createDataFrame(rows, "question_id long, rank int, element_type string, img_path string").repartition(4)
    images = spark.createDataFrame([(f"p{k}", b"x") for k in range(40)], "img_path string, content binary")
    shown = qa.attach_images(found, images)
    assert shown.columns == [*found.columns, "image_base64"] and shown.count() == 2000
    assert shown.where("image_base64 is not null").count() == sum(k % 2 and k % 50 < 40 for k in range(500))
    assert most_in_a_task(spark, shown) < 1000


def test_elements_of_a_frequent_path_are_split(spark, tmp_path):
    """Images that were written, and a path that most elements have: Spark deals its elements to several tasks."""
    rows = [{"type": "image", "img_path": "hot" if k % 10 else f"p{k}"} for k in range(6000)]
    made(spark, rows).repartition(16, "element_index").write.parquet(f"{tmp_path}/elements")
    spark.createDataFrame([("hot",), *((f"p{k}",) for k in range(0, 6000, 20))], "img_path string").write.parquet(f"{tmp_path}/images")
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.openCostInBytes": "1m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        found = elements.explode_records(spark.read.parquet(f"{tmp_path}/elements"), spark.read.parquet(f"{tmp_path}/images"))
        tasks = [r["n"] for r in found.where("img_path = 'hot' or img_path is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) == 5400 and max(tasks) < 2700
        assert found.count() == 5700
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_points_are_gone_through_once_for_the_status(spark):
    """What makes the points is evaluated for the files that are known, and not again for the status."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(x):
        seen.add(1)
        return x

    result = made(spark, [{"type": "text", "text": "a"}]).withColumn("file_hash", F.lit("h2"))
    images = spark.createDataFrame([], "img_path string")
    points = spark.range(10).select(key.asNondeterministic()(F.lit("h")).alias("file_hash"), F.col("id").alias("element_index"), F.lit(0).cast("long").alias("seq"), F.lit("t").alias("text"), embed.embed_text(F.lit("t")).alias("vector"))
    asked = spark.createDataFrame([(1, "h"), (2, "h2"), (3, "h3")], "question_id long, file_hash string")
    status, _ = qa.index_missing(asked, points, result, images)
    assert sorted(one(status.select("question_id", "status"))) == [(1, "success"), (2, "success"), (3, "error")]
    assert seen.value == 10
