from pyspark.sql import functions as F

from sillar.functions import places
from sillar.operators import assembly as A


def test_blocks(spark):
    df = spark.createDataFrame([("a.py", 1, 3, "function", "f", "x", True), ("b.py", 2, 2, "raw", None, "y", False), ("[resumen]", 0, 0, "overview", None, "z", False)], "file_path string, start_line int, end_line int, chunk_type string, name string, code string, expanded boolean")
    assert [r.block for r in A.blocks(df).collect()] == ["[a.py (líneas 1-3)] function 'f' [incluido automáticamente por grafo de llamadas]\n```\nx\n```", "[b.py (líneas 2-2)] raw\n```\ny\n```", "[[resumen]]\nz"]


def test_prompts_fit(spark):
    q = spark.createDataFrame([(1, "where?"), (2, "none?")], "question_id int, question string")
    c = spark.createDataFrame([(1, i, "b%d " % i + "x" * n) for i, n in enumerate([2000, 9000, 1500, 300], 1)], "question_id int, rank int, block string")
    got = {r.question_id: r for r in A.prompts(q, c, "rules", num_ctx=2300).collect()}
    assert "b1 " in got[1].prompt and "b2 " not in got[1].prompt and "b3 " in got[1].prompt and "b4 " in got[1].prompt
    assert got[1].used <= 2300 - A.ANSWER_RESERVE and A.NO_CONTEXT in got[2].prompt and got[2].system.startswith("IMPORTANTE")


def test_parts(spark):
    df = spark.createDataFrame([("f", i, "x" * n) for i, n in enumerate([50, 60, 500, 10])], "f string, o int, block string")
    got = [r.text for r in A.document_parts(df, ["f"], "o", 120).orderBy("part").collect()]
    assert [len(x) for x in got] == [112, 60 + 16, 10] or sum(x.count("x") for x in got) == 50 + 60 + 60 + 10


def test_rerank(spark):
    c = spark.createDataFrame([(1, i) for i in range(1, 6)], "question_id int, rank int")
    o = spark.createDataFrame([(1, 1, 4), (1, 2, 9), (1, 3, 2), (1, 4, 4)], "question_id int, place int, number int")
    assert [r.rank for r in A.rerank(c, o).orderBy("new_rank").collect()] == [4, 2, 1, 3, 5]


def test_places(spark):
    hosts = ["http://localhost:1", "10.0.0.3", "box.local", "ollama", "example.com", "", None, "8.8.8.8", "http://[::1]:3"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(places.is_local(F.col("h")).alias("x"))
    assert [r.x for r in df.collect()] == [True, True, True, True, False, False, False, False, True]
    ids = spark.createDataFrame([("a-b",), ("..",), (None,), ("x" * 65,)], "i string")
    assert [r.x for r in ids.select(places.is_project_id(F.col("i")).alias("x")).collect()] == [True, False, False, False]
    assert [r.x for r in spark.createDataFrame([("ext::sh",), ("https://a/b",)], "u string").select(places.is_repository(F.col("u")).alias("x")).collect()] == [False, True]
