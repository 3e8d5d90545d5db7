import json

import pytest
from pyspark.sql import functions as F

from sillar.functions import embed as E
from sillar.operators import chunking, studies
from sillar.sources import files, synthetic


def study(start, vram, n=3, profile="abierto", digest="d"):
    q = [{"n": i, "question": f"q{i}", "answer": "a", "answer_seconds": start, "answer_tokens": 5, "rating": {"correct": "si"}} for i in range(n)]
    return {"schema": 2, "meta": {"id": "x", "profile": profile}, "consents": [{"kind": "participacion", "accepted": True}], "hardware": {"gpus": [{"model": "g", "vram_gb": vram}]}, "questions": q, "integrity": {"sha256_of_questions": digest}}


def test_studies(spark, tmp_path):
    for name, data in (("a", study(4.0, 8)), ("b", study(10.0, 6, digest="e")), ("c", study(4.0, 8)), ("d", study(1.0, 8, n=2, digest="f"))):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    (tmp_path / "e.json").write_text("{broken")
    (tmp_path / "x-identidad.json").write_text("{}")
    r = studies.review(files.studies(spark, str(tmp_path)))
    got = {x.path[-6:]: x.problems for x in r.collect()}
    assert got == {"a.json": [], "b.json": [], "c.json": ["duplicado"], "d.json": ["menos de 3 preguntas"], "e.json": ["JSON ilegible"]}
    assert {x.bucket: (x.n, x.median) for x in studies.times(r).collect()} == {"7-8 GB": (3, 4.0), "<=6 GB": (3, 10.0), None: (6, 7.0)}


def test_digest(spark):
    import hashlib

    values = ["a \"b\"", "ñ/é\n"]
    want = hashlib.sha256(json.dumps(values, ensure_ascii=False).encode()).hexdigest()
    assert spark.createDataFrame([(values,)], "v array<string>").select(studies.digest(F.col("v")).alias("d")).first().d == want


def test_csv_and_state(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿id,data\n1,"{""schema"": 2}"\n2,"{""schema"": 3}"\n', encoding="utf-8")
    assert [(r.row, r.data.schema) for r in files.study_rows(spark, str(tmp_path / "x.csv"), "data").collect()] == [("fila 1", 2), ("fila 2", 3)]
    (tmp_path / "s.json").write_text("[]")
    assert files.state(str(tmp_path / "s.json"), 1) == files.state(str(tmp_path / "none"), 1) == {"version": 1, "dirs": {}, "root": {}}


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/b.md").write_text("x" * 10)
    (tmp_path / "OVERVIEW.md").write_text("y")
    assert files.sizes(spark, str(tmp_path)).agg(F.sum("bytes")).first()[0] == 11
    assert [r.path[-9:] for r in files.documentation(spark, str(tmp_path)).collect()] == ["docs/b.md"]
    lines = spark.createDataFrame([("RTX 5070, Laptop, 8151",), ("bad",), ("x, [N/A]",)], "line string")
    assert [tuple(r) for r in files.gpus(lines).collect()] == [("RTX 5070, Laptop", 8.0)]


def test_embedding(spark):
    df = spark.createDataFrame([("a.py", "def load_item(x): pass"), ("a.py", "def load_item(x): pass"), ("b.py", None)], "file_path string, code string")
    v = [r.embedding for r in E.embed_chunks(df).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-5 and v[2] is None

    class Bad:
        model = "bad"

        def __call__(self, texts):
            return []

    with pytest.raises(Exception, match="one vector"):
        E.embed_chunks(df, Bad()).collect()
    assert E.profile("nomic-embed-text:v1")[0] == "search_query: " and E.profile("other") == ("", "", 2048)
    with pytest.raises(ValueError):
        E.check_model(None, "bge-m3")


def test_synthetic(spark):
    df = synthetic.corpus(spark, 30)
    assert sorted(map(tuple, df.collect())) == sorted(synthetic.source_file(i) for i in range(30))
    for i in range(30):
        path, text = synthetic.source_file(i)
        kinds = [c[2] for c in chunking.chunk_text(path, text)]
        assert 4 <= kinds.count("function") <= 12
