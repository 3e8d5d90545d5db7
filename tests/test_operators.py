"""Operators on small inputs, against brute force or stated results."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from sillar.functions import predicates as P
from sillar.functions import text as T
from sillar.functions.vector import cosine_distance
from sillar.operators import changes, chunking, evaluation, folds, monitor, retrieval, rollup
from sillar.sources.store import Store


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_identifiers(spark):
    assert one(spark, "where is super_len used by TooManyRedirects and _private, again super_len?", P.identifiers) == ["super_len", "TooManyRedirects"]
    assert one(spark, None, P.identifiers) is None


@pytest.mark.parametrize("q,general", [("¿Qué hace este proyecto?", True), ("What does this project do?", True), ("how is it organized?", True), ("¿Cuáles son los principales módulos?", True), ("What does parse_url do in this project", False), ("¿Dónde se valida el saldo?", False)])
def test_general(spark, q, general):
    assert one(spark, q, P.is_general) is general


def test_usage_and_tests(spark):
    assert one(spark, "¿Qué usa x?", P.asks_usage)
    assert not one(spark, "explica x", P.asks_usage)
    assert one(spark, "hay pruebas de esto", P.asks_tests)
    assert not one(spark, "contest", P.asks_tests)


def test_calls(spark):
    code = "def outer(a):\n    hook(a)\n    if (a): send(hook(b))\n    def inner(c): pass\n    return ab(1) or outer(2)"
    df = spark.createDataFrame([(code, "outer")], "code string, name string").select(P.call_names(F.col("code"), F.col("name")).alias("y"))
    assert df.first().y == ["hook", "send"]


def test_refusal(spark):
    assert one(spark, "Lo siento, no hay suficiente información aquí.", P.is_refusal)
    assert one(spark, "x" * 300 + " no encontré información suficiente", P.is_refusal)
    assert not one(spark, "x" * 300 + " no hay fragmentos", P.is_refusal)


def test_text(spark):
    assert one(spark, "# a\n## Propósito\nUno  dos\n\ntres\n## Otro\nx", T.purpose) == "Uno dos tres"
    assert one(spark, "# a\n> cita\nuno\n\ndos", T.purpose) == "uno dos"
    assert one(spark, "abcdef", lambda c: T.shorten(c, 4)) == "abc…"
    assert one(spark, "Aquí está la respuesta\n\nTexto", T.strip_preamble) == "Texto"
    assert one(spark, "hola\n## Título\nTexto", T.strip_preamble) == "## Título\nTexto"


def test_sizes(spark):
    assert [one(spark, n, P.human_size, "long") for n in (5, 2048, 5 * 1024**2, 3 * 1024**3, None)] == ["5 B", "2.0 KB", "5.0 MB", "3.0 GB", None]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r.d, 6) + 0.0 for r in df.select(cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1.0, 0.0, 1.0, 1.0, 1.0]


def test_knn_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vid long, embedding array<float>")
    q = df.where("vid % 20 = 0").select(F.col("vid").alias("qid"), "embedding")
    got = {}
    for r in retrieval.knn(q, df, 7, "qid", "vid", "embedding").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vid)
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    for i, v in rows[::20]:
        assert got[i] == [j for _, j in sorted((round(cos(v, w), 9), j) for j, w in rows)[:7]]


def test_adaptive_cut(spark):
    d = [0.20, 0.21, 0.22, 0.23, 0.24, 0.25, 0.26, 0.40]
    df = spark.createDataFrame([(1, f"f{i}", x, i + 1) for i, x in enumerate(d)], "question_id int, chunk_id string, distance double, rank int")
    assert sorted(r.chunk_id for r in retrieval.adaptive_cut(df).collect()) == [f"f{i}" for i in range(7)]


def test_resolve_calls(spark):
    c = spark.createDataFrame([("p", "a::1", "src/core/a.py", "function", "run", "gogo(1)"), ("p", "b::1", "src/core2/b.py", "function", "gogo", ""), ("p", "c::1", "lib/c.py", "function", "gogo", ""), ("p", "d::1", "lib/x/d.py", "function", "main", "gogo(2)\nrun()")], "project_id string, chunk_id string, file_path string, chunk_type string, name string, code string")
    got = {(r.chunk_id, r.callee): r.target for r in retrieval.resolve_calls(retrieval.call_edges(c), c).collect()}
    # the scope is a text prefix: src/core also meets src/core2; lib/x meets nothing
    assert got == {("a::1", "gogo"): "b::1", ("d::1", "run"): "a::1"}


def brute_windows(text, size=1500, back=2):
    lines, out, start = text.split("\n"), [], 0
    while True:
        end, n = start, 0
        while end < len(lines) and n < size:
            n += len(lines[end]) + 1
            end += 1
        out.append((len(out) + 1, start + 1, end))
        if end >= len(lines):
            return out
        start = max(end - back, start + 1)


def test_windows():
    assert folds.window_lines("x" * 2000 + "\ny\nz") == brute_windows("x" * 2000 + "\ny\nz")
    rng = random.Random(1)
    for _ in range(60):
        text = "\n".join("a" * rng.choice([0, 3, 40, 700, 1600]) for _ in range(rng.randrange(1, 40)))
        assert folds.window_lines(text) == brute_windows(text)
    assert folds.window_lines("") == [(1, 1, 1)] and folds.window_lines(None) == []


def test_folds(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 4, 3, 1, 9, 1])], "g string, o int, c int")
    assert sorted(r.o for r in folds.skip_fit(df, ["g"], "o", "c", 10).collect()) == [0, 1, 3]
    assert [(r.o, r.part) for r in folds.next_fit(df, ["g"], "o", "c", 8).orderBy("o").collect()] == [(0, 1), (1, 2), (2, 2), (3, 2), (4, 3), (5, 4)]
    assert sorted(r.o for r in folds.prefix_cut(df, ["g"], ["o"], "c", 10).collect()) == [0, 1]
    big = spark.createDataFrame([("g", 0, 50), ("g", 1, 1)], "g string, o int, c int")
    assert [r.o for r in folds.prefix_cut(big, ["g"], ["o"], "c", 10).collect()] == [0]


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "5")], "path string, digest string")
    c = changes.change_set(old, new)
    assert sorted(map(tuple, c.collect()), key=str) == sorted([("M", "b", "b"), ("R", "c", "e"), ("D", "d", None), ("A", None, "f")], key=str)
    assert sorted(r.key for r in changes.to_reindex(c).collect()) == ["b", "e", "f"]
    assert sorted(r.key for r in changes.to_purge(c).collect()) == ["c", "d"]


def test_merge_twice(spark):
    live = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    fresh = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = changes.merge(live, fresh, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, changes.merge(once, fresh, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_rollup_of_any_depth(spark, tmp_path):
    from sillar.plans import queries

    df = spark.createDataFrame([("p", "a/b/c/d/e/f/x.py", "deep"), ("p", "a/y.py", "flat")], "project_id string, path string, purpose string")
    got = {r.folder: r.depth for r in rollup.rollup_levels(df, ["project_id"], 3000).collect()}
    assert got == {"/".join("abcdef"[:n]): n for n in range(1, 7)}
    assert rollup.rollup_levels(df.limit(0), ["project_id"], 3000).count() == 0
    rows = df.selectExpr("project_id", "path", "purpose as content", "timestamp'2024-01-01' as ingested_at", "1 as commit_no")
    rows.write.parquet(f"{tmp_path}/repo_files.parquet")
    assert {r.depth for r in queries.folder_rollup(spark, str(tmp_path)).collect()} == set(range(1, 7))


def test_rollup(spark):
    df = spark.createDataFrame([("p", "a/b/x.py", "one"), ("p", "a/b/y.py", "two"), ("p", "a/z.py", "three"), ("p", "root.py", "four")], "project_id string, path string, purpose string")
    got = {r.folder: r.text for r in rollup.rollup_levels(df, ["project_id"], 3000, 3).collect()}
    assert got == {"a/b": "x.py: one\ny.py: two", "a": "z.py: three\nb/: x.py: one\ny.py: two"}


def test_monitor(spark):
    ok = [True, False, False, True, False]
    df = spark.createDataFrame([("p", i, v, 1.0, None) for i, v in enumerate(ok)], "project_id string, check_time int, ok boolean, seconds double, error string")
    rows = monitor.streaks(df).orderBy("check_time").collect()
    assert [r.failures for r in rows] == [0, 1, 2, 0, 1] and [r.recovered for r in rows] == [False, False, False, True, False]
    assert [r.last_ok for r in rows] == [0, 0, 0, 3, 3]


def test_percentiles(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 21)], "g int, v double")
    assert evaluation.nearest_rank(df, ["g"], "v", 90).first().p == 18
    assert evaluation.indexed_percentile(df, ["g"], "v", 90, "floor").first().p == 18
    assert evaluation.indexed_percentile(df, ["g"], "v", 95, "rounded").first().p == 19


def test_chunker():
    src = "import os\n\nX = 1\n\n\n@deco\ndef a():\n    return 1\n\n\n# about B\nclass B:\n    def m(self):\n        pass\n"
    got = [(c[2], c[3], c[4], c[5]) for c in chunking.chunk_text("m.py", src)]
    assert got == [("raw", "module_level", 1, 3), ("function", "a", 6, 8), ("class", "B", 11, 14), ("function", "m", 13, 14)]
    go = "package x\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Get() int {\n\treturn t.a\n}\n\nfunc Top(a int) {\n\tif a > 1 {\n\t}\n}\n"
    assert [(c[2], c[3]) for c in chunking.chunk_text("x.go", go)] == [("raw", "module_level"), ("class", "T"), ("method", "Get"), ("function", "Top")]
    ts = "export class A {\n  run(x: number): void {\n    go();\n  }\n}\n\nexport const f = (a) => {\n  return a;\n};\n"
    assert [(c[2], c[3]) for c in chunking.chunk_text("a.ts", ts)] == [("class", "A"), ("method", "run"), ("function", "f")]
    assert chunking.chunk_text("a.py", " \n") == [] and chunking.chunk_text("a.py", None) == []
    assert chunking.chunk_text("a.py", "def (")[0][2] == "raw"
    ids = [c[0] for c in chunking.chunk_text("a.js", "class A { get x() { return 1; } set x(v) { this.y = v; } }")]
    assert len(ids) == len(set(ids))


def test_adaptive_pieces():
    code = "\n".join("line %d" % i for i in range(9000))
    got = chunking.pieces(code)
    assert "".join(c for _, _, c in got) == code and max(len(c) for *_, c in got) <= chunking.SPLIT_AT


def test_store(spark, tmp_path):
    s = Store(str(tmp_path / "s"))
    assert s.control() == {} and s.read(spark) is None
    s.write(spark.range(3).toDF("x"), commit="a")
    old = s.read(spark)
    v = s.control()["version"]
    s.write(spark.range(5).toDF("x"), commit="b")
    assert old.count() == 3 and s.read(spark).count() == 5 and s.read(spark, v).count() == 3 and s.control()["commit"] == "b"
    with pytest.raises(Exception):
        s.write(spark.range(1).select(F.raise_error(F.lit("no"))), commit="c")
    assert s.read(spark).count() == 5
    with s.lock(), pytest.raises(BlockingIOError), s.lock():
        pass
    s.write(spark.range(1).toDF("x"))
    assert s.clean(keep=1) == 2


def test_watch_is_idempotent(spark, tmp_path):
    from sillar.streaming.watch import sync_batch

    s = Store(str(tmp_path / "w"))
    schema = "project_id string, path string, content string, ingested_at string"
    sync_batch(s, spark.createDataFrame([("p", "a", "1", "1"), ("p", "b", "2", "1"), ("p", "b", "3", "2")], schema), 0)
    sync_batch(s, spark.createDataFrame([("p", "a", None, "3"), ("p", "c", "4", "3")], schema), 1)
    sync_batch(s, spark.createDataFrame([("p", "z", "9", "9")], schema), 1)
    assert sorted(r.path for r in s.read(spark).collect()) == ["b", "c"]


def test_git(spark, tmp_path):
    from sillar.sources import git

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, text in (("a.py", "x = 1\n"), ("b.py", "y = 2\n"), ("note.md", "n")):
        (tmp_path / name).write_text(text)
    run("add", "."), run("commit", "-qm", "one")
    first = git.resolve(str(tmp_path))
    (tmp_path / "a.py").write_text("x = 3\n")
    os.rename(tmp_path / "b.py", tmp_path / "c.py")
    run("add", "-A"), run("commit", "-qm", "two")
    diff, full = git.changes(spark, str(tmp_path), first, git.resolve(str(tmp_path)))
    assert not full and sorted(map(tuple, diff.collect())) == [("M", "a.py", "a.py"), ("R", "b.py", "c.py")]
    added, full = git.changes(spark, str(tmp_path), "0" * 40, first)
    assert full and sorted(r.new_key for r in added.collect()) == ["a.py", "b.py"]
    assert {r.path: r.content for r in git.contents(spark, str(tmp_path), git.tree(spark, str(tmp_path), first)).collect()} == {"a.py": "x = 1\n", "b.py": "y = 2\n"}


def test_state_stream(spark, tmp_path):
    from sillar.streaming.monitor import state_stream

    import datetime as dt

    at = [dt.datetime(2024, 1, 1, 0, i) for i in range(5)]
    schema = "project_id string, check_time timestamp, ok boolean"
    spark.createDataFrame([("p", at[0], True), ("p", at[2], False), ("p", at[1], False)], schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    out = []
    q = lambda: state_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    q()
    spark.createDataFrame([("p", at[3], False), ("p", at[4], True)], schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    q()
    rows = sorted(out, key=lambda r: r.check_time)
    assert [r.failures for r in rows] == [0, 1, 2, 3, 0] and [r.recovered for r in rows] == [False] * 4 + [True]
