"""Splitting, packing, encoding and mixing: invariants, brute force, round trips, edge cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sillar.llm import encode, mix, pack, split

CHUNK = "project_id string, chunk_id string, file_path string, code string, start_line int, end_line int, ingested_at timestamp, bucket int, rank int"


def greedy(text, limit, overlap):
    """Cuts one after the other, each as far as its best kind of place allows."""
    out, end = [], overlap
    if len(text) <= limit:
        return [len(text)] if text else []
    step = limit - overlap
    places = [sorted({m.end() for m in rx.finditer(text)} - {0, len(text)}) for rx in split._PLACES]
    while True:
        if end + step >= len(text):
            return [*out, len(text)]
        best = None
        for half in (True, False):
            for p in places:
                ok = [x for x in p if (end + step // 2 if half else end) < x <= end + step]
                if ok:
                    best = max(ok)
                    break
            if best:
                break
        if best is None:
            return None  # forced cuts are tested by the invariants
        out.append(best)
        end = best


def test_cuts():
    rng = random.Random(2)
    compared = 0
    for t in range(400):
        text = "".join(rng.choice("ab  \n\n;x") for _ in range(rng.randrange(600))) if t % 4 else "é" * rng.randrange(300)
        limit = rng.randrange(5, 90)
        overlap = rng.randrange(limit)
        got = split.cuts(text, limit, overlap)
        joined, begin = "", 0
        for k, end in enumerate(got):
            begin = got[k - 1] - overlap if k else 0
            assert end - max(begin, 0) <= limit and (not k or end > got[k - 1])
            joined += text[got[k - 1] if k else 0 : end]
        assert joined == text
        want = greedy(text, limit, overlap)
        if want is not None:
            compared += 1
            assert got == want
    assert compared > 100
    with pytest.raises(ValueError):
        split.cuts("x", 5, 5)


def test_split_chunks(spark):
    import datetime as dt

    code = "\n".join(f"line {i} of the code" for i in range(1, 2001))
    rows = [("p", "c", "a.py", code, 11, 2010, dt.datetime(2024, 1, 1), 1, 1), ("p", "c", "a.py", code, 11, 2010, dt.datetime(2024, 1, 2), 1, 1), ("p", "s", "a.py", "x" * 16_000, 1, 1, None, 1, 1), ("p", "n", None, None, None, None, None, None, None), (None, "l", "b", "y" * 16_001, None, None, None, None, None)]
    df = spark.createDataFrame(rows, CHUNK)
    pieces = split.split_chunks(df, 16_000, 200).orderBy("project_id", "piece_no").collect()
    mine = [r for r in pieces if r.chunk_id == "c"]
    assert mine[0].code + "".join(r.code[200:] for r in mine[1:]) == code and all(len(r.code) <= 16_000 for r in mine)
    lines = code.split("\n")
    for r in mine:
        part = "\n".join(lines[r.start_line - 11 : r.end_line - 10])
        assert r.code.strip("\n") in part
    assert {r.chunk_id for r in split.oversized(split.split_chunks(df, 16_000, 200)).collect()} == {"c", "l"}
    assert split.split_chunks(df.limit(0), 16_000, 200).count() == 0


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), 9))
        counts = [rng.randrange(1, 9) for _ in lengths]
        cost = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))  # noqa: E731, B023
        from itertools import combinations

        best = min(cost([*e, lengths[-1]]) for k in range(3) for e in combinations(lengths[:-1], k))
        assert cost(pack.boundaries(lengths, counts, 60, 3)) == best


def test_boundaries_are_optimal_over_many_lengths():
    """Against the recurrence over every distinct length, of which there are more than 1,200."""
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.choice(np.arange(1, 9000), 1500, replace=False))
    counts = rng.integers(1, 40, 1500)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    cost = lengths[None, :] * (number[None, 1:] - number[:-1, None]) - (total[None, 1:] - total[:-1, None])
    cost = np.where(np.tri(1500, k=-1) > 0, 1 << 50, cost)
    best = cost[0]
    for _ in range(11):
        best = np.minimum(best, (np.concatenate([[1 << 50], best[:-1]])[:, None] + cost).min(axis=0))
    ends = np.array(pack.boundaries(lengths, counts, 9000, 12))
    assert len(ends) == 12 and ((ends[np.searchsorted(ends, lengths)] - lengths) * counts).sum() == best[-1]


def test_plan_fits():
    rng = random.Random(6)
    for _ in range(50):
        capacity = rng.randrange(10, 200)
        sizes = {rng.randrange(1, capacity + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))}
        segments, used = pack.plan(sizes, capacity)
        load, placed = {}, dict.fromkeys(sizes, 0)
        for size, parts in segments.items():
            firsts = [p[0] for p in parts]
            for r in range(sizes[size]):
                first, container, each = parts[np.searchsorted(firsts, r, "right") - 1]
                c = container + (r - first) // each
                load[c] = load.get(c, 0) + size
                placed[size] += 1
        assert placed == sizes and max(load.values()) <= capacity and sorted(load) == list(range(used))


def test_pack_chunks(spark):
    rng = random.Random(1)
    rows = [("p" if i % 3 else None, f"c{i}", "f", "x" * (rng.choice([0, 5, 40, 300, 999, 1000, 2500]) if i else 0), 1, 1, None, 7, 7) for i in range(3000)]
    rows += rows[:50] + [("p", "null", "f", None, 1, 1, None, 1, 1)]
    df = spark.createDataFrame(rows, CHUNK)
    got = pack.pack_chunks(df, 1000)
    assert got.groupBy("container_id").agg(F.sum("length").alias("s")).where("s > 1000").count() == 0
    want = df.where("code is not null").select("project_id", "chunk_id", F.length("code").alias("n")).distinct()
    have = got.groupBy("project_id", "chunk_id").agg(F.sum("length").cast("int").alias("n"), F.count("*").alias("k"))
    assert want.exceptAll(have.drop("k")).count() == 0 and have.count() == 3000
    assert have.where("k > 1 and n <= 1000").count() == 0
    assert pack.report(got, 1000).first().fill > 0.95
    assert pack.pack_chunks(df.limit(0), 1000).count() == 0
    assert pack.pack_chunks(df.limit(1), 1000).count() == 1


needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{encode.FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


@needs_vocabulary
def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [None, "", " ", "a", "don't  we'll\r\n\tx", "<|endoftext|> ñ 你好 😀👩‍💻", "a b " * 500, "word" * 400, "x  y\n" * 300, "1.234,5" * 90]
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    for window in (encode.WINDOW, 64, 7):
        got = {r.doc_id: r.ids for r in encode.encode_documents(df, window=window).collect()}
        assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
        assert all(encode.decode(got[i]).decode() == x for i, x in enumerate(texts) if x)
    assert encode.encode_documents(df.limit(0)).count() == 0


def test_amounts():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1), "none": (0.1, 3)}
    got = mix.amounts({"a": 100, "b": 10, "c": 100}, targets)
    assert got["b"] == 20 and got["none"] == 0 and abs(sum(got.values()) - 210) < 1e-6 and got["a"] <= 100 and got["c"] <= 100
    free = mix.amounts({"a": 900, "b": 900, "c": 900}, targets | {"none": (0.0, 0)}, total=1000)
    assert [round(free[k]) for k in "abc"] == [500, 300, 200]


def test_pivot():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(1, 500, 400).astype(float), rng.random(400)
    taken = np.zeros(400)
    for _ in range(200):
        out = mix.pivot(sizes, p, rng)
        inside = (out > 1e-9) & (out < 1 - 1e-9)
        assert inside.sum() <= 1 and abs((out * sizes).sum() - (p * sizes).sum()) < 1e-6
        taken += out
    assert abs((taken / 200 - p).mean()) < 0.02


@needs_vocabulary
def test_mixture(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 40), rng.choice(["a", " A ", "b-x", "B X", "zz", None, ""]), 1) for i in range(1500)] + [(9001, None, "a", 1), (9002, "", "a", 1), (None, "x", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.3, 2, 0), ("b_x", 0.65, 3, 0), ("empty", 0.05, 1, 0)], "source string, target_share double, max_repeats int, copies int")
    monkeypatch.setattr(mix, "GROUP", 60)
    monkeypatch.setattr(mix, "FAN", 4)
    got = mix.mixture(df, targets)
    one = got.groupBy("doc_id").count().where("count > 1").count()
    assert one == 0 and got.where("copies > 3 or (source = 'a' and copies > 2)").count() == 0
    shares = {r.source: r for r in mix.shares(got, targets).collect()}
    assert abs(shares["a"].reached_share - 0.3 / 0.95) < 0.005 and shares["empty"].reached_share == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mix.mixture(df, targets).collect()))
    assert mix.mixture(df.limit(0), targets).count() == 0
