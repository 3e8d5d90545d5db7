"""Problem 6: filling containers of a fixed capacity with whole chunks.

A dynamic programme over the histogram of all lengths chooses the bucket
boundaries with the least padding.  Inside a bucket all items count as its upper
boundary, so token-budget batches are known from counts alone: full batches of
one bucket first, the room left in them then goes to batches of the smaller
buckets that fit.  Items find their container by their rank in their bucket; the
ranks come from counts per (bucket, salt), so no bucket is sorted in one task.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillar.sources.tables import tasks

BUCKETS = 160


def boundaries(lengths, counts, capacity: int, buckets: int = BUCKETS) -> list[int]:
    """Upper bucket boundaries that minimise the padding of a length histogram, over all distinct lengths.

    The padding of a bucket is a Monge cost, so the best first length of the last
    bucket does not fall as the lengths rise: a layer of the programme is filled by
    halving, every length between the choices of its neighbours, in n log n steps.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    order = np.argsort(lengths)
    ends, counts = lengths[order], counts[order]
    n = len(ends)
    if n <= buckets:
        return ends.tolist()
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * ends)])
    far = np.iinfo(np.int64).max // 4
    best = ends * number[1:] - total[1:]  # padding of the lengths up to each in one bucket
    choice = []
    for _ in range(buckets - 1):
        through = np.concatenate([[far], best[:-1]])
        new, pick = np.full(n, far), np.zeros(n, dtype=np.int32)
        step = 1 << n.bit_length()
        while step > 1:
            half = step // 2
            at = np.arange(half - 1, n, step)
            if len(at):
                low = np.where(at >= half, pick[np.maximum(at - half, 0)], 0)
                after = at + half
                high = np.minimum(at, np.where(after < n, pick[np.minimum(after, n - 1)], n - 1))
                width = high - low + 1
                first = np.concatenate([[0], np.cumsum(width)[:-1]])
                i = np.arange(width.sum()) - np.repeat(first - low, width)
                j = np.repeat(at, width)
                value = through[i] + ends[j] * (number[j + 1] - number[i]) - (total[j + 1] - total[i])
                least = np.minimum.reduceat(value, first)
                hit = np.flatnonzero(value == np.repeat(least, width))
                own = np.repeat(np.arange(len(at)), width)[hit]
                pick[at] = i[hit[np.searchsorted(own, np.arange(len(at)))]]
                new[at] = least
            step = half
        better = new < best
        choice.append(np.where(better, pick, -1).astype(np.int32))
        best = np.minimum(new, best)
    out, j = [int(ends[-1])], n - 1
    for pick in reversed(choice):
        i = pick[j]
        if i > 0:
            j = i - 1
            out.append(int(ends[j]))
    return sorted(out)


def plan(sizes: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Containers for ``count`` items of each padded size, largest first, fullest container first.

    Returns {size: [(first rank, first container, items per container), ...]} and
    the number of containers.  Works on counts, so its cost does not depend on
    how many items there are.
    """
    room: list[int] = []  # the different amounts of free room, ascending
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: [(first container, containers)]
    out: dict[int, list[tuple[int, int, int]]] = {}
    used = 0

    def keep(free, first, n):
        if n > 0 and free > 0:
            if free not in groups or not groups[free]:
                insort(room, free)
            groups[free].append((first, n))

    smallest = min(sizes, default=1)
    for size in sorted(sizes, reverse=True):
        left, rank, segments = sizes[size], 0, []
        at = bisect_right(room, size - 1)
        while left and at < len(room):
            free = room[at]
            each = free // size
            todo, groups[free] = groups[free], []
            room.pop(at)
            rest = []
            for first, n in todo:
                if not left:
                    rest.append((first, n))
                    continue
                full = min(n, left // each)
                if full:
                    segments.append((rank, first, each))
                    rank, left = rank + full * each, left - full * each
                    if free - each * size >= smallest:
                        keep(free - each * size, first, full)
                if full < n and left and left < each:
                    segments.append((rank, first + full, left))
                    keep(free - left * size, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    rest.append((first + full, n - full))
            for first, n in rest:
                keep(free, first, n)
            at = bisect_right(room, free)
        if left:
            each = capacity // size
            full, odd = divmod(left, each)
            if full:
                segments.append((rank, used, each))
                keep(capacity - each * size, used, full)
                rank, used = rank + full * each, used + full
            if odd:
                segments.append((rank, used, odd))
                keep(capacity - odd * size, used, 1)
                used += 1
        out[size] = segments
    return out, used


def _items(chunks: DataFrame, capacity: int) -> DataFrame:
    """One row per chunk, or per piece of a chunk beyond the capacity."""
    key = ["project_id", "chunk_id"]
    one = chunks.where(F.col("code").isNotNull()).select(*key, "file_path", "ingested_at", F.length("code").alias("length"))
    one = one.groupBy(*key).agg(F.max_by(F.struct("file_path", "length"), F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp"))).alias("v")).select(*key, "v.*")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("length") / capacity).cast("int"))
    one = one.withColumn("piece_no", F.explode(F.sequence(F.lit(1), pieces)))
    return one.select(*key, "file_path", "piece_no", ((F.col("piece_no") - 1) * capacity).alias("char_start"), F.least(F.col("length") - (F.col("piece_no") - 1) * capacity, F.lit(capacity)).alias("length"))


OUT = "project_id string, chunk_id string, file_path string, piece_no int, char_start int, length int, bucket int, container_id long"


def pack_chunks(chunks: DataFrame, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """The container of each distinct chunk: (.., length, bucket, container_id).

    The lengths of a container add up to at most ``capacity``.  A chunk beyond the
    capacity is cut into pieces of the capacity and a rest (``piece_no``,
    ``char_start``); all other chunks stay whole.  Empty codes have length 0 and
    take the room of one character; null codes give no row.  Repeated rows count
    once, the latest wins.  Container numbers are dense from 0.
    """
    spark = chunks.sparkSession
    items = _items(chunks, capacity)
    size = F.greatest("length", F.lit(1))
    # at most ``capacity`` different lengths exist, so this is bounded
    histogram = items.groupBy(size.alias("length")).count().collect()
    ends = boundaries([r["length"] for r in histogram], [r["count"] for r in histogram], capacity, buckets)
    if not ends:
        return spark.createDataFrame([], OUT)
    per_bucket: dict[int, int] = defaultdict(int)
    for r in histogram:
        per_bucket[ends[int(np.searchsorted(ends, r["length"]))]] += r["count"]
    segments, _ = plan(per_bucket, capacity)
    firsts = {b: [np.array(x, dtype=np.int64) for x in zip(*s)] for b, s in segments.items()}
    # the bucket comes from a table of at most ``capacity`` rows, as an array in the plan
    bucket = F.element_at(F.array(*[F.lit(int(e)) for e in ends]), (F.lit(1) + sum(F.when(size > e, 1).otherwise(0) for e in ends[:-1])).cast("int")) if len(ends) <= 8 else None
    if bucket is None:
        table = np.array(ends)

        @F.pandas_udf("int")
        def bucket_of(x: pd.Series) -> pd.Series:
            return pd.Series(table[np.searchsorted(table, np.maximum(x.to_numpy(), 1))])

        bucket = bucket_of("length")
    salts = tasks(spark)
    salted = items.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("project_id", "chunk_id", "piece_no"), F.lit(salts)).cast("int"))
    local = salted.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("project_id", "chunk_id", "piece_no")) - 1)
    counts = salted.groupBy("bucket", "salt").count()
    offsets = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = local.join(offsets.drop("count"), ["bucket", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = np.zeros(len(b), dtype=np.int64)
            for bucket_, rows in b.groupby("bucket").indices.items():
                first, container, each = firsts[int(bucket_)]
                r = b["rank"].to_numpy()[rows]
                s = np.searchsorted(first, r, "right") - 1
                ids[rows] = container[s] + (r - first[s]) // each[s]
            b["container_id"] = ids
            yield b[["project_id", "chunk_id", "file_path", "piece_no", "char_start", "length", "bucket", "container_id"]]

    return ranked.mapInPandas(place, OUT)


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, containers, characters, unused space and fill, and the fewest containers possible."""
    per = packed.groupBy("container_id").agg(F.sum("length").alias("used"), F.count("*").alias("items"))
    return per.agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("used").alias("characters"), (F.count("*") * capacity - F.sum("used")).alias("unused"), F.max("used").alias("fullest"), F.ceil(F.sum("used") / capacity).alias("least_containers")).withColumn("fill", F.round(F.col("characters") / (F.col("containers") * capacity), 6))
