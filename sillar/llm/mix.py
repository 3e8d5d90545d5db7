"""Problem 9: a mixture of sources with target shares of all tokens.

Each document of a source is wanted the same fractional number of times.  The
whole part is taken as it is; the fractions are rounded by pivotal sampling in
token mass: two open documents exchange mass until one of them is at 0 or 1, so
the tokens of a group keep their sum.  Groups are sub-hashes of a source, and what
is left open in a group (one document) goes up a reduction tree, so a source may
hold any number of documents and no task sees more than a bounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.llm.encode import FOLDER, count_tokens
from sillar.sources.tables import spread

GROUP, FAN, SEED = 20_000, 500, 20_240_611


def amounts(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens to take of each source: its share of ``total``, at most ``max_repeats`` times what it has.

    total: by default what all target sources hold once.  What capped sources
    cannot give is spread over the others in proportion to their shares, as far
    as these can give it, so the mixture reaches ``total`` where that is possible
    at all.
    """
    have = {s: float(tokens.get(s, 0)) for s in targets}
    total = sum(have.values()) if total is None else float(total)
    caps = {s: have[s] * max(0, targets[s][1] or 0) for s in targets}
    total = min(total, sum(caps[s] for s in targets if targets[s][0] > 0))
    out, open_ = {s: 0.0 for s in targets}, {s for s in targets if targets[s][0] > 0 and caps[s] > 0}
    left = total
    while open_ and left > 1e-9:
        weight = sum(targets[s][0] for s in open_)
        full = {s for s in open_ if targets[s][0] / weight * left >= caps[s]}
        if not full:
            for s in open_:
                out[s] = targets[s][0] / weight * left
            break
        for s in full:
            out[s] = caps[s]
            left -= caps[s]
        open_ -= full
    return out


def pivot(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances after pivotal rounding: all 0 or 1 but for at most one, the sum of sizes x chances unchanged."""
    p = chances.copy()
    at = -1
    u = rng.random(len(p))
    for k in range(len(p)):
        if not 0 < p[k] < 1:
            continue
        if at < 0:
            at = k
            continue
        a, b = sizes[at], sizes[k]
        up = min((1 - p[at]) * a, p[k] * b)  # mass that may go from k to at
        down = min(p[at] * a, (1 - p[k]) * b)
        if u[k] * (up + down) < down:
            p[at] += up / a
            p[k] -= up / b
        else:
            p[at] -= down / a
            p[k] += down / b
        for i in (at, k):
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        at = at if 0 < p[at] < 1 else k if 0 < p[k] < 1 else -1
    return p


def _round(key, frame: pd.DataFrame) -> pd.DataFrame:
    group, source, level = (key + (0,))[:3]
    frame = frame.sort_values(["tokens", "doc_id"], kind="stable")
    rng = np.random.default_rng([SEED, int(level), abs(int(group)), *str(source).encode()])
    frame["chance"] = pivot(frame["tokens"].to_numpy(dtype=float), frame["chance"].to_numpy(dtype=float), rng)
    return frame


def clean_source(c) -> F.Column:
    """Source names as the targets have them: trimmed, lower-cased, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))), r"[\s-]+", "_")


def sized(documents: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, tokens) of every document with a text; one row per doc_id."""
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", clean_source(F.col("source")).alias("source"), "text")
    return spread(docs, "doc_id").select("doc_id", "source", count_tokens(folder=folder)("text").alias("tokens")).dropDuplicates(["doc_id"])


def mixture(documents: DataFrame, source_targets: DataFrame, total: float | None = None, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents taken at least once.

    No document is taken more often than ``max_repeats`` of its source says.
    Documents with null, empty or unlisted sources, and null or empty texts, are
    not taken; a source without documents gives nothing.  The same input gives the
    same mixture.  ``source_targets`` is a fixed table of a few rows.
    """
    spark = documents.sparkSession
    targets = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in source_targets.select("source", "target_share", "max_repeats").collect() if r.source}
    docs = sized(documents, folder).where(F.col("source").isin(*targets) if targets else F.lit(False))
    docs = _cut(docs)
    has = {r.source: (r.tokens, r.n) for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    want = amounts({s: t for s, (t, _) in has.items()}, targets, total)
    times = {s: want[s] / has[s][0] for s in has}
    per = F.create_map(*[x for s, v in times.items() for x in (F.lit(s), F.lit(v))]) if times else F.create_map(F.lit(""), F.lit(0.0))
    x = F.coalesce(F.element_at(per, F.col("source")), F.lit(0.0))
    whole = F.floor(x + 1e-9).cast("int")
    rows = docs.withColumn("base", whole).withColumn("chance", F.greatest(x - whole, F.lit(0.0)))
    groups = max(1, -(-max((n for _, n in has.values()), default=1) // GROUP))
    schema = "doc_id long, source string, tokens long, base int, chance double, grp long"
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    settled, level = [], 0
    while True:
        run = rows.withColumn("level", F.lit(level)).groupBy("grp", "source", "level").applyInPandas(lambda k, f: _round(k, f)[["doc_id", "source", "tokens", "base", "chance", "grp"]], schema)
        if groups == 1:
            settled.append(run)
            break
        run = _cut(run)
        settled.append(run.where("chance <= 0 or chance >= 1"))
        groups, level = -(-groups // FAN), level + 1
        rows = run.where("chance > 0 and chance < 1").withColumn("grp", F.floor(F.col("grp") / FAN))
    out = settled[0]
    for other in settled[1:]:
        out = out.unionByName(other)
    # the one document that is left open at the root is rounded by its hash
    last = F.when(F.col("chance") >= F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) / 1_000_000, 1).otherwise(0)
    copies = F.col("base") + F.when(F.col("chance") >= 1, 1).when(F.col("chance") <= 0, 0).otherwise(last)
    return out.select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def _cut(df: DataFrame) -> DataFrame:
    """A table that later steps read several times, written once where the session names a shared folder."""
    from sillar.sources.checkpoints import cut_lineage

    return cut_lineage(df)


def shares(mixed: DataFrame, source_targets: DataFrame) -> DataFrame:
    """Target and reached share, tokens, documents and most copies of each target source."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    out = source_targets.select("source", "target_share", "max_repeats").join(got, "source", "left").join(total)
    n = F.coalesce("mixed_tokens", F.lit(0))
    return out.select("source", "target_share", "max_repeats", n.alias("mixed_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(n / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"))
