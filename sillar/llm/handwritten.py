"""Problem 1: generated, minified, vendored and data files among source code.

Four linear support-vector classifiers (one for each kind) on hashed character
n-grams, path components and layout, trained here on files that give themselves
away (a tool's or library's notice at their head, text that is packed or data);
the notice itself is masked, so what is learned holds for files without one.
Validation splits by repository.  How much of a file is found in other
repositories comes from a bottom-k sketch of its five-word shingles, held against all of theirs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.sources.checkpoints import cut_lineage
from sillar.sources.tables import extension, spread

KINDS = ("generated", "minified", "vendored", "data")
DIMS, SKETCH, SHINGLE = 1 << 14, 64, 5
#: bound on the labelled sample a classifier is fitted on, per label
SAMPLE = 600
#: rounds of relabelling, and the margin from which a file without a notice joins the kind it looks like
ROUNDS, RELABEL = 3, -0.25
#: margin from which a file counts; below 0 for kinds whose training labels lack many cases without a notice, which pushes margins down
THRESHOLDS = {"generated": -0.4, "minified": 0.0, "vendored": 0.4, "data": -0.4}

# How a tool's or a library's notice at the head of a file begins.
NOTICE = re.compile(
    r"@generated|<auto-?generated|auto-?generated (?:file|code|by|from)|autogenerated|(?:code|file|source) (?:was )?(?:auto(?:matically)?[- ])?(?:generated|produced|created|written) (?:automatically )?(?:by|from|with)|^\W*generated (?:from|by|with|using) \S+|produced automatically by|do not (?:edit|modify)|changes will be (?:lost|overwritten)"
    r"|generad[oa] autom[aá]ticamente|generad[oa] por (?:el|la|una?)?|no (?:editar|modificar)|gerado automaticamente|n[aã]o (?:editar|modificar)|ne pas modifier|(?:cr[eé][eé]|g[eé]n[eé]r[eé]) (?:automatiquement|par)|automatisch (?:erzeugt|generiert)|nicht (?:bearbeiten|[aä]ndern)", re.I)  # fmt: skip
BANNER = re.compile(r"^\s*(?:<\?php\s*)?(?:/\*!|//!|\#!?)?[^\n]*\bv\d+\.\d+(?:\.\d+)?\b[^\n]*(?:\n[^\n]*){0,3}?(?:licen[cs]e|redistribut|copy(?:ing)? |permi(?:ssive|tted)|maintained by|contributors)|@(?:license|preserve|version)\b", re.I)

_HEAD = re.compile(r"\A(?:\s*(?:#![^\n]*\n|<\?php\b|//[^\n]*\n?|\#(?!\s*(?:include|define|if|pragma|region))[^\n]*\n?|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''))*")
_BYTE_WORD = re.compile(rb"[\w\x80-\xff]+")
_DATA_LINE = re.compile(r"""^[\s"'`(\[{.+]*(?:[A-Za-z0-9+/=_\\-]{40,}["'`)\]};,.+\s]*|(?:["'\w-]+\s*:\s*)?[\[{(]?\s*(?:[-+]?(?:0x)?[\da-fA-F.]+(?:[\s,\]})]+|(?=[;,]?\s*$))){3,}[;,]?|(?:\\x[\da-f]{2})+["',;]*)\s*$""")


def head(text: str) -> str:
    """The comments a file begins with."""
    m = _HEAD.match(text)
    return m[0] if m else ""


#: without one of these no line holds a notice; looked up before the pattern, which is slow on whole texts
_STEMS = ("generat", "generad", "gerado", "generier", "produced", "do not", "changes will", "editar", "modific", "modifi", "erzeugt", "bearbeiten", "ndern", "cré", "cree", "géné", "gene", "created", "written")


def masked(text: str) -> str:
    """The text without its head and without lines that hold a notice."""
    body = text[len(head(text)) :]
    low = body.lower()
    if not any(x in low for x in _STEMS):
        return body
    return "\n".join(x for x in body.split("\n") if not (any(k in x.lower() for k in _STEMS) and NOTICE.search(x)))


_ATOM = re.compile(rb"w+")
_AS_ATOM = bytes(119 if chr(c).isalnum() or c == 95 or c > 127 else c for c in range(256))


def layout(body: str) -> dict[str, float]:
    lines = body.split("\n")
    n = max(1, len(body))
    filled = [x for x in lines if x.strip()]
    longest = max(map(len, lines), default=0)
    data = sum(len(x) for x in filled if _DATA_LINE.match(x)) / n
    shapes = [x for x in map(bytes.strip, _ATOM.sub(b"w", body.encode("utf-8", "replace").translate(_AS_ATOM)).split(b"\n")) if x]
    return {
        "mean": n / max(1, len(lines)),
        "longest": longest,
        "blank": sum(map(body.count, " \n\t\r")) / n,
        "digits": sum(map(body.count, "0123456789")) / n,
        "data": data,
        "repeat": 1 - len(set(shapes)) / max(1, len(shapes)),
        "lines": len(filled),
    }


def give_away(text: str, lay: dict[str, float]) -> str:
    """The kind a file shows by itself, or '' ; only for training."""
    top = head(text)[:2000]
    if BANNER.search(top):
        return "vendored"
    if NOTICE.search(top):
        return "generated"
    if lay["data"] > 0.6 and lay["lines"] > 3:
        return "data"
    if lay["mean"] > 110 and lay["blank"] < 0.08 and lay["digits"] < 0.4:
        return "minified"
    return ""


def _bucket(x: float, edges) -> int:
    return int(np.searchsorted(edges, x))


_EDGES = {"mean": (15, 25, 40, 60, 110, 200), "longest": (80, 120, 200, 400, 1000), "blank": (0.03, 0.08, 0.15, 0.25, 0.4), "digits": (0.02, 0.06, 0.12, 0.25, 0.4), "data": (0.05, 0.2, 0.4, 0.6, 0.8), "repeat": (0.2, 0.4, 0.55, 0.7, 0.85), "lines": (3, 10, 30, 100, 400)}


_FOLD = bytes(48 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else c for c in range(256))


def features(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values) of a file: character n-grams of its masked text, path components, layout."""
    body = masked(text)
    raw = np.frombuffer(body.encode("utf-8", "replace").translate(_FOLD), dtype=np.uint8).astype(np.uint32)
    parts = []
    for n in (4, 6):
        if len(raw) >= n:
            h = np.zeros(len(raw) - n + 1, dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(16777619) ^ raw[k : len(raw) - n + 1 + k]
            parts.append((h * np.uint32(2654435761)) >> np.uint32(32 - 13))
    idx, val = np.zeros(0, dtype=np.int64), np.zeros(0)
    if parts:
        counts = np.bincount(np.concatenate(parts), minlength=DIMS // 2)
        idx = np.nonzero(counts)[0]
        val = 1 + np.log(counts[idx])
        val /= math.sqrt((val * val).sum())
    lay = layout(body)
    words = [f"{k}={_bucket(v, _EDGES[k])}" for k, v in lay.items()]
    comps = [re.sub(r"\d+", "0", c.lower()) for c in re.split(r"[/\\]", path)]
    words += [f"dir={re.split(r'[-_.@]', c)[0]}" for c in comps[:-1]] + [f"in={c}" for c in comps[:-1]]
    words += [f"ext={'.'.join(comps[-1].split('.')[1:])[-8:]}"] + [f"name={w}" for w in re.split(r"[-_.]", comps[-1])]
    extra = np.array([DIMS // 2 + zlib.crc32(w.encode()) % (DIMS // 2) for w in words], dtype=np.int64)
    weight = np.array([0.3 if not w.startswith(("dir", "in=", "name", "ext")) else 0.2 for w in words])
    return np.concatenate([idx, extra]), np.concatenate([val, weight])


def shingles(body: str) -> np.ndarray:
    """The hashes of a masked text's five-word shingles, ascending: the first ``SKETCH`` are its sketch."""
    crc = zlib.crc32
    w = np.array([crc(x) for x in _BYTE_WORD.findall(body.encode("utf-8", "replace"))], dtype=np.uint64)
    if len(w) < SHINGLE:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(len(w) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h ^ w[k : len(w) - SHINGLE + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h >> np.uint64(1)).astype(np.int64)


class Svm:
    """Linear classifiers by stochastic subgradients of the hinge loss, averaged."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def margins(self, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        return self.weights[:, idx] @ val + self.bias

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 12, rate: float = 0.5, decay: float = 2e-4, seed: int = 3) -> "Svm":
        rng = np.random.default_rng(seed)
        y = np.array([[1.0 if x == k else -1.0 for k in KINDS] for x in labels])
        share = (y > 0).mean(axis=0)
        cost = np.where(y > 0, np.sqrt((1 - share) / np.maximum(share, 1e-6)).clip(1, 6), 1.0)
        w, b = np.zeros((len(KINDS), DIMS)), np.zeros(len(KINDS))
        sw, sb, t = np.zeros_like(w), np.zeros_like(b), 0
        scale = 1.0
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for i in rng.permutation(len(rows)):
                idx, val = rows[i]
                m = (w[:, idx] @ val) * scale + b
                scale *= 1 - step * decay
                g = np.where(y[i] * m < 1, y[i] * cost[i], 0.0) * step
                hit = np.nonzero(g)[0]
                if len(hit):
                    for k in hit:
                        np.add.at(w[k], idx, g[k] / scale * val)
                    b += g * 0.1
            if epoch >= epochs // 2:
                sw += w * scale
                sb += b
                t += 1
        return Svm(sw / t, sb / t)


DUP_EDGES = (0.15, 0.35, 0.55, 0.8)


def with_overlap(idx, val, overlap: float):
    """The features with the overlap's bucket."""
    k = DIMS // 2 + zlib.crc32(f"overlap={_bucket(overlap, DUP_EDGES)}".encode()) % (DIMS // 2)
    return np.append(idx, idx.dtype.type(k)), np.append(val, val.dtype.type(0.6))


_KEYS = ["project_id", "path"]


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [t.removeprefix("﻿") for t in b["content"]]
        bodies = [masked(t) for t in texts]
        b["shown"] = [give_away(t, layout(m)) for t, m in zip(texts, bodies)]
        b["shingles"] = [shingles(m) for m in bodies]
        yield b[[*_KEYS, "ingested_at", "shown", "shingles"]]


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        both = [features(t.removeprefix("﻿"), p) for t, p in zip(b["content"], b["path"])]
        b["idx"] = [x[0].astype(np.int16).tobytes() for x in both]
        b["val"] = [x[1].astype(np.float16).tobytes() for x in both]
        yield b[[*_KEYS, "shown", "overlap", "idx", "val"]]


def _sources(files: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """The source files with a text."""
    known = ext_languages.select(F.lower("ext").alias("_ext")).distinct()
    rows = files.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select(*_KEYS, "content", "ingested_at", extension(F.col("path")).alias("_ext"))
    return rows.join(known, "_ext").drop("_ext")


def _latest():
    return F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp"))


def overlaps(surveyed: DataFrame) -> DataFrame:
    """(project_id, path, shown, overlap): the share of a file's sketch that other repositories' files hold anywhere.

    The sketch is met by all shingles of the others, so a file counts as copied
    whatever the size of the file that holds it.  Hashes are first reduced to their least and greatest repository, so a hash
    that a third of all files hold costs one row a task.
    """
    sketch = F.slice("shingles", 1, SKETCH)
    hashes = surveyed.select(*_KEYS, F.explode(sketch).alias("h"))
    shared = surveyed.select("project_id", F.explode("shingles").alias("h")).groupBy("h").agg(F.min("project_id").alias("a"), F.max("project_id").alias("b")).where("a <> b").select("h")
    hits = hashes.join(shared, "h").groupBy(*_KEYS).agg(F.count("*").alias("hits"))
    joined = surveyed.join(hits.withColumnsRenamed({"project_id": "_p", "path": "_f"}), F.col("project_id").eqNullSafe(F.col("_p")) & (F.col("path") == F.col("_f")), "left")
    return joined.select(*_KEYS, "shown", (F.coalesce("hits", F.lit(0)) / F.greatest(F.size(sketch), F.lit(1))).alias("overlap"))


def fit(files: DataFrame, known: DataFrame, sample: int = SAMPLE) -> tuple[Svm, dict]:
    """Classifiers and their figures on held-out repositories.

    At most ``sample`` files of each kind that give themselves away and three
    times as many others, those with the smallest hashes, so that the sample does
    not depend on the order of rows.
    """
    # about twice the wanted number by a hash threshold from exact counts, then the smallest hashes: no sort of all files
    counts = {r.shown: r.n for r in known.groupBy("shown").agg(F.count("*").alias("n")).collect()}
    h = F.pmod(F.xxhash64(*_KEYS), F.lit(1 << 30))
    wanted = {k: (3 * sample if not k else sample) for k in counts}
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.0 * wanted[k] / max(1, n)) * (1 << 30)))])
    chosen = known.where(h < F.element_at(limit, F.col("shown"))) if counts else known
    texts = files.select(*_KEYS, "content").join(F.broadcast(chosen), _KEYS)  # at most about seven samples of short rows
    rows = texts.mapInPandas(_featurise, "project_id string, path string, shown string, overlap double, idx binary, val binary").toPandas()
    rows = rows.drop_duplicates(_KEYS).sort_values(_KEYS, kind="stable")
    x = [with_overlap(np.frombuffer(i, dtype=np.int16).astype(np.int32), np.frombuffer(v, dtype=np.float16).astype(np.float32), o) for i, v, o in zip(rows["idx"], rows["val"], rows["overlap"])]
    y = rows["shown"].tolist()
    if not y:
        return Svm(np.zeros((len(KINDS), DIMS)), np.full(len(KINDS), -1.0)), {}
    held = np.array([zlib.crc32(str(p).encode()) % 5 == 0 for p in rows["project_id"]])
    train = [i for i in range(len(y)) if not held[i]] or list(range(len(y)))
    first = Svm.fit([x[i] for i in train], [y[i] for i in train])
    figures = {}
    for k, kind in enumerate(KINDS):
        m = np.array([first.margins(*x[i])[k] > 0 for i in range(len(y)) if held[i]], dtype=bool)
        t = np.array([y[i] == kind for i in range(len(y)) if held[i]], dtype=bool)
        figures[kind] = {"cases": int(t.sum()), "recall": float(m[t].mean()) if t.any() else None, "precision": float(t[m].mean()) if m.any() else None}
    # files without a notice that look like those with one were labelled as others: relabel and fit again, on all repositories
    last = first
    for _ in range(ROUNDS):
        again = []
        for xi, yi in zip(x, y):
            m = last.margins(*xi)
            again.append(KINDS[int(m.argmax())] if not yi and m.max() > RELABEL else yi)
        last = Svm.fit(x, again)
    return last, figures


def _score(svm: Svm):
    shift = {k: svm.weights[:, DIMS // 2 + zlib.crc32(f"overlap={k}".encode()) % (DIMS // 2)] * 0.6 for k in range(len(DUP_EDGES) + 1)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["margins"] = [svm.margins(*features(t.removeprefix("﻿"), p)).tolist() for t, p in zip(b["content"], b["path"])]
            yield b[[*_KEYS, "ingested_at", "margins"]]

    return run, shift


def classify(files: DataFrame, ext_languages: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """((project_id, path, kind, margin, overlap) of every source file, figures on held-out repositories).

    kind: the one with the largest margin over its threshold, '' for hand-written
    files (none above its threshold; margins are given relative to it).  Repeated rows of a file count once, the latest wins; null contents
    and paths and other extensions give no row; a file with an empty text is
    hand-written unless its path says otherwise by itself.
    """
    source = _sources(files, ext_languages)
    rows = spread(source, *_KEYS)
    surveyed = rows.mapInPandas(_survey, "project_id string, path string, ingested_at timestamp, shown string, shingles array<long>")
    surveyed = cut_lineage(surveyed.groupBy(*_KEYS).agg(F.max_by(F.struct("shown", "shingles"), _latest()).alias("v")).select(*_KEYS, "v.*"))
    known = cut_lineage(overlaps(surveyed))
    svm, figures = fit(source, known, sample)  # few rows pass the join, so their texts need no shuffle
    run, shift = _score(svm)
    scored = rows.mapInPandas(run, "project_id string, path string, ingested_at timestamp, margins array<double>")
    scored = scored.groupBy(*_KEYS).agg(F.max_by("margins", _latest()).alias("margins"))
    bucket = sum(F.when(F.col("overlap") > e, 1).otherwise(0) for e in DUP_EDGES)
    shifts = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in shift[k]]) for k in range(len(DUP_EDGES) + 1)]), (bucket + 1).cast("int"))
    both = scored.join(known.select(F.col("project_id").alias("_p"), F.col("path").alias("_f"), "overlap"), F.col("project_id").eqNullSafe(F.col("_p")) & (F.col("path") == F.col("_f"))).drop("_p", "_f")
    least = F.array(*[F.lit(THRESHOLDS[k]) for k in KINDS])
    both = both.withColumn("margins", F.zip_with(F.zip_with("margins", shifts, lambda a, b: a + b), least, lambda a, b: a - b)).withColumn("margin", F.array_max("margins"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    kind = F.when(F.col("margin") > 0, F.element_at(kinds, F.array_position("margins", F.col("margin")).cast("int"))).otherwise("")
    return both.select(*_KEYS, kind.alias("kind"), F.round("margin", 6).alias("margin"), F.round("overlap", 6).alias("overlap")), figures


def found(files: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """The files that are not hand-written."""
    return classify(files, ext_languages)[0].where("kind <> ''").select("project_id", F.col("path").alias("file_path"))
