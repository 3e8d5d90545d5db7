"""Problem 10: the subject areas of each document.

Document vectors of a bounded labelled sample are clustered by bisecting k-means;
each leaf is described by the terms that set it apart, and takes the subject that
its labels agree on.  The leaves' terms then vote sentence by sentence, and a few
rounds of re-estimation over the sample's sentences sharpen them; the mixture of a
document's sentences gives its subjects.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.sources.tables import spread

#: bound on the labelled documents the clusters are fitted on
SAMPLE = 6000
LEAVES, ROUNDS, SEED = 48, 4, 5
#: a subject needs this share of the sentences (in code: names) that speak of any subject, a little under a quarter as some speak of two, and two sentences where there are more
SHARE, LEAST = 0.22, 2

_SPLIT = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\w{3,}")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")
_UNIT = re.compile(r"(?<=[.!?。！？;])\s+|\n+")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def|class|import|from|const|let|var|func|fn|pub|use|package|return|public|private|static|if|for|while|else|elif|try|namespace|using|#include|#define|template)\b.*[:;{(]?|\w\(.*\)|:=|=>|->|^\s*[\w.$\[\]]+\s*=\s*\S", re.I)


@lru_cache(maxsize=200_000)
def split_word(token: str) -> tuple[str, ...]:
    """The words of an identifier, case and accents gone; short ones and figures left out."""
    flat = unicodedata.normalize("NFKD", _CAMEL.sub(" ", token)).casefold()
    return tuple(w for w in _SPLIT.findall("".join(c for c in flat if not unicodedata.combining(c))) if len(w) > 2 and not w.isdigit())


def words(text: str) -> list[str]:
    """Words of a text in composed form: identifiers split, case and accents gone."""
    return [w for t in _TOKEN.findall(text) for w in split_word(t)]


def cut(text: str) -> tuple[bool, list[str]]:
    """(whether it is source code, its sentences or lines)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    code = len(lines) > 3 and sum(x.rstrip()[-1:] in ";{}" or bool(_CODE_LINE.search(x)) for x in lines) > 0.55 * len(lines)
    return code, lines if code else _UNIT.split(text)


def units(text: str) -> tuple[bool, list[list[str]]]:
    """(whether it is source code, the words of each sentence or line)."""
    code, parts = cut(text)
    return code, [w for w in map(words, parts) if w]


class Model:
    """Log-odds of terms for each subject, and the leaves they came from."""

    def __init__(self, subjects: list[str], terms: dict[str, np.ndarray], leaves: list[tuple[str, list[str], int]]):
        self.subjects, self.terms, self.leaves = subjects, terms, leaves
        self.known: dict[str, list[np.ndarray]] = {}

    def mixture(self, text: str | None) -> tuple[bool, np.ndarray, int, float]:
        """(code, sentences or names per subject, sentences that speak of any, sentences)."""
        got = np.zeros(len(self.subjects))
        if not text or not text.strip():
            return False, got, 0, 0
        code, parts = cut(text)
        known, find = self.known, _TOKEN.findall
        held, n = [], 0
        for part in parts:
            tokens = find(part)
            n += bool(tokens)
            hits = []
            for t in tokens:
                v = known.get(t)
                if v is None:
                    v = known[t] = [self.terms[w] for w in split_word(t) if w in self.terms]
                    if len(known) > 200_000:
                        known.clear()
                if v:
                    hits += v
            if hits:
                held.append((sum(hits), len(hits)))
        if not held:
            return code, got, 0, n
        scores = np.stack([x[0] for x in held])
        whole = np.exp(np.minimum(scores, 6) - 6).sum(axis=0)
        prior = np.log(whole / max(whole.sum(), 1e-9) + 0.02)
        # a shared term goes with what the document speaks of
        best = (scores + 0.7 * prior).argmax(axis=1)
        sure = scores[np.arange(len(best)), best] > min(1.0, 0.6 * math.log(len(self.subjects) + 0.01))
        weight = np.array([x[1] if code else 1 for x in held])[sure]
        np.add.at(got, best[sure], weight)
        return code, got, int(weight.sum()), n

    def assign(self, text: str | None) -> list[str]:
        _, got, said, _ = self.mixture(text)
        if not said:
            return []
        return [s for s, x in zip(self.subjects, got) if x >= SHARE * said and (x >= LEAST or said <= LEAST)]


def bisect(rows: list[dict[int, float]], dims: int, leaves: int, seed: int = SEED) -> np.ndarray:
    """Leaf of each row by bisecting k-means with cosine distance; the least coherent leaf is split next."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    x = np.zeros((n, dims), dtype=np.float32)
    for i, r in enumerate(rows):
        for j, v in r.items():
            x[i, j] = v
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    leaf = np.zeros(n, dtype=int)
    cost = {0: n - np.linalg.norm(x.sum(axis=0))}
    while len(cost) < leaves and max(cost.values()) > 1e-6:
        at = max(cost, key=cost.get)
        idx = np.nonzero(leaf == at)[0]
        best = None
        for _ in range(3):
            a = rng.integers(len(idx))
            far = idx[(x[idx] @ x[idx[a]]).argmin()]
            c = np.stack([x[idx[a]], x[far]])
            for _ in range(12):
                side = (x[idx] @ c.T).argmax(axis=1)
                new = np.stack([x[idx[side == k]].sum(axis=0) if (side == k).any() else c[k] for k in (0, 1)])
                new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
                if np.allclose(new, c, atol=1e-4):
                    break
                c = new
            parts = [idx[side == k] for k in (0, 1)]
            value = sum(len(p) - np.linalg.norm(x[p].sum(axis=0)) for p in parts)
            if min(map(len, parts)) and (best is None or value < best[0]):
                best = (value, parts)
        if best is None:
            cost[at] = 0.0
            continue
        new_id = max(cost) + 1
        leaf[best[1][1]] = new_id
        for k, p in ((at, best[1][0]), (new_id, best[1][1])):
            cost[k] = len(p) - np.linalg.norm(x[p].sum(axis=0))
    return leaf


def train(docs: list[tuple[str, list[str]]], subjects: list[str]) -> Model:
    """A model from (text, labels) pairs; labels outside ``subjects`` are ignored."""
    subjects = sorted(subjects)
    of = {s: k for k, s in enumerate(subjects)}
    parsed = [(units(t)[1], [of[x] for x in l if x in of]) for t, l in docs if t and t.strip()]
    n = len(parsed)
    if not n or not subjects:
        return Model(subjects, {}, [])
    df = Counter(w for parts, _ in parsed for w in {w for p in parts for w in p})
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, c in df.items() if c >= max(3, n // 1000) and c < 0.9 * n))}
    # how far a term's documents agree on a subject, from the labels; terms that say nothing would make clusters of style
    lab = np.zeros((n, len(subjects)))
    for i, (_, l) in enumerate(parsed):
        for k in l:
            lab[i, k] = 1 / len(l)
    counts = np.zeros((len(vocabulary), len(subjects)))
    vectors = []
    for i, (parts, _) in enumerate(parsed):
        tf = Counter(w for p in parts for w in p if w in vocabulary)
        vectors.append({vocabulary[w]: (1 + math.log(c)) * math.log(n / df[w]) for w, c in tf.items()})
        for w in tf:
            counts[vocabulary[w]] += lab[i]
    base = lab.sum(axis=0) + 1
    rate = (counts + 0.5 * base / base.sum()) / base
    total = counts.sum(axis=1)
    spike = rate.max(axis=1) / np.maximum(rate.mean(axis=1), 1e-9)
    # the least spike that chance would not give a term of so many documents
    may = (spike > np.minimum(2.2 + 4 / np.sqrt(np.maximum(total, 1)), 0.62 * len(subjects))) & (total >= 3)
    telling = np.nonzero(may)[0]
    dims = {int(j): k for k, j in enumerate(telling)}
    rows = [{dims[j]: v for j, v in r.items() if j in dims} for r in vectors]
    kept = [i for i, r in enumerate(rows) if r]
    if not kept:
        return Model(subjects, {}, [])
    leaf = bisect([rows[i] for i in kept], len(dims), min(LEAVES, max(1, len(kept) // 8)))
    names = list(vocabulary)
    # leaves: discriminative terms, and the subject their labels agree on
    members = defaultdict(list)
    for i, k in zip(kept, leaf):
        members[int(k)].append(i)
    leaves, term_score = [], np.zeros((len(vocabulary), len(subjects)))
    all_df = np.zeros(len(vocabulary))
    for i in kept:
        for j in vectors[i]:
            all_df[j] += 1
    for k, docs_in in members.items():
        inside = np.zeros(len(vocabulary))
        for i in docs_in:
            for j in vectors[i]:
                inside[j] += 1
        m = len(docs_in)
        odds = np.log((inside + 0.5) / (m + 1)) - np.log((all_df - inside + 0.5) / (len(kept) - m + 1))
        votes = lab[docs_in].sum(axis=0)
        s = int((votes / base).argmax())
        top = [int(j) for j in np.argsort(-odds * (inside > 1)) if j in dims][:12]
        leaves.append((subjects[s], [names[j] for j in top], m))
        gain = np.maximum(odds, 0) * (inside > 1)
        term_score[:, s] = np.maximum(term_score[:, s], np.minimum(gain, 4) * votes[s] / max(votes.sum(), 1e-9))
    # sentences of the sample: the leaves' terms vote first, then terms are counted again where they fell
    log = np.zeros((len(vocabulary), len(subjects)))
    log[telling] = term_score[telling]
    for rnd in range(ROUNDS):
        seen = np.zeros((len(vocabulary), len(subjects)))
        neutral = np.zeros(len(vocabulary))
        for i, (parts, own) in enumerate(parsed):
            mask = np.full(len(subjects), -2.0)
            mask[own] = 0.0
            if not own:
                mask[:] = 0.0
            for p in parts:
                ids = list({vocabulary[w] for w in p if w in vocabulary})
                if not ids:
                    continue
                s = log[ids].sum(axis=0) + mask
                top = s.max()
                q = np.exp(s - top)
                q /= q.sum()
                if top > min(0.8, 0.5 * math.log(len(subjects) + 0.01)):
                    seen[ids] += q
                else:
                    neutral[ids] += 1
        share = seen / np.maximum(seen.sum(axis=0), 1)
        back = (neutral + 1) / (neutral.sum() + len(vocabulary))
        mean = share.mean(axis=1, keepdims=True)
        new = np.log((share + 2e-5) / (mean + 2e-5))
        used = seen.sum(axis=1)
        focus = share.max(axis=1) / np.maximum(share.sum(axis=1), 1e-12)
        good = may & (used >= 3) & (focus > 0.28) & (used > 0.5 * neutral)
        log = np.where(good[:, None], new, 0.0)
    keep = np.nonzero(np.abs(log).max(axis=1) > 0.5)[0]
    return Model(subjects, {names[j]: log[j].astype(np.float64) for j in keep}, leaves)


def labelled_sample(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> list[tuple[str, list[str]]]:
    """(text, labels) of at most ``bound`` labelled documents, those with the smallest hashes."""
    clean = labels.where("doc_id is not null and subject is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject"))
    per = clean.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    chosen = per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    rows = sorted(texts.collect(), key=lambda r: (r.doc_id, r.text))
    return [(r.text, r.labels) for r in rows]


def assign_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, subjects) of every document; the empty array where it deals with none.

    Null, empty and blank texts have no subject.  Repeated rows of a document give
    one row (the longest list of subjects, then the greatest).  ``subjects`` is a
    fixed table; without labels no subject can be told.
    """
    names = [r.subject for r in subjects.where("subject is not null").select(F.lower(F.trim("subject")).alias("subject")).distinct().collect()]
    model = train(labelled_sample(documents, labels, bound), names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["subjects"] = [model.assign(t) for t in b["text"]]
            yield b[["doc_id", "subjects"]]

    rows = spread(documents.where("doc_id is not null").select("doc_id", "text"), "doc_id")
    found_ = rows.mapInPandas(run, "doc_id long, subjects array<string>")
    return found_.groupBy("doc_id").agg(F.max_by("subjects", F.struct(F.size("subjects"), F.concat_ws(",", "subjects"))).alias("subjects"))


def found(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document and subject."""
    return assign_subjects(documents, subjects, labels).select("doc_id", F.explode("subjects").alias("subject"))


def composition(assigned: DataFrame) -> DataFrame:
    """Documents per subject and their share of all documents; null stands for documents without a subject."""
    rows = assigned.select("doc_id", F.explode_outer("subjects").alias("subject"))
    return rows.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents")).join(assigned.agg(F.count("*").alias("n"))).select("subject", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))
