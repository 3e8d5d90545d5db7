"""Problem 5: cutting oversized items at natural boundaries, with overlap.

Every place where a piece may end is a node; its successor is the farthest legal
end of the next piece, whose start lies the overlap before it.  Squaring the
successor table (pointer doubling) marks all ends that the greedy walk from the
start of the item reaches, in log2(pieces) vectorised rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.sources.tables import spread

#: ends of pieces from the best place to the worst: before a blank line that is followed by text at the margin, after a blank line, after a line, after a blank or a stop
_PLACES = (re.compile(r"\n[ \t\r]*\n(?=[^\s])"), re.compile(r"\n[ \t\r]*\n"), re.compile(r"\n"), re.compile(r"[\s;,.。，；、]"))
_JOINED = re.compile(r"[̀-ͯ҃-҉֑-ׇؐ-ًؚ-ٰٟऀ-ः़ा-ॏ᪰-᫿᷀-᷿⃐-⃿️︎︠-︯‍\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef\n]")


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of a text; piece k starts ``overlap`` characters before the end of k-1.

    All pieces have at most ``limit`` characters.  overlap must be below limit; a
    text within the limit is one piece, the empty text none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [n] if n else []
    step = limit - overlap
    levels = [np.array([m.end() for m in rx.finditer(text)], dtype=np.int64) for rx in _PLACES]
    levels = [x[(x > 0) & (x < n)] for x in levels]
    known = np.unique(np.concatenate([*levels, [overlap, n]]))
    # stretches without a boundary get forced ones, close enough for a legal step, not inside CRLF or a joined character
    forced = []
    edges = np.concatenate([[0], known])
    for a in edges[:-1][np.diff(edges) > step]:
        b = known[np.searchsorted(known, a, "right")]
        at = a + step
        while at < b:
            p = int(at)
            while p > a + 1 and (_JOINED.match(text, p) and (text[p] != "\n" or text[p - 1] == "\r") or text[p - 1] == "‍"):
                p -= 1
            p = p if p > a + step // 2 else int(at)
            forced.append(p)
            at = p + step
    levels.append(np.unique(np.array(forced, dtype=np.int64)))
    nodes = np.unique(np.concatenate([known, levels[-1]]))
    far = nodes + step
    chosen = np.full(len(nodes), -1, dtype=np.int64)
    chosen[far >= n] = n
    for half in (True, False):  # first any place in the farther half of the reach, then any at all
        for level in levels:
            if not len(level):
                continue
            at = np.searchsorted(level, far, "right") - 1
            found = np.where(at >= 0, level[np.maximum(at, 0)], -1)
            ok = (chosen < 0) & (found > (nodes + step // 2 if half else nodes))
            chosen[ok] = found[ok]
    jump = np.searchsorted(nodes, np.where(chosen < 0, n, chosen))
    start = int(np.searchsorted(nodes, overlap))  # a virtual end: the first piece starts at 0
    reached = np.zeros(len(nodes), dtype=bool)
    reached[start] = True
    last = len(nodes) - 1
    while True:
        new = reached.copy()
        new[jump[reached]] = True
        if (new == reached).all():
            break
        reached = new
        jump = jump[jump]
    reached[start] = start == last
    return nodes[reached].tolist()


OUT = "project_id string, chunk_id string, file_path string, piece_no int, piece_id string, code string, start_line int, end_line int, char_start int, char_end int"


def _splitter(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, chunk, path, code, first, last in zip(b["project_id"], b["chunk_id"], b["file_path"], b["code"], b["start_line"], b["end_line"]):
                begin, line, at = 0, None if pd.isna(first) else int(first), 0
                for k, end in enumerate(cuts(code, limit, overlap)):
                    if k:
                        begin = rows[-1][9] - overlap
                    lines = (None, None)
                    if line is not None:
                        line += code.count("\n", at, begin)
                        at = begin
                        stop = line + code.count("\n", begin, end - 1)
                        lines = (min(line, int(last)), min(stop, int(last))) if not pd.isna(last) else (line, stop)
                    rows.append((project, chunk, path, k + 1, f"{chunk}::P{k + 1}", code[begin:end], *lines, begin, end))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return run


def split_chunks(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of the chunks whose code has more than ``limit`` characters.

    One row per piece: consecutive, at most ``limit`` characters, each starting
    ``overlap`` characters before the end of the one before, so that the pieces
    without their overlaps give the code back.  Lines are counted from the
    chunk's ``start_line`` and never go beyond its ``end_line`` (a chunk put
    together from several places has more code lines than its range says); null
    line numbers stay null.  Repeated rows of a chunk count once, the latest
    wins; chunks within the limit, empty and null codes give no piece.
    """
    cols = ["file_path", "code", "start_line", "end_line"]
    big = chunks.where(F.length("code") > limit).select("project_id", "chunk_id", *cols, "ingested_at")
    one = big.groupBy("project_id", "chunk_id").agg(F.max_by(F.struct(*cols), F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp"))).alias("v"))
    return spread(one.select("project_id", "chunk_id", "v.*"), "project_id", "chunk_id").mapInPandas(_splitter(limit, overlap), OUT)


def oversized(pieces: DataFrame) -> DataFrame:
    """The chunks that were cut: those with a second piece."""
    return pieces.where("piece_no = 2").select("project_id", "chunk_id")


def limits(size_limits: DataFrame, purpose: str) -> tuple[int, int]:
    """(capacity, overlap) of a purpose; the table has a fixed handful of rows."""
    row = size_limits.where(F.col("purpose") == purpose).select("max_units", F.coalesce("overlap_units", F.lit(0)).alias("overlap_units")).first()
    if row is None:
        raise ValueError(f"size_limits has no purpose {purpose!r}")
    return row.max_units, row.overlap_units
