"""Problem 4: source files that are no valid source in their language.

Every file's text is lexed and run through the SLR(1) tables of its language's
bundled grammar, following all readings of a conflict at once; the first token
that no reading accepts is reported.  One pass over the files, no shuffle of
verdicts beyond one row a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.llm.syntax.glr import compile_grammar, recognise
from sillar.llm.syntax.grammars import GRAMMARS
from sillar.llm.syntax.lexers import BAD, LEXERS, variants
from sillar.sources.tables import extension, latest, spread

VERDICT = "project_id string, path string, language string, ingested_at timestamp, verdict struct<valid:boolean,line:int,kind:string>"


@lru_cache(maxsize=None)
def tables(language: str):
    return compile_grammar(GRAMMARS[language])


def first_error(text: str, language: str) -> tuple[int, str] | None:
    """(1-based line, kind) of the first unrecoverable error, or None for a valid text.

    kind: ``lexical`` where no token begins, ``end`` where the text stops too
    soon, ``merge`` at a merge mark, else ``syntax``.  A leading byte-order mark
    is skipped; an empty text is valid except in Go and Java-like grammars that
    ask for something.  Of conditional compilation every branch is parsed, each in
    a text of its own (``variants``); the first line with an error counts.
    """
    errors = [e for t in variants(text.removeprefix("﻿"), language) if (e := _error(t, language))]
    return min(errors, default=None)


def _error(text: str, language: str) -> tuple[int, str] | None:
    t = tables(language)
    tokens, offsets, breaks = LEXERS[language](text, t.terms)
    insert = None
    if breaks is not None:
        semi, close = t.terms[";"], t.terms["}"]
        insert = lambda i: semi if i >= len(tokens) or i in breaks or tokens[i] == close else None
    at = recognise(t, tokens, insert)
    if at is None:
        return None
    end = at >= len(tokens) or offsets[at] >= len(text)
    offset = len(text) if end else offsets[at]
    line = text.count("\n", 0, offset) + 1
    begin = text.rfind("\n", 0, offset) + 1
    if text.startswith(("<<<<<<<", "=======", ">>>>>>>", "|||||||"), begin):
        return line, "merge"
    return line, "end" if end else "lexical" if tokens[at] == BAD else "syntax"


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [first_error(text, language) for text, language in zip(b["content"], b["language"])]
        b["verdict"] = [{"valid": e is None, "line": e and e[0], "kind": e and e[1]} for e in out]
        yield b[["project_id", "path", "language", "ingested_at", "verdict"]]


def parse_files(files: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """(project_id, path, language, valid, line, kind) of each file with a source extension.

    Repeated rows of a file give one row, by the latest ``ingested_at``.  Null
    content, null paths and other extensions give no row; a null project is kept
    as such.  Other columns of the inputs are not looked at.
    """
    known = ext_languages.select(F.lower("ext").alias("_ext"), F.col("language")).where(F.col("language").isin(*GRAMMARS)).dropDuplicates(["_ext"])
    rows = files.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select("project_id", "path", "content", "ingested_at", extension(F.col("path")).alias("_ext"))
    rows = rows.join(known, "_ext").select("project_id", "path", "language", "content", "ingested_at")
    checked = spread(rows, "project_id", "path").mapInPandas(_check, VERDICT)
    return latest(checked, ["project_id", "path", "language"], "verdict").select("project_id", "path", "language", "verdict.valid", "verdict.line", "verdict.kind")


def rates(parsed: DataFrame) -> DataFrame:
    """Files, invalid files and their share per project and language, with totals (nulls stand for all)."""
    return parsed.rollup("project_id", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
