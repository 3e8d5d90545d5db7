"""Problem 8: encoding texts with a public byte-level BPE.

Texts beyond ``WINDOW`` characters are cut into windows that run over their end;
each is pre-tokenised on its own, and neighbours are stitched where their pre-token
boundaries must agree: after a letter, digit or mark that is followed by white
space.  The stretches between are encoded by themselves and their ids put together.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.sources.tables import spread

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
WINDOW = 200_000
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = FOLDER):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean(text: str) -> str:
    """Lone surrogates cannot be encoded; Parquet strings never hold any."""
    return text.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in text) else text


def encode_text(text: str | None, name: str = "byte_bpe_50k", folder: str = FOLDER) -> list[int]:
    return encoder(name, folder).encode_ordinary(text) if text else []


def decode(ids, name: str = "byte_bpe_50k", folder: str = FOLDER) -> bytes:
    """Raw bytes; those of stretches of a text may be put together."""
    return encoder(name, folder).decode_bytes(list(ids))


def _encode(name, folder):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["ids"] = [encode_text(t, name, folder) for t in b["_text"]]
            yield b.drop(columns="_text")

    return run


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER, window: int = WINDOW) -> DataFrame:
    """(key, ids) of every row: token ids of the text as stored, without special tokens.

    Null and empty texts give the empty list.  Names of special tokens inside a
    text are ordinary text.  Ids come from one pass over the rows; only texts of
    more than ``window`` characters are cut, spread over tasks and put together
    again.  Rows are kept as they are, repeated ones too; other columns are not
    looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    short = rows.where(F.col("_text").isNull() | (F.length("_text") <= window))
    done = short.mapInPandas(_encode(name, folder), f"`{key}` {kind}, ids array<int>")
    long = rows.where(F.length("_text") > window).withColumn("_row", F.monotonically_increasing_id())
    n = F.length("_text")
    # where a window's overrun begins anew: the first place at or after its border with a non-blank before a blank; 0 if the next window has none
    probe = lambda i: F.length(F.regexp_extract(F.col("_text").substr(i * window + 1, F.lit(window)), r"(?sU)^(.*?\S)\s", 1))
    borders = F.transform(F.sequence(F.lit(1), F.floor((n - 1) / window).cast("int")), lambda i: F.when(probe(i) > 0, i * window + probe(i)))
    long = long.withColumn("_cuts", F.concat(F.array(F.lit(0)), F.filter(borders, lambda x: x.isNotNull()), F.array(n)))
    parts = long.select(key, "_row", "_text", "_cuts", F.posexplode(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1)).alias("_part", "_from"))
    parts = parts.select(F.col(key), "_row", "_part", F.col("_text").substr(F.col("_from") + 1, F.get("_cuts", F.col("_part") + 1) - F.col("_from")).alias("_text"))
    coded = spread(parts, "_row", "_part").mapInPandas(_encode(name, folder), f"`{key}` {kind}, _row long, _part int, ids array<int>")
    whole = coded.groupBy("_row").agg(F.first(key).alias(key), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_part", "ids"))), lambda x: x["ids"])).alias("ids"))
    return done.unionByName(whole.select(key, "ids"))


def count_tokens(name: str = "byte_bpe_50k", folder: str = FOLDER):
    """A column function: tokens of a text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode_text(t, name, folder)) for t in texts], dtype="int64")

    return run
