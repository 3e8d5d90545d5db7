"""Queries of the ten training-data problems over a corpus folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillar.llm import credentials, encode, handwritten, mix, natural_text, pack, pairs, parse_check, split, subjects
from sillar.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.found(load(spark, d, "repo_files"), load(spark, d, "ext_languages"))


def p1_kinds(spark, d):
    files, _ = handwritten.classify(load(spark, d, "repo_files"), load(spark, d, "ext_languages"))
    return files.withColumnRenamed("path", "file_path")


def p1_validation(spark, d):
    _, figures = handwritten.classify(load(spark, d, "repo_files"), load(spark, d, "ext_languages"))
    rows = [(k, v["cases"], v["recall"], v["precision"]) for k, v in figures.items()]
    return spark.createDataFrame(rows, "kind string, held_out_cases int, recall double, precision double")


def p2_found(spark, d):
    return pairs.found(load(spark, d, "asks"))


def p2_rates(spark, d):
    flagged = pairs.flag_pairs(load(spark, d, "asks"))
    n = flagged.agg(F.count("*").alias("pairs"))
    return flagged.select(F.explode("defects").alias("defect")).groupBy("defect").count().join(n).select("defect", "count", F.round(F.col("count") / F.col("pairs"), 6).alias("rate"))


def p3_found(spark, d):
    return credentials.found(load(spark, d, "repo_files"))


def p3_redacted(spark, d):
    out = credentials.scan(load(spark, d, "repo_files"), ["project_id", "path"], "content", "path", redacted=True)
    return out.select("project_id", F.col("path").alias("file_path"), F.size("hits").alias("stretches"), "redacted")


def p3_chunks(spark, d):
    out = credentials.scan(load(spark, d, "chunks"), ["project_id", "chunk_id", "file_path"], "code", "file_path", redacted=True)
    return out.select("project_id", "chunk_id", F.size("hits").alias("stretches"), "redacted")


def _parsed(spark, d):
    return parse_check.parse_files(load(spark, d, "repo_files"), load(spark, d, "ext_languages"))


def p4_found(spark, d):
    return _parsed(spark, d).where("not valid").select("project_id", F.col("path").alias("file_path"))


def p4_errors(spark, d):
    return _parsed(spark, d).where("not valid").select("project_id", F.col("path").alias("file_path"), "language", "line", "kind")


def p4_rates(spark, d):
    return parse_check.rates(_parsed(spark, d))


def _pieces(spark, d, purpose):
    limit, overlap = split.limits(load(spark, d, "size_limits"), purpose)
    return split.split_chunks(load(spark, d, "chunks"), limit, overlap)


def p5_found(spark, d):
    return split.oversized(_pieces(spark, d, "split_chunk"))


def p5_pieces(spark, d):
    return _pieces(spark, d, "split_chunk")


def p5_small(spark, d):
    return _pieces(spark, d, "split_small")


def _packed(spark, d, purpose):
    capacity, _ = split.limits(load(spark, d, "size_limits"), purpose)
    return pack.pack_chunks(load(spark, d, "chunks"), capacity), capacity


def p6_packed(spark, d):
    return _packed(spark, d, "pack_context")[0]


def p6_small(spark, d):
    return _packed(spark, d, "pack_small")[0]


def p6_report(spark, d):
    return pack.report(*_packed(spark, d, "pack_context"))


def p7_found(spark, d):
    return natural_text.found(load(spark, d, "repo_files"), load(spark, d, "ext_languages"))


def p7_shares(spark, d):
    return natural_text.natural_text(load(spark, d, "repo_files"), load(spark, d, "ext_languages"))


def p8_ids(spark, d):
    return encode.encode_documents(load(spark, d, "documents"))


def p9_mixture(spark, d):
    return mix.mixture(load(spark, d, "documents"), load(spark, d, "source_targets"))


def p9_shares(spark, d):
    targets = load(spark, d, "source_targets")
    return mix.shares(mix.mixture(load(spark, d, "documents"), targets), targets)


def _assigned(spark, d):
    return subjects.assign_subjects(load(spark, d, "documents"), load(spark, d, "subjects"), load(spark, d, "subject_labels"))


def p10_found(spark, d):
    return _assigned(spark, d).select("doc_id", F.explode("subjects").alias("subject"))


def p10_composition(spark, d):
    return subjects.composition(_assigned(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_kinds, p1_validation, p2_found, p2_rates, p3_found, p3_redacted, p3_chunks, p4_found, p4_errors, p4_rates, p5_found, p5_pieces, p5_small,
        p6_packed, p6_small, p6_report, p7_found, p7_shares, p8_ids, p9_mixture, p9_shares, p10_found, p10_composition,
    )}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say on its own: the rest is held against brute force, round trips and held-out figures in the tests."""
    return {
        "p5_found": "SELECT DISTINCT project_id, chunk_id FROM chunks WHERE length(code) > (SELECT max_units FROM size_limits WHERE purpose = 'split_chunk')",
    }
