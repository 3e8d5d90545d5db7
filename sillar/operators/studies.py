"""Validation, duplicates and times of study results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Profiles and answers that a study may hold.
PROFILES = ["abierto", "piloto"]
CORRECT = ["si", "parcial", "no", "no_se"]
SCHEMA_VERSION, MIN_QUESTIONS = 2, 3


def json_text(s: Column) -> Column:
    """A string as JSON, letters beyond ASCII kept."""
    return F.regexp_replace(F.to_json(F.struct(s.alias("s"))), r'^\{"s":|\}$', "")


def digest(values: Column) -> Column:
    """SHA-256 of an array of strings written as JSON with ', ' between its items."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(values, json_text), ", "), F.lit("]")).cast("binary"), 256)


def problems(d: Column) -> Column:
    """What makes a result unusable, as an array; empty for a valid one."""
    q = d["questions"]
    return F.when(d.isNull(), F.array(F.lit("JSON ilegible"))).otherwise(
        F.filter(
            F.array(
                F.when(d["schema"].isNull() | (d["schema"] != SCHEMA_VERSION), F.concat(F.lit("esquema "), F.coalesce(d["schema"].cast("string"), F.lit("")), F.lit(" no soportado"))),
                F.when(~F.coalesce(d["meta"]["profile"].isin(*PROFILES), F.lit(False)), F.lit("perfil inválido")),
                F.when(~F.coalesce(F.exists(d["consents"], lambda c: (c["kind"] == "participacion") & c["accepted"]), F.lit(False)), F.lit("sin consentimiento de participación")),
                F.when(F.coalesce(F.size(q), F.lit(0)) < MIN_QUESTIONS, F.lit(f"menos de {MIN_QUESTIONS} preguntas")),
                F.when(F.exists(q, lambda x: x["rating"].isNotNull() & ~F.coalesce(x["rating"]["correct"].isin(*CORRECT), F.lit(False))), F.lit("valoración inválida")),
                F.when(F.exists(q, lambda x: (F.trim(F.coalesce(x["question"], F.lit(""))) == "") | (F.trim(F.coalesce(x["answer"], F.lit(""))) == "")), F.lit("pregunta o respuesta vacía")),
            ),
            lambda x: x.isNotNull(),
        )
    )


def vram_bucket(gpus: Column) -> Column:
    most = F.array_max(F.transform(gpus, lambda g: F.coalesce(g["vram_gb"], F.lit(0.0))))
    return F.when(gpus.isNull() | (F.size(gpus) == 0), "sin GPU / no declarada").when(most <= 6, "<=6 GB").when(most <= 8, "7-8 GB").otherwise(">8 GB")


def review(results: DataFrame) -> DataFrame:
    """(path, data, problems): repeated digests of valid results are rejected as duplicates, the first path stays."""
    r = results.withColumn("problems", problems(F.col("data")))
    d = F.col("data.integrity.sha256_of_questions")
    w = Window.partitionBy(d, F.size("problems") == 0).orderBy("path")
    return r.withColumn("_n", F.row_number().over(w)).withColumn("problems", F.when((F.size("problems") == 0) & (F.col("_n") > 1), F.array(F.lit("duplicado"))).otherwise(F.col("problems"))).drop("_n")


def times(reviewed: DataFrame) -> DataFrame:
    """Median and mean answer times of valid results by graphics memory, and over all (null)."""
    q = reviewed.where(F.size("problems") == 0).select(vram_bucket(F.col("data.hardware.gpus")).alias("bucket"), F.explode("data.questions").alias("q"))
    return q.rollup("bucket").agg(F.count("*").alias("n"), F.round(F.median("q.answer_seconds"), 2).alias("median"), F.round(F.avg("q.answer_seconds"), 2).alias("mean"))
