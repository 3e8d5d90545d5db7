"""Retrieval metrics, answer grading, percentiles, and the validation and analysis of study rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions.text import strip

# What a rating may say.
CORRECT = ["si", "parcial", "no", "no_se"]


def retrieval_metrics(ranks: DataFrame, rank: str = "rank", depth: int = 10) -> DataFrame:
    """Hit@1, 3, 5, 10 in percent and MRR@10 over rows that hold the rank of the first right answer, or null."""
    r = F.when(F.col(rank) <= depth, F.col(rank))
    hits = [F.round(100 * F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 1).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    return ranks.agg(F.count("*").alias("questions"), *hits, F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 3).alias("mrr_10"))


def nearest_rank(values: DataFrame, group: list[str], value: str, q: float) -> DataFrame:
    """The smallest value with at least q percent of the sample at or below it."""
    return values.groupBy(*group).agg(F.percentile_disc(value, q / 100).alias("p") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({q / 100}) within group (order by {value})").alias("p"))


def indexed_percentile(values: DataFrame, group: list[str], value: str, q: float, how: str) -> DataFrame:
    """The value at the index q percent of n-1, rounded half to even ('rounded') or down ('floor').

    Ranks come from a window over the group; only the row at the index is kept.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    rows = values.where(F.col(value).isNotNull())
    n = F.count("*").over(w)
    at = (F.bround if how == "rounded" else lambda x, _: F.floor(x))(F.lit(q / 100) * (n - 1), 0).cast("long")
    ordered = rows.withColumn("_at", at).withColumn("_rn", F.row_number().over(w.orderBy(value)) - 1)
    return ordered.where(F.col("_rn") == F.col("_at")).select(*group, F.col(value).alias("p"))


def problems() -> Column:
    """Problems of a study: consents of a study row, its question count, ratings and empty texts.

    Reads the columns questions, bad_ratings and empty_texts.
    """
    return F.filter(
        F.array(
            F.when(F.col("questions") < 3, F.lit("menos de 3 preguntas")),
            F.when(F.col("bad_ratings") > 0, F.lit("valoración inválida")),
            F.when(F.col("empty_texts") > 0, F.lit("pregunta o respuesta vacía")),
        ),
        lambda x: x.isNotNull(),
    )


def warnings() -> Column:
    """Warnings of a study: repeated questions, impossible and long times, no rating, implausible speed."""
    return F.filter(
        F.array(
            F.when(F.col("distinct_questions") < F.col("questions"), F.lit("preguntas repetidas")),
            F.when(F.col("least_seconds") <= 0.2, F.lit("tiempo de respuesta imposible (menor o igual a 0,2 s)")),
            F.when(F.col("most_seconds") > 900, F.lit("tiempo de respuesta mayor a 15 minutos")),
            F.when(F.col("ratings") == 0, F.lit("ninguna respuesta fue valorada")),
            F.when(F.col("fast") > 0, F.lit("velocidad de generación de más de 400 tokens/s: poco plausible para un modelo local de 8B")),
        ),
        lambda x: x.isNotNull(),
    )


def studies(asks: DataFrame) -> DataFrame:
    """One row per study with what validation needs."""
    rated = F.col("rating").isNotNull()
    q = F.lower(strip(F.coalesce("pregunta", F.lit(""))))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    fast = (F.col("answer_tokens") >= 50) & (F.col("answer_seconds") > 0) & (F.col("answer_tokens") / F.col("answer_seconds") > 400)
    return asks.where("study_id is not null").groupBy("study_id").agg(
        F.count("*").alias("questions"), F.countDistinct(q).alias("distinct_questions"), F.count_if(rated).alias("ratings"),
        F.count_if(rated & ~F.coalesce(F.col("rating.correct").isin(*CORRECT), F.lit(False))).alias("bad_ratings"), F.count_if(blank("pregunta") | blank("answer")).alias("empty_texts"),
        F.min("answer_seconds").alias("least_seconds"), F.max("answer_seconds").alias("most_seconds"), F.count_if(fast).alias("fast"),
    )
