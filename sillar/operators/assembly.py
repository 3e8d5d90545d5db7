"""Context blocks, prompts within a window, and parts of long documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillar.functions.predicates import estimate_tokens
from sillar.operators.folds import next_fit

# Sizes in tokens and characters, and the texts around a context.
CHARS_PER_TOKEN, ANSWER_RESERVE, DOC_RESERVE, OVERVIEW_SHARE, GENERAL_TOP_K = 3.5, 1024, 1536, 0.55, 3
NO_CONTEXT = "(No se encontraron fragmentos relevantes.)"
EXPANDED = " [incluido automáticamente por grafo de llamadas]"
LANGUAGE = {"es": "IMPORTANTE: escribe tu respuesta completa en español neutro (sin modismos regionales, sin voseo).", "en": "IMPORTANT: write your entire response in English."}
CUT_NOTE = {"es": "\n\n[La respuesta alcanzó el límite de longitud y se cortó.]", "en": "\n\n[The answer reached the length limit and was cut off.]"}


def block_head(path: Column, first: Column, last: Column, kind: Column, name: Column, expanded: Column | None = None) -> Column:
    """'[path (líneas a-b)] type 'name'', without the name where there is none."""
    label = F.when(F.coalesce(name, F.lit("")) != "", F.concat(kind, F.lit(" '"), name, F.lit("'"))).otherwise(kind)
    tag = F.lit("") if expanded is None else F.when(expanded, EXPANDED).otherwise("")
    return F.concat(F.lit("["), path, F.lit(" (líneas "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")] "), label, tag)


def blocks(chunks: DataFrame) -> DataFrame:
    """chunks with the block each gives; those of chunk_type overview have no lines and no fence."""
    c = F.col
    code = F.concat(block_head(c("file_path"), c("start_line"), c("end_line"), c("chunk_type"), c("name"), c("expanded") if "expanded" in chunks.columns else None), F.lit("\n```\n"), c("code"), F.lit("\n```"))
    return chunks.withColumn("block", F.when(c("chunk_type") == "overview", F.concat(F.lit("["), c("file_path"), F.lit("]\n"), c("code"))).otherwise(code))


def prompts(questions: DataFrame, context: DataFrame, system: str, num_ctx: int = 8192, language: str = "es") -> DataFrame:
    """(question_id, system, prompt, used): blocks by rank as far as they fit the window; too large ones are skipped.

    questions: question_id, question.  context: question_id, rank, block.  A
    question without a block gets the sentence that says so.  The fold carries
    ranks and sums; texts are joined to the kept ranks afterwards.
    """
    head = LANGUAGE.get(language, LANGUAGE["es"]) + "\n\n" + system
    frame = lambda body: F.concat(F.lit("CONTEXTO:\n\n"), body, F.lit("\n\n---\n\nPREGUNTA: "), F.col("question"), F.lit("\n\nResponde siguiendo las reglas del sistema."))
    q = questions.select("question_id", "question", (estimate_tokens(F.lit(head)) + estimate_tokens(frame(F.lit(NO_CONTEXT)))).alias("_base"))
    budget = num_ctx - ANSWER_RESERVE
    costs = context.select("question_id", "rank", (estimate_tokens(F.col("block")) + 1).alias("cost"))
    items = costs.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cost"))).alias("items")).join(q, "question_id")
    fold = F.aggregate(
        "items",
        F.struct(F.col("_base").alias("used"), F.array().cast("array<int>").alias("kept")),
        lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.array_append(s["kept"], x["rank"].cast("int")).alias("kept"))).otherwise(s),
    )
    kept = items.select("question_id", fold["used"].alias("used"), F.explode_outer(fold["kept"]).alias("rank"))
    texts = kept.join(context.select("question_id", F.col("rank").cast("int").alias("rank"), "block"), ["question_id", "rank"], "left")
    body = texts.groupBy("question_id").agg(F.max("used").alias("used"), F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("rank", "block")))).alias("b"))
    full = q.join(body, "question_id", "left")
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return full.select("question_id", F.lit(head).alias("system"), frame(F.when(F.coalesce(F.size("b"), F.lit(0)) > 0, text).otherwise(NO_CONTEXT)).alias("prompt"), F.coalesce("used", "_base").alias("used"))


def document_parts(blocks_: DataFrame, group: list[str], order: str, budget: int) -> DataFrame:
    """(group, part, text): blocks grouped next-fit; one above the budget is cut to it with a mark."""
    mark = "\n[... recortado]"
    cut = F.when(F.length("block") > budget, F.concat(F.substring("block", 1, budget - 60), F.lit(mark))).otherwise(F.col("block"))
    rows = blocks_.withColumn("block", cut)
    parts = next_fit(rows.withColumn("_n", F.length("block")), group, order, "_n", budget)
    joined = rows.join(parts, [*group, order])
    return joined.groupBy(*group, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda x: x["block"]), "\n\n").alias("text"))


def rerank(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """Candidates (question_id, rank, ..) with new_rank: numbers that a model named first, once each and in range, the rest as before.

    order: question_id, place, number.
    """
    named = order.join(candidates.groupBy("question_id").agg(F.max("rank").alias("_most")), "question_id").where("number between 1 and _most").groupBy("question_id", F.col("number").alias("rank")).agg(F.min("place").alias("_place"))
    from pyspark.sql import Window

    joined = candidates.join(named, ["question_id", "rank"], "left")
    return joined.withColumn("new_rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("_place").isNull(), "_place", "rank"))).drop("_place")
