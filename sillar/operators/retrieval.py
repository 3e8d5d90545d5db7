"""Exact nearest neighbours, hybrid re-scoring, adaptive context and call-graph expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillar.functions import predicates as P
from sillar.functions.vector import cosine_distance, norm

# How candidates are re-scored and how far a context may grow.
NAME_BONUS, CODE_BONUS, TEST_PENALTY = 0.10, 0.04, 0.08
MAX_CODE_MATCHES, MARGIN, MAX_EXTRA, MAX_EXPANSIONS = 15, 0.03, 5, 5


def knn(queries: DataFrame, rows: DataFrame, k: int, qid: str, rid: str, vector: str, on: list[str] | None = None) -> DataFrame:
    """The k nearest rows of each query by cosine distance, ties by id: (qid, rid, distance, rank).

    Queries are the smaller side; rows are scanned once, with norms computed once
    a row.  Each task keeps only its own k best of a query before the shuffle, so
    what is shuffled does not grow with the pairs.  ``on``: columns that query and
    row must share (a project).
    """
    on = on or []
    q = queries.select(F.col(qid), F.col(vector).alias("_q"), norm(F.col(vector)).alias("_qn"), *on)
    r = rows.select(F.col(rid), F.col(vector).alias("_r"), norm(F.col(vector)).alias("_rn"), *on)
    pairs = q.join(r, on) if on else q.join(r, F.lit(True))
    d = cosine_distance(F.col("_q"), F.col("_r"), F.col("_qn"), F.col("_rn"))
    scored = pairs.select(qid, F.struct(F.round(d, 9).alias("distance"), F.col(rid).alias(rid)).alias("s"), F.spark_partition_id().alias("_part"))
    local = Window.partitionBy(qid, "_part").orderBy("s")
    first = scored.withColumn("_n", F.row_number().over(local)).where(F.col("_n") <= k)
    best = Window.partitionBy(qid).orderBy("s")
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(qid, f"s.{rid}", "s.distance", "rank")


def identifier_matches(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_id, bonus): chunks named like an identifier of the question, or using a rare one.

    An identifier counts as rare when at most 15 chunks of its project contain it
    as a substring; questions about usage swap the two bonuses; the larger bonus of
    a chunk is kept.  questions: question_id, project_id, text.
    """
    ids = questions.select("question_id", "project_id", P.asks_usage(F.col("text")).alias("usage"), F.explode(P.identifiers(F.col("text"))).alias("ident"))
    distinct = ids.select("project_id", "ident").distinct()
    named = distinct.join(chunks.select("project_id", F.col("name").alias("ident"), "chunk_id"), ["project_id", "ident"]).withColumn("by", F.lit("name"))
    inside = distinct.join(chunks.select("project_id", "chunk_id", "code"), "project_id").where(F.col("code").contains(F.col("ident"))).select("project_id", "ident", "chunk_id")
    rare = inside.groupBy("project_id", "ident").count().where(F.col("count") <= MAX_CODE_MATCHES).drop("count")
    using = inside.join(rare, ["project_id", "ident"]).withColumn("by", F.lit("code"))
    hits = ids.join(named.unionByName(using), ["project_id", "ident"])
    high = (F.col("by") == "name") != F.col("usage")
    return hits.groupBy("question_id", "chunk_id").agg(F.max(F.when(high, NAME_BONUS).otherwise(CODE_BONUS)).alias("bonus"))


def hybrid(questions: DataFrame, chunks: DataFrame, top_k: int = 5) -> DataFrame:
    """Ranked candidates: semantic ones joined with identifier matches, re-scored; (question_id, chunk_id, file_path, chunk_type, name, distance, rank).

    questions: question_id, project_id, text, embedding.  Semantic search takes
    max(4k, 20) rows; a chunk found both ways keeps its exact distance less the
    bonus; test paths lie 0.08 farther unless the question is about tests.
    """
    n = max(4 * top_k, 20)
    usable = chunks.where(F.col("embedding").isNotNull())
    semantic = knn(questions.where(F.col("embedding").isNotNull()), usable, n, "question_id", "chunk_id", "embedding", ["project_id"]).select("question_id", "chunk_id", "distance")
    matched = identifier_matches(questions, chunks)
    both = semantic.join(matched, ["question_id", "chunk_id"], "full_outer")
    info = chunks.select("chunk_id", "project_id", "file_path", "chunk_type", "name", F.col("embedding").alias("_v"))
    q = questions.select("question_id", "project_id", F.col("embedding").alias("_q"), P.asks_tests(F.col("text")).alias("_tests"))
    rows = both.join(q, "question_id").join(info, ["project_id", "chunk_id"])
    exact = cosine_distance(F.col("_q"), F.col("_v"))
    score = exact - F.coalesce("bonus", F.lit(0.0)) + F.when(P.is_test(F.col("file_path")) & ~F.col("_tests"), TEST_PENALTY).otherwise(0.0)
    w = Window.partitionBy("question_id").orderBy("distance", "chunk_id")
    return rows.select("question_id", "chunk_id", "file_path", "chunk_type", "name", F.round(score, 6).alias("distance")).withColumn("rank", F.row_number().over(w))


def adaptive_cut(ranked: DataFrame, k: int = 5) -> DataFrame:
    """The first k rows, and up to five more whose distance is within 0.03 of the k-th (or last) one's."""
    w = Window.partitionBy("question_id")
    last = F.max(F.when(F.col("rank") <= k, F.struct("rank", "distance"))).over(w)["distance"]
    return ranked.withColumn("_last", last).where((F.col("rank") <= k) | ((F.col("rank") <= k + MAX_EXTRA) & (F.col("distance") <= F.col("_last") + MARGIN))).drop("_last")


def call_edges(chunks: DataFrame) -> DataFrame:
    """(project_id, chunk_id, file_path, callee, position): one row per name that a function or method calls."""
    rows = chunks.where(F.col("chunk_type").isin("function", "method"))
    return rows.select("project_id", "chunk_id", "file_path", F.posexplode(P.call_names(F.col("code"), F.col("name"))).alias("position", "callee"))


def resolve_calls(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with the one chunk they mean: the only one of that name, or the only one whose path starts with the caller's scope.

    The scope is the text of the first two path components; several matches in it
    leave a call unresolved.  Names are reduced to counts before the join, so a
    name that a third of all chunks carry does not multiply its callers.
    """
    named = chunks.where(F.col("name") != "").select("project_id", F.col("name").alias("callee"), F.col("chunk_id").alias("target"), F.col("file_path").alias("_path"))
    single = named.groupBy("project_id", "callee").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    known = edges.join(single, ["project_id", "callee"])
    one = known.where("n = 1").select("project_id", "chunk_id", "position", "callee", "target")
    # of the other names, a definition is met by every scope its path starts with: those of one component and of two cut anywhere
    many = known.where("n > 1").withColumn("scope", P.scope(F.col("file_path"))).drop("target", "n")
    scopes = many.select("project_id", "callee", "scope").distinct()
    met = scopes.join(named, ["project_id", "callee"]).where(F.expr("startswith(_path, scope)")).groupBy("project_id", "callee", "scope").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1")
    scoped = many.join(met, ["project_id", "callee", "scope"]).select("project_id", "chunk_id", "position", "callee", "target")
    return one.unionByName(scoped)


def expand(context: DataFrame, resolved: DataFrame, chunks: DataFrame, limit: int = MAX_EXPANSIONS) -> DataFrame:
    """Up to five called chunks a question: (question_id, target, callee, place), first come first served by rank and position.

    context: question_id, project_id, chunk_id, name, rank.  Names the context
    already has are left out; of several callers that resolve a name the first wins.
    """
    present = context.where(F.col("name") != "").select("question_id", F.col("name").alias("callee")).distinct()
    calls = context.select("question_id", "project_id", "chunk_id", "rank").join(resolved, ["project_id", "chunk_id"])
    new = calls.join(present, ["question_id", "callee"], "left_anti")
    first = Window.partitionBy("question_id", "callee").orderBy("rank", "position")
    once = new.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("question_id").orderBy("rank", "position")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("question_id", "target", "callee", "place")
