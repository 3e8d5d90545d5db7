"""Queries of the engine's own operators over the tables of a corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillar.functions import predicates as P
from sillar.functions import text as T
from sillar.functions.vector import cosine_distance
from sillar.operators import assembly, changes, evaluation, folds, monitor, retrieval, rollup
from sillar.plans import corpus
from sillar.sources.tables import load

KEY = ["project_id", "chunk_id"]


# --- paths, names, questions -------------------------------------------------


def file_languages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files(spark, d).select("project_id", "path", P.language(F.col("path")).alias("language"))


def path_filters(spark, d):
    f = corpus.files(spark, d)
    return f.groupBy("project_id").agg(F.count("*").alias("files"), F.count_if(P.is_indexable(F.col("path"))).alias("indexable"), F.count_if(P.is_generated(F.col("path"))).alias("generated"), F.count_if(P.is_test(F.col("path"))).alias("tests"))


def question_identifiers(spark, d):
    return corpus.asks(spark, d).select("ask_id", F.posexplode(P.identifiers(F.col("pregunta"))).alias("place", "identifier"))


def question_kinds(spark, d):
    q = F.col("pregunta")
    return corpus.asks(spark, d).select("ask_id", P.asks_tests(q).alias("about_tests"), P.asks_usage(q).alias("about_usage"), P.is_general(q).alias("general"))


def source_lines(spark, d):
    s = corpus.asks(spark, d).select("ask_id", F.posexplode("sources").alias("place", "s"))
    path = F.replace(F.coalesce("s.file", F.lit("")), F.lit("\\"), F.lit("/"))
    clean = F.when(path.startswith("/") | path.rlike("^.:"), F.element_at(F.split(path, "/"), -1)).otherwise(path)
    return s.select("ask_id", "place", clean.alias("file"), F.coalesce("s.lines", F.lit("")).alias("lines"))


def embedding_texts(spark, d):
    t = F.concat("file_path", F.lit("\n\n"), "code")
    return corpus.chunks(spark, d).select(*KEY, F.length(t).alias("length"), F.md5(t.cast("binary")).alias("digest"))


def context_blocks(spark, d):
    c = corpus.chunks(spark, d)
    head = assembly.block_head(*[F.col(x) for x in ("file_path", "start_line", "end_line", "chunk_type", "name")])
    return c.select(*KEY, head.alias("head"), F.length(F.concat(head, F.lit("\n```\n"), "code", F.lit("\n```"))).alias("length"))


def component_index(spark, d):
    """Every component of a file once: the pieces of a split chunk count as their parent."""
    c = corpus.chunks(spark, d).withColumn("component", F.coalesce("split_of", "chunk_id"))
    w = Window.partitionBy("project_id", "component").orderBy("chunk_id")
    return c.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("project_id", "file_path", "component", "chunk_type", "start_line", "end_line")


def chunk_counts(spark, d):
    c = corpus.chunks(spark, d)
    return c.groupBy("project_id").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.count_if(P.is_generated(F.col("file_path"))).alias("generated"))


def repeated_ids(spark, d):
    """Ids of chunks whose rows came more than once, with how often."""
    return load(spark, d, "chunks").groupBy(*KEY).agg(F.count("*").alias("rows")).where("rows > 1")


# --- vectors and retrieval ---------------------------------------------------


def _vectors(spark, d):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return q, e


def knn_top20(spark, d):
    q, e = _vectors(spark, d)
    return retrieval.knn(q, e, 20, "query_id", "vec_id", "embedding").select("query_id", "vec_id", (F.round("distance", 5) + F.lit(0.0)).alias("distance"))


def knn_metrics(spark, d):
    """Hit@k and MRR@10 when a neighbour of the same label, other than itself, is right."""
    q, e = _vectors(spark, d)
    near = retrieval.knn(q, e, 11, "query_id", "vec_id", "embedding").where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("place", F.row_number().over(w)).where("place <= 10")
    lab = e.select("vec_id", "label")
    right = near.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id").where("label = wanted")
    first = q.select("query_id").join(right.groupBy("query_id").agg(F.min("place").alias("rank")), "query_id", "left")
    return evaluation.retrieval_metrics(first)


def distance_guards(spark, d):
    """Distances to a zero, a short, a null and the own vector."""
    e = load(spark, d, "embeddings").where("vec_id % 20 = 0")
    v = F.col("embedding")
    zero = F.transform(v, lambda x: F.lit(0.0).cast("float"))
    dist = lambda b: F.round(cosine_distance(v, b), 6)
    return e.select("vec_id", dist(zero).alias("to_zero"), dist(F.slice(v, 1, 3)).alias("to_short"), dist(F.lit(None).cast("array<float>")).alias("to_null"), dist(v).alias("to_self"))


def _questions(spark, d):
    """Questions whose ask_id is divisible by 20, with the vector of their project's first chunk that has one."""
    c = corpus.chunks(spark, d).where(F.size("embedding") == 8)
    probe = c.groupBy("project_id").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    return corpus.asks(spark, d).where("ask_id % 20 = 0").select(F.col("ask_id").alias("question_id"), "project_id", F.col("pregunta").alias("text")).join(probe, "project_id")


def hybrid_retrieval(spark, d):
    ranked = retrieval.hybrid(_questions(spark, d), corpus.chunks(spark, d))
    return ranked.select("question_id", "chunk_id", (F.col("distance") + F.lit(0.0)).alias("distance"))


def adaptive_context(spark, d):
    ranked = retrieval.hybrid(_questions(spark, d), corpus.chunks(spark, d))
    return retrieval.adaptive_cut(ranked).select("question_id", "chunk_id", "file_path", (F.col("distance") + F.lit(0.0)).alias("distance"))


def identifier_matches(spark, d):
    return retrieval.identifier_matches(_questions(spark, d), corpus.chunks(spark, d))


def named_chunks(spark, d):
    """Chunks by the exact name that a question gives."""
    ids = corpus.asks(spark, d).select("ask_id", "project_id", F.explode(P.identifiers(F.col("pregunta"))).alias("name"))
    c = corpus.chunks(spark, d).where("name <> ''")
    return ids.join(c.select("project_id", "name", "chunk_id"), ["project_id", "name"]).select("ask_id", "name", "chunk_id").distinct()


# --- call graph ----------------------------------------------------------------


def call_edges(spark, d):
    return retrieval.call_edges(corpus.chunks(spark, d)).drop("file_path")


def call_resolution(spark, d):
    c = corpus.chunks(spark, d)
    return retrieval.resolve_calls(retrieval.call_edges(c), c).select("project_id", "chunk_id", "callee", "target")


def call_expansion(spark, d):
    """Called chunks of each file's functions, taken as one context in the order of their lines."""
    c = corpus.chunks(spark, d)
    w = Window.partitionBy("project_id", "file_path").orderBy("start_line", "chunk_id")
    context = c.withColumn("question_id", F.concat_ws("//", "project_id", "file_path")).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("question_id", "project_id", "chunk_id", "name", "rank")
    return retrieval.expand(context, retrieval.resolve_calls(retrieval.call_edges(c), c), c)


# --- budgets, windows, text ------------------------------------------------------


def token_estimates(spark, d):
    return corpus.documents(spark, d).select("doc_id", P.estimate_tokens(F.col("text")).alias("tokens"))


def _costs(spark, d):
    c = corpus.chunks(spark, d).where("split_of is null")
    return c.select("project_id", "file_path", "chunk_id", "start_line", (P.estimate_tokens(F.col("code")) + 1).alias("cost"), F.length("code").alias("chars"))


def budget_skip_fit(spark, d):
    return folds.skip_fit(_costs(spark, d), ["project_id", "file_path"], "chunk_id", "cost", 600)


def next_fit_groups(spark, d):
    return folds.next_fit(_costs(spark, d), ["project_id", "file_path"], "chunk_id", "chars", 2000)


def prefix_cut(spark, d):
    return folds.prefix_cut(_costs(spark, d), ["project_id", "file_path"], ["start_line", "chunk_id"], "chars", 2000).select("project_id", "chunk_id", "used")


def fallback_windows(spark, d):
    """Line windows of every document's text."""
    rows = corpus.documents(spark, d).where("text is not null").select("doc_id", F.explode(folds.line_windows("text")).alias("w"))
    return rows.select("doc_id", "w.*")


def purposes(spark, d):
    return corpus.documents(spark, d).where("source = 'generated_docs' and text is not null").select("doc_id", F.md5(T.purpose(F.col("text")).cast("binary")).alias("purpose"), F.md5(T.shorten(T.purpose(F.col("text")), 70).cast("binary")).alias("short"))


def preambles(spark, d):
    """Answers without a courtesy line; the heading step is left out, as in question answering."""
    return corpus.asks(spark, d).where("answer is not null").select("ask_id", F.length(T.strip_preamble(F.concat(F.lit("Aquí está la respuesta:\n\n"), "answer"), None)).alias("length"), F.length(T.collapse(F.col("answer"))).alias("collapsed"))


# --- increments -------------------------------------------------------------------


def _snapshots(spark, d):
    """Two snapshots of each file tree: what was there before the last commit of its project, and all of it."""
    f = corpus.files(spark, d).withColumn("last", F.max("commit_no").over(Window.partitionBy("project_id")))
    key = F.concat_ws("//", "project_id", "path")
    new = f.where("content is not null").select(key.alias("path"), F.md5(F.col("content").cast("binary")).alias("digest"))
    older = f.where("commit_no < last or content is null")
    old = older.select(F.when(F.col("commit_no") % 7 == 0, F.concat(key, F.lit(".old"))).otherwise(key).alias("path"), F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("digest"), "commit_no").withColumn("digest", F.when(F.col("commit_no") % 5 == 0, F.lit("changed")).otherwise(F.col("digest"))).drop("commit_no")
    return old, new


def snapshot_changes(spark, d):
    return changes.change_set(*_snapshots(spark, d))


def reindex_and_purge(spark, d):
    c = changes.change_set(*_snapshots(spark, d))
    return changes.to_reindex(c).withColumn("what", F.lit("reindex")).unionByName(changes.to_purge(c).withColumn("what", F.lit("purge")))


def merge_upsert(spark, d):
    """The live index after the files of the last commits came anew, applied twice."""
    c = corpus.chunks(spark, d).select(*KEY, "file_path", "ingested_at")
    late = c.where("dayofmonth(ingested_at) > 15").withColumn("ingested_at", F.date_trunc("day", "ingested_at"))
    purge = corpus.files(spark, d).where("content is null").select("project_id", F.col("path").alias("file_path"))
    once = changes.merge(c, late, KEY, purge)
    return changes.merge(once, late, KEY, purge).groupBy("project_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("ingested_at") == F.date_trunc("day", "ingested_at")).alias("fresh"))


def orphans(spark, d):
    """Files that have no chunk, and documents of files that are not in the tree."""
    f = corpus.files(spark, d).select("project_id", "path")
    c = load(spark, d, "chunks").select("project_id", F.col("file_path").alias("path")).distinct()
    docs = corpus.documents(spark, d).where("file_path is not null").select("project_id", F.col("file_path").alias("path")).distinct()
    return f.join(c, ["project_id", "path"], "left_anti").withColumn("what", F.lit("no chunk")).unionByName(docs.join(f, ["project_id", "path"], "left_anti").withColumn("what", F.lit("no file")))


# --- roll-up ------------------------------------------------------------------------


def folder_tree(spark, d):
    return rollup.folder_counts(corpus.files(spark, d).select("project_id", "path"), ["project_id"]).select("project_id", "folder", "depth", "files", "direct_files")


def extension_histogram(spark, d):
    return rollup.extension_histogram(corpus.files(spark, d).select("project_id", "path"), ["project_id"])


def _purposes(spark, d):
    f = corpus.files(spark, d).where("content is not null")
    return f.select("project_id", "path", F.substring(F.regexp_replace("content", "[ \t\r\n]+", " "), 1, 180).alias("purpose"))


def folder_rollup(spark, d):
    return rollup.rollup_levels(_purposes(spark, d), ["project_id"], 3000).select("project_id", "folder", "depth", "copied", "digest")


def overview_memo(spark, d):
    """Folders whose hash is not in the state before: those to be summarised again."""
    now = rollup.rollup_levels(_purposes(spark, d), ["project_id"], 3000)
    before = rollup.rollup_levels(_purposes(spark, d).where("not path like '%test%'"), ["project_id"], 3000)
    old = before.select("project_id", "folder", F.col("digest").alias("old"))
    return now.join(old, ["project_id", "folder"], "left").groupBy("project_id").agg(F.count("*").alias("folders"), F.count_if(F.col("digest").eqNullSafe(F.col("old"))).alias("reused"))


def storage_totals(spark, d):
    u = load(spark, d, "project_usage")
    n = lambda c: F.coalesce(c, F.lit(0))
    total = n("clone_bytes") + n("index_bytes") + n("docs_bytes")
    rows = u.withColumn("total", total).rollup("id").agg(F.sum("total").cast("long").alias("total"), F.sum(F.when(F.col("managed_clone"), n("clone_bytes")).otherwise(0)).cast("long").alias("managed"))
    return rows.select(F.coalesce("id", F.lit("(all)")).alias("project_id"), "total", "managed", P.human_size(F.col("total")).alias("size"))


# --- evaluation ------------------------------------------------------------------------


def refusals(spark, d):
    a = corpus.asks(spark, d).where("answer is not null")
    lang = F.coalesce(F.nullif(F.lower(F.trim("idioma")), F.lit("")), F.lit("(none)"))
    ref = P.is_refusal(F.col("answer"))
    return a.groupBy(lang.alias("language")).agg(F.count("*").alias("answers"), F.count_if(ref).alias("refused"), F.count_if(ref & ~F.col("answer").contains("```")).alias("clean"))


def spanish_answers(spark, d):
    return corpus.asks(spark, d).where("answer is not null").select("ask_id", P.is_spanish(F.col("answer")).alias("spanish"))


def ungrounded_identifiers(spark, d):
    """Names in backticks of an answer that neither its question nor its sources contain."""
    a = corpus.asks(spark, d).where("answer is not null")
    snippets = F.regexp_extract_all("answer", F.lit("`([^`\n]{2,80})`"), F.lit(1))
    names = F.array_distinct(F.flatten(F.transform(snippets, lambda s: F.regexp_extract_all(s, F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1)))))
    text = F.concat_ws("\n", F.coalesce("pregunta", F.lit("")), F.array_join(F.transform(F.coalesce("sources", F.array().cast("array<struct<file:string,lines:string>>")), lambda s: F.coalesce(s["file"], F.lit(""))), "\n"))
    return a.select("ask_id", F.explode(F.filter(names, lambda t: ~F.contains(text, t))).alias("identifier"))


def answer_grades(spark, d):
    """Whether an answer names its source file and one of two terms."""
    low = F.lower("answer")
    cite = F.lower(F.coalesce(F.get("sources", F.lit(0))["file"], F.lit("")))
    must = F.array(F.array(F.lit("line"), F.lit("líne"), F.lit("linha")), F.array(F.lit("list"), F.lit("result")))
    return corpus.asks(spark, d).where("answer is not null").select("ask_id", F.contains(low, cite).alias("cites_ok"), F.forall(must, lambda g: F.exists(g, lambda t: F.contains(low, t))).alias("content_ok"))


def _seconds(spark, d):
    return corpus.asks(spark, d).where("answer_seconds is not null").select("project_id", "answer_seconds", "ask_id")


def percentile_nearest(spark, d):
    return evaluation.nearest_rank(_seconds(spark, d), ["project_id"], "answer_seconds", 90)


def percentile_rounded(spark, d):
    return evaluation.indexed_percentile(_seconds(spark, d), ["project_id"], "answer_seconds", 95, "rounded")


def percentile_floor(spark, d):
    return evaluation.indexed_percentile(_seconds(spark, d), ["project_id"], "answer_seconds", 90, "floor")


def answer_times(spark, d):
    bucket = F.when(F.col("answer_tokens") <= 64, "short").when(F.col("answer_tokens") <= 256, "medium").otherwise("long")
    a = corpus.asks(spark, d).where("answer_seconds is not null")
    return a.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.median("answer_seconds"), 4).alias("median"), F.round(F.avg("answer_seconds"), 4).alias("mean"), F.max("answer_seconds").alias("most"))


def correctness_shares(spark, d):
    r = corpus.asks(spark, d).where("rating is not null").groupBy(F.coalesce("rating.correct", F.lit("(none)")).alias("correct")).agg(F.count("*").alias("n"), F.round(F.avg("rating.useful_sources"), 4).alias("useful"))
    return r.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def study_validation(spark, d):
    s = evaluation.studies(corpus.asks(spark, d))
    return s.select("study_id", "questions", F.array_join(evaluation.problems(), "; ").alias("problems"), F.array_join(evaluation.warnings(), "; ").alias("warnings"))


def duplicate_studies(spark, d):
    """Documents of equal text by digest: the first id stays, the others are duplicates."""
    t = corpus.documents(spark, d).where("text is not null and text <> ''").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = t.groupBy("digest").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return t.join(first, "digest").where("doc_id <> kept").select("doc_id", "kept")


def question_numbers(spark, d):
    w = Window.partitionBy("study_id").orderBy("asked_at", "ask_id")
    return corpus.asks(spark, d).select("ask_id", "study_id", F.row_number().over(w).alias("number"))


def latest_ratings(spark, d):
    """The last rating of each study that says whether an answer was right."""
    a = corpus.asks(spark, d).where("rating.correct is not null and study_id is not null")
    return a.groupBy("study_id").agg(F.max_by("rating.correct", F.struct("asked_at", "ask_id")).alias("correct"))


# --- monitor, streams ----------------------------------------------------------------------


def _checks(spark, d):
    return monitor.once(load(spark, d, "checks"))


def monitor_failures(spark, d):
    s = monitor.streaks(_checks(spark, d))
    return s.groupBy("project_id").agg(F.max("failures").alias("longest"), F.count_if("recovered").alias("recoveries"), F.count("*").alias("checks"))


def monitor_states(spark, d):
    return monitor.streaks(_checks(spark, d)).where("not ok or recovered").select("project_id", "check_time", "ok", "failures", "recovered", "last_ok")


def monitor_recent(spark, d):
    return monitor.recent(_checks(spark, d)).groupBy("project_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg("seconds"), 4).alias("seconds"), F.min("check_time").alias("since"))


def event_counts(spark, d):
    """Five-minute windows of the event stream, by a stream that reads all there is."""
    from sillar.streaming.monitor import stream_window_counts

    return stream_window_counts(spark, d)


def stream_sync(spark, d):
    """The chunk index kept by a stream of files, held against one batch."""
    from sillar.streaming.watch import sync_all

    return sync_all(spark, d)


def chunker(spark, d):
    """Structural chunks of every source file."""
    from sillar.operators.chunking import chunk_files

    return chunk_files(corpus.files(spark, d))


def adaptive_split(spark, d):
    from sillar.operators.chunking import split_adaptive

    return split_adaptive(corpus.chunks(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (
        file_languages, path_filters, question_identifiers, question_kinds, source_lines, embedding_texts, context_blocks, component_index, chunk_counts, repeated_ids,
        knn_top20, knn_metrics, distance_guards, hybrid_retrieval, adaptive_context, identifier_matches, named_chunks, call_edges, call_resolution, call_expansion,
        token_estimates, budget_skip_fit, next_fit_groups, prefix_cut, fallback_windows, purposes, preambles, snapshot_changes, reindex_and_purge, merge_upsert, orphans,
        folder_tree, extension_histogram, folder_rollup, overview_memo, storage_totals, refusals, spanish_answers, ungrounded_identifiers, answer_grades,
        percentile_nearest, percentile_rounded, percentile_floor, answer_times, correctness_shares, study_validation, duplicate_studies, question_numbers, latest_ratings,
        monitor_failures, monitor_states, monitor_recent, event_counts, stream_sync, chunker, adaptive_split,
    )}
