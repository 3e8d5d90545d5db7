"""The same queries in SQL over the same tables, as DuckDB runs it."""

from __future__ import annotations

import re

from sillar.functions import predicates as P
from sillar.functions import text as T

CH = "ch AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY project_id, chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
RF = "rf AS (SELECT * FROM repo_files QUALIFY row_number() OVER (PARTITION BY project_id, path ORDER BY ingested_at DESC NULLS LAST) = 1)"
AK = "ak AS (SELECT * FROM asks QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY received_at DESC NULLS LAST) = 1)"
CK = "ck AS (SELECT * FROM checks QUALIFY row_number() OVER (PARTITION BY project_id, check_time ORDER BY received_at DESC) = 1)"
_EDGE = r"[^\p{L}\p{N}_]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _suffix(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^/](\.[^./]+)$', 1))"


def _generated(path: str) -> str:
    return "(" + " OR ".join(f"contains(replace({path}, '\\', '/'), {_q(m)})" for m in P.GENERATED_MARKERS) + ")"


def _ids(text: str) -> str:
    return rf"list_filter(regexp_extract_all({text}, '([A-Za-z_][A-Za-z0-9_]{{3,}})', 1), lambda t: contains(regexp_replace(t, '^_+|_+$', '', 'g'), '_') OR regexp_matches(t, '[a-z][A-Z]'))"


def _first_seen(items: str) -> str:
    """A list without repeated items, in first order."""
    return f"list_filter({items}, lambda t, i: list_position({items}, t) = i)"


def _edged(pattern: str) -> str:
    return f"(^|{_EDGE})(?:{pattern.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')})($|{_EDGE})"


_USAGE_HEAD, _USAGE_TAIL = P.ASKS_USAGE.removeprefix(r"\b").removesuffix(r"\b").split(r"\b.{0,25}\b")
_USAGE = f"(^|{_EDGE}){_USAGE_HEAD}({_EDGE}|{_EDGE}.{{0,23}}{_EDGE}){_USAGE_TAIL}($|{_EDGE})"
_GENERAL = "|".join(_edged(p) for p in P.GENERAL)
_BLANK = re.sub(r"\\u([0-9A-F]{4})|\\x([89A-F][0-9A-F])", lambda m: rf"\x{{{m[1] or m[2]}}}", T.BLANK)


def _strip(t: str) -> str:
    return f"regexp_replace({t}, {_q('^' + _BLANK + '+|' + _BLANK + '+$')}, '', 'g')"


def _collapse(t: str) -> str:
    return _strip(f"regexp_replace({t}, {_q(_BLANK + '+')}, ' ', 'g')")


def _shorten(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace(left({t}, {n - 1}), {_q(_BLANK + '+$')}, '') || '…' END"


def _cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    n = f"sqrt({dot(a, a)}) * sqrt({dot(b, b)})"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) <> len({b}) OR {n} = 0 THEN 1.0 ELSE 1 - {dot(a, b)} / ({n}) END"


_KNN = f"""pairs AS (SELECT q.vec_id AS query_id, e.vec_id, round({_cosine('q.embedding', 'e.embedding')}, 9) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)"""

_QUESTIONS = f"""{CH}, {AK},
probe AS (SELECT project_id, arg_min(embedding, chunk_id) AS embedding FROM ch WHERE len(embedding) = 8 GROUP BY project_id),
qs AS (SELECT ask_id AS question_id, project_id, pregunta AS text, embedding FROM ak JOIN probe USING (project_id) WHERE ask_id % 20 = 0),
ids AS (SELECT DISTINCT question_id, project_id, coalesce(regexp_matches(text, {_q('(?i)' + _USAGE)}), false) AS usage, unnest({_ids('text')}) AS ident FROM qs),
inside AS (SELECT DISTINCT i.project_id, i.ident, c.chunk_id FROM (SELECT DISTINCT project_id, ident FROM ids) i JOIN ch c ON c.project_id = i.project_id AND contains(c.code, i.ident)),
rare AS (SELECT project_id, ident FROM inside GROUP BY ALL HAVING count(*) <= 15),
hits AS (SELECT project_id, ident, chunk_id, 'code' AS how FROM inside JOIN rare USING (project_id, ident) UNION ALL SELECT i.project_id, i.ident, c.chunk_id, 'name' FROM (SELECT DISTINCT project_id, ident FROM ids) i JOIN ch c ON c.project_id = i.project_id AND c.name = i.ident),
matched AS (SELECT question_id, chunk_id, max(CASE WHEN (how = 'name') <> usage THEN 0.10 ELSE 0.04 END)::DOUBLE AS bonus FROM ids JOIN hits USING (project_id, ident) GROUP BY ALL)"""

_HYBRID = f"""{_QUESTIONS},
sem AS (SELECT question_id, chunk_id, distance FROM (SELECT q.question_id, c.chunk_id, round({_cosine('q.embedding', 'c.embedding')}, 9) AS distance FROM qs q JOIN ch c USING (project_id) WHERE c.embedding IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) <= 20),
cand AS (SELECT question_id, chunk_id, distance, bonus FROM sem FULL OUTER JOIN matched USING (question_id, chunk_id)),
scored AS (SELECT k.question_id, k.chunk_id, c.file_path, c.chunk_type, round({_cosine('q.embedding', 'c.embedding')} - coalesce(bonus, 0.0)
  + CASE WHEN regexp_matches(c.file_path, {_q(P.TEST_PATH)}) AND NOT coalesce(regexp_matches(q.text, {_q('(?i)' + _edged(P.ASKS_TESTS))}), false) THEN 0.08 ELSE 0.0 END, 6) AS distance
  FROM cand k JOIN qs q USING (question_id) JOIN ch c ON c.project_id = q.project_id AND c.chunk_id = k.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM scored)"""

_CALLS = rf"""{CH},
found AS (SELECT project_id, chunk_id, file_path, list_filter(regexp_extract_all(regexp_replace(regexp_replace(code, '[^\P{{L}}\x00-\x7F]', 'zqz', 'g'), '\b(def|func|function|class) ([A-Za-z_][A-Za-z0-9_]*)(\s*\()', '\1 1\3', 'g'), '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1),
  lambda t: t NOT IN {_list(P.NO_CALLS)} AND t <> coalesce(name, '') AND length(t) > 2 AND NOT contains(t, 'zqz')) AS names FROM ch WHERE chunk_type IN ('function', 'method')),
uniq AS (SELECT project_id, chunk_id, file_path, {_first_seen('names')} AS names FROM found),
edges AS (SELECT project_id, chunk_id, file_path, unnest(names) AS callee, unnest(range(len(names)))::INT AS position FROM uniq),
met AS (SELECT e.project_id, e.chunk_id, e.position, e.callee, c.chunk_id AS target, count(*) OVER w AS n, count(*) FILTER (WHERE starts_with(c.file_path, array_to_string(string_split(e.file_path, '/')[:2], '/'))) OVER w AS near,
  starts_with(c.file_path, array_to_string(string_split(e.file_path, '/')[:2], '/')) AS inside FROM edges e JOIN ch c ON c.project_id = e.project_id AND c.name = e.callee AND c.name <> '' WINDOW w AS (PARTITION BY e.project_id, e.chunk_id, e.callee)),
resolved AS (SELECT project_id, chunk_id, position, callee, target FROM met WHERE n = 1 OR (near = 1 AND inside))"""

_COSTS = f"""{CH}, costs AS (SELECT project_id, file_path, chunk_id, start_line, (ceil(length(code) / 3.5) + 1)::BIGINT AS cost, length(code)::BIGINT AS chars FROM ch WHERE split_of IS NULL)"""

_SNAP = f"""{RF}, f AS (SELECT *, max(commit_no) OVER (PARTITION BY project_id) AS last, project_id || '//' || path AS key FROM rf),
new AS (SELECT key AS nk, md5(content) AS nd FROM f WHERE content IS NOT NULL),
old AS (SELECT CASE WHEN commit_no % 7 = 0 THEN key || '.old' ELSE key END AS ok, CASE WHEN commit_no % 5 = 0 THEN 'changed' ELSE md5(coalesce(content, '')) END AS od FROM f WHERE commit_no < last OR content IS NULL),
diff AS (SELECT CASE WHEN ok IS NULL THEN 'A' WHEN nk IS NULL THEN 'D' WHEN od IS DISTINCT FROM nd THEN 'M' END AS change, ok, nk, od, nd FROM old FULL OUTER JOIN new ON ok = nk),
ren AS (SELECT d.ok, a.nk FROM (SELECT od, min(ok) AS ok FROM diff WHERE change = 'D' GROUP BY od HAVING count(*) = 1) d JOIN (SELECT nd, min(nk) AS nk FROM diff WHERE change = 'A' GROUP BY nd HAVING count(*) = 1) a ON od = nd),
changes AS (SELECT change, ok AS old_key, nk AS new_key FROM diff WHERE change IS NOT NULL AND NOT (change = 'D' AND ok IN (SELECT ok FROM ren)) AND NOT (change = 'A' AND nk IN (SELECT nk FROM ren)) UNION ALL SELECT 'R', ok, nk FROM ren)"""


def _rollup(name: str, where: str, depth: int = 4, budget: int = 3000) -> str:
    """CTEs of the folder roll-up: one a level, from the deepest."""
    out = [f"{name}f AS (SELECT project_id, path, left(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'), 180) AS purpose FROM rf WHERE content IS NOT NULL AND {where})",
           f"{name}e AS (SELECT project_id, regexp_replace(path, '/[^/]*$', '') AS folder, 0 AS kind, string_split(path, '/')[-1] AS name, purpose AS text FROM {name}f WHERE contains(path, '/'))"]
    levels = []
    for level in range(depth, 0, -1):
        src = f"SELECT * FROM {name}e WHERE len(string_split(folder, '/')) = {level}"
        if levels:
            src += f" UNION ALL SELECT project_id, regexp_replace(folder, '/[^/]*$', ''), 1, string_split(folder, '/')[-1], text FROM {name}{level + 1}"
        line = lambda n: f"name || CASE WHEN kind = 1 THEN '/' ELSE '' END || ': ' || {_shorten('text', n)}"
        items = ", ".join(f"string_agg({line(n)}, chr(10) ORDER BY kind, name, {line(n)}) AS t{n}" for n in T.LEVELS)
        fits = ", ".join(f"CASE WHEN length(t{n}) <= {budget} THEN t{n} END" for n in T.LEVELS)
        out.append(f"{name}g{level} AS (SELECT project_id, folder, {items}, count(*) AS n, max(text) AS single FROM ({src}) GROUP BY ALL)")
        out.append(f"{name}{level} AS (SELECT project_id, folder, {level} AS depth, n = 1 AS copied, CASE WHEN n = 1 THEN {_shorten('single', 350)} ELSE coalesce({fits}, left(t70, {budget})) END AS text FROM {name}g{level})")
        levels.append(level)
    out.append(f"{name} AS ({' UNION ALL '.join(f'SELECT * FROM {name}{x}' for x in levels)})")
    return ", ".join(out)


_C1, _C2 = "coalesce(pregunta, '')", "coalesce(answer, '')"


def oracle_sql() -> dict[str, str]:
    lang = "CASE " + " ".join(f"WHEN s = {_q(e)} THEN {_q(v)}" for e, v in P.LANGUAGES.items()) + " END"
    return {
        "file_languages": f"WITH {RF} SELECT project_id, path, {lang} AS language FROM (SELECT *, {_suffix('path')} AS s FROM rf)",
        "path_filters": f"WITH {RF} SELECT project_id, count(*) AS files, count(*) FILTER (WHERE {_suffix('path')} IN {_list(P.LANGUAGES)} AND NOT {_generated('path')}) AS indexable, count(*) FILTER (WHERE {_generated('path')}) AS generated, count(*) FILTER (WHERE regexp_matches(path, {_q(P.TEST_PATH)})) AS tests FROM rf GROUP BY project_id",
        "question_identifiers": f"WITH {AK}, x AS (SELECT ask_id, {_ids('pregunta')} AS l FROM ak), y AS (SELECT ask_id, {_first_seen('l')} AS l FROM x) SELECT ask_id, unnest(range(len(l)))::INT AS place, unnest(l) AS identifier FROM y",
        "question_kinds": f"WITH {AK} SELECT ask_id, regexp_matches(pregunta, {_q('(?i)' + _edged(P.ASKS_TESTS))}) AS about_tests, regexp_matches(pregunta, {_q('(?i)' + _USAGE)}) AS about_usage, regexp_matches(pregunta, {_q('(?i)' + _GENERAL)}) AND len({_ids('pregunta')}) = 0 AS general FROM ak",
        "source_lines": f"WITH {AK}, s AS (SELECT ask_id, unnest(range(len(sources)))::INT AS place, unnest(sources) AS s FROM ak), p AS (SELECT ask_id, place, replace(coalesce(s.file, ''), '\\', '/') AS path, coalesce(s.lines, '') AS lines FROM s) SELECT ask_id, place, CASE WHEN starts_with(path, '/') OR path[2] = ':' THEN string_split(path, '/')[-1] ELSE path END AS file, lines FROM p",
        "embedding_texts": f"WITH {CH} SELECT project_id, chunk_id, length(file_path || chr(10) || chr(10) || code)::INT AS length, md5(file_path || chr(10) || chr(10) || code) AS digest FROM ch",
        "context_blocks": f"WITH {CH}, b AS (SELECT project_id, chunk_id, code, '[' || file_path || ' (líneas ' || start_line || '-' || end_line || ')] ' || chunk_type || CASE WHEN coalesce(name, '') <> '' THEN ' ''' || name || '''' ELSE '' END AS head FROM ch) SELECT project_id, chunk_id, head, (length(head) + length(code) + 9)::INT AS length FROM b",
        "component_index": f"WITH {CH} SELECT project_id, file_path, coalesce(split_of, chunk_id) AS component, chunk_type, start_line, end_line FROM ch QUALIFY row_number() OVER (PARTITION BY project_id, coalesce(split_of, chunk_id) ORDER BY chunk_id) = 1",
        "chunk_counts": f"WITH {CH} SELECT project_id, count(*) AS chunks, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE {_generated('file_path')}) AS generated FROM ch GROUP BY project_id",
        "repeated_ids": "SELECT project_id, chunk_id, count(*) AS rows FROM chunks GROUP BY ALL HAVING count(*) > 1",
        "knn_top20": f"WITH {_KNN} SELECT query_id, vec_id, round(distance, 5) + 0::DOUBLE AS distance FROM near WHERE rank <= 20",
        "knn_metrics": f"""WITH {_KNN}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM near WHERE rank <= 11 AND query_id <> vec_id),
            f AS (SELECT q.vec_id AS query_id, min(p.place) FILTER (WHERE p.place <= 10 AND e.label = q.label) AS rank FROM embeddings q LEFT JOIN p ON p.query_id = q.vec_id LEFT JOIN embeddings e ON e.vec_id = p.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)
            SELECT count(*) AS questions, {', '.join(f'round(100 * avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 1) AS hit_{k}' for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0 / rank, 0.0)), 3) AS mrr_10 FROM f""",
        "distance_guards": "SELECT vec_id, 1.0::DOUBLE AS to_zero, 1.0::DOUBLE AS to_short, 1.0::DOUBLE AS to_null, 0.0::DOUBLE AS to_self FROM embeddings WHERE vec_id % 20 = 0",
        "hybrid_retrieval": f"WITH {_HYBRID} SELECT question_id, chunk_id, distance + 0::DOUBLE AS distance FROM ranked",
        "adaptive_context": f"WITH {_HYBRID}, k AS (SELECT *, max(CASE WHEN rank = least(5, n) THEN distance END) OVER (PARTITION BY question_id) AS edge FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM ranked)) SELECT question_id, chunk_id, file_path, distance + 0::DOUBLE AS distance FROM k WHERE rank <= 5 OR (rank <= 10 AND distance <= edge + 0.03)",
        "identifier_matches": f"WITH {_QUESTIONS} SELECT question_id, chunk_id, bonus FROM matched",
        "named_chunks": f"WITH {CH}, {AK}, i AS (SELECT DISTINCT ask_id, project_id, unnest({_ids('pregunta')}) AS name FROM ak) SELECT DISTINCT i.ask_id, i.name, c.chunk_id FROM i JOIN ch c ON c.project_id = i.project_id AND c.name = i.name WHERE c.name <> ''",
        "call_edges": f"WITH {_CALLS} SELECT project_id, chunk_id, position, callee FROM edges",
        "call_resolution": f"WITH {_CALLS} SELECT project_id, chunk_id, callee, target FROM resolved",
        "call_expansion": f"""WITH {_CALLS}, ctx AS (SELECT *, project_id || '//' || file_path AS question_id, row_number() OVER (PARTITION BY project_id, file_path ORDER BY start_line, chunk_id) AS rank FROM ch QUALIFY rank <= 5),
            have AS (SELECT DISTINCT question_id, name FROM ctx WHERE name <> ''), new AS (SELECT x.question_id, x.rank, r.position, r.callee, r.target FROM ctx x JOIN resolved r ON r.project_id = x.project_id AND r.chunk_id = x.chunk_id WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.question_id = x.question_id AND h.name = r.callee)),
            once AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY question_id, callee ORDER BY rank, position) = 1) SELECT question_id, target, callee, (row_number() OVER (PARTITION BY question_id ORDER BY rank, position))::INT AS place FROM once QUALIFY place <= 5""",
        "token_estimates": "SELECT doc_id, ceil(length(text) / 3.5)::BIGINT AS tokens FROM documents",
        "budget_skip_fit": f"""WITH {_COSTS}, l AS (SELECT project_id, file_path, list({{'o': chunk_id, 'c': cost}} ORDER BY chunk_id) AS items FROM costs GROUP BY ALL),
            r AS (SELECT project_id, file_path, list_reduce(list_transform(items, lambda x: {{'used': x.c, 'kept': [{{'o': x.o, 'used': x.c}}]}}), lambda s, x: CASE WHEN s.used + x.used <= 600 THEN {{'used': s.used + x.used, 'kept': list_append(s.kept, {{'o': x.kept[1].o, 'used': s.used + x.used}})}} ELSE s END, {{'used': 0::BIGINT, 'kept': []::STRUCT(o VARCHAR, used BIGINT)[]}}) AS s FROM l)
            SELECT project_id, file_path, k.o AS chunk_id, k.used AS used FROM (SELECT project_id, file_path, unnest(s.kept) AS k FROM r)""",
        "next_fit_groups": f"""WITH {_COSTS}, l AS (SELECT project_id, file_path, list({{'o': chunk_id, 'c': least(chars, 2000)}} ORDER BY chunk_id) AS items FROM costs GROUP BY ALL),
            r AS (SELECT project_id, file_path, list_reduce(list_transform(items, lambda x: {{'used': x.c, 'part': 1, 'kept': [{{'o': x.o, 'part': 1}}]}}), lambda s, x: CASE WHEN s.used > 0 AND s.used + x.used > 2000 THEN {{'used': x.used, 'part': s.part + 1, 'kept': list_append(s.kept, {{'o': x.kept[1].o, 'part': s.part + 1}})}}
              ELSE {{'used': s.used + x.used, 'part': s.part, 'kept': list_append(s.kept, {{'o': x.kept[1].o, 'part': s.part}})}} END, {{'used': 0::BIGINT, 'part': 1, 'kept': []::STRUCT(o VARCHAR, part INTEGER)[]}}) AS s FROM l)
            SELECT project_id, file_path, k.o AS chunk_id, k.part AS part FROM (SELECT project_id, file_path, unnest(s.kept) AS k FROM r)""",
        "prefix_cut": f"WITH {_COSTS}, s AS (SELECT *, sum(chars) OVER w AS used, row_number() OVER w AS n FROM costs WINDOW w AS (PARTITION BY project_id, file_path ORDER BY start_line, chunk_id ROWS UNBOUNDED PRECEDING)), o AS (SELECT *, max(CASE WHEN used > 2000 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, file_path ORDER BY n ROWS UNBOUNDED PRECEDING) AS over FROM s) SELECT project_id, chunk_id, used::BIGINT AS used FROM o WHERE over = 0",
        "fallback_windows": """WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS len FROM documents WHERE text IS NOT NULL),
            s AS (SELECT doc_id, len(len) AS n, list_transform(range(0, len(len) + 1), lambda i: coalesce(list_sum(len[1:i]), 0)) AS sums FROM d),
            w AS (SELECT doc_id, n, sums, 1 AS no, 0::BIGINT AS start, least(greatest(len(list_filter(sums, lambda x: x < 1500)), 1), n) AS stop FROM s
              UNION ALL SELECT doc_id, n, sums, no + 1, greatest(stop - 2, start + 1), least(greatest(len(list_filter(sums, lambda x: x < sums[greatest(stop - 2, start + 1) + 1] + 1500)), greatest(stop - 2, start + 1) + 1), n) FROM w WHERE stop < n)
            SELECT doc_id, no::INT AS no, (start + 1)::INT AS first, stop::INT AS last FROM w""",
        "purposes": rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS text FROM documents WHERE source = 'generated_docs' AND text IS NOT NULL),
            p AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?im)^##[\t\n\f\r\x{{0B}} ]+Prop[oóOÓ]sito[\t\f\r\x{{0B}} ]*$') THEN regexp_replace(regexp_extract(text, '(?ims)^##[\t\n\f\r\x{{0B}} ]+Prop[oóOÓ]sito[\t\f\r\x{{0B}} ]*$(.*)', 1), '(?ms)^##[\t\n\f\r\x{{0B}} ].*', '')
              ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: {_strip('x')} <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '>')), chr(10)) END AS body FROM t), c AS (SELECT doc_id, {_collapse('body')} AS purpose FROM p)
            SELECT doc_id, md5(purpose) AS purpose, md5({_shorten('purpose', 70)}) AS short FROM c""",
        "preambles": f"WITH {AK} SELECT ask_id, length({_strip('answer')})::INT AS length, length({_collapse('answer')})::INT AS collapsed FROM ak WHERE answer IS NOT NULL",
        "snapshot_changes": f"WITH {_SNAP} SELECT change, old_key, new_key FROM changes",
        "reindex_and_purge": f"WITH {_SNAP} SELECT new_key AS key, 'reindex' AS what FROM changes WHERE change IN ('A', 'M', 'R') UNION ALL SELECT old_key, 'purge' FROM changes WHERE change IN ('D', 'R')",
        "merge_upsert": f"""WITH {CH}, {RF}, late AS (SELECT project_id, chunk_id, file_path, date_trunc('day', ingested_at) AS since FROM ch WHERE day(ingested_at) > 15),
            live AS (SELECT project_id, chunk_id, file_path, ingested_at AS since FROM ch WHERE NOT coalesce(day(ingested_at) > 15, false) AND (project_id, file_path) NOT IN (SELECT project_id, path FROM rf WHERE content IS NULL))
            SELECT project_id, count(*) AS chunks, count(*) FILTER (WHERE since = date_trunc('day', since)) AS fresh FROM (SELECT * FROM live UNION ALL SELECT * FROM late) GROUP BY project_id""",
        "orphans": f"WITH {RF} SELECT project_id, path, 'no chunk' AS what FROM rf WHERE (project_id, path) NOT IN (SELECT project_id, file_path FROM chunks WHERE project_id IS NOT NULL AND file_path IS NOT NULL) UNION ALL SELECT DISTINCT project_id, file_path, 'no file' FROM documents d WHERE file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rf WHERE rf.project_id = d.project_id AND rf.path = d.file_path)",
        "folder_tree": f"WITH {RF}, p AS (SELECT project_id, path, string_split(path, '/') AS s FROM rf), x AS (SELECT project_id, path, len(s) AS n, s, unnest(range(1, len(s))) AS i FROM p), y AS (SELECT project_id, n, i, array_to_string(s[1:i], '/') AS folder FROM x) SELECT project_id, folder, i::INT AS depth, count(*) AS files, count(*) FILTER (WHERE i = n - 1) AS direct_files FROM y GROUP BY project_id, folder, i",
        "extension_histogram": f"WITH {RF}, e AS (SELECT project_id, path, CASE WHEN {_suffix('path')} = '' THEN '(none)' ELSE {_suffix('path')} END AS ext FROM rf), g AS (SELECT project_id, ext, count(*) AS n, min(path) AS first FROM e GROUP BY ALL) SELECT project_id, ext, n, (row_number() OVER (PARTITION BY project_id ORDER BY n DESC, first))::INT AS place FROM g QUALIFY place <= 8",
        "folder_rollup": f"WITH {RF}, {_rollup('now', 'true')} SELECT project_id, folder, depth, copied, sha1('1' || text) AS digest FROM now",
        "overview_memo": f"WITH {RF}, {_rollup('now', 'true')}, {_rollup('old', 'path NOT LIKE ' + _q('%test%'))} SELECT project_id, count(*) AS folders, count(*) FILTER (WHERE n.text = o.text) AS reused FROM now n LEFT JOIN old o USING (project_id, folder) GROUP BY project_id",
        "storage_totals": """WITH u AS (SELECT id, coalesce(clone_bytes, 0) + coalesce(index_bytes, 0) + coalesce(docs_bytes, 0) AS total, CASE WHEN managed_clone THEN coalesce(clone_bytes, 0) ELSE 0 END AS managed FROM project_usage),
            t AS (SELECT coalesce(id, '(all)') AS project_id, sum(total)::BIGINT AS total, sum(managed)::BIGINT AS managed FROM u GROUP BY ROLLUP (id))
            SELECT *, CASE WHEN total < 1024 THEN printf('%.0f B', total::DOUBLE) WHEN total < 1048576 THEN printf('%.1f KB', total / 1024.0::DOUBLE) WHEN total < 1073741824 THEN printf('%.1f MB', total / 1048576.0::DOUBLE) ELSE printf('%.1f GB', total / 1073741824.0::DOUBLE) END AS size FROM t""",
        "refusals": f"""WITH {AK}, r AS (SELECT CASE WHEN coalesce(lower(trim(idioma)), '') = '' THEN '(none)' ELSE lower(trim(idioma)) END AS language, answer, regexp_matches(answer, {_q('(?i)' + P.CANONICAL_REFUSAL)}) OR (regexp_matches(answer, {_q('(?i)' + P.REFUSAL)}) AND length(regexp_extract(answer, {_q('(?is)^(.*?)' + P.REFUSAL)}, 1)) < 120) AS ref FROM ak WHERE answer IS NOT NULL)
            SELECT language, count(*) AS answers, count(*) FILTER (WHERE ref) AS refused, count(*) FILTER (WHERE ref AND NOT contains(answer, '```')) AS clean FROM r GROUP BY language""",
        "spanish_answers": f"WITH {AK}, w AS (SELECT ask_id, regexp_extract_all(lower(answer), '[a-záéíóúñ]+') AS w FROM ak WHERE answer IS NOT NULL) SELECT ask_id, len(list_filter(w, lambda x: x IN {_list(P.SPANISH)})) > len(list_filter(w, lambda x: x IN {_list(P.ENGLISH)})) AS spanish FROM w",
        "ungrounded_identifiers": f"""WITH {AK}, s AS (SELECT ask_id, coalesce(pregunta, '') || chr(10) || array_to_string(list_transform(coalesce(sources, []), lambda x: coalesce(x.file, '')), chr(10)) AS text, unnest(regexp_extract_all(answer, '`([^`\\n]{{2,80}})`', 1)) AS snippet FROM ak WHERE answer IS NOT NULL),
            n AS (SELECT ask_id, text, unnest(regexp_extract_all(snippet, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS identifier FROM s) SELECT DISTINCT ask_id, identifier FROM n WHERE NOT contains(text, identifier)""",
        "answer_grades": f"WITH {AK} SELECT ask_id, contains(lower(answer), lower(coalesce(sources[1].file, ''))) AS cites_ok, (contains(lower(answer), 'line') OR contains(lower(answer), 'líne') OR contains(lower(answer), 'linha')) AND (contains(lower(answer), 'list') OR contains(lower(answer), 'result')) AS content_ok FROM ak WHERE answer IS NOT NULL",
        "percentile_nearest": f"WITH {AK} SELECT project_id, quantile_disc(answer_seconds, 0.9) AS p FROM ak WHERE answer_seconds IS NOT NULL GROUP BY project_id",
        "percentile_rounded": f"WITH {AK}, r AS (SELECT project_id, answer_seconds, row_number() OVER (PARTITION BY project_id ORDER BY answer_seconds) - 1 AS i, round_even(0.95::DOUBLE * (count(*) OVER (PARTITION BY project_id) - 1), 0)::BIGINT AS place FROM ak WHERE answer_seconds IS NOT NULL) SELECT project_id, answer_seconds AS p FROM r WHERE i = place",
        "percentile_floor": f"WITH {AK}, r AS (SELECT project_id, answer_seconds, row_number() OVER (PARTITION BY project_id ORDER BY answer_seconds) - 1 AS i, floor(0.9::DOUBLE * (count(*) OVER (PARTITION BY project_id) - 1))::BIGINT AS place FROM ak WHERE answer_seconds IS NOT NULL) SELECT project_id, answer_seconds AS p FROM r WHERE i = place",
        "answer_times": f"WITH {AK} SELECT CASE WHEN answer_tokens <= 64 THEN 'short' WHEN answer_tokens <= 256 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, round(median(answer_seconds), 4) AS median, round(avg(answer_seconds), 4) AS mean, max(answer_seconds) AS most FROM ak WHERE answer_seconds IS NOT NULL GROUP BY bucket",
        "correctness_shares": f"WITH {AK}, g AS (SELECT coalesce(rating.correct, '(none)') AS correct, count(*) AS n, round(avg(rating.useful_sources), 4) AS useful FROM ak WHERE rating IS NOT NULL GROUP BY ALL) SELECT correct, n, useful, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS share FROM g",
        "study_validation": f"""WITH {AK}, s AS (SELECT study_id, count(*) AS questions, count(DISTINCT lower({_strip(_C1)})) AS dq, count(*) FILTER (WHERE rating IS NOT NULL) AS ratings, count(*) FILTER (WHERE rating IS NOT NULL AND NOT coalesce(rating.correct IN ('si', 'parcial', 'no', 'no_se'), false)) AS bad,
            count(*) FILTER (WHERE {_strip(_C1)} = '' OR {_strip(_C2)} = '') AS empty, min(answer_seconds) AS least, max(answer_seconds) AS most, count(*) FILTER (WHERE answer_tokens >= 50 AND answer_seconds > 0 AND answer_tokens / answer_seconds > 400) AS fast FROM ak WHERE study_id IS NOT NULL GROUP BY study_id)
            SELECT study_id, questions, concat_ws('; ', CASE WHEN questions < 3 THEN 'menos de 3 preguntas' END, CASE WHEN bad > 0 THEN 'valoración inválida' END, CASE WHEN empty > 0 THEN 'pregunta o respuesta vacía' END) AS problems,
            concat_ws('; ', CASE WHEN dq < questions THEN 'preguntas repetidas' END, CASE WHEN least <= 0.2 THEN 'tiempo de respuesta imposible (menor o igual a 0,2 s)' END, CASE WHEN most > 900 THEN 'tiempo de respuesta mayor a 15 minutos' END, CASE WHEN ratings = 0 THEN 'ninguna respuesta fue valorada' END, CASE WHEN fast > 0 THEN 'velocidad de generación de más de 400 tokens/s: poco plausible para un modelo local de 8B' END) AS warnings FROM s""",
        "duplicate_studies": "SELECT doc_id, kept FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM documents WHERE text IS NOT NULL AND text <> '') WHERE doc_id <> kept",
        "question_numbers": f"WITH {AK} SELECT ask_id, study_id, (row_number() OVER (PARTITION BY study_id ORDER BY asked_at NULLS FIRST, ask_id))::INT AS number FROM ak",
        "latest_ratings": f"WITH {AK} SELECT study_id, rating.correct AS correct FROM ak WHERE rating.correct IS NOT NULL AND study_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY asked_at DESC NULLS LAST, ask_id DESC) = 1",
        "monitor_failures": f"WITH {CK}, i AS (SELECT *, sum(ok::INT) OVER w AS island, lag(ok) OVER w AS before FROM ck WINDOW w AS (PARTITION BY project_id ORDER BY check_time)), s AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY project_id, island ORDER BY check_time) AS failures FROM i) SELECT project_id, max(failures)::BIGINT AS longest, count(*) FILTER (WHERE ok AND NOT before) AS recoveries, count(*) AS checks FROM s GROUP BY project_id",
        "monitor_states": f"WITH {CK}, i AS (SELECT *, sum(ok::INT) OVER w AS island, lag(ok) OVER w AS before, max(CASE WHEN ok THEN check_time END) OVER w AS last_ok FROM ck WINDOW w AS (PARTITION BY project_id ORDER BY check_time)), s AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY project_id, island ORDER BY check_time) AS failures, ok AND coalesce(NOT before, false) AS recovered FROM i) SELECT project_id, check_time, ok, failures::BIGINT AS failures, recovered, last_ok FROM s WHERE NOT ok OR recovered",
        "monitor_recent": f"WITH {CK}, r AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY check_time DESC) <= 50) SELECT project_id, count(*) AS checks, count(*) FILTER (WHERE NOT ok) AS failed, round(avg(seconds), 4) AS seconds, min(check_time) AS since FROM r GROUP BY project_id",
        "event_counts": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AT TIME ZONE 'UTC' AS since, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL",
        "stream_sync": f"WITH {RF} SELECT project_id, count(*) AS files, count(DISTINCT md5(content)) AS contents FROM rf WHERE content IS NOT NULL GROUP BY project_id",
    }
