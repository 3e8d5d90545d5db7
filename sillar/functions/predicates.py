"""Predicates and small projections over paths, names, questions and answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the language each stands for.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".cs": "c_sharp",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".c": "c", ".h": "c", ".rs": "rust", ".php": "php",
}
# Parts of paths that mean generated or third-party code.
GENERATED_MARKERS = ["_pb2.py", "_pb2_grpc.py", ".pb.go", "_grpc.pb.go", ".pb.h", ".pb.cc", "genproto/", "/generated/", "/gen/", "vendor/", "node_modules/", "/dist/", "/build/", ".min.js"]
# Patterns of test paths, of questions about tests and about usage.
TEST_PATH = r"(^|/)(tests?|testing|__tests__)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[jt]sx?$"
ASKS_TESTS = r"\b(tests?|testing|prueba|pruebas|testear|spec)\b"
ASKS_USAGE = r"\b(d[oó]nde|qui[eé]n|qu[eé]|cu[aá]ndo)\b.{0,25}\b(usa|usan|utiliza|llama|llaman|invoca|lanza|lanzan|levanta|produce|lee|leen|modifica|asigna)\b"
# Questions about a whole repository.
SUBJECT = r"(proyecto|repositorio|repo|sistema|aplicaci[oó]n|app|programa|c[oó]digo|software|librer[ií]a|biblioteca|project|repository|codebase|system|application|library)"
GENERAL = [
    rf"\bqu[eé] hace (este|esta|el|la|todo el|todo este)\s+{SUBJECT}\b", rf"\bpara qu[eé] sirve (este|esta|el|la)\s+{SUBJECT}\b", rf"\bde qu[eé] (trata|se trata|va) (este|esta|el|la)\s+{SUBJECT}\b",
    rf"\bqu[eé] es (este|esta|el|la)\s+{SUBJECT}\b", rf"\bexpl[ií]ca(me)? (este|esta|el|la)\s+{SUBJECT}\b", rf"\bresumen (general |breve )?(de|del) (este |esta |el |la )?{SUBJECT}\b",
    r"\b(visi[oó]n|descripci[oó]n|panorama) general\b", r"\bc[oó]mo est[aá] (organizad[oa]|estructurad[oa]|compuest[oa]|armad[oa]|dividid[oa])\b",
    rf"\b(estructura|organizaci[oó]n|arquitectura) (general )?(de|del) (este |esta |el |la )?{SUBJECT}\b", r"\b(arquitectura|estructura) general\b",
    r"\b(cu[aá]les|qu[eé]) son (los|las) (principales|m[aá]s importantes)\s+(componentes|m[oó]dulos|servicios|carpetas|partes|piezas)\b",
    r"\bqu[eé] (servicios|m[oó]dulos|componentes|partes|carpetas) (hay|tiene|existen|componen|forman)\b", r"\b(qu[eé]|cu[aá]les) (tecnolog[ií]as|lenguajes|frameworks|librer[ií]as) (usa|utiliza|emplea|hay|tiene)\b",
    rf"\bwhat does (this|the|that) (\w+ )?{SUBJECT} do\b", rf"\bwhat is (this|the) {SUBJECT}( for| about)?\b", rf"\bwhat('s| is) (this|the) {SUBJECT} about\b",
    rf"\bhow is (this|the|it)( {SUBJECT})? (organi[sz]ed|structured|laid out|built up)\b", r"\b(high[- ]level|general) (overview|architecture|structure|description)\b",
    rf"\boverview of (this|the) {SUBJECT}\b", r"\b(main|key|principal) (components|modules|services|parts|folders)\b", r"\bwhich (technologies|languages|frameworks) (does|do|are)\b",
]
# Words that look like calls but are none.
NO_CALLS = """if for while switch catch return func def class new delete print println printf fmt string int float double bool var let const public private protected static void struct interface
try except finally with case default else elif match async await yield throw raise super this self import from package namespace using typeof instanceof sizeof make len append range in is and or not lambda
require module export type enum impl fn""".split()
# Refusing phrases, and the characters within which the second must begin.
CANONICAL_REFUSAL = r"no encontr[ée] informaci[óo]n suficiente"
REFUSAL = r"no (encontr[ée]|hay|tengo|se encontr[óo]|dispongo de) (suficiente )?(informaci[óo]n|fragmentos|c[óo]digo)"
REFUSAL_OPENING = 120
# Words that tell Spanish from English.
SPANISH = "el la los las de que se en una un es para con por del".split()
ENGLISH = "the is and of to in that this for with it are".split()


def suffix(path: Column) -> Column:
    """The last suffix of a path's name, dot included, lower-cased; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Language by extension, null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix(path))


def is_generated(path: Column) -> Column:
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for m in GENERATED_MARKERS:
        out = out | flat.contains(m)
    return out


def is_indexable(path: Column) -> Column:
    return suffix(path).isin(*LANGUAGES) & ~is_generated(path)


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def asks_tests(q: Column) -> Column:
    return q.rlike("(?iuU)" + ASKS_TESTS)


def asks_usage(q: Column) -> Column:
    return q.rlike("(?iuU)" + ASKS_USAGE)


def identifiers(q: Column) -> Column:
    """Code-shaped words of a question in their first order: an inner underscore, or a capital after a small letter."""
    found = F.regexp_extract_all(q, F.lit(r"([A-Za-z_][A-Za-z0-9_]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.regexp_replace(t, "^_+|_+$", "").contains("_") | t.rlike("[a-z][A-Z]")))


def is_general(q: Column) -> Column:
    """An open question about the repository: one of the forms, and no identifier in it."""
    return q.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in GENERAL)) & (F.size(identifiers(q)) == 0)


def is_refusal(answer: Column) -> Column:
    at = F.regexp_instr(answer, F.lit("(?iu)" + REFUSAL))
    return answer.rlike("(?iu)" + CANONICAL_REFUSAL) | at.between(1, REFUSAL_OPENING)


def is_spanish(answer: Column) -> Column:
    words = F.regexp_extract_all(F.lower(answer), F.lit("([a-záéíóúñ]+)"), F.lit(1))
    count = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws)))
    return count(SPANISH) > count(ENGLISH)


def call_names(code: Column, own: Column) -> Column:
    """Names called in a piece of code, in their first order; definitions, keywords, its own and short names left out."""
    found = F.regexp_extract_all(code, F.lit(r"(?<!\bdef )(?<!\bfunc )(?<!\bfunction )(?<!\bclass )\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*NO_CALLS) & (t != F.coalesce(own, F.lit(""))) & (F.length(t) > 2)))


def scope(path: Column) -> Column:
    """The first two components of a path, joined."""
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB to the base 1024; null stays null."""
    d = n.cast("double")
    return (
        F.when(d < 1024, F.format_string("%.0f B", d))
        .when(d < 1024**2, F.format_string("%.1f KB", d / 1024))
        .when(d < 1024**3, F.format_string("%.1f MB", d / 1024**2))
        .when(d.isNotNull(), F.format_string("%.1f GB", d / 1024**3))
    )


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(3.5)).cast("long")
