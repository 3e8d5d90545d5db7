"""Text functions of the documentation roll-up, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a courtesy line before an answer, and the limits of shortening.
PREAMBLES = ["respuesta completa", "en español", "en inglés", "in english", "the response", "la respuesta", "i will respond", "aquí está", "aquí tienes", "a continuación", "below is", "here is", "responderé"]
LEVELS = (350, 200, 120, 70)
BLANK = r"[ \t\n\x0B\f\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(t: Column) -> Column:
    """Blanks of any script removed at both ends."""
    return F.regexp_replace(t, f"^{BLANK}+|{BLANK}+$", "")


def collapse(t: Column) -> Column:
    return strip(F.regexp_replace(t, f"{BLANK}+", " "))


def shorten(t: Column, limit: int) -> Column:
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), f"{BLANK}+$", ""), F.lit("…")))


def purpose(markdown: Column) -> Column:
    """The section 'Propósito', else the lines that are neither headings nor quotations."""
    flat = F.regexp_replace(markdown, "\r\n|\r", "\n")
    section = F.regexp_extract(flat, r"(?ims)^##\s+Prop[oóOÓ]sito[^\S\n]*$(.*?)(?=^##\s|\z)", 1)
    lines = F.filter(F.split(flat, "\n"), lambda x: (strip(x) != "") & ~x.startswith("#") & ~x.startswith(">"))
    return collapse(F.when(flat.rlike(r"(?im)^##\s+Prop[oóOÓ]sito[^\S\n]*$"), section).otherwise(F.array_join(lines, "\n")))


def strip_preamble(t: Column, heading: str | None = "##") -> Column:
    """Drops what stands before a heading near the start, then a short first line that speaks of the answer itself."""
    if heading:
        at = F.locate(heading, t)
        t = F.when(at.between(2, 300), strip(F.substring(t, at, F.length(t)))).otherwise(t)
    first = F.substring_index(t, "\n", 1)
    rest = F.when(F.instr(t, "\n") > 0, F.substring(t, F.length(first) + 2, F.length(t))).otherwise(F.lit(""))
    marked = F.lit(False)
    for m in PREAMBLES:
        marked = marked | F.lower(first).contains(m)
    return F.when((rest != "") & (F.length(first) < 200) & marked, strip(rest)).otherwise(t)
