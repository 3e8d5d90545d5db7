"""Structural chunks of source files, and the split of chunks that a model would not take.

Python files are cut by their syntax tree; brace languages by a scanner that knows
strings and comments and finds the headers before braces.  What lies between goes
into one chunk of the module level; what cannot be read is cut into line windows.
Known differences to a full grammar: headers over many lines, and macros that open
braces, are left to the module level.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.functions.predicates import LANGUAGES, is_indexable
from sillar.operators.folds import window_lines
from sillar.sources.tables import spread

#: characters from which a chunk is split at once, below which a piece is dropped, and the greatest depth
SPLIT_AT, LEAST_PIECE, MAX_DEPTH = 16_000, 800, 8

OUT = "project_id string, file_path string, chunk_id string, language string, chunk_type string, name string, start_line int, end_line int, code string"

_TEXTS = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\#[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""")
_TYPE = re.compile(r"\b(class|struct|interface|enum|impl|trait|record|union)\s+(?:[\w<>]+\s+for\s+)?([A-Za-z_]\w*)")
_GO_TYPE = re.compile(r"^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b")
_ASSIGNED = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)")
_FUNC = re.compile(r"(?:\b(?:function|func|fn)\s*\*?\s*(?:\([^()]*\)\s*)?([A-Za-z_$][\w$]*)|([A-Za-z_$~][\w$]*))\s*(?:<[^<>]*>)?\s*\([^{};]*$")
_NOT_FUNC = frozenset("if for while switch catch return else do try finally synchronized lock using with match loop unsafe foreach elseif new sizeof typeof throw await yield case default namespace module extern".split())


def _python(text: str) -> list[tuple[str, str, int, int]] | None:
    """(type, name, first line, last line) of classes, functions and their members; None if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")
    out = []

    def lead(line):
        while line > 1 and lines[line - 2].lstrip().startswith("#"):
            line -= 1
        return line

    def visit(body):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *(x.lineno for x in node.decorator_list)])
                if any(getattr(x, "id", getattr(x, "attr", "")) == "overload" for x in node.decorator_list):
                    out.append(("stub", node.name, first, node.end_lineno))
                    continue
                is_class = isinstance(node, ast.ClassDef)
                out.append(("class" if is_class else "function", node.name, lead(first), node.end_lineno))
                if is_class:
                    visit(node.body)

    visit(tree.body)
    return out


def _braces(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """The same for languages with braces, from the headers that stand before them."""
    blank = _TEXTS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "/`\"'" or (m[0][0] == "#" and language == "php") else m[0], text)
    out, stack = [], []
    last = 0  # where the current header begins
    line_of = [0]
    for m in re.finditer("\n", blank):
        line_of.append(m.end())
    from bisect import bisect_right

    lines = text.split("\n")
    for m in re.finditer(r"[{};]", blank):
        c, at = m[0], m.start()
        if c == ";":
            last = m.end()
            continue
        if c == "{":
            head = blank[last:at]
            flat = head.strip()[-2000:]  # a header's end tells what it is
            if language == "go":  # no marks end its statements: the header is the last line, or as many as close its parentheses
                at_line = flat.rfind("\n") + 1
                while at_line and flat.count(")", at_line) > flat.count("(", at_line):
                    at_line = flat.rfind("\n", 0, at_line - 1) + 1
                last += len(head.rstrip()) - len(flat) + at_line
                head, flat = blank[last:at], flat[at_line:]
            kind = name = None
            t = _GO_TYPE.search(flat) if language == "go" else _TYPE.search(flat)
            a = _ASSIGNED.search(flat)
            if t and "(" not in flat[: t.start()]:
                kind, name = "class", t.groups()[-1]
            elif a:
                kind, name = "function", a[1]
            else:
                f = _FUNC.search(flat.split("=>")[0] if language == "c_sharp" else flat)
                if f:
                    n = f[1] or f[2]
                    inside = any(x[0] == "class" for x in stack)
                    if n not in _NOT_FUNC and not (f[2] and not f[1] and flat.rstrip().endswith("=>")) and not any(x[0] in ("function", "method") for x in stack):
                        method = inside and language not in ("go", "rust") or (language == "go" and re.match(r"\s*func\s*\(", flat))
                        kind, name = "method" if method else "function", n
            if any(x[0] in ("function", "method") for x in stack):
                kind = None
            begin = last + len(head) - len(head.lstrip())
            stack.append((kind, name, bisect_right(line_of, begin)))
            last = m.end()
        else:
            if stack:
                kind, name, first = stack.pop()
                if kind:
                    while first > 1 and re.match(r"\s*(?://|/\*|\*|\#\[|@\w)", lines[first - 2]):
                        first -= 1
                    out.append((kind, name, first, bisect_right(line_of, at)))
            last = m.end()
    return sorted(out, key=lambda x: (x[2], -x[3]))


def chunk_text(path: str, text: str | None) -> list[tuple]:
    """(chunk_id, language, type, name, first line, last line, code) of a file's chunks, ids unique, the module level first.

    Blank files give none.  A class is given whole and its members again.
    """
    if text is None or not text.strip():
        return []
    language = LANGUAGES.get(re.search(r"(\.[^./]+)?$", path.lower())[0])
    lines = text.split("\n")
    found = None if language is None else _python(text) if language == "python" else _braces(text, language)
    if found is None:
        return [(f"{path}::{a}-{b}", "unknown", "raw", None, a, b, "\n".join(lines[a - 1 : b])) for _, a, b in window_lines(text)]
    covered = [False] * (len(lines) + 1)
    out, seen = [], set()
    for kind, name, a, b in found:
        for i in range(a, b + 1):
            covered[i] = True
        key = f"{path}::{a}-{b}"
        if kind == "stub" or key in seen:
            continue
        seen.add(key)
        out.append((key, language, kind, name, a, b, "\n".join(lines[a - 1 : b])))
    left, run = [], []
    for i in range(1, len(lines) + 2):
        if i <= len(lines) and not covered[i]:
            run.append(i)
        elif run:
            piece = "\n".join(lines[j - 1] for j in run).strip()
            if piece and not re.fullmatch(r"[{}\s;)(]*|(?:export(?: default)?|(?:declare )?(?:namespace|module) [\w.\"']+)", piece):
                left.append((run, piece))
            run = []
    if not out and not left:
        left = []
    if not out:
        return [(f"{path}::1-{len(lines)}", language, "raw", None, 1, len(lines), text)]
    if left:
        full = [j for run, _ in left for j in run if lines[j - 1].strip()]
        out.insert(0, (f"{path}::module_level", language, "raw", "module_level", full[0], full[-1], "\n\n".join(p for _, p in left)))
    return out


def _chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for project, path, text in zip(b["project_id"], b["path"], b["content"]):
            rows += [(project, path, *c) for c in chunk_text(path, text.removeprefix("﻿").replace("\r\n", "\n") if text else text)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of every indexable file with a text; generated and third-party paths are left out."""
    rows = files.where(is_indexable(F.col("path")) & F.col("content").isNotNull()).select("project_id", "path", "content")
    return spread(rows, "project_id", "path").mapInPandas(_chunk, OUT)


def pieces(code: str, depth: int = 0, at: int = SPLIT_AT) -> list[tuple[str, int, str]]:
    """(suffix, depth, code) of a chunk split in halves at line breaks until each piece fits.

    Pieces of at most 800 characters that still do not fit, and pieces beyond the
    greatest depth, are dropped, as a model would refuse them.
    """
    if len(code) <= at:
        return [("", depth, code)]
    if depth >= MAX_DEPTH or len(code) <= LEAST_PIECE:
        return []
    mid = len(code) // 2
    cut = code.rfind("\n", 0, mid)
    cut = cut if cut > 0 else mid
    out = []
    for side, half in (("L", code[:cut]), ("R", code[cut:])):
        out += [(f"::{side}{depth + 1}{s}", d, c) for s, d, c in pieces(half, depth + 1, at)]
    return out


def split_adaptive(chunks: DataFrame) -> DataFrame:
    """Pieces of every chunk above the limit: (project_id, chunk_id, split_of, split_depth, code)."""

    def run(batches):
        for b in batches:
            rows = [(p, f"{c}{s}", c, d, t) for p, c, code in zip(b["project_id"], b["chunk_id"], b["code"]) for s, d, t in pieces(code)]
            yield pd.DataFrame(rows, columns=["project_id", "chunk_id", "split_of", "split_depth", "code"])

    rows = chunks.where(F.length("code") > SPLIT_AT).select("project_id", "chunk_id", "code")
    return rows.mapInPandas(run, "project_id string, chunk_id string, split_of string, split_depth int, code string")
