"""Comments and string literals of a source file, by the syntax it really has.

The scanners go on after errors (truncation, merge marks), so they serve files
that do not parse; ``actual_language`` decides the syntax of misnamed files.
"""

from __future__ import annotations

import re

_LINE_STR = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|\'(?:[^\'\\\n]|\\(?:\r\n|[\s\S]))*\''
_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
_C = re.compile(rf"(?P<cmt>//[^\n]*|{_BLOCK})|(?P<str>{_LINE_STR})")
_SCAN = {
    "python": re.compile(rf'(?P<cmt>\#[^\n]*)|(?P<str>[rRbBuUfF]{{0,2}}(?:"""[\s\S]*?(?:(?<!\\)"""|\Z)|\'\'\'[\s\S]*?(?:(?<!\\)\'\'\'|\Z)|{_LINE_STR}))'),
    "script": re.compile(rf"(?P<cmt>//[^\n]*|{_BLOCK})|(?P<re>(?<=[=(,:;!&|?\[])\s*/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/)|(?P<str>{_LINE_STR}|`(?:[^`\\]|\\[\s\S])*`)"),
    "go": re.compile(rf"(?P<cmt>//[^\n]*|{_BLOCK})|(?P<str>{_LINE_STR}|`[^`]*`)"),
    "rust": re.compile(rf"(?P<cmt>//[^\n]*|{_BLOCK})|(?P<life>'\w+(?!'))|(?P<str>[bc]?r(?P<hash>\#*)\"[\s\S]*?\"(?P=hash)|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.)')"),
    "java": re.compile(rf'(?P<cmt>//[^\n]*|{_BLOCK})|(?P<str>"""[\s\S]*?"""|{_LINE_STR})'),
    "c_sharp": re.compile(rf'(?P<cmt>//[^\n]*|{_BLOCK})|(?P<str>\$*"""[\s\S]*?"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|{_LINE_STR})'),
    "c": re.compile(rf"(?P<inc>(?m:^[ \t]*\#[ \t]*include[^\n]*))|(?P<cmt>//[^\n]*|{_BLOCK})|(?P<str>R\"(?P<hash>[^()\s\\]{{0,16}})\([\s\S]*?\)(?P=hash)\"|{_LINE_STR})"),
    "php": re.compile(rf"(?P<cmt>//[^\n]*|\#(?!\[)[^\n]*|{_BLOCK})|(?P<str>\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|<<<[ \t]*[\"']?(?P<tag>[^\W\d]\w*)[\"']?\r?\n[\s\S]*?\n[ \t]*(?P=tag)\b)"),
    "json": re.compile(r'(?P<str>"(?:[^"\\\n]|\\.)*")'),
    "none": re.compile(r"(?P<cmt>(?!))"),
}
_FAMILY = {"python": "python", "javascript": "script", "typescript": "script", "tsx": "script", "go": "go", "rust": "rust", "java": "java", "c_sharp": "c_sharp", "c": "c", "cpp": "c", "php": "php", "json": "json", "none": "none"}

#: line patterns by which a misnamed file's language shows
_CUES = {
    "python": r"^[ \t]*(?:def \w+\(.*|class \w+(?:\(.*\))?:|elif .*:|(?:if|for|while|with|try|except|else)\b.*:)$|^(?:import [\w.]+(?: as \w+)?|from [\w.]+ import .+)$",
    "go": r"^package \w+$|^func [\w(].*\{$|^[ \t]*\w+ := |^\t(?:if|for) [^(].*\{$",
    "rust": r"^[ \t]*(?:pub )?(?:fn|struct|impl|mod|enum|trait) .*\{$|^[ \t]*(?:pub )?use [\w:{}, ]+;$|^[ \t]*let (?:mut )?\w+.* = .*;$|^[ \t]*pub const \w+: .*;$",
    "java": r"^package [\w.]+;$|^import (?:static )?[\w.*]+;$|^[ \t]*(?:public|private|protected) .*[{;]$|^[ \t]*(?:String|boolean|final) \w+",
    "c_sharp": r"^using [\w.]+;$|^namespace [\w.]+|^[ \t]*(?:public|private|internal|protected) .*|^[ \t]*var \w+ = .*;$",
    "cpp": r"^#include [<\"].*|^[ \t]*(?:public|private|protected):$|^[ \t]*auto \w+ = .*;$|std::\w+|^template\s*<|^namespace \w+ \{|^using namespace",
    "c": r"^#(?:include|define|ifdef|ifndef|endif)\b.*|^(?:static |const )*(?:int|void|char|long|struct \w+) \*?\w+\(.*",
    "php": r"^<\?php|^[ \t]*\$\w+ = .*;$|^namespace [\w\\]+;$|^[ \t]*(?:public |private |static )*function \w+\(\$?.*",
    "javascript": r"^[ \t]*(?:export |default |async )*function\b.*\{$|^[ \t]*(?:export )?(?:const|let|var) [\w{\[].*|^(?:import|export) .*from .*;?$|^import \{.*|=> \{$|console\.\w+\(",
    "typescript": r"^[ \t]*(?:export )?(?:interface|type|enum) \w+|^[ \t]*(?:export )?(?:const|let|var) \w+: .*|\): [\w\[\]]+ \{$|\w: (?:number|string|any|boolean)\b",
}
_CUE = {k: re.compile(v, re.M) for k, v in _CUES.items()}
_HTML = re.compile(r"\s*<(?:!doctype|html|\?xml)\b", re.I)


def actual_language(text: str, declared: str) -> str:
    """The language whose line patterns prevail; the declared one where nothing speaks against it."""
    if text[:300].lstrip("\ufeff \t\r\n").startswith("<?php"):
        return "php"
    if _HTML.match(text.lstrip("\ufeff")):
        return "none"
    if text[:300].lstrip("\ufeff \t\r\n").startswith("{") and re.match(r'\s*\{\s*"[^"\n]*"\s*:', text.lstrip("\ufeff")):
        return "json"
    plain = text.replace("\r", "")
    hits = {k: len(rx.findall(plain)) for k, rx in _CUE.items()}
    if "<?" not in plain:
        hits["php"] = 0
    if declared in ("typescript", "tsx"):
        hits[declared] = hits["typescript"] + hits["javascript"]
    if declared == "cpp":
        hits["cpp"] += hits["c"]
    best = max(hits, key=lambda k: (hits[k], k == declared))
    if hits[best] > 2 * hits.get(declared, 0):
        return best
    if not any(hits.values()) and plain.count("\n") >= 2 and all(x.count(",") == plain.split("\n", 1)[0].count(",") > 0 for x in plain.strip().split("\n")):
        return "none"  # tables
    return declared


def spans(text: str, language: str):
    """(kind, start, end) of every comment ('cmt') and string literal ('str')."""
    for m in _SCAN[_FAMILY.get(language, "c")].finditer(text):
        kind = m.lastgroup
        if kind in ("hash", "tag"):
            kind = "str"
        if kind in ("cmt", "str"):
            yield kind, m.start(), m.end()


_ESC = re.compile(r"\\(?:u\{([\da-fA-F]{1,6})\}|u([\da-fA-F]{4})|U([\da-fA-F]{8})|x([\da-fA-F]{2})|([0-7]{1,3})|([\s\S]))")
_PLAIN = {"n": "\n", "t": " ", "r": "\n", "0": " ", "\n": "", "b": " ", "f": " ", "v": " "}


def unescape(body: str) -> str:
    """Escape sequences as the characters they stand for; surrogate pairs are joined."""
    if "\\" not in body:
        return body

    def one(m):
        code = m[1] or m[2] or m[3] or m[4]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 else " "
        if m[5]:
            return chr(int(m[5], 8) & 0xFF)
        return _PLAIN.get(m[6], m[6])

    out = _ESC.sub(one, body)
    if re.search("[\ud800-\udfff]", out):
        out = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if re.search("[\xc3-\xf4][\x80-\xbf]", out) and "\\x" in body:
        try:
            out = out.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return out


def inner(kind: str, raw: str) -> str:
    """The text of a comment or literal without its marks."""
    if kind == "cmt":
        if raw.startswith("/*"):
            body = raw[2:-2] if raw.endswith("*/") and len(raw) > 3 else raw[2:]
            return "\n".join(re.sub(r"^\s*[*!]+ ?", "", x) for x in body.split("\n"))
        return re.sub(r"^(?://[/!]*|#+!?)", "", raw)
    m = re.match(r"""(?:[A-Za-z$@]{0,3}\#*)("{3,}|'''|["'`])""", raw)
    if not m:
        return raw
    verbatim = "r" in raw[: m.start(1)].lower() or "@" in raw[: m.start(1)]
    body = raw[m.end() :]
    close = m[1]
    body = body[: -len(close)] if body.endswith(close) else body
    return body if verbatim else unescape(body)
