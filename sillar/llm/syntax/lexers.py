"""Lexers: source text to terminal numbers, line offsets and line breaks.

Each ``lex_*`` returns (tokens, offsets, breaks): the grammar's terminal numbers
(BAD where no token begins), the character offset of each, and the indexes of
tokens that have a line break before them.  Comments and white space yield
nothing.
"""

from __future__ import annotations

import re

BAD = -1
_BLOCK = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_DQ, _SQ = r'"[^"\\\n]*(?:\\(?:\r\n|[\s\S])[^"\\\n]*)*"', r"'[^'\\\n]*(?:\\(?:\r\n|[\s\S])[^'\\\n]*)*'"
_BT = r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
_IDENT = r"[^\W\d]\w*"


def _ops(words: str) -> str:
    return "|".join(re.escape(w) for w in sorted(words.split(), key=len, reverse=True))


_C_OPS = _ops("+ - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } += -= *= /= %= &= |= ^= == != <= >= && || ++ -- << >>= <<= -> ... :: ## #")
_C_NUM = r"(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*(?:\.[\d']*)?|\.\d[\d']*)(?:[eE][+-]?\d+)?)[uUlLfFzZ]{0,4}(?!\w)"

#: language: (skipped, number, string, character, operators)
_FORMS = {
    "c": (rf"\s+|//[^\n]*|{_BLOCK}|\\\r?\n", _C_NUM, rf"(?:u8|[uUL])?{_DQ}", r"(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n]){1,4}'|(?:u8|[uUL])?'\\[xuU][\da-fA-F]+'", _C_OPS),
    "cpp": (rf"\s+|//[^\n]*|{_BLOCK}|\\\r?\n", _C_NUM, rf'(?:u8|[uUL])?R"(?P<raw>[^()\s\\]{{0,16}})\([\s\S]*?\)(?P=raw)"|(?:u8|[uUL])?{_DQ}', r"(?:u8|[uUL])?'(?:[^'\\\n]|\\[^\n]){1,4}'|(?:u8|[uUL])?'\\[xuU][\da-fA-F]+'", _ops("<=> ->* .*") + "|" + _C_OPS),
    "java": (rf"\s+|//[^\n]*|{_BLOCK}", r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w)", rf'"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""|{_DQ}', r"'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'", _ops("+ - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } += -= *= /= %= &= |= ^= == != <= >= && || ++ -- << <<= -> ... :: @")),
    "c_sharp": (rf"\s+|//[^\n]*|{_BLOCK}", r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?:[uU]?[lL]?|[lL][uU]|[fFdDmM])(?!\w)", rf'\$*"""[\s\S]*?"{{3,}}|(?:\$@|@\$|@)"[^"]*(?:""[^"]*)*"|\$"[^"\\{{\n]*(?:(?:\\.|\{{\{{|\{{[^{{}}\n]*\}})[^"\\{{\n]*)*"|{_DQ}', r"'(?:[^'\\\n]|\\[xuU][\da-fA-F]+|\\.)'", _ops("+ - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } += -= *= /= %= &= |= ^= == != <= >= && || ++ -- << <<= -> => ?? ??= :: ?. .. #")),
    "go": (rf"[ \t\r]+|//[^\n]*|{_BLOCK}", r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)", rf"{_DQ}|`[^`]*`", r"'(?:[^'\\\n]|\\[xuU][\da-fA-F]+|\\[0-7]{3}|\\.)'", _ops("+ - * / % & | ^ ! ~ < > = : ; , . ( ) [ ] { } += -= *= /= %= &= |= ^= &^ &^= == != <= >= && || ++ -- << >> <<= >>= <- := ...")),
    "rust": (rf"\s+|//[^\n]*", r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![._\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)", r'[bc]?r(?P<hash>#*)"[\s\S]*?"(?P=hash)|[bc]?"[^"\\]*(?:\\[\s\S][^"\\]*)*"', r"b?'(?:[^'\\\n]|\\u\{[\da-fA-F_]+\}|\\x[\da-fA-F]{2}|\\.)'", _ops("+ - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } += -= *= /= %= &= |= ^= == != <= >= && || << <<= -> => :: .. ... ..= @ # $")),
}


_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b([^\n]*)")
_PREPROCESSED = ("c", "cpp", "c_sharp")


def _condition(word: str, rest: str) -> tuple[str | None, bool]:
    """(what a branch depends on, the value it asks for); None where the value is fixed."""
    rest = re.sub(r"//.*|/\*.*?\*/", "", rest).strip().rstrip("\\").strip()
    wanted = word not in ("ifndef", "elifndef")
    if word in ("if", "elif"):
        while m := re.fullmatch(r"!\s*(defined\b.*|\w+|\(.*\))", rest):
            rest, wanted = m[1].strip(), not wanted
        if m := re.fullmatch(r"defined\s*\(?\s*(\w+)\s*\)?", rest):
            rest = m[1]
        elif rest in ("0", "false"):
            return None, not wanted
        elif rest in ("1", "true"):
            return None, wanted
    return rest, wanted


def variants(text: str, language: str):
    """The texts that conditional compilation may leave, until every branch was in one of them.

    Each text assumes one value for each condition throughout, so halves of a
    construct that stand under the same condition stay together.  Lines keep their
    numbers.  Branches that no values leave (``#if 0``) are never compiled and
    stay unread.
    """
    if language not in _PREPROCESSED or "#" not in text:
        yield text
        return
    lines = text.split("\n")
    marks = [(i, m[1], m[2]) for i, x in enumerate(lines) if "#" in x and (m := _DIRECTIVE.match(x))]
    # groups: the lines of their branches' marks, and the groups inside each branch
    groups: list[list[tuple[int, str | None, bool]]] = []
    inside: dict[tuple[int, int], list[int]] = {}
    open_: list[int] = []
    for i, word, rest in marks:
        if word in ("if", "ifdef", "ifndef"):
            at = len(groups)
            groups.append([(i, *_condition(word, rest))])
            inside.setdefault((open_[-1], len(groups[open_[-1]]) - 1) if open_ else (-1, 0), []).append(at)
            open_.append(at)
        elif word == "endif":
            if open_:
                groups[open_.pop()].append((i, "", False))
        elif open_:
            groups[open_[-1]].append((i, None, True) if word == "else" else (i, *_condition(word, rest)))
    for at in open_:
        groups[at].append((len(lines), "", False))
    unread = {(g, k) for g, branches in enumerate(groups) for k in range(len(branches) - 1)}

    def waits(g, k):
        return (g, k) in unread or any(waits(x, y) for x in inside.get((g, k), ()) for y in range(len(groups[x]) - 1))

    while True:
        values: dict[str, bool] = {}
        out, read = list(lines), set()
        todo = list(reversed(inside.get((-1, 0), [])))
        while todo:
            g = todo.pop()
            branches = groups[g]
            aim = next((k for k in range(len(branches) - 1) if waits(g, k)), None)
            picked = None
            for k in range(len(branches) - 1):
                _, on, wanted = branches[k]
                if on is None:
                    true = wanted
                else:
                    value = values.setdefault(on, wanted if aim is None or k == aim else not wanted)
                    true = value == wanted
                if true and picked is None:
                    picked = k
                    read.add((g, k))
                    todo += reversed(inside.get((g, k), []))
                    break
            for k in range(len(branches) - 1):
                if k != picked:
                    a, b = branches[k][0] + 1, branches[k + 1][0]
                    out[a:b] = [""] * (b - a)
        if not read & unread and len(unread) < sum(len(b) - 1 for b in groups):
            return
        unread -= read
        yield "\n".join(out)
        if not unread:
            return


_CPP_LINE = r"(?:(?<=\n)|(?<![\s\S]))[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|error|warning|pragma|line|region|endregion|nullable|import)?\b[^\n]*(?:(?<=\\)\n[^\n]*|(?<=\\\r)\n[^\n]*)*"


def _plain(language: str):
    skip, num, string, char, ops = _FORMS[language]
    if language in _PREPROCESSED:
        skip = rf"{_CPP_LINE}|{skip}"
    ident = {"rust": r"'(?!\w')" + _IDENT + r"|r\#" + _IDENT + "|" + _IDENT, "c_sharp": "@?" + _IDENT, "java": r"[^\W\d][\w$]*|\$[\w$]*"}.get(language, _IDENT)
    order = rf"(?P<skip>{skip})|(?P<nl>\n)|(?P<str>{string})|(?P<chr>{char})|(?P<id>{ident})|(?P<num>{num})|(?P<op>{ops})|(?P<bad>[\s\S])"
    if language == "rust":
        order = order.replace("(?P<bad>", r"(?P<nest>/\*)|(?P<bad>").replace(rf"(?P<op>{ops})", rf"(?P<op>(?!/\*)(?:{ops}))")
    scan = re.compile(order)
    go = language == "go"

    def lex(text, terms):
        ID, NUM, STR, CHR = terms.get("ID", BAD), terms.get("NUM", BAD), terms.get("STR", BAD), terms.get("CHR", BAD)
        LIFE = terms.get("LIFE", BAD)
        toks, offs = [], []
        semi = False
        get = terms.get
        at, n = 0, len(text)
        ends = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
        SEMI = terms.get(";", BAD)
        while at < n:
            for m in scan.finditer(text, at):
                kind = m.lastgroup
                if kind == "raw" or kind == "hash":
                    kind = "str"
                if kind == "skip":
                    if go and semi and "\n" in m[0]:
                        toks.append(SEMI)
                        offs.append(m.start())
                        semi = False
                    continue
                if kind == "nl":
                    if semi:
                        toks.append(SEMI)
                        offs.append(m.start())
                        semi = False
                    continue
                if kind == "id":
                    w = m[0]
                    if w[0] == "'":
                        t = LIFE
                    else:
                        t = get(w, ID)
                    if go:
                        semi = t == ID or w in ends
                elif kind == "op":
                    w = m[0]
                    t = get(w, BAD)
                    if go:
                        semi = w in ends
                elif kind == "nest":
                    depth, p = 1, m.end()
                    step = re.compile(r"/\*|\*/")
                    while depth:
                        x = step.search(text, p)
                        if not x:
                            break
                        depth += 1 if x[0] == "/*" else -1
                        p = x.end()
                    if depth:
                        toks.append(BAD)
                        offs.append(m.start())
                        return toks, offs, None
                    at = p
                    break
                else:
                    t = NUM if kind == "num" else STR if kind == "str" else CHR if kind == "chr" else BAD
                    semi = go
                toks.append(t)
                offs.append(m.start())
                if t == BAD:
                    return toks, offs, None
            else:
                at = n
        if go and semi:
            toks.append(SEMI)
            offs.append(n)
        return toks, offs, None

    return lex


# --- Python -----------------------------------------------------------------

_PY_STR = r'(?:[rRbBuUfF]|[rRfF][bB]|[bB][rR]|[fF][rR])?(?:"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""|\'\'\'[^\'\\]*(?:(?:\\[\s\S]|\'(?!\'\'))[^\'\\]*)*\'\'\'|(?!"""|\'\'\')(?:' + _DQ + "|" + _SQ + "))"
_PY = re.compile(
    rf"(?P<skip>[ \t\f]+|\\\r?\n)|(?P<cmt>\#[^\n]*)|(?P<nl>\r?\n|\r)|(?P<str>{_PY_STR})|(?P<id>{_IDENT})"
    r"|(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w))"
    r"|(?P<op>" + _ops("+ - * ** / // % @ << >> & | ^ ~ := < > <= >= == != ( ) [ ] { } , : . ; = -> += -= *= /= //= %= @= &= |= ^= >>= <<= **= ...") + r")|(?P<bad>[\s\S])"
)


def _lex_python(text, terms):
    ID, NUM, STR = terms["ID"], terms["NUM"], terms["STR"]
    NL, IN, OUT = terms["NEWLINE"], terms["INDENT"], terms["DEDENT"]
    toks, offs, levels, depth, fresh = [], [], [0], 0, True
    get, start = terms.get, 0
    opened = []
    pair = {")": "(", "]": "[", "}": "{"}
    for m in _PY.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "cmt":
            continue
        if kind == "nl":
            if not depth:
                if not fresh:
                    toks.append(NL)
                    offs.append(m.start())
                fresh, start = True, m.end()
            continue
        if fresh:
            width = 0
            for ch in text[start:m.start()]:
                width = width + 1 if ch == " " else width // 8 * 8 + 8 if ch == "\t" else 0 if ch == "\f" else width
            if width > levels[-1]:
                levels.append(width)
                toks.append(IN)
                offs.append(m.start())
            else:
                while width < levels[-1]:
                    levels.pop()
                    toks.append(OUT)
                    offs.append(m.start())
                if width != levels[-1]:
                    toks.append(BAD)
                    offs.append(m.start())
                    return toks, offs, None
            fresh = False
        if kind == "id":
            t = get(m[0], ID)
        elif kind == "op":
            w = m[0]
            if w in "([{":
                depth += 1
                opened.append(w)
            elif w in ")]}":
                if not opened or opened.pop() != pair[w]:
                    toks.append(BAD)
                    offs.append(m.start())
                    return toks, offs, None
                depth -= 1
            t = get(w, BAD)
        else:
            t = NUM if kind == "num" else STR if kind == "str" else BAD
        toks.append(t)
        offs.append(m.start())
        if t == BAD:
            return toks, offs, None
    if depth:
        return [*toks, BAD], [*offs, len(text)], None
    if not fresh:
        toks.append(NL)
        offs.append(len(text))
    for _ in levels[1:]:
        toks.append(OUT)
        offs.append(len(text))
    return toks, offs, None


# --- JavaScript, TypeScript -------------------------------------------------

_JS_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$])"
_JS_OPS = _ops("+ - * ** / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } += -= *= **= /= %= &= |= ^= == != === !== <= >= && || ?? &&= ||= ??= ++ -- << <<= ?. ... => @")
_JS = re.compile(
    rf"(?P<skip>(?:[ \t\f\v\u00a0\ufeff]+|//[^\n]*|{_BLOCK}|<!--[^\n]*|\s)+)|(?P<id>\#?(?:[^\W\d]|\$|\\u[\da-fA-F]{{4}})(?:[\w$]|\\u[\da-fA-F]{{4}})*)|(?P<num>{_JS_NUM})|(?P<str>{_DQ}|{_SQ})|(?P<tpl>`)|(?P<op>{_JS_OPS})|(?P<bad>[\s\S])"
)
_JS_RE = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TPL_PART = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*(`|\$\{)")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_JSX_SPACE = re.compile(r"\s*")
_ENDS_VALUE = {")", "]", "}", "this", "super", "null", "true", "false"}


def _script(jsx: bool, typed: bool):
    def lex(text, terms):
        toks, offs, breaks = [], [], set()
        ID, NUM, STR, REGEX, TPL, TS_, TM, TE = (terms[x] for x in ("ID", "NUM", "STR", "REGEX", "TPL", "TPL_S", "TPL_M", "TPL_E"))
        if jsx:
            JB, JE, JL, JR = (terms[x] for x in ("JSX_B", "JSX_E", "JSX_L", "JSX_R"))
        get, match = terms.get, _JS.match
        n = len(text)

        class Stop(Exception):
            pass

        def bad(at):
            toks.append(BAD)
            offs.append(at)
            raise Stop

        def put(t, at):
            toks.append(t)
            offs.append(at)

        def template(at, head):
            """at: after the opening mark or the closing brace; returns (position, more)."""
            m = _TPL_PART.match(text, at)
            if not m:
                bad(at)
            more = m[1] == "${"
            put((TS_ if more else TPL) if head else (TM if more else TE), at)
            return m.end(), more

        def element(at):
            """A JSX element at its '<'; its embedded expressions are lexed in place."""
            space = lambda p: _JSX_SPACE.match(text, p).end()
            at = space(at + 1)
            m = _JSX_NAME.match(text, at)
            name = m[0] if m else ""
            at = space(m.end() if m else at)
            if m and typed and text.startswith("<", at):
                close = re.compile(r"<[^<>()]*>").match(text, at)
                if not close:
                    bad(at)
                at = space(close.end())
            while True:
                if at >= n:
                    bad(n)
                c = text[at]
                if c == ">":
                    at += 1
                    break
                if c == "/":
                    at = space(at + 1)
                    if not text.startswith(">", at) or not name:
                        bad(at)
                    return at + 1
                if not name:
                    bad(at)
                if c == "{":
                    put(JL, at)
                    at = space(code(at + 1, True))
                    continue
                m = _JSX_NAME.match(text, at)
                if not m:
                    bad(at)
                at = space(m.end())
                if text.startswith("=", at):
                    at = space(at + 1)
                    if text.startswith("{", at):
                        put(JL, at)
                        at = code(at + 1, True)
                    elif text[at:at + 1] in ('"', "'"):
                        end = text.find(text[at], at + 1)
                        if end < 0:
                            bad(at)
                        at = end + 1
                    elif text.startswith("<", at):
                        at = element(at)
                    else:
                        bad(at)
                    at = space(at)
            stop = re.compile(r"[<{}>]")
            while True:
                m = stop.search(text, at)
                if not m or m[0] in "}>":
                    bad(m.start() if m else n)
                at = m.start()
                if m[0] == "{":
                    put(JL, at)
                    at = code(at + 1, True)
                    continue
                after = space(at + 1)
                if text.startswith("/", after):
                    after = space(after + 1)
                    m = _JSX_NAME.match(text, after)
                    if (m[0] if m else "") != name:
                        bad(at)
                    after = space(m.end() if m else after)
                    if not text.startswith(">", after):
                        bad(after)
                    return after + 1
                at = element(at)

        def code(at, inner):
            """Tokens from at on; inner: up to the brace that closes an embedded expression."""
            braces = []  # True: a template's
            value = False
            prev = ""
            while at < n:
                m = match(text, at)
                kind = m.lastgroup
                if kind == "skip":
                    if "\n" in m[0]:
                        breaks.add(len(toks))
                        if prev in ("return", "break", "continue", "throw"):
                            put(terms[";"], at)
                            prev, value = ";", False
                            breaks.add(len(toks))
                    at = m.end()
                    continue
                w = m[0]
                if kind == "id":
                    after_dot = prev in (".", "?.")
                    t = ID if after_dot or "\\" in w else get(w, ID)
                    if w[0] == "#":
                        t = ID
                    put(t, at)
                    value = t == ID or w in _ENDS_VALUE or w in ("of", "as", "async", "get", "set", "static", "from", "let", "any", "number", "string", "boolean", "unknown", "never", "object", "symbol", "void" if typed else "any")
                    prev = w if not after_dot else "name"
                    at = m.end()
                elif kind == "op":
                    if w in ("/", "/=") and not value:
                        r = _JS_RE.match(text, at)
                        if not r:
                            bad(at)
                        put(REGEX, at)
                        at, value, prev = r.end(), True, "re"
                        continue
                    if w[0] == "<" and jsx and not value and (typed is False or not re.compile(r"<\s*[\w$]+\s*(?:,|extends\b)|<\s*(?:const\s)").match(text, at)) and re.compile(r"<\s*[A-Za-z_$>]").match(text, at):
                        put(JB, at)
                        at = element(at)
                        put(JE, at)
                        value, prev = True, "jsx"
                        continue
                    if w in ("++", "--") and value and len(toks) in breaks:
                        put(terms[";"], at)  # no postfix operator after a line break
                    if w == "?." and text[at + 2:at + 3].isdigit():
                        w = "?"
                    if w == "{":
                        braces.append(False)
                    elif w == "}":
                        if not braces:
                            if inner:
                                put(JR, at)
                                return at + 1
                        elif braces.pop():
                            at, more = template(at + 1, False)
                            if more:
                                braces.append(True)
                            value, prev = not more, "tpl"
                            continue
                    put(get(w, BAD), at)
                    if toks[-1] == BAD:
                        raise Stop
                    value = w in (")", "]", "}")
                    prev = w
                    at += len(w)
                elif kind == "tpl":
                    at, more = template(at + 1, True)
                    if more:
                        braces.append(True)
                    value, prev = not more, "tpl"
                elif kind == "bad":
                    bad(at)
                else:
                    put(NUM if kind == "num" else STR, at)
                    at, value, prev = m.end(), True, kind
            if inner or any(braces):
                bad(n)
            return n

        try:
            start = re.compile(r"#![^\n]*").match(text)
            code(start.end() if start else 0, False)
        except (Stop, RecursionError):
            if not toks or toks[-1] != BAD:
                toks.append(BAD)
                offs.append(n)
        return toks, offs, breaks

    return lex


# --- PHP --------------------------------------------------------------------

_PHP_OPS = _ops("+ - * ** / % . & | ^ ! ~ < > = ? : ; , ( ) [ ] { } += -= *= **= /= .= %= &= |= ^= == != === !== <> <= >= <=> && || ?? ??= ++ -- << >> <<= >>= -> ?-> => :: ... @ $ \\ |> #[")
_PHP = re.compile(
    rf"(?P<skip>\s+|//(?:[^?\n]|\?(?!>))*|\#(?!\[)(?:[^?\n]|\?(?!>))*|{_BLOCK})|(?P<end>\?>\r?\n?)"
    r"|(?P<here><<<[ \t]*(?P<q>[\"']?)(?P<tag>[^\W\d]\w*)(?P=q)\r?\n(?:[\s\S]*?\r?\n)??[ \t]*(?P=tag)\b)"
    rf"|(?P<str>[bB]?(?:\"[^\"\\]*(?:\\[\s\S][^\"\\]*)*\"|'[^'\\]*(?:\\[\s\S][^'\\]*)*')|{_BT})|(?P<var>\${_IDENT})"
    rf"|(?P<cast>\([ \t]*(?:int|integer|float|double|string|bool|boolean|array|object|unset)[ \t]*\))|(?P<id>{_IDENT})"
    rf"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.(?:\d[\d_]*)?|\.\d[\d_]*|\d[\d_]*)(?:[eE][+-]?\d+)?)(?!\w))|(?P<op>{_PHP_OPS})|(?P<bad>[\s\S])",
    re.I,
)
_PHP_OPEN = re.compile(r"<\?(?:php(?=\s|$)|=)", re.I)


def _lex_php(text, terms):
    toks, offs = [], []
    ID, NUM, STR, VAR, CAST, SEMI, HTML = (terms[x] for x in ("ID", "NUM", "STR", "VAR", "CAST", ";", "HTML"))
    get, n, at = terms.get, len(text), 0
    prev = ""
    if text.startswith("#!"):
        at = text.find("\n") + 1 or n
    while at < n:
        m = _PHP_OPEN.search(text, at)
        stop = m.start() if m else n
        if text[at:stop].strip():
            toks.append(HTML)
            offs.append(at)
        if not m:
            break
        at = m.end()
        if m[0] == "<?=":
            toks.append(get("echo", BAD))
            offs.append(m.start())
        while at < n:
            m = _PHP.match(text, at)
            kind, w = m.lastgroup, m[0]
            begin, at = at, m.end()
            if kind == "skip":
                continue
            if kind == "end":
                toks.append(SEMI)
                offs.append(begin)
                prev = ";"
                break
            if kind == "id":
                t = ID if prev in ("->", "?->") else get(w.lower(), ID)
            elif kind == "op":
                t = get(w, BAD)
            else:
                t = {"num": NUM, "str": STR, "here": STR, "tag": STR, "q": STR, "var": VAR, "cast": CAST}.get(kind, BAD)
            prev = w
            toks.append(t)
            offs.append(begin)
            if t == BAD:
                return toks, offs, None
    return toks, offs, None


LEXERS = {k: _plain(k) for k in _FORMS} | {"python": _lex_python, "javascript": _script(True, False), "typescript": _script(False, True), "tsx": _script(True, True), "php": _lex_php}
