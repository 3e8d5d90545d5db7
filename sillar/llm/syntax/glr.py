"""A table-driven recogniser: SLR(1) tables run over several stacks at once.

``compile_grammar`` turns a grammar text into action and goto tables; where the
tables hold more than one action, ``recognise`` follows all of them.  Stacks are
linked nodes that are shared while more than one of them is alive, so readings
of a local ambiguity that end in the same non-terminal fall together again, and
most tokens are handled by the single-stack loop.  Only validity is decided, so
grammars may leave out operator precedence.

Grammar text: ``name : alternatives ;`` with ``|``, groups in parentheses,
``?  *  +`` and ``%`` (one or more, separated by commas) and ``%%`` (the same,
a comma may follow).  Quoted words and upper-case names are terminals.
"""

from __future__ import annotations

import re

END = 0
_TOKEN = re.compile(r"""\s*(?:(?P<lit>'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<op>%%|[:;|()?*+%]))""")


class Tables:
    """What a worker needs to run a grammar; plain data, so that it pickles well."""

    def __init__(self, terms, action, goto, prods, start):
        self.terms, self.action, self.goto, self.prods, self.start = terms, action, goto, prods, start


def _read(text):
    text = re.sub(r"(?m)^\s*#.*$", "", text)
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at:at + 40]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text):
        self.toks, self.at, self.rules, self.made, self.n = _read(text), 0, {}, {}, 0

    def fresh(self, key, alternatives):
        if key not in self.made:
            self.n += 1
            name = self.made[key] = f"@{self.n}"
            self.rules[name] = alternatives(name)
        return self.made[key]

    def peek(self):
        return self.toks[self.at][1] if self.at < len(self.toks) else None

    def grammar(self):
        first = None
        while self.at < len(self.toks):
            name = self.toks[self.at][1]
            assert self.toks[self.at + 1][1] == ":", f"':' after {name}"
            self.at += 2
            first = first or name
            self.rules.setdefault(name, []).extend(self.alternatives())
            assert self.peek() == ";", f"';' after {name}, not {self.peek()}"
            self.at += 1
        return first

    def alternatives(self):
        out = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            out.append(self.sequence())
        return out

    def sequence(self):
        out = []
        while self.peek() not in ("|", ")", ";", None):
            kind, word = self.toks[self.at]
            self.at += 1
            if word == "(" and kind == "op":
                inner = self.alternatives()
                assert self.peek() == ")", "')'"
                self.at += 1
                sym = self.fresh(("group", tuple(map(tuple, inner))), lambda _, a=inner: a)
            else:
                sym = word[1:-1] if kind == "lit" else word
                if kind == "lit":
                    sym = "'" + sym
            while self.peek() in ("?", "*", "+", "%", "%%"):
                op = self.peek()
                self.at += 1
                some = lambda name, s=sym: [[s], [name, s]]
                if op == "?":
                    sym = self.fresh((sym, "?"), lambda _, s=sym: [[], [s]])
                elif op == "+":
                    sym = self.fresh((sym, "+"), some)
                elif op == "*":
                    # empty first, then longer: a list before an optional item keeps one stack
                    sym = self.fresh((sym, "*"), lambda name, s=sym: [[], [name, s]])
                else:
                    listed = self.fresh((sym, "%"), lambda name, s=sym: [[s], [name, "',", s]])
                    sym = listed if op == "%" else self.fresh((sym, "%%"), lambda _, s=listed: [[s], [s, "',"]])
            out.append(sym)
        return out


def compile_grammar(text: str) -> Tables:
    reader = _Reader(text)
    start = reader.grammar()
    rules = reader.rules
    is_term = lambda s: s not in rules and (s[0] == "'" or s.isupper() or s.replace("_", "").isupper())
    terms, nts = {"$": END}, {name: i for i, name in enumerate(rules)}
    prods, by_lhs = [], {}
    for lhs, alts in [("@start", [[start]]), *rules.items()]:
        for alt in alts:
            for s in alt:
                if s not in rules:
                    assert is_term(s), f"unknown symbol {s} in {lhs}"
                    terms.setdefault(s, len(terms))
            by_lhs.setdefault(lhs, []).append(len(prods))
            prods.append((lhs, tuple(alt)))
    nullable, again = set(), True
    while again:
        again = False
        for lhs, rhs in prods:
            if lhs not in nullable and all(s in nullable for s in rhs):
                nullable.add(lhs)
                again = True
    first = {s: {s} for s in terms} | {n: set() for n in [*rules, "@start"]}
    again = True
    while again:
        again = False
        for lhs, rhs in prods:
            for s in rhs:
                if not first[s] <= first[lhs]:
                    first[lhs] |= first[s]
                    again = True
                if s not in nullable:
                    break
    follow = {n: set() for n in [*rules, "@start"]}
    follow["@start"].add("$")
    again = True
    while again:
        again = False
        for lhs, rhs in prods:
            trail = follow[lhs]
            for s in reversed(rhs):
                if s in rules:
                    if not trail <= follow[s]:
                        follow[s] |= trail
                        again = True
                    trail = trail | first[s] if s in nullable else first[s]
                else:
                    trail = first[s]

    closed: dict[str, frozenset] = {}

    def opened(nt):
        """Productions that begin wherever nt may begin."""
        if nt not in closed:
            seen, todo = {nt}, [nt]
            while todo:
                for p in by_lhs[todo.pop()]:
                    rhs = prods[p][1]
                    if rhs and rhs[0] in rules and rhs[0] not in seen:
                        seen.add(rhs[0])
                        todo.append(rhs[0])
            closed[nt] = frozenset(seen)
        return closed[nt]

    kernels, todo, moves = {((0, 0),): 0}, [((0, 0),)], []
    complete = []
    while todo:
        kernel = todo.pop(0)
        nts_in = set()
        for p, d in kernel:
            rhs = prods[p][1]
            if d < len(rhs) and rhs[d] in rules:
                nts_in |= opened(rhs[d])
        out, done = {}, []
        for p, d in kernel:
            rhs = prods[p][1]
            if d == len(rhs):
                done.append(p)
            else:
                out.setdefault(rhs[d], []).append((p, d + 1))
        for n in nts_in:
            for p in by_lhs[n]:
                rhs = prods[p][1]
                if rhs:
                    out.setdefault(rhs[0], []).append((p, 1))
                else:
                    done.append(p)
        row = {}
        for s, items in out.items():
            k = tuple(sorted(items))
            if k not in kernels:
                kernels[k] = len(kernels)
                todo.append(k)
            row[s] = kernels[k]
        moves.append(row)
        complete.append(done)
    action, goto = [], []
    for row, done in zip(moves, complete):
        acts: dict[int, list[int]] = {}
        for s, to in row.items():
            if s in terms:
                acts.setdefault(terms[s], []).append(to)
        for p in done:
            for t in follow[prods[p][0]]:
                acts.setdefault(terms[t], []).append(~p)
        action.append({t: a[0] if len(a) == 1 else tuple(a) for t, a in acts.items()})
        goto.append({nts[s]: to for s, to in row.items() if s in rules})
    sizes = [(len(rhs), nts.get(lhs, -1)) for lhs, rhs in prods]
    return Tables({k.lstrip("'") if len(k) > 1 else k: v for k, v in terms.items()}, action, goto, sizes, 0)


def recognise(t: Tables, tokens, insert=None):
    """Index of the first token that no reading accepts, or None if all is valid.

    tokens: terminal numbers, without END.  insert(i): a terminal that may be put
    in before token i where nothing else fits (automatic semicolons), or None.
    """
    action, goto, prods = t.action, t.goto, t.prods
    node = (0, None)
    alive = None  # several stacks
    intern: dict = {}
    n = len(tokens)
    i = 0
    while i <= n:
        tok = tokens[i] if i < n else END
        if alive is None:
            top = node
            while True:
                a = action[top[0]].get(tok)
                if a is None:
                    break
                if a.__class__ is int:
                    if a >= 0:
                        top = (a, top)
                        break
                    if a == -1:  # the start rule
                        return None
                    size, lhs = prods[~a]
                    while size:
                        top = top[1]
                        size -= 1
                    top = (goto[top[0]][lhs], top)
                else:
                    break
            if a.__class__ is int:
                node = top
                i += 1
                continue
            if a is not None:
                alive = [top]
                intern = {}
                # from here on the several-stack loop takes this token
            else:
                put = insert(i) if insert else None
                if put is None:
                    return i
                got = _step(action, goto, prods, [node], put, {})
                if not got:
                    return i
                insert_at = _step(action, goto, prods, got, tok, {})
                if not insert_at and insert_at is not True:
                    return i
                if insert_at is True:
                    return None
                alive, intern = insert_at, {}
                i += 1
                if len(alive) == 1:
                    node, alive = alive[0], None
                continue
        got = _step(action, goto, prods, alive, tok, intern)
        if got is True:
            return None
        if not got:
            put = insert(i) if insert else None
            got = put is not None and _step(action, goto, prods, alive, put, intern)
            got = got and _step(action, goto, prods, got, tok, intern)
            if got is True:
                return None
            if not got:
                return i
        i += 1
        if len(got) == 1:
            node, alive = got[0], None
        else:
            alive = got
    return n


def _step(action, goto, prods, alive, tok, intern):
    """The stacks after tok; True when the input is accepted."""
    out, seen, todo = [], set(), list(alive)
    for x in todo:
        seen.add(id(x))
    taken = set()
    accepted = False
    while todo:
        top = todo.pop()
        a = action[top[0]].get(tok)
        if a is None:
            continue
        for one in (a,) if a.__class__ is int else a:
            if one >= 0:
                key = (one, id(top))
                new = intern.get(key)
                if new is None:
                    new = intern[key] = (one, top)
                if id(new) not in taken:
                    taken.add(id(new))
                    out.append(new)
            elif one == -1:
                accepted = True
            else:
                size, lhs = prods[~one]
                base = top
                while size:
                    base = base[1]
                    size -= 1
                to = goto[base[0]][lhs]
                key = (to, id(base))
                new = intern.get(key)
                if new is None:
                    new = intern[key] = (to, base)
                if id(new) not in seen:
                    seen.add(id(new))
                    todo.append(new)
    return True if accepted else out
