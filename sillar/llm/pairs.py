"""Problem 2: defects of question and answer pairs.

A suffix automaton of the question measures how much of the answer is copied; an
Aho-Corasick automaton finds refusing phrases sentence by sentence; a stack of
delimiters and the last line show where an answer breaks off; words vote for the
language of the prose.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.llm.natural_text import LANGS, word_scores
from sillar.sources.tables import latest, spread

# Phrases by which an answer declines, without accents.
REFUSALS = """
i could not find anything|could not find any information|couldn't find any|i found nothing|found nothing about|nothing was found|no answer can be given|no answer is possible|rather not guess|rather not answer|prefer not to answer
unable to answer|unable to help|unable to respond|unable to say|unable to assist|not able to answer|not able to help|not able to assist|cannot answer|can't answer|can not answer|cannot help|can't help|cannot assist|can't assist|cannot respond
cannot be answered|can't be answered|cannot provide|can't provide|cannot tell|can't tell|have to decline|must decline|i decline|need to decline|beyond what i can see|outside the material|outside the scope|out of scope|beyond my scope|i do not know|i don't know|i have no information
there isn't enough|there is not enough|not enough code|not enough information|not enough context|insufficient information|insufficient context|lacks the information|holds nothing on|contains nothing about|contains nothing on|says nothing about|does not say anything|doesn't say anything|doesn't mention|does not mention
none of the excerpts|none of the sources|none of the fragments|none of the retrieved|no information about|no information on|no mention of|not in the indexed|not part of this repository|not available in the sources|i lack the|impossible to answer|not possible to answer|won't be able to|as an ai|against my guidelines|more context|more information is needed|i would need|i'd need
no puedo contestar|no puedo responder|no puedo ayudar|no puedo dar|no puedo decir|no podria responder|no se puede dar respuesta|no se puede contestar|no se puede responder|no es posible responder|no es posible contestar|no es posible dar|imposible responder|imposible contestar|prefiero no|debo abstenerme|me abstengo|debo declinar|no me es posible|no soy capaz
fuera del material|fuera de mi alcance|fuera del alcance|no he hallado|no halle nada|no he encontrado|no encontre nada|no encuentro nada|no se ha encontrado|no figura en|no consta en|no aparece en el repositorio|me faltan datos|faltan datos para|ninguna de las fuentes|ninguno de los fragmentos|no hay codigo suficiente|no hay informacion|no hay suficiente|no tengo informacion|no dispongo de
no dice nada|no dicen nada|no contiene nada|no menciona|no mencionan|no lo se|desconozco|no sabria|no cuento con|no tengo suficiente|no tengo datos|carezco de|mas alla de lo que puedo ver|mas contexto|necesitaria|mais contexto|plus de contexte|mehr kontext
nao encontrei nada|nao encontrei|nao posso responder|nao posso ajudar|nao e possivel responder|nao e possivel dar|nao ha codigo suficiente|nao ha informacao|nao ha informacoes|nao consigo responder|nao consigo ajudar|prefiro nao|devo recusar|devo me abster|fora do material|nao consta|nenhuma das fontes|nenhum dos trechos|nao menciona|nao diz nada|nao contem nada|faltam dados|nao tenho informacoes|nao sei|nao da para responder|nao se pode responder|nao ha como responder|infelizmente nao
je ne peux pas|je ne suis pas en mesure|je n'ai rien trouve|je n'ai pas trouve|impossible de repondre|ne permet pas de repondre|ne permettent pas de repondre|aucune des sources|aucun des extraits|aucune reponse|je prefere ne pas|je dois refuser|je ne sais pas|pas assez de code|pas assez d'informations|ne dit rien|ne mentionne pas|hors du materiel|je ne saurais
kann ich nicht beantworten|kann diese frage nicht|kann nicht beantwortet|kann dabei nicht helfen|kann ich nicht helfen|habe nichts gefunden|nichts gefunden|keine antwort|keine der quellen|keine information|keine angaben|nicht genug|lieber nicht|muss ich ablehnen|weiss ich nicht|ich weiss nicht|dazu nichts|nicht moglich zu antworten|leider nicht
"""  # fmt: skip
# Sentences that may stand beside a refusal without answering.
POLITE = """sorry|apolog|disculp|lo siento|lamentablemente|desculp|sinto muito|infelizmente|desole|malheureusement|leider|entschuldig|unfortunately|try asking|try to ask|ask about another|please ask|please rephrase|prueba a|pruebe a|intenta preguntar|intente|tente perguntar|pregunta por otra|reformul|rephrase|essayez|versuchen sie|outro lado|another question|otra pregunta|let me know|hazme saber"""
# How the language column may name a language.
LANGUAGE_NAMES = {"es": "es spa español espanol spanish castellano", "en": "en eng english inglés ingles", "pt": "pt por português portugues portugués portuguese", "fr": "fr fra fre français francais francés frances french", "de": "de deu ger deutsch german alemán aleman", "ru": "ru rus russian ruso русский", "zh": "zh zho chi chinese chino 中文"}
# Words of short answers that tell the language.
SHORT = {"en": "yes lines line sources source sure true done right correct okay", "es": "sí líneas línea fuentes fuente claro cierto hecho correcto vale", "pt": "sim linhas linha fontes fonte claro feito certo", "fr": "oui lignes ligne bien sûr vrai fait", "de": "ja nein zeilen zeile quellen quelle klar richtig"}

_NAMES = {n: k for k, v in LANGUAGE_NAMES.items() for n in v.split()}
_SHORT = {k: frozenset(v.split()) for k, v in SHORT.items()}
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)", re.M)
_FENCED = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n[\s\S]*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M)
_TAG = re.compile(r"<!--[\s\S]*?-->|</?[A-Za-z][^<>]*>")
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)]|[a-z][.)])\s+")
_NOTE = re.compile(r"[\[(<]\s*(?:\.\.\.|…)?[^\[\]()<>\n]*\b(?:stopped|cut off|truncated|interrupted|length limit|token limit|detenid[ao]|cortad[ao]|truncad[ao]|interrumpid[ao]|interrompid[ao]|tronqu\w*|abgeschnitten|abgebrochen)\b[^\[\]()<>\n]*[\])>]?\s*$", re.I)
_CLOSED = re.compile(r"[.!?。！？…](?:[\"'»”’)\]*_`]*)$")
_SOURCE = re.compile(r"^\s*(?:[-*•+]\s*|\d+[.)]\s*)?[`\"(\[]?(?=[\w./\\-]*(?:/|\.\w{1,5}\b))[\w./\\-]++[`\"\])]?(?:\s*[,:]?\s*\(?(?:l[ií]ne[as]*|lines?|linhas?|lignes?|zeilen?|L)?\s*\d+(?:\s*[-–]\s*L?\d+)?\)?)?[.,]?\s*$", re.I)
_MID = re.compile(r"(?:[,;:({\[–—/&+=\-]|\b(?:the|a|an|of|to|and|or|in|is|are|that|with|for|by|on|el|la|los|las|un|una|de|del|en|y|o|que|con|por|para|se|no|si|su|al|os|as|um|uma|do|da|e|em|le|les|des|du|et|ou|der|die|das|und|oder|zu))$", re.I)


#: words with a slash or an underscore, and names of files
_NAME = re.compile(r"(?<!\S)(?:(?=[^\s/\\_]*[/\\_])\S+|[^\w\s]*\w+\.\w{1,4}[,;:)]*(?!\S))")


class _Bare(dict):
    """A translation that drops combining marks, filled as characters come."""

    def __missing__(self, c):
        self[c] = out = None if unicodedata.combining(chr(c)) else c
        return out


_BARE = _Bare()
_LETTERS_RUN = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, accents and marks gone, blanks collapsed: what a respelling keeps."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return " ".join(_LETTERS_RUN.findall(text.lower()))
    return " ".join(_LETTERS_RUN.findall(unicodedata.normalize("NFKD", text).casefold().translate(_BARE)))


def _is_source(line: str) -> bool:
    """A path with its lines and nothing else."""
    return bool(_SOURCE.match(line))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = html.unescape(_TAG.sub(" ", answer))
    text = _TAG.sub(" ", text)
    text = re.sub(r"^[ \t]*(?:```+|~~~+)[ \t]*[\w+-]*[ \t]*$", " ", text, flags=re.M)
    return not any(c.isalnum() for c in text)


class SuffixAutomaton:
    """Of one text; ``coverage`` is the share of another text inside its common stretches."""

    def __init__(self, text: str):
        self.next, self.link, self.len = [{}], [-1], [0]
        last = 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def coverage(self, text: str, least: int = 4) -> float:
        if not text:
            return 0.0
        state = size = covered = upto = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            if size >= least:
                begin = max(upto, i + 1 - size)
                covered += i + 1 - begin
                upto = i + 1
        return covered / len(text)


_LABEL = re.compile(r"^\W*(?:pregunta|question|q|p|pergunta|frage|prompt|consulta)\s*[:：]\s*", re.I)


@lru_cache(maxsize=4096)
def automaton(text: str) -> SuffixAutomaton:
    return SuffixAutomaton(text)


def compared(question: str | None, answer: str | None) -> tuple[str, str, float]:
    """Both texts as ``plain`` gives them, and the share of the answer that stretches of the question cover."""
    q, a = plain(question or ""), plain(_LABEL.sub("", answer or ""))
    return q, a, automaton(q).coverage(a) if q and a else 0.0


def copies(q: str, a: str, share: float) -> bool:
    """Nothing but the question: stretches of it cover the answer, and the answer has all of it, or its words in another order."""
    if not q or not a:
        return False
    words, asked = a.split(), q.split()
    if share < 0.7:  # the other way round need not be looked at
        return sorted(words) == sorted(asked)
    known = set(asked)
    strange = sum(w not in known for w in words)
    back = SuffixAutomaton(a).coverage(q)
    if share >= 0.9 and back >= 0.8 and strange <= max(1, 0.1 * len(words)):
        return True
    return sorted(words) == sorted(asked) or (back >= 0.7 and strange <= 0.25 * len(words) and abs(len(a) - len(q)) <= 0.2 * len(q))


@lru_cache(maxsize=1)
def _automata():
    import ahocorasick

    made = []
    for phrases in (re.split(r"[|\n]", REFUSALS.strip()), POLITE.split("|")):
        a = ahocorasick.Automaton()
        for x in phrases:
            x = " ".join(re.findall(r"\w+", x))
            a.add_word(f" {x}", x)
        a.make_automaton()
        made.append(a)
    return made


@lru_cache(maxsize=4)
def prose(answer: str) -> str:
    """Without code blocks, inline code, links and paths."""
    text = _FENCED.sub("\n", answer)
    text = html.unescape(_TAG.sub(" ", text))
    text = re.sub(r"`[^`\n]*`?", " ` ", text)
    return _NAME.sub(" ` ", text)


def is_refusal(question: str | None, answer: str) -> bool:
    """Some sentence declines and none answers."""
    refuse, polite = _automata()
    asked = set(plain(question or "").split())
    declined = False
    if _FENCED.search(answer):
        return False
    for s in re.split(r"(?<=[.!?。！？])\s+|\n+", prose(answer)):
        words = re.findall(r"\w+", s)
        flat = plain(s)
        if len(words) < 2 or not flat:
            continue
        if next(refuse.iter(f" {flat} "), None) is not None:
            declined = True
        elif next(polite.iter(f" {flat} "), None) is not None or _is_source(s):
            continue
        elif asked and sum(w in asked for w in flat.split()) >= 0.9 * len(flat.split()):
            continue
        elif len(words) >= 3:
            return False
    return declined


def is_truncated(answer: str) -> bool:
    """The text stops inside a code block, a bracket, a quotation, a sentence or a word."""
    text = answer.rstrip("​﻿ \t\r\n ")
    if _NOTE.search(text):
        return True
    if len(_FENCE.findall(text)) % 2:
        return True
    if re.search(r"^[ \t]*(?:```+|~~~+)[ \t]*$", text.rsplit("\n", 1)[-1]):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    last = lines[-1].rstrip()
    if re.match(r"^( {4}|\t)", last) and not _ITEM.match(last):
        return False  # indented code
    if last.count("`") % 2:
        return True
    stack, pairs = [], {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
    bare = re.sub(r"`[^`]*`", "x", last)
    for c in _ITEM.sub("", bare):
        if c in "([{«“":
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
    if stack:
        return True
    if _CLOSED.search(last):
        return False
    item = _ITEM.match(last)
    core = _ITEM.sub("", last).strip()
    if _is_source(last):
        return False
    if item:
        before = [x.rstrip() for x in lines[:-1] if _ITEM.match(x) and not _is_source(x)]
        if before and sum(bool(_CLOSED.search(x)) for x in before) * 2 > len(before):
            return True
        return bool(_MID.search(core))
    if last.startswith(("#", "|", ">")) and not _MID.search(core):
        return False
    if last.endswith(("*", "_")) and re.search(r"(\*\*|__|\*|_)[^*_]+\1$", last) or core.endswith((")", "]", "`", '"')) and len(lines) > 1 and len(core.split()) < 4:
        return False
    return len(re.findall(r"\w+", core)) >= 1


def wanted(idioma: str | None) -> str:
    """The language a name stands for; Spanish where it is null, blank or unknown."""
    name = (idioma or "").strip().casefold()
    return _NAMES.get(name) or _NAMES.get(re.split(r"[-_\s(]", name)[0]) or "es"


#: letters that only one of the languages has
_LETTERS = {"pt": "ãõ", "es": "ñ", "de": "ß", "fr": "œèùûîë"}


@lru_cache(maxsize=200_000)
def word_votes(low: str) -> tuple[tuple[str, float], ...]:
    """What one word says for each language."""
    if "一" <= low[0] <= "鿿":
        return (("zh", len(low) / 2),)
    scores, frequent = word_scores(low)
    votes = [(k, 0.8) for k, marks in _LETTERS.items() if any(c in marks for c in low)]
    short = [(k, 1.5) for k, words in _SHORT.items() if low in words]
    if short:
        return (*votes, *short)
    if frequent:
        return (*votes, *((k, x - 1) for k, x in zip(LANGS, scores) if x > 1))
    top = max(scores)
    return (*votes, *((k, 0.25 if k not in ("ru", "zh") else 1.0) for k, x in zip(LANGS, scores) if x == top and x > 0.2))


_PROSE_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def languages(answer: str) -> dict[str, float]:
    """Votes of the words of the prose."""
    votes = dict.fromkeys(LANGS, 0.0)
    for low in _PROSE_WORD.findall(prose(answer).lower()):
        for k, x in word_votes(low):
            votes[k] += x
    return votes


def other_language(idioma: str | None, answer: str) -> bool:
    votes = languages(answer)
    best = max(votes, key=votes.get)
    want = wanted(idioma)
    return votes[best] > 0.4 and best != want and votes[best] > 1.25 * votes[want]


def measured(question: str | None, idioma: str | None, answer: str | None, truncated) -> tuple[list[str], float]:
    """(all defects of a pair in a fixed order, the share of the answer copied from the question)."""
    out = []
    empty = is_empty(answer)
    q, a, share = compared(question, answer)
    copied = not empty and copies(q, a, share)
    if empty:
        out.append("empty")
    if truncated is True or (not empty and not copied and is_truncated(answer)):
        out.append("truncated")
    if not empty and not copied:
        if is_refusal(question, answer):
            out.append("refusal")
        if other_language(idioma, answer):
            out.append("other_language")
    if copied:
        out.append("copies_question")
    return out, round(share, 4)


def defects(question: str | None, idioma: str | None, answer: str | None, truncated) -> list[str]:
    return measured(question, idioma, answer, truncated)[0]


OUT = "ask_id long, received_at timestamp, v struct<defects:array<string>,coverage:double>"


def _flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        both = [measured(q, i, a, None if t is None or pd.isna(t) else bool(t)) for q, i, a, t in zip(b["pregunta"], b["idioma"], b["answer"], b["truncated"])]
        b["v"] = [{"defects": d, "coverage": c} for d, c in both]
        yield b[["ask_id", "received_at", "v"]]


def flag_pairs(asks: DataFrame) -> DataFrame:
    """(ask_id, defects, coverage) of every pair; a sound pair has the empty array.

    coverage: the share of the answer's characters inside stretches of the
    question, by its suffix automaton; 0 for null and empty texts.  Repeated rows
    of an ask count once, the one received last wins, ties go to the greater
    result; rows without an ask_id give none.  Null answers are empty, null
    questions cannot be copied, null languages mean Spanish, null flags prove
    nothing.
    """
    rows = asks.where(F.col("ask_id").isNotNull()).select("ask_id", "received_at", "pregunta", "idioma", "answer", "truncated")
    return latest(spread(rows, "ask_id").mapInPandas(_flag, OUT), ["ask_id"], "v", "received_at").select("ask_id", "v.defects", "v.coverage")


def found(asks: DataFrame) -> DataFrame:
    """One row per ask and defect."""
    return flag_pairs(asks).select("ask_id", F.explode("defects").alias("defect"))
