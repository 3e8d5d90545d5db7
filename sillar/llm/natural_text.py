"""Problem 7: natural language in the comments and string literals of source files.

A file's comments and literals are found by the syntax it really has; each is cut
into passages, and a dynamic programme over the words of a passage gives the
best sequence of languages: a score of each word in each language, less a penalty
for each switch.  Spans of one language are summed per file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.llm.syntax.spans import actual_language, inner, spans
from sillar.sources.tables import extension, latest, spread

LANGS = ("en", "es", "pt", "fr", "de", "ru", "zh")
LEAST_WORDS, LEAST_HAN = 5, 8
SWITCH, UNKNOWN = 4.0, -0.4

# Frequent words of each language.
WORDS = {
    "en": """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would
        their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like
        my now over such our even most after also did many must before through where your way should because each just those how too good very make still while here never
        same another know until again without during between though once see used using need does your cannot whether both keep might every whose upon ends sure why allowed a i near found small each next last again early old file""",
    "es": """de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos
        también fue había era muy años hasta desde está mi porque qué solo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida
        otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella tres sí dijo sido gran país según menos aquí estos antes luego nada debe hacer
        pueda primero mientras esto quien alguien nunca ante bajo ellos nosotros usted esas estas cual pronto lento viejo vieja anterior siguiente falta espera fila""",
    "pt": """de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela
        entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês vos
        lhes meus minhas teu tua nosso nossa dela delas esta estes estas aquele aquela isto aquilo estou está estamos estão foi fomos foram era seja sejam somente aqui antes
        precisa pode podem ler lembre fechar arquivo pasta acima faltar usamos possível próximo antiga ainda então onde porque cada outro outra sempre nunca agora fila
        sobre nada tudo todo todos toda todas há ser ter tem têm nova novo vez entre durante contra desde sob tão pois arquivos nenhum nenhuma nova nada encontrei""",
    "fr": """de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou comme mais nous cette on sa ses ont aussi leur été
        être si tout même peut elle bien fait deux sans leurs ces après entre où très sous encore ici aux ils avant toujours autre faut dont moins alors je vous lui y tous
        cela quand depuis rien avoir notre votre mon ma mes quel quelle seulement jusque chez vers donc puis seule seul peuvent doit parce lorsque pendant chaque déjà
        dernière vieille suivant ainsi selon contre car peu fois""",
    "de": """der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass daß sie nach wird bei einer um am sind noch
        wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir
        soll ich eines jahr zwei diese dieser wieder keine seiner worden will zwischen immer was sagte gibt alle ohne weil muss müssen hier fehlt solange konnte dieses damit
        jetzt sehr letzte alter lange sollte beim ihr uns jede jeder dort leer""",
}
# A few sentences of each language, from which letter sequences are counted.
_SEED = {
    "en": "Returns the number of lines that were read before the stream was closed. Make sure the value has been checked, otherwise the whole thing will fail. This function should throw an error whenever something unexpected happens while we are working through the list. Everything which changed since yesterday gets written back to the right place, although nothing else would notice. They would rather know about missing things early than wait for another hour.",
    "es": "Devuelve el número de líneas que se leyeron antes de cerrar el flujo. Hay que comprobar el valor, pues de lo contrario todo fallará. Esta función debería lanzar un error siempre que ocurra algo inesperado mientras recorremos la lista. Todo aquello que cambió desde ayer se escribe de nuevo en el sitio correcto, aunque nadie más se daría cuenta. Prefieren conocer pronto los elementos ausentes antes que esperar otra hora. El archivo generado automáticamente no pudo modificarse.",
    "pt": "Devolve o número de linhas que foram lidas antes de fechar o fluxo. É preciso verificar o valor, caso contrário tudo falhará. Esta função deveria lançar um erro sempre que aconteça algo inesperado enquanto percorremos a lista. Tudo aquilo que mudou desde ontem é escrito novamente no lugar certo, embora ninguém mais perceba. Preferem conhecer cedo os elementos ausentes do que esperar outra hora. O ficheiro gerado automaticamente não pôde ser alterado pela aplicação nas configurações.",
    "fr": "Renvoie le nombre de lignes qui ont été lues avant la fermeture du flux. Il faut vérifier la valeur, sinon tout échouera. Cette fonction devrait lever une erreur chaque fois qu'il arrive quelque chose d'inattendu pendant que nous parcourons la liste. Tout ce qui a changé depuis hier est réécrit au bon endroit, bien que personne ne s'en aperçoive. Ils préfèrent connaître tôt les éléments manquants plutôt que d'attendre une heure. Le fichier créé automatiquement par l'outil ne peut pas être modifié.",
    "de": "Gibt die Anzahl der Zeilen zurück, die vor dem Schließen des Stroms gelesen wurden. Der Wert muss geprüft werden, sonst schlägt alles fehl. Diese Funktion sollte einen Fehler werfen, sobald beim Durchlaufen der Liste etwas Unerwartetes geschieht. Alles, was sich seit gestern geändert hat, wird wieder an die richtige Stelle geschrieben, obwohl es sonst niemand bemerken würde. Sie möchten lieber früh von fehlenden Einträgen erfahren, als eine weitere Stunde zu warten. Diese Datei wurde automatisch erzeugt.",
}
_FUNC = {k: frozenset(v.split()) for k, v in WORDS.items()}
_LATIN = ("en", "es", "pt", "fr", "de")


def _grams(word):
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]


def _model():
    counts = {}
    for k in _LATIN:
        c = Counter()
        for w in [*re.findall(r"[^\W\d_]+", _SEED[k].lower()), *_FUNC[k]]:
            c.update(_grams(w))
        counts[k] = c
    vocabulary = set().union(*counts.values())
    return {k: ({g: math.log((c[g] + 0.3) / (c.total() + 0.3 * len(vocabulary))) for g in vocabulary}, math.log(0.3 / (c.total() + 0.3 * len(vocabulary)))) for k, c in counts.items()}


_MODEL = _model()


@lru_cache(maxsize=200_000)
def word_scores(word: str) -> tuple[tuple[float, ...], bool]:
    """(score in each of LANGS, whether it is a frequent word); all negative for what is no word."""
    w = word.lower()
    first = w[0]
    if len(w) > 40:
        return (-4.0,) * len(LANGS), False
    if "Ѐ" <= first <= "ӿ":
        foreign = any(c in "іїєґўјљњћџђ" for c in w)
        return tuple(1.0 if k == "ru" and not foreign else -4.0 for k in LANGS), not foreign
    if not first.isascii() and not ("À" <= first <= "ɏ"):
        return (-4.0,) * len(LANGS), False
    frequent = [w in _FUNC[k] for k in _LATIN]
    grams = [g for g in _grams(w)]
    logs = []
    for k in _LATIN:
        table, rest = _MODEL[k]
        logs.append(sum(table.get(g, rest) for g in grams) / len(grams) * min(len(grams), 8) / 2)
    top = max(logs)
    total = top + math.log(sum(math.exp(x - top) for x in logs))
    out = []
    sure = 1.2 + 0.7 / max(1, sum(frequent))
    for known, x in zip(frequent, logs):
        out.append(sure if known else max(-1.0, 0.3 + (x - total) * 0.4))
    return (*out, -4.0, -4.0), any(frequent)


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HAN = re.compile(r"[一-鿿]")
_TOKEN = re.compile(r"\S+")
_CODE = re.compile(r"[_/\\=<>{}\[\]|@#$%^~`*+]|\w\(|::|->|\w\.\w|[a-z][A-Z]|\d")
_SQL = re.compile(r"^\s*(?:(?:select|delete)\b[\s\S]*\bfrom\b|insert\s+into\b|update\s+\S+\s+set\b|(?:create|alter|drop)\s+(?:table|index|view|database|unique)\b|with\s+\w+\s+as\s*\(|merge\s+into\b|grant\s+\w+\s+on\b|match\s*\()", re.I)
_COMMAND = re.compile(r"(?:^|\s)--?[A-Za-z][\w-]*(?:=\S+)?(?=\s|$)[\s\S]*$")
_SHELL = re.compile(r"^\s*(?:\$\s+)?(?:git|docker|npm|npx|yarn|pip3?|python3?|curl|wget|make|cargo|go|java|mvn|gradle|kubectl|ssh|sudo|apt(?:-get)?|brew|bash|sh|cd|ls|cp|mv|rm|mkdir|chmod|grep|sed|awk|tar|echo|export|helm|dotnet|composer|php|node)\s+[-\w./]")
_STATEMENT = re.compile(r"^\s*(?:[\w.$\->:\[\]]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{:]?|.*[;{}]|(?:return|if|for|while|let|const|var|def|import|from|int|auto|else|elif|public|private|static)\b.*[=(;:{].*|[\w.$\[\]]+\s*[-+*/|&]?:?=[^=].*)\s*$")


def _is_code(line: str) -> bool:
    if _SQL.match(line) or _SHELL.match(line) or (_COMMAND.search(line) and len(_FLAG.findall(line)) >= 1 and not _prose(line)):
        return True
    return bool(_STATEMENT.match(line)) and not _prose(line)


_FLAG = re.compile(r"(?:^|\s)--?[A-Za-z][\w-]*")


def _prose(line: str) -> bool:
    """Words without marks of code make up most of the line, and some are frequent ones."""
    tokens = _TOKEN.findall(line)
    plain = [t.strip(".,;:!?()\"'«»¿¡“”…-") for t in tokens]
    words = [t for t in plain if t and _WORD.fullmatch(t) and not _CODE.search(t)]
    return len(words) >= 0.7 * len(tokens) and sum(word_scores(w)[1] for w in words) >= 0.25 * len(words)


_SENTENCE = re.compile(r"\n\s*\n|\n(?=\s*(?:[-*•]|\d+[.)]|@\w+|:param|:return)\s)|\n(?=\s*[A-ZÀ-ÞЀ-Я¿¡])")


def segment(sentence: str) -> list[tuple[str, int, int]]:
    """Optimal languages of a sentence: (language, words, bytes) of each span."""
    kept: list[tuple[str, tuple, bool]] = []
    for t in _TOKEN.findall(sentence):
        bare = t.strip(".,;:!?()[]{}\"'«»¿¡“”„‘’…—–-<>")
        if not bare:
            continue
        code = bool(_CODE.search(bare))
        for w in () if code else _WORD.findall(bare):
            scores, frequent = word_scores(w)
            kept.append((w, scores, frequent))
        if code:
            kept.append((bare, (UNKNOWN,) * len(LANGS), False))
    if not kept:
        return []
    n = len(LANGS)
    best, back = list(kept[0][1]), []
    for _, scores, _ in kept[1:]:
        top = max(range(n), key=best.__getitem__)
        jump = best[top] - SWITCH
        row = []
        new = []
        for k in range(n):
            if best[k] >= jump:
                row.append(k)
                new.append(best[k] + scores[k])
            else:
                row.append(top)
                new.append(jump + scores[k])
        back.append(row)
        best = new
    k = max(range(n), key=best.__getitem__)
    path = [k]
    for row in reversed(back):
        k = row[k]
        path.append(k)
    path.reverse()
    out, i = [], 0
    while i < len(path):
        j = i
        while j < len(path) and path[j] == path[i]:
            j += 1
        part = kept[i:j]
        lang = LANGS[path[i]]
        words = [x for x in part if x[1][path[i]] > -3 and x[1] != (UNKNOWN,) * n]
        frequent = sum(x[0].lower() in _FUNC[lang] if lang in _FUNC else True for x in part)
        fit = sum(x[1][path[i]] for x in part)
        if words and frequent >= max(1, 0.15 * len(part)) and fit > 0 and len(words) >= 0.6 * len(part):
            out.append((lang, len(words), sum(len(x[0].encode()) for x in part) + len(part) - 1))
        i = j
    return out


@lru_cache(maxsize=50_000)
def passages(text: str) -> tuple[tuple[str, int, int], ...]:
    """(language, longest span in words or Han characters, bytes) of the prose in a comment or literal."""
    found: dict[str, list[int]] = {}
    text = re.sub(r"</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>", " ", text)
    for part in _SENTENCE.split(text):
        if not part or not part.strip():
            continue
        han = _HAN.findall(part)
        if han and not re.search(r"[぀-ヿ가-힯]", part):
            run = max((len(_HAN.findall(x)) for x in re.split(r"[A-Za-z]{3,}[^一-鿿]*[A-Za-z]{3,}", part)), default=0)
            if len(han) >= 2:
                old = found.setdefault("zh", [0, 0])
                old[0] = max(old[0], run)
                old[1] += 3 * len(han)
        if "\n" in part:
            kept = [x for x in part.split("\n") if not _is_code(x)]
            part = " ".join(kept)
        elif _is_code(part):
            continue
        for lang, words, size in segment(part):
            old = found.setdefault(lang, [0, 0])
            old[0] = max(old[0], words)
            old[1] += size
    return tuple((k, a, b) for k, (a, b) in found.items())


def comment_texts(text: str, language: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, start) of comments and literals; a sentence that goes on in the next line comment is joined."""
    held, held_end, start = "", -1, 0
    for kind, a, b in spans(text, language):
        raw = text[a:b]
        body = inner(kind, raw)
        line_comment = kind == "cmt" and not raw.startswith("/*")
        if held:
            gap = text[held_end:a]
            if line_comment and gap.count("\n") == 1 and not gap.strip() and body.strip() and body.strip()[0].islower() and not held.rstrip().endswith((".", "!", "?", ":", ";", ")", ",")):
                held, held_end = held + " " + body.strip(), b
                continue
            yield "cmt", held, start
            held = ""
        if line_comment:
            held, held_end, start = body.rstrip("\r"), b, a
        else:
            yield kind, body, a
    if held:
        yield "cmt", held, start


#: what is not prose at all: encoded data and keys
_DATA = re.compile(r"[A-Za-z0-9+/=_-]{60,}|-----BEGIN ")


def file_languages(text: str, declared: str) -> dict[str, tuple[int, int]]:
    """{language: (longest passage, bytes)} of a file's comments and literals."""
    out: dict[str, list[int]] = {}
    text = text.removeprefix("﻿")
    for _, body, _ in comment_texts(text, actual_language(text, declared)):
        if len(body) < LEAST_HAN:  # no room for a passage
            continue
        for lang, words, size in passages(_DATA.sub(" ", body)):
            old = out.setdefault(lang, [0, 0])
            old[0] = max(old[0], words)
            old[1] += size
    return {k: (a, b) for k, (a, b) in out.items()}


OUT = "project_id string, file_path string, ingested_at timestamp, file_bytes long, found array<struct<nat_lang:string,longest:int,bytes:long>>"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["file_bytes"] = [len(t.encode("utf-8", "surrogatepass")) for t in b["content"]]
        b["found"] = [[{"nat_lang": k, "longest": a, "bytes": n} for k, (a, n) in sorted(file_languages(t, l).items())] for t, l in zip(b["content"], b["language"])]
        yield b.rename(columns={"path": "file_path"})[["project_id", "file_path", "ingested_at", "file_bytes", "found"]]


def natural_text(files: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """(project_id, file_path, nat_lang, longest, bytes, share) of the prose in each source file.

    longest: words (Chinese: characters) of the longest passage; share: its bytes
    in the file's bytes.  Of repeated rows of a file only the latest counts, with
    all its languages: one that only an older version had gives no row.  Rows
    without a time count as oldest, ties go to the greater text.  Null content and
    paths and other extensions give no row.
    """
    known = ext_languages.select(F.lower("ext").alias("_ext"), "language").dropDuplicates(["_ext"])
    rows = files.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select("project_id", "path", "content", "ingested_at", extension(F.col("path")).alias("_ext"))
    rows = spread(rows.join(known, "_ext").drop("_ext"), "project_id", "path")
    one = latest(rows.mapInPandas(_extract, OUT).withColumn("v", F.struct("file_bytes", "found")), ["project_id", "file_path"], "v")
    each = one.select("project_id", "file_path", "v.file_bytes", F.explode("v.found").alias("x"))
    return each.select("project_id", "file_path", "x.*", F.round(F.col("x.bytes") / F.col("file_bytes"), 6).alias("share"))


def found(files: DataFrame, ext_languages: DataFrame) -> DataFrame:
    """Files and languages with a passage of five words at least (Chinese: eight characters)."""
    least = F.when(F.col("nat_lang") == "zh", LEAST_HAN).otherwise(LEAST_WORDS)
    return natural_text(files, ext_languages).where(F.col("longest") >= least).select("project_id", "file_path", "nat_lang")
