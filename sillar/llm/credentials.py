"""Problem 3: live credentials in source code and configuration, and their redaction.

A line's literal tokens (words of strings, comments and configuration values) are
labelled by a linear-chain conditional random field over shape and context
features; the Viterbi spans are the characters to hide.  The field is trained on
the driver from lines written by rules (``training_lines``), never on the corpus,
so its size does not depend on the data.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillar.llm.crf import B, I, O, Crf
from sillar.sources.tables import spread

TRAINING_LINES, SEED = 5000, 11

# Parts of names that say a value is secret, or that it is not.
SECRET = r"pass(?:word|wd|phrase|code)?s?|pwd|pw|passwort|kennwort|contrase[nñ]a|contrasenia|senha|clave(?:s)?|secret[oa]?s?|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|signing[_-]?(?:key|salt)|salt|session[_-]?key|encryption[_-]?key|auth(?:orization|oriz)?|cred(?:ential|encial)?(?:s|es)?|bearer|webhook|jwt|pin|otp|llave|chave|motdepasse|mdp|signature[_-]?key|master[_-]?key|account[_-]?key|hmac"
NOT_SECRET = r"hash|sha\d*|digest|checksum|revision|commit|etag|uuid|guid|tenant|request[_-]?id|trace[_-]?id|build|version|integrity|fingerprint|public|pub[_-]?key|verify|cert(?:ificate)?|anchor|icon|image|img|logo|pattern|regex|regexp|column|field[_-]?name|key[_-]?name|header[_-]?name|placeholder|prefix|suffix|path|file|url[_-]?path|md5|crc|nonce[_-]?name|locale|charset|format|template|label|title|message|msg|help|description|tokenizer|max[_-]?tokens|num[_-]?tokens|token[_-]?(?:limit|count|mode|size|type|level|path|url|length)|keyboard|keyword|primary[_-]?key|foreign[_-]?key|author"
_SECRET = re.compile(rf"(?:^|[_\-.\s]|(?<=(?-i:[a-z]))(?=(?-i:[A-Z])))(?:{SECRET})(?:$|[_\-.\s\d]|(?=(?-i:[A-Z])))|(?:{SECRET.replace('|pin|', '|').replace('|otp|', '|').replace('|pw|', '|').replace('salt|', '').replace('|auth(', '|authorization|auth(')})(?:[_\-]?[a-z]?\d*)?$", re.I)
_NOT = re.compile(rf"(?:^|[_\-.\s\d]|(?<=(?-i:[a-z]))(?=(?-i:[A-Z])))(?:{NOT_SECRET})(?:$|[_\-.\s\d]|(?=(?-i:[A-Z])))|(?:digest|checksum|integrity|revision|commit|etag|fingerprint)\w{{0,3}}$", re.I)
# Names of calls that read a setting, and that open a session.
_READ = re.compile(r"(?:get_?env|env(?:_get|_or)?|environ|lookup_?env|env_?var|var|setting|config(?:_get)?|secret|vault|read_?secret|get_?secret|System\.getProperty|get_?property|get_?string|getParameter|resolve)$", re.I)
_LOGIN = re.compile(r"(?:log_?in|sign_?in|connect|authenticate|auth|open_?\w*|login_?\w*|with_?(?:password|token|credentials)|set_?(?:password|token|key)|credentials?|basic_?auth|bind|logon|iniciar\w*|conectar|unlock|decrypt)$", re.I)
# What stands where a value will be put.
_PLACEHOLDER = re.compile(r"^(?:x{3,}|\*{3,}|\.{3,}|_{3,}|-{3,}|0{6,}|1234(?:5678?9?0?)?|null|none|nil|undefined|empty|unset|true|false|todo|tbd|fixme|change[_-]?(?:me|it)\S*|replace\S*|insert\S*|your\S*|tu[_-]\S+|my[_-]?(?:password|token|secret|key)|enter\S*|fill\S*|example\S*|sample\S*|dummy\S*|test|foo|bar|redacted|hidden|masked|placeholder\S*|not[_-]?set|none[_-]?set|secret|password|passwd|token|apikey|api[_-]key|prompt|stdin|ask|vault\S*|ver|see|ninguna?|vac[ií]o|cambiar\S*|cambiame\S*|default)$|placeholder|not-set|your[_-]?\w*[_-]?(?:key|token|password|secret)|ENC\(|<[^<>]*>|^\$\{|^\{\{|^%\(|^\$\(|^%\w+%$|^\$[A-Z_]+$|^#\{|^@@|file:/|/run/secrets|secretKeyRef|valueFrom|^arn:|^op://|^vault:|^ssm:|^env:|^\[\w", re.I)
# Shapes that only tokens of known issuers have.
_ISSUED = re.compile(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^glpat-[\w-]{16,}$|^xox[abprs]-[\w-]{10,}$|^AIza[\w-]{30,}$|^sk[-_](?:live|test|proj|ant)?[-_]?[A-Za-z0-9_-]{16,}$|^SG\.[\w-]{16,}\.[\w-]{16,}$|^eyJ[\w-]{8,}\.[\w-]{8,}(?:\.[\w-]*)?$|^[a-z]{2,6}_(?:live|prod|test|key|pat|sk|tok)_[A-Za-z0-9]{16,}$|^npm_[A-Za-z0-9]{30,}$|^dop_v1_[0-9a-f]{40,}$")

_WORD = re.compile(r"""[^\s"'`<>(){}\[\],;|\\=:@]+(?:={1,2}(?![^\s"'`,;)\]}&]))?|"|'|`|://|:=|=>|\|\||\?\?|[=:@+(),;{}\[\]<>|\\]""")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----")
_BREAK = re.compile(r"\r?\n|(?:\\+r)?\\+n")
_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Content-Domain|Key-Info|Comment|Subject|Version|Hash|Charset|MessageID|X-[\w-]+):.*")
_ELISION = re.compile(r"<[^<>]*>|\$?\{[^{}]*\}|\{\{[^{}]*\}\}|\[[^\[\]]*\]|[A-Za-z0-9+/=.…]+")
_CONFIG = re.compile(r"\.(?:env|ya?ml|json|ini|cfg|conf|config|toml|properties|npmrc|netrc|xml|tfvars|pem|key|pypirc|htpasswd|txt|sh)$|(?:^|/)\.?(?:env|netrc|npmrc|pgpass|credentials)\b", re.I)
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|;|<!--|rem\s)|(?<=\s)(?://|#)\s")
#: what stands in every line with a literal token outside configuration: a quotation mark, a comment or an address
_LITERAL = re.compile(r"""["'`]|://|""" + _COMMENT.pattern.replace(r"^\s*", r"^[^\S\n]*"), re.M | re.I)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


@lru_cache(maxsize=100_000)
def shape(v: str) -> tuple[str, ...]:
    """What a token's characters alone say."""
    out = []
    n = len(v)
    up, low, dig = any(c.isupper() for c in v), any(c.islower() for c in v), any(c.isdigit() for c in v)
    mark = any(not c.isalnum() for c in v)
    out.append(f"cls={up:d}{low:d}{dig:d}{mark:d}")
    out.append("len=" + ("s" if n < 4 else "5" if n < 6 else "8" if n < 9 else "12" if n < 13 else "18" if n < 19 else "24" if n < 25 else "40" if n < 41 else "64" if n < 65 else "128" if n < 400 else "x"))
    e = _entropy(v)
    out.append(f"ent={min(5, int(e))}")
    if _PLACEHOLDER.search(v):
        out.append("placeholder")
    kind = "other"
    if re.fullmatch(r"[\da-fA-F]{8}-(?:[\da-fA-F]{4}-){3}[\da-fA-F]{12}", v):
        kind = "uuid"
    elif re.fullmatch(r"(?:sha\d{1,3}|md5)[-:=]?\S*", v):
        kind = "hash"
    elif _ISSUED.match(v):
        kind = "issued"
    elif re.fullmatch(r"[\da-fA-F]{24,}", v) and dig:
        kind = "hex"
    elif re.fullmatch(r"[\d.,\-+/]+%?", v):
        kind = "number"
    elif re.fullmatch(r"\d{4}-\d\d.*|v?\d+(?:\.\d+)+\S*", v):
        kind = "date"
    elif "/" in v and re.fullmatch(r"[\w./-]+", v) and low and all(re.search("[a-z]", x) for x in v.strip("/").split("/")) and (e < 4.0 or v[0] == "/" and n < 40 and not re.search(r"[A-Z][^A-Z]*\d[^A-Z]*[A-Z]", v)):
        kind = "path"
    elif re.fullmatch(r"[a-zà-ÿ]+|[A-ZÀ-Ý]?[a-zà-ÿ]+[.,!?]?|[A-ZÀ-Ý]+", v):
        kind = "word"
    elif re.fullmatch(r"[a-z]+(?:[._/-][a-z]+)+|[A-Z]+(?:_[A-Z\d]+)*|[a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:_[a-z\d]+)+|[A-Z][a-z]+(?:-[A-Z][A-Za-z]+)+", v):
        kind = "name"
    elif re.fullmatch(r"[\w.-]+\.(?:com|net|org|io|dev|local|internal|invalid|example|test|json|ya?ml|py|js|ts|go|rs|java|c|h|cs|php|pem|txt|md|html|png|svg)(?:/\S*)?", v):
        kind = "host"
    elif n < 200 and re.search(r"[*+?^$\\]\S*[\[({]|\\[dwsb]|\[[A-Za-z\d]-[A-Za-z\d]|\{\d+,?\d*\}", v):
        kind = "regex"
    elif re.fullmatch(r"[A-Z]{2,6}[A-Z0-9]{12,30}", v) and dig:
        kind = "upper"
    elif re.fullmatch(r"W/\S*", v):
        kind = "etag"
    elif re.fullmatch(r"[A-Za-z]+(?:[._-][A-Za-z]+){0,3}\d{2,6}[!?*#+$%&.@\w-]{0,3}", v) and up and low and n < 40:
        kind = "phrase"  # words, figures and a mark
    elif n >= 16 and dig and up and low and e >= 3.5 and re.fullmatch(r"[A-Za-z0-9+/=_.\-]+", v):
        kind = "random"
    elif n >= 20 and dig and low and e >= 3.3 and re.fullmatch(r"[a-z0-9_.-]+", v):
        kind = "randomlow"
    out.append("kind=" + kind)
    if n >= 12 and re.match(r"[A-Za-z]{2,5}[._-]", v) and dig and up and low:
        out.append("prefixed")
    if re.fullmatch(r"[A-Za-z0-9+/_-]{60,}={0,2}", v):
        out.append("longdata")
    return tuple(out)


def name_class(name: str) -> str:
    if _NOT.search(name):
        return "not"
    if _SECRET.search(name) or re.search(r"(?:password|passwd|secret|contrasena|apikey|accesskey|authtoken|credential|passphrase|clave|senha|sessionkey|signingsalt|webhook|smtppass|adminpwd|_auth)", name, re.I):
        return "secret"
    return "plain"


def analyse(line: str, config: bool) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """(spans, features) of the literal tokens of a line, left to right."""
    spans, feats = [], []
    tokens = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(line)]
    comment_at = next((m.start() for m in _COMMENT.finditer(line)), len(line)) if not line.lstrip().startswith("//repo") and not re.match(r"\s*//[\w.-]+/\S*:_", line) else len(line)
    quote = ""
    name, key, op, call, reads, env = "", "", "", "", False, False
    calls: list[tuple[str, int]] = []
    args = 0
    scheme = ""
    url = ""  # scheme -> user -> password
    last_value, joined = -9, False
    said: list[str] = []
    for i, (w, a, b) in enumerate(tokens):
        in_comment = a >= comment_at
        nxt = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        if w in "\"'`":
            if quote == w:
                quote = ""
                url = ""
            elif not quote and not (in_comment and w == "'"):
                quote = w
                key = ""
                scheme = ""
            continue
        if w == "://":
            url = "scheme"
            continue
        if not quote:
            if w == "(":
                prev = tokens[i - 1][0] if i else ""
                calls.append((prev, 0))
                call, args = prev.lstrip("!"), 0
                env = env or bool(_READ.search(prev.rstrip("!")))
                continue
            if w in "[" and i and re.search(r"environ|env$|ENV$", tokens[i - 1][0], re.I):
                reads = True
                continue
            if w == ")":
                if calls:
                    calls.pop()
                call = calls[-1][0] if calls else ""
                continue
            if w == ",":
                args += 1
                if not calls:
                    name = ""
                continue
            if w in ("||", "??", "or"):
                op = "default"
                reads = False
                continue
            if w in ("+",):
                joined = True
                continue
            if w in ("=", ":", ":=", "=>"):
                if i and a - tokens[i - 1][2] <= 3:
                    before = tokens[i - 1][0]
                    if before in "\"'`" and i >= 3:
                        before = tokens[i - 2][0]
                    if not (w == ":" and name and op == "=") and re.search(r"\w", before):
                        name = before
                op = "=" if w != ":" else ":" if op != "=" else op
                continue
        else:
            if w in ("=", ":") and not url:
                key = said[-1] if said else ""
                continue
            if w in (";", ",") or w == "&":
                key = ""
                continue
        if w == ":" and url == "scheme-user":
            url = "password"
            continue
        if w == "@":
            url = ""
            continue
        if w in "=:@+(),;{}[]<>|\\" or w in (":=", "=>", "||", "??"):
            continue
        said.append(w)
        # a word
        literal = bool(quote) or in_comment or (config and (op or url)) or (url == "password")
        if url == "scheme":
            url = "scheme-user"
            if not (nxt == ":" or nxt == "@"):
                url = ""
            continue_user = True
        else:
            continue_user = False
        if not literal or continue_user:
            if w.lower() in ("bearer", "basic", "token"):
                scheme = w.lower()
            continue
        if quote and line[b : b + 1] == quote and re.match(r"\s*:", line[b + 1 : b + 4]) and not calls:
            continue  # the key of a pair
        if b - a < 4 and not url:
            if w.lower() in ("bearer", "basic", "token", "pw", "pwd"):
                scheme = w.lower() if w.lower() in ("bearer", "basic", "token") else scheme
            if in_comment and name_class(w) == "secret":
                name = w
            continue
        f = list(shape(w))
        kind = next(x for x in f if x.startswith("kind="))
        if url == "password":
            where = "url"
        elif scheme and kind not in ("kind=word",):
            where = "scheme"
        elif quote and key:
            where = "kv-" + name_class(key)
            key = ""
        elif env and call and _READ.search(call) and args == 0:
            where = "envname"
        elif reads:
            where = "envname"
        elif (env and args > 0) or op == "default":
            where = "default"
        elif call and _LOGIN.search(call):
            where = "login-" + ("1" if args else "0")
        elif in_comment:
            recent = " ".join(said[-4:-1])
            where = "comment-" + ("secret" if re.search(rf"(?i)\b(?:{SECRET})\b", recent) or name_class(name) == "secret" else "login" if re.search(r"(?i)\b(?:log_?in|user|usuario|admin|cuenta|account|credenciales|acceso)\b", recent) else "plain")
        elif op or config:
            where = "assigned-" + name_class(name)
        else:
            where = "bare"
        f += ["in=" + where, f"in={where}|{kind}", f"in={where}|" + f[0], f"in={where}|" + f[1]]
        if "placeholder" in f:
            f.append(f"in={where}|placeholder")
        if name:
            f.append(f"name={name_class(name)}|{kind}")
        if quote:
            before, after = line[max(0, a - 9) : a].rstrip(), line[b : b + 9].lstrip()
            f.append("whole" if before.endswith(quote) and after.startswith(quote) else "part")
            if f[-1] == "part":
                f.append(f"part|{kind}")
        if nxt == "@" and where == "url":
            f.append("before@")
        if joined or (0 <= last_value and a - last_value < 40 and re.fullmatch(r"""["'`]?\s*[+.,]?\s*["'`]?""", line[last_value:a]) and re.search(r"[\"'`]", line[last_value:a])):
            f.append("joined")
        f.append("bias")
        if w.lower() in ("bearer", "basic", "token") and kind == "kind=word":
            scheme = w.lower()
        elif scheme and where == "scheme":
            scheme = ""
        spans.append((a, b))
        feats.append(f)
        last_value, joined = b, False
        if in_comment and name_class(w) == "secret":
            name = w
    return spans, feats


# --- training ---------------------------------------------------------------

# Names and words from which training lines are put together.
_SECRET_NAMES = "db_password password passwd dbPassword smtp_pass admin_pwd api_key apiKey API_KEY access_key secret_key SECRET_KEY client_secret clientSecret auth_token authToken session_key signing_salt webhook_secret bot_credential passphrase clave_api contrasena_bd contrasenaBd clave senha app.db.password app.auth.token token private_key jwt_secret encryption_key _authToken dbpassword clientsecret accesskey".split()
_PLAIN_NAMES = "tmp_str default_arg seed_text magic conf_b value_two header_line origin endpoint base_url host greeting option mode level row_size limit cache_dir label_text queue state data_source conn conexion dsn".split()
_NOT_NAMES = "revision commit base_sha sha checksum lock_digest etag tenant request_id icon_data image_digest integrity public_key verify_key trust_anchor build_hash trace_id fingerprint fileHash contentDigest token_pattern password_column".split()
_WORDS = "river candle orbit siesta verde noche maple punta copper bruma lantern tortuga quartz thistle summer winter dragon monkey sunset coffee panda tiger forest castle amigo luna sol cielo fuego".split()
_PLACES = "null|<your-token>|<fill in>|xxxxxxxxxxxxxxxx|changeit-placeholder-not-set|ENC(see vault)|${SECRET_FROM_VAULT}|{{ vault.db_pass }}|file:/run/secrets/db|db_password|password_hash_column|secretKeyRef|auth.token.name|your-api-key-here|changeme|********|TODO|none|${DB_PASSWORD}|%DB_PASS%|example|REPLACE_ME|access_token|user.password.label|ver gestor|see vault|/run/secrets/token".split("|")
_SENTENCES = "could not read the queue while updating|Only the session is allowed to change|select token_id, key from auth_state where secret = ?|git log -n 24 --format=oneline --no-merges|/api/v3/token/state|text/token; charset=utf-8|%s: %d key|no se pudo leer el token al actualizar|auth.token.state|token/state|https://repo.example.test/v1|/srv/data|info|true|4821|invalid password|the password must have eight characters|password reset requested|Keep the token until the next batch is released".split("|")


def _value(rng, kind):
    alnum = string.ascii_letters + string.digits
    r = lambda n, a=alnum: "".join(rng.choice(a) for _ in range(n))
    if kind == "phrase":
        w1, w2 = rng.choice(_WORDS), rng.choice(_WORDS)
        return w1.capitalize() + rng.choice(["", "_", "-", ".", ""]) + (w2 if rng.random() < 0.7 else w2.capitalize()) + str(rng.randrange(100, 9999)) + rng.choice(["", "!", "?", "#", "*", "+", "$", "%3F"])
    if kind == "issued":
        return rng.choice([lambda: f"{r(3, string.ascii_lowercase)}_live_{r(28)}", lambda: f"gh{rng.choice('pous')}_{r(36)}", lambda: f"AKIA{r(16, string.ascii_uppercase + string.digits)}", lambda: f"sk_live_{r(24)}", lambda: f"xoxb-{r(12, string.digits)}-{r(24)}", lambda: f"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJz{r(40)}.{r(43)}"])()
    if kind == "dotted":
        return f"{rng.choice(['SG', r(3, string.ascii_lowercase)])}.{r(22)}.{r(27)}"
    if kind == "dashed":
        return f"{r(2, string.ascii_lowercase)}-{r(14)}-{r(12)}-{r(12)}"
    if kind == "upper":
        return r(4, string.ascii_uppercase) + r(16, string.ascii_uppercase + string.digits)
    if kind == "random":
        return r(rng.choice([20, 24, 32, 40, 40, 48]), alnum + "+/") if rng.random() < 0.7 else r(rng.choice([24, 32]))
    if kind == "hex":
        return r(rng.choice([32, 40, 64]), "0123456789abcdef")
    if kind == "uuid":
        return "-".join(r(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))
    if kind == "simple":
        return rng.choice([r(10, string.ascii_lowercase + string.digits), rng.choice(_WORDS) + str(rng.randrange(10, 99999)), r(12), r(9, alnum + "!#$%&*") + "7a"])
    return r(20)


def _declare(rng, name, literal):
    q = rng.choice("\"'")
    camel = re.sub(r"[_.](\w)", lambda m: m[1].upper(), name)
    return rng.choice([
        f"{name} = {q}{literal}{q}", f"const {camel} = {q}{literal}{q};", f'String {camel} = "{literal}";', f'{camel} := "{literal}"', f"    {name.upper()} = {q}{literal}{q}",
        f'private static final String {name.upper()} = "{literal}";', f'const char *{name} = "{literal}";', f'pub static {name.upper()}: &str = "{literal}";', f"${name} = {q}{literal}{q};",
        f'static const std::string {camel} = "{literal}";', f'"{name}": "{literal}",', f"let {name}: string = {q}{literal}{q};",
    ])


def _config(rng, name, literal):
    return rng.choice([f"{name}: {literal}", f'{name}: "{literal}"', f"{name.upper()}={literal}", f"export {name.upper()}={literal}", f"app.{name.replace('_', '.')}={literal}", f"{name} = {literal}", f'{name} = "{literal}"', f'  "{name.replace("_", "")}": "{literal}",', f"  {name}: '{literal}'"])


def training_lines(n: int = TRAINING_LINES, seed: int = SEED) -> list[tuple[str, bool, list[tuple[int, int]]]]:
    """(line, whether it is configuration, spans of its credential) made by rules."""
    rng = random.Random(seed)
    out = []
    kinds = ["phrase", "issued", "dotted", "dashed", "upper", "random", "hex", "simple"]

    def add(line, *values, config=False):
        spans, at = [], 0
        for v in values:
            at = line.index(v, at)
            spans.append((at, at + len(v)))
            at += len(v)
        out.append((line, config, spans))

    while len(out) < n:
        config = rng.random() < 0.35
        put = _config if config else _declare
        name, plain_, not_ = rng.choice(_SECRET_NAMES), rng.choice(_PLAIN_NAMES), rng.choice(_NOT_NAMES)
        if rng.random() < 0.3:
            suffix = rng.choice(["_1", "2", "_k0", "_b", "_prod", "_old"])
            name, plain_, not_ = name + suffix, plain_ + suffix, not_ + suffix
        v = _value(rng, rng.choice(kinds))
        env = rng.choice(["DB_PASSWORD", "API_KEY", "SMTP_PASS", "ACCESS_KEY", "CLIENT_SECRET"])
        host, user = rng.choice(["10.20.0.7:5432", "db.acme.invalid", "cache.acme.example", "mq.acme.test"]), rng.choice(["app", "svc", "root", "lector", "svc_batch"])
        case = rng.randrange(38)
        if case < 5:
            add(put(rng, name, v), v, config=config)
        elif case < 7:
            v = _value(rng, rng.choice(["issued", "dotted", "dashed", "upper", "random"]))
            add(put(rng, plain_, v), v, config=config)
        elif case < 10:
            url = f"{rng.choice(['mysql', 'postgres', 'redis', 'amqp', 'mongodb+srv', 'https'])}://{user}:{v}@{host}/{rng.choice(['q', 'main', 'data'])}"
            add(put(rng, rng.choice([plain_, name]), url), v, config=config)
        elif case < 12:
            v = _value(rng, rng.choice(["phrase", "simple", "random"])).replace(";", "")
            text = rng.choice([f"host={host} user={user} password={v} sslmode=require", f"Server=tcp:{host};User Id={user};Password={v};Encrypt=yes", f"Data Source=main;Uid={user};Pwd={v}"])
            add(put(rng, plain_, text), v, config=config)
        elif case == 12:
            v = _value(rng, rng.choice(["issued", "random", "dotted", "hex"]))
            s = rng.choice(["Bearer", "Basic", "Token"])
            v = v if s != "Basic" else _value(rng, "random")[:24] + "=="
            add(put(rng, rng.choice(["authorization", "cabecera", "auth_header", "header"]), f"{s} {v}"), v, config=config)
        elif case == 13:
            q = rng.choice("\"'")
            camel = re.sub(r"[_.](\w)", lambda m: m[1].upper(), name)
            add(rng.choice([f"{name} = os.getenv({q}{env}{q}, {q}{v}{q})", f"const {camel} = process.env.{env} || {q}{v}{q};", f'const std::string {camel} = env_or("{env}", "{v}");', f"${name} = getenv('{env}') ?: '{v}';", f'String {camel} = env("{env}", "{v}");', f'{name} = os.environ.get("{env}", "{v}")']), v)
        elif case == 14:
            add(rng.choice([f'login("{user}", "{v}");', f'signIn("deploy", "{v}");', f'connect("{user}", "{v}")', f'sign_in("robot", "{v}")', f'openVault("{user}", "{v}");', f'client.authenticate("{user}", "{v}")']), v)
        elif case in (15, 34, 35):
            v = _value(rng, rng.choice(["phrase", *kinds]))
            c = rng.choice(["//", "#", "    //", "    #", " *"])
            add(rng.choice([f"{c} staging pw: {v}", f"{c} old token {v}", f"{c} clave vieja = {v}", f"{c} login admin / {v}", f"{c} password: {v}", f"{c} TODO remove secret {v}", f"{c} senha antiga {v}", f"{c} user admin pass {v}"]), v)
        elif case == 16:
            v = _value(rng, rng.choice(["issued", "dotted", "hex", "random", "upper"]))
            a, b = v[: len(v) // 2], v[len(v) // 2 :]
            q = rng.choice("\"'")
            add(rng.choice([f"{name} = {q}{a}{q} + {q}{b}{q}", f"const {name} = {q}{a}{q} + {q}{b}{q};", f'concat!("{a}", "{b}")', f'pub static {name.upper()}: &str = concat!("{a}", "{b}");', f"${name} = {q}{a}{q} . {q}{b}{q};"]), a, b)
        elif case == 17:
            add(f"//{host}/npm/:_authToken={v}", v, config=True)
        elif case < 21:
            add(put(rng, name, rng.choice(_PLACES)), config=config)
        elif case < 24:
            v = rng.choice([_value(rng, "hex"), "sha256:" + _value(rng, "hex"), "md5:" + _value(rng, "hex")[:32], "sha512-" + _value(rng, "random") * 2, _value(rng, "uuid"), "W/" + _value(rng, "random")[:22], "data:image/png;base64,iVBORw0KGgo" + _value(rng, "random") * 3, _value(rng, "random")])
            add(put(rng, not_, v), config=config)
        elif case == 24:
            add(put(rng, rng.choice([plain_, "tenant", "node_id"]), _value(rng, rng.choice(["uuid", "hex"]))), config=config)
        elif case < 27:
            add(put(rng, rng.choice([plain_, name, plain_]), rng.choice(_SENTENCES)), config=config)
        elif case == 27:
            q = rng.choice("\"'")
            add(rng.choice([f"{name} = os.environ[{q}{env}{q}]", f'{name} = os.getenv("{env}")', f'String {name} = System.getenv("{env}");', f'let {name} = env_get("{env}");', f"const {name} = process.env.{env};", f"{name} := os.Getenv(\"{env}\")", f"{name} = config.get('{env.lower()}')", f"{name} = vault.read('secret/{env.lower()}')"]))
        elif case == 28:
            add(rng.choice([f"# {rng.choice(_SENTENCES)}", f"// password: {rng.choice(['ver gestor', 'see the vault', 'ask ops', 'in the keychain'])}", f"// token: {rng.choice(_SENTENCES)}", "# the token is read from the vault", "// rotate the secret every month", f"// {rng.choice(_WORDS)}Token(key, 90);", f"# sort_token({rng.choice(_WORDS)}, 80)"]))
        elif case == 29:
            pattern = rng.choice(["^[a-z]{3}_live_[A-Za-z0-9]{28}$", "AKIA[0-9A-Z]{16}", r"password\s*=\s*\S+", "[A-Fa-f0-9]{40}", r"(?i)bearer\s+[\w.-]+"])
            add(put(rng, rng.choice(["token_pattern", "secret_regex", "key_pattern", name]), pattern), config=config)
        elif case == 30:
            add(rng.choice([f'log.info("{rng.choice(_SENTENCES)}");', f"total_token = token[6] * {rng.randrange(99)}", f'throw new Error("{rng.choice(_SENTENCES)}");', f'x = lookup(key, "{rng.choice(_SENTENCES)}");', f'login("{user}", {name});', f'connect("{user}", "{rng.choice(_PLACES)}");', f'login("{user}", os.getenv("{env}"))', 'open("report.csv", "w")', f'open("data/{rng.choice(_WORDS)}_2024.json", "rb")', 'connect("cache.acme.example", "main")', 'open_file("token_state.txt")']))
        elif case == 31:
            add(put(rng, plain_, f"{rng.choice(['https', 'postgres'])}://{rng.choice(['', user + ':' + rng.choice(['${DB_PASSWORD}', '<password>', '{{ vault.db_pass }}', '****', '$DB_PASS']) + '@'])}{host}/v1"), config=config)
        elif case == 36:
            w1, w2, w3 = (rng.choice(_WORDS) for _ in range(3))
            add(rng.choice([f'var {w1[:2]}3={{"{w1}":578,"{w2}2":"token/{w3}",z:null}};function vv7(z,n){{return z*6+n}}', f'!function(x,n){{if(!x)throw Error("{w1}");n(x[1],1)}}(window.aw4,console.log);var q1={{"{w2}":1,"key2":"{w3}/secret"}};', f"// Code generated by {w1}{w2} from schema.def. DO NOT EDIT.", f"# Generated from {w1}.xsd by {w2} 4.2 on every build", f"# @generated by {w1}{w2}", f"// Copyright 2021 {w1.capitalize()} Works. All rights are reserved"]))
        elif case == 37:
            add(put(rng, rng.choice([name, name, plain_]), rng.choice(["X-Api-Key", "Authorization", "Content-Type", "auth.token.name", "user_password", "token_value", "passwordField", "PASSWORD", "API_KEY"])), config=config)
        elif case == 32:
            add(put(rng, rng.choice(["size", "token_limit", "token_mode", "key_level", "auth_path", "pass_count"]), rng.choice(["4821", "info", "/srv/data", "true", "https://repo.example.test/v1", "es"])), config=config)
        else:
            add(rng.choice([f'"{_value(rng, "random") * 2}",', f"  '{_value(rng, 'random')}{_value(rng, 'random')}',", f'"{_value(rng, "hex")}",']))
    return out


@lru_cache(maxsize=4)
def trained(lines: int = TRAINING_LINES, seed: int = SEED) -> Crf:
    """The field, trained once per process; the same lines give the same field."""
    data = []
    for line, config, secret in training_lines(lines, seed):
        spans, feats = analyse(line, config)
        gold = []
        for a, b in spans:
            hit = next((k for k, (x, y) in enumerate(secret) if a < y and b > x), None)
            before = gold[-1] if gold else O
            gold.append(O if hit is None else I if before in (B, I) and (hit > 0 or any(x < p[1] and y > p[0] for p in [spans[len(gold) - 1]] for x, y in [secret[hit]])) else B)
        if feats:
            data.append((feats, gold))
    return Crf().train(data)


# --- application ------------------------------------------------------------

_PLAIN_KINDS = frozenset("kind=word kind=name kind=host kind=number kind=date kind=path kind=regex kind=hash kind=uuid".split())
_SURE = ("in=url", "in=assigned-secret", "in=kv-secret", "in=login-1", "in=comment-secret", "in=default")


def _harmless(value: str, features: list[str]) -> bool:
    """Exact check after the labels: placeholders, and plain words, paths or dates where no name or place asks for a secret."""
    if "placeholder" in features and "in=url" not in features:
        return True
    plain = any(f in _PLAIN_KINDS for f in shape(value.rstrip(".,;:!?"))) or not any(c.isdigit() or c.isascii() and c.isalnum() for c in value)  # words of other scripts
    return plain and not any(f in _SURE for f in features)


_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")


def candidate_lines(text: str) -> set[int]:
    """Numbers of the lines that may hold a literal token as ``analyse`` sees it outside configuration."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    out, at = set(), 0
    while m := _LITERAL.search(text, at):
        no = bisect_right(starts, m.start())
        out.add(no)
        if no == len(starts):
            break
        at = starts[no]
    return out


def _body(piece: str, before: int) -> tuple[bool, bool, int]:
    """(whether a line may stand in a block that is closed, in one that is not, its characters of a key)."""
    core = piece.strip(" \t\r\"'`.,;\\()&|>*#-+=")
    parts = re.split(r"""["'`][\s+.\\,&]*["'`]""", core)
    if not core:
        return True, True, before
    if all(re.fullmatch(r"[A-Za-z0-9+/]+", x) for x in parts):
        n = sum(map(len, parts))
        return True, n >= 16 or before >= 40, n  # the last line of a key may be short
    header = bool(_HEADER.fullmatch(core))
    return header or bool(_ELISION.fullmatch(core)), header, 0


def key_blocks(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(label, start, start of the body, end of the body, end) of each block of a key, left to right.

    A block ends at its END mark if only lines of a key, header fields and elisions
    lie before that; else before the first line that is no line of a key.
    """
    done = 0
    for m in _BEGIN.finditer(text):
        if m.start() < done:
            continue
        close, at, kept, holds, before = f"-----END {m[1]}-----", m.end(), m.end(), True, 0
        while True:
            brk = _BREAK.search(text, at)
            stop = brk.start() if brk else len(text)
            again = text.find("-----BEGIN ", at, stop)
            if again >= 0:  # the next block takes the rest of the line
                stop, brk = again, None
            mark = text.find(close, at, stop)
            closed, opened, before = _body(text[at : mark if mark >= 0 else stop], before)
            holds = holds and opened
            if not closed:
                body, done = kept, kept
                break
            if mark >= 0:
                body, done = mark, mark + len(close)
                break
            if holds:
                kept = stop
            if not brk:
                body, done = kept, kept
                break
            at = brk.end()
        yield m[1], m.start(), m.end(), body, done


def find(text: str, path: str | None, crf: Crf) -> list[tuple[int, int, int]]:
    """(line, start, end) of each hidden stretch; stretches of one credential follow one another with the same line.

    Lines are counted by LF from 1.  A private key is one stretch, at the line of
    its opening mark, or of the quotation that opens just before it.
    """
    out: list[tuple[int, int, int]] = []
    config = bool(_CONFIG.search(path or ""))
    skip: list[tuple[int, int]] = []
    for label, start, first, last, stop in key_blocks(text):
        skip.append((start, stop))
        body = text[first:last]
        if "PRIVATE KEY" in label and _KEY_BODY.search(body) and not re.search(r"<[^<>\n]{3,}>|\.\.\.|\$\{", body):
            opened = re.search(r"(?:\"\"\"|'''|`|<<<?-?['\"]?\w+['\"]?)[ \t]*\r?\n[ \t]*$", text[max(0, start - 80) : start])
            at = start - (len(text[max(0, start - 80) : start]) - opened.start()) if opened else start
            out.append((text.count("\n", 0, at) + 1, first, last))
    marked = None if config else candidate_lines(text)
    no, begin = 0, 0
    at_skip = 0
    carried = 0  # line of a credential that goes on in the next line
    for raw in text.split("\n"):
        no += 1
        end = begin + len(raw)
        while at_skip < len(skip) and skip[at_skip][1] <= begin:
            at_skip += 1
        inside = at_skip < len(skip) and skip[at_skip][0] <= begin and end <= skip[at_skip][1]
        beside = [x for x in skip[at_skip : at_skip + 1] if x[0] < end]  # blocks on a part of the line
        while beside and at_skip + len(beside) < len(skip) and skip[at_skip + len(beside)][0] < end:
            beside.append(skip[at_skip + len(beside)])
        line = raw.rstrip("\r")
        goes_on, carried_was = False, carried
        if not inside and line and (marked is None or no in marked):
            spans, feats = analyse(line, config)
            if not all(_harmless(line[a:b], f) for (a, b), f in zip(spans, feats)):
                labels = crf.viterbi(feats)
                current = 0
                for (a, b), y, f in zip(spans, labels, feats):
                    if y == O or _harmless(line[a:b], f) or any(x < begin + b and begin + a < z for x, z in beside):
                        continue
                    first = carried_was and a < 200 and not line[:a].strip(" \t\"'`+.,&(")
                    if y == B or not current:
                        current = carried_was if first else no
                    out.append((current, begin + a, begin + b))
                    goes_on = bool(re.fullmatch(r"""["'`]\s*[+.\\&,]?\s*\\?""", line[b:])) and not line.rstrip().endswith((",", '"', "'", "`")) or line.rstrip().endswith("\\")
                    if goes_on:
                        carried = current
        if not goes_on:
            carried = 0
        begin = end + 1
    return sorted(out)


_HIDE = re.compile(r"\\[nrt]|[^\s\\]")


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every character of the stretches hidden, line breaks and escapes kept: all else stays at its place."""
    out, at = [], 0
    for _, a, b in found:
        a = max(a, at)
        out.append(text[at:a])
        out.append(_HIDE.sub(lambda m: m[0] if m[0][0] == "\\" else "X", text[a:b]))
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def _scan(crf, keys, text, path, redacted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [find(t, p, crf) for t, p in zip(b[text], b[path])]
            b["hits"] = [[{"line_no": n, "start": s, "stop": e} for n, s, e in h] for h in hits]
            if redacted:
                b["redacted"] = [redact(t, h) if h else None for t, h in zip(b[text], hits)]
            yield b[[*keys, "ingested_at", "hits", *(["redacted"] if redacted else [])]]

    return run


def scan(df: DataFrame, keys: list[str], text: str, path: str, redacted: bool = False) -> DataFrame:
    """(keys, hits array<struct<line_no,start,stop>>[, redacted]) of each row with a text.

    One row per key, the latest ``ingested_at`` wins; null texts give none.  With
    ``redacted`` only rows that hold a credential are returned, with their text.
    """
    crf = trained()
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    cols = list(dict.fromkeys([*keys, text, path, "ingested_at"]))
    rows = spread(df.where(F.col(text).isNotNull()).select(*cols), *keys)
    schema = f"{kinds}, ingested_at timestamp, hits array<struct<line_no:int,start:int,stop:int>>" + (", redacted string" if redacted else "")
    out = rows.mapInPandas(_scan(crf, keys, text, path, redacted), schema)
    if redacted:
        out = out.where(F.size("hits") > 0)
    value = F.struct("hits", *(["redacted"] if redacted else []))
    return out.groupBy(*keys).agg(F.max_by(value, F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp"))).alias("v")).select(*keys, "v.*")


def found(files: DataFrame) -> DataFrame:
    """One row per line of a file on which a credential begins."""
    hits = scan(files, ["project_id", "path"], "content", "path")
    return hits.select("project_id", F.col("path").alias("file_path"), F.explode("hits").alias("h")).select("project_id", "file_path", F.col("h.line_no").alias("line_no")).distinct()
