"""Problem 2: credentials in source code, configuration and rendered Markdown.

A text is cut into tokens by the lexer of its language.  A literal is a
credential if it is assigned or passed to an identifier named for one and is
no placeholder, or if its form alone shows it (issued keys, signed tokens,
private keys, a password in an address or in an Authorization header).
Configuration and prose have no string tokens to rely on; there each line is
read as ``key separator value``.  Markdown is read fence by fence.

Only the literal's content is ever replaced: quotes, prefixes, line ends and
escapes outside it stay as they are, so the text around it still parses.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import SUFFIX_LANGUAGE, language_of, name_of
from ..sources.tables import spread
from .lexer import CODE, lex

SPANS = "array<struct<line_no:int,start:int,stop:int,rule:string>>"
MASK = "REDACTED"

_SECRET_WORDS = {"password", "passwd", "pwd", "passphrase", "passwort", "pass", "secret", "secrets", "token", "apikey", "credential", "credentials", "creds", "auth", "pw"}
_KEY_BEFORE = {"api", "access", "private", "signing", "encryption", "service", "secret", "auth", "master", "account", "storage", "shared", "client", "app", "admin", "root", "deploy", "license", "hmac", "session", "aes"}
# A last word that makes a name say something about a credential instead of holding one.
_ABOUT = set("hint field name path label limit mode ratio url uri id type count length len size min max regex pattern policy file env ttl expiry expires header prefix suffix budget index kind class counter list ids names text title format rule rules hash help error message placeholder version status".split())
_PLACEHOLDER = re.compile(
    r"(?i)^(|[*x#.•_-]+|\W+|null|none|nil|undefined|true|false|todo\b.*|tbd|fixme.*|n/?a|unset|empty|default|test|example\S*|sample\S*|dummy\S*|fake\S*|changeme\S*|change[-_ ]?me\S*|replace[-_ ]?me\S*|redacted|masked|hidden|removed|secret|password|passwd|pass|token|key|api[-_]?key|[a-z]+[-_](password|secret|token|key|passwd|pwd)|insert\S*|enter\S*|(your|my|the)[-_ ].*|.*[-_]here|.*placeholder.*)$"
    r"|^[<\[({%].*[>\])}%]$|^\$\{?\w|^\$\(|\$\{[^}]*\}|\{\{|<%|^%\(?\w|^@\w+@$|^#\{|^(vault|env|ssm|kms|secretsmanager|aws|gcp|azure|keyring|file|op|sops|secret|ref|arn|config|k8s)[:/]|^(os\.|process\.|system\.|env\[|getenv|ENV\b)|^/(run|etc|var|opt|home|usr)/|(\*{3,}|x{6,}|•{3,})|^-----BEGIN (PUBLIC|CERT)|^ssh-(rsa|ed25519)|^sha\d+[-:]|^data:"
)
_PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_FORMS = re.compile(
    rf"(?P<pem>{_PEM}(?:(?!-----END)[\s\S])*(?:-----END [A-Z0-9 ]*-----)?)"
    r"|(?P<issued>\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{18,}|(?:AKIA|ASIA)[0-9A-Z]{16}\b|AIza[\w-]{35}|(?:sk|rk|pk)_(?:live|prod)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{32,}|xox[abeprs]-[\w-]{10,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|dop_v1_[0-9a-f]{40,}|pypi-[\w-]{30,}|ya29\.[\w-]{20,}))"
    r"|(?P<signed>\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
    r"|[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>`]*:(?P<url>[^\s/\"'<>`]+)@[\w.\[-]"
    r"|(?i:authorization\b\W{0,4}\s*(?:basic|bearer|token)|\b(?:bearer|basic))\s+(?P<header>[A-Za-z0-9+/_=.-]{12,})"
    r"|[?&;](?i:(?:access_?|auth_?|api_?)?(?:token|key)|password|passwd|pwd|secret|sig(?:nature)?|client_secret)=(?P<query>[^\s&\"'<>`#;]+)"
    r"|(?i:(?<=\s)(?:-u|--user)[ =]+[\w.-]+:)(?P<user>[^\s\"']+)|(?i:--(?:password|token|api-key|secret)[= ]+)(?P<flag>[^\s\"'\\]+)"
)
# Notes that tell a login: what follows a name, and what must stand before that.
_TOLD = re.compile(r" (?:as [`\"']?[\w.@-]+[`\"']? (?:with|using) (?:(?:the )?(?:password|passwd|pwd|secret|token) )?[`\"']?(?P<with>[^\s\"'`]{6,})|/ (?P<login>[^\s\"'`|]{8,})(?=[ \t]*(?:\*/|-->)?[ \t]*\r?$))", re.M)
_LOGIN = re.compile(r"(?i)\b(?:(?:log|sign)(?:ged|ging|ning|ed|s)?[- _]?in|authenticated?|connect(?:ed)?|user(?:name)?|account|cred(?:ential)?s?)[:=]?(?:[ \t]+[\w.@-]+)?$")
_PAIR = re.compile(r"""(?P<q>[`"']?)(?P<k>[A-Za-z_$][\w.$-]*)(?P=q)[^\S\n]*(?P<o>:=|=>|=(?!=)|:(?!:|//))[^\S\n]*(?:"(?P<dq>(?:[^"\\\n]|\\.)*)"|'(?P<sq>(?:[^'\\\n]|\\.|''(?=[^\n']*'))*)'|`(?P<bq>[^`\n]*)`|(?P<bare>[^\s"'`,;{}\[\]<>&][^\s&]*))""")
_PASSED = re.compile(r"\b(?P<k>[A-Za-z]+(?:_[A-Za-z]+)+|[a-z]+[A-Z]\w+|(?i:password|passwd|pwd|passphrase|passwort|apikey|token|secret|creds|credentials))(?:\s+is)?[ \t]+[`\"']?(?P<v>[^\s`\"',;]{6,})")
_TAG = re.compile(r"<(?P<k>[A-Za-z_][\w.-]*)[^<>]*>(?P<v>[^<\n]+)</(?P=k)>")
# Words of messages and prompts; a phrase with one of them is no password.
_TALK = set("a an and are as at be by can cannot check does enter field for from forgot has have here in input invalid is it its key login match missing must need new no not of old on or please reset set should strong than that the this to too type use user valid was weak when with wrong you your".split())
# Calls that only wrap a literal, and languages in which neighbouring literals are one.
_WRAPPERS = {"from", "String", "str", "Some", "bytes", "Secret", "SecretString", "SecretStr", "to_string", "fromString"}
_ADJOINED = ("python", "c", "cpp", "ruby", "dart")
_CONNECT = re.compile(r"(?i)(connect|login|log_in|sign_?in|open_?session|auth|authenticate|basic_?auth|credential|open_?client|new_?client)")
_GETTER = re.compile(r"(?i)(^|_)(get|getenv|env|lookup|read|fetch|load|find|resolve)|get$|getenv|environ")
_FENCE = re.compile(r"^[ \t]*(?:>[ \t]*)?(`{3,}|~{3,})[ \t]*([\w+#.-]*)[^\n`]*$", re.M)
_ALIAS = SUFFIX_LANGUAGE | {"bash": "env", "sh": "env", "shell": "env", "env": "env", "dotenv": "env", "dockerfile": "env", "c++": "cpp", "c#": "csharp", "golang": "go", "py3": "python"} | {v: v for v in SUFFIX_LANGUAGE.values()}


def names_credential(name: str) -> bool:
    """Whether an identifier is named for a credential it holds."""
    words = re.findall(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+", name)
    words = [w.lower() for w in words]
    if not words or words[-1] in _ABOUT or words[0] in ("public", "host", "verify", "is", "has", "no"):
        return False
    if any(w in _SECRET_WORDS for w in words):
        return "public" not in words
    return "".join(words) in ("apikey", "accesskey", "secretkey", "privatekey") or words[-1] in ("key", "keys") and len(words) > 1 and words[-2] in _KEY_BEFORE


def is_secret(value: str, strict: bool = False) -> bool:
    """Whether a value can be a credential: no placeholder, reference, label or number."""
    v = value.strip()
    if len(v) < 4 or _PLACEHOLDER.search(v) or re.search(r"\s", v) or re.fullmatch(r"[\d.,+-]+%?", v) and len(v) < 8:
        return False
    if re.fullmatch(r"[A-Za-z]+(/[A-Za-z]+)+", v) or len(v) > 12 and not v.isascii() or len(set(v)) < 3:
        return False
    return not strict or bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v)) or bool(re.search(r"[^\w\s.,]", v) and len(v) >= 8)


def is_passphrase(name: str, value: str) -> bool:
    """Whether the value of a password is a phrase of plain words that says nothing about passwords itself."""
    words = value.split()
    if not re.search(r"(?i)pass|pwd|secret", name) or not 3 <= len(words) <= 8 or not all(re.fullmatch(r"[a-z0-9]{2,12}", w) for w in words):
        return False
    return len(set(words)) == len(words) and not any(w in _SECRET_WORDS or w in _ABOUT or w in _TALK for w in words)


def _by_form(text: str, at: int) -> list[tuple[int, int, str]]:
    out = []
    for m in _FORMS.finditer(text):
        rule = m.lastgroup
        a, b = m.span(rule)
        v = m[rule]
        if rule == "pem":
            a = m.start() + re.match(_PEM, v).end()
            b = m.start() + (v.rindex("-----END") if "-----END" in v else len(v))
            if re.search(r"(?i)\.\.\.|redacted|<[^>]*>|\*{4}", text[a:b]) or len(re.sub(r"\\n|\s", "", text[a:b])) < 16:
                continue
        elif rule in ("url", "query", "user", "flag") and not is_secret(v):
            continue
        elif rule == "header":
            if not is_secret(v) or not re.search(r"[\d+/=._-]|[a-z][A-Z]", v):
                continue
            if re.search(r"(?i)basic\s+$", text[m.start() : a]):
                try:
                    if ":" not in base64.b64decode(v + "=" * (-len(v) % 4)).decode() or not is_secret(base64.b64decode(v + "=" * (-len(v) % 4)).decode().split(":", 1)[1]):
                        continue
                except ValueError:
                    continue
        elif rule == "issued" and re.search(r"(?i)x{6,}|example|0{8,}|\*{3}", v):
            continue
        out.append((at + a, at + b, rule))
    for m in _TOLD.finditer(text):
        if is_secret(m[m.lastgroup], True) and _LOGIN.search(text[text.rfind("\n", 0, m.start()) + 1 : m.start()]):
            out.append((at + m.start(m.lastgroup), at + m.end(m.lastgroup), "told"))
    return out


def _in_lines(text: str, at: int, strict: bool) -> list[tuple[int, int, str]]:
    """Credentials in ``key separator value`` lines."""
    out = []
    from_ = 0
    while m := _PAIR.search(text, from_):
        named = names_credential(m["k"])
        # The value of another name may itself be a pair, as in ``note: token=...``.
        from_ = m.start("bare") if not named and m["bare"] and _PAIR.match(text, m.start("bare")) else m.end()
        if named:
            group = next(g for g in ("dq", "sq", "bq", "bare") if m[g] is not None)
            if is_secret(m[group].rstrip(",;)") if group == "bare" else m[group], strict) and not (group == "bare" and re.search(r"[(\[]", m[group]) and m["o"] != "="):
                out.append((at + m.start(group), at + m.start(group) + len(m[group].rstrip(",;)") if group == "bare" else m[group]), "named"))
    for m in _PASSED.finditer(text):
        v = m["v"].rstrip(".")
        # After a mere word of prose, a value of one hyphen is prose too.
        sure = re.search(r"[_\d]|[a-z][A-Z]", m["k"] + v) or len(re.findall(r"[^\w\s.,]", v)) > 1
        if names_credential(m["k"]) and sure and is_secret(v, True):
            out.append((at + m.start("v"), at + m.start("v") + len(v), "named"))
    for m in _TAG.finditer(text):
        if names_credential(m["k"]) and is_secret(m["v"], strict):
            out.append((at + m.start("v"), at + m.end("v"), "named"))
    return out


def _content(piece: str) -> tuple[int, int]:
    """Where the content of a string token starts and stops."""
    m = re.match(r"[A-Za-z@$]*#*(\"\"\"|'''|[\"'`])", piece)
    if not m:
        return 0, len(piece)
    q = m[1]
    stop = len(piece.rstrip("#"))
    return m.end(), stop - len(q) if piece[:stop].endswith(q) and stop - len(q) >= m.end() else stop


def _assigned(toks: list[tuple[str, int, int, str]], i: int, text: str) -> str:
    """The name that the expression which begins at token ``i`` is assigned to, or an empty string."""
    j = i - 1
    if j > 0 and toks[j][3] == ">" and toks[j - 1][3] == "=":
        j -= 1
    if not (j > 0 and toks[j][3] in ("=", ":") and not (toks[j - 1][3] in ("=", "!", "<", ">") and toks[j - 1][2] == toks[j][1])):
        return ""
    by = toks[j][3]
    j -= 1
    if toks[j][3] == ":":
        j -= 1
    if toks[j][3] == "]" and j > 1 and toks[j - 1][0] == "s":
        j -= 1
    elif toks[j][3] == ">" and by == "=":  # a type with parameters
        depth = 0
        while j > 0 and (depth := depth + (toks[j][3] == ">") - (toks[j][3] == "<")) > 0:
            j -= 1
        j -= j > 0
    elif toks[j][0] == "p" and toks[j][3] in "?!>]*":
        while j > 0 and (toks[j][0] == "p" and toks[j][3] in "?!<>[]*&"):
            j -= 1
    if j > 1 and toks[j][0] == "i" and toks[j - 1][3] == ":" and toks[j - 2][0] == "i" and by == "=" and "\n" not in text[toks[j - 1][1] : toks[j][1]]:
        j -= 2  # name : type = literal
    elif j > 2 and toks[j][0] == "i" and toks[j - 1][3] in "&*" and toks[j - 2][3] == ":":
        j -= 3
    if toks[j][0] == "i":
        return toks[j][3].lstrip("$")
    if toks[j][0] == "s":
        a, b = _content(toks[j][3])
        return toks[j][3][a:b]
    return ""


def _wrapped(toks: list[tuple[str, int, int, str]], i: int) -> int:
    """Where the expression begins that only wraps the literal at ``i``: ``String::from("...")``, ``Some("...")``, ``("...")``."""
    while i > 0 and toks[i - 1][3] == "(":
        j = i - 1
        if j and toks[j - 1][0] == "i" and toks[j - 1][3] in _WRAPPERS:
            j -= 1
            while j > 1 and (toks[j - 1][3] in (".", ":") or toks[j - 1][0] == "i" and toks[j][3] in (".", ":") or toks[j - 1][3] == "new"):
                j -= 1
        elif j and toks[j - 1][0] == "i":
            return i
        i = j
    return i


def _in_code(text: str, lang: str, at: int) -> list[tuple[int, int, str]]:
    """Credentials among the literals that are assigned or passed."""
    out, toks, comments = [], [], []
    for k, a, b in lex(text, lang):
        if k == "c":
            comments.append((a, b))
        elif k not in "wn":
            toks.append((k, a, b, text[a:b]))
    calls: list[tuple[str, int]] = []  # callee and number of string arguments so far
    groups: list[tuple[str, list[tuple[int, int]]]] = []
    previous = None
    for i, (k, a, b, piece) in enumerate(toks):
        if k == "p":
            if piece == "(":
                calls.append((toks[i - 1][3] if i and toks[i - 1][0] == "i" else "", 0))
            elif piece == ")" and calls:
                calls.pop()
            continue
        if k not in "sx":
            continue
        x, y = _content(piece)
        span = (a + x, a + y)
        # A literal may hold configuration itself; escaped quotes are read as quotes, at the same offsets.
        if y - x > 8:
            out += _in_lines(piece[x:y].replace('\\"', ' "').replace("\\'", " '"), at + a + x, True)
        before = toks[i - 1][3] if i else ""
        joined = before in ("+", ".") and previous == i - 2 or previous == i - 1 and lang in _ADJOINED
        if joined and groups:
            groups[-1][1].append(span)  # a literal in parts
            previous = i
            continue
        previous = i
        name = _assigned(toks, _wrapped(toks, i), text)
        if name:
            groups.append((name, [span]))
        elif calls and before in ("(", ","):
            callee, n = calls[-1]
            calls[-1] = (callee, n + 1)
            passed = (names_credential(callee) and n == 0 or _CONNECT.search(callee) and n == 1) and not _GETTER.search(callee)
            groups.append(("password" if passed else "", [span]))
        else:
            groups.append(("", [span]))
    for name, spans in groups:
        value = "".join(text[a:b] for a, b in spans)
        if name and names_credential(name) and (is_secret(value) or is_passphrase(name, value)):
            out += [(at + a, at + b, "named" if n == 0 else "part") for n, (a, b) in enumerate(spans)]
    for a, b in comments:
        out += _in_lines(text[a:b], at + a, True)
    return out


def find(text: str, lang: str) -> list[tuple[int, int, int, str]]:
    """All credentials of a text as (line, start, stop, rule), without overlaps, in order."""
    spans: list[tuple[int, int, str]] = []
    if lang == "markdown":
        at, inside = 0, None
        cuts = []
        for m in _FENCE.finditer(text):
            if inside is None:
                cuts.append((at, m.start(), ""))
                inside, at = (m[1], _ALIAS.get(m[2].lower(), "") or "-"), m.end()
            elif m[1].startswith(inside[0]) and not m[2]:
                cuts.append((at, m.start(), inside[1]))
                inside, at = None, m.end()
        cuts.append((at, len(text), inside[1] if inside else ""))
        for a, b, kind in cuts:
            spans += _in_code(text[a:b], kind, a) if kind in CODE else _in_lines(text[a:b], a, False)
    elif lang in CODE:
        spans = _in_code(text, lang, 0)
    else:
        spans = _in_lines(text, 0, False)
    spans += _by_form(text, 0)
    out, last, line, seen = [], -1, 1, 0
    for a, b, rule in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= last:
            line += text.count("\n", seen, a)
            seen, last = a, b
            out.append((line, a, b, rule))
    return out


def credential_spans(records: DataFrame, text: str, language: str) -> DataFrame:
    """Add ``spans``, an array of (line_no, start, stop, rule); null for texts that are null or blank."""

    @F.pandas_udf(SPANS)
    def udf(t: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("line_no", "start", "stop", "rule"), s)) for s in find(x, y)] for x, y in zip(t, lang)])

    some = F.col(text).rlike(r"\S")
    # Not told to be deterministic: a filter on the spans would search the texts a second time, below the spreading.
    return records.where(some).withColumn("spans", udf.asNondeterministic()(F.col(text), F.col(language)))


def config_language(path: Column) -> Column:
    base = F.lower(name_of(path))
    return F.when(base.rlike(r"^\.env|\.env$|^dockerfile$"), "env").otherwise(language_of(path))


def records_of(inputs: DataFrame, responses: DataFrame) -> DataFrame:
    """Uploads and responses as one table (record_kind, record_id, text, language)."""
    path = F.regexp_replace(F.coalesce(F.col("name"), F.lit("")), r"\\", "/")
    a = inputs.select(F.lit("input_file").alias("record_kind"), F.col("input_id").cast("long").alias("record_id"), F.col("content").alias("text"), config_language(path).alias("language"))
    b = responses.select(F.lit("sift_response").alias("record_kind"), F.col("response_id").cast("long").alias("record_id"), F.col("markdown").alias("text"), F.lit("markdown").alias("language"))
    return a.unionByName(b)


def credentials(records: DataFrame) -> DataFrame:
    """One row per line that holds a credential: (record_kind, record_id, line_no).

    Null and blank texts give no row; a null language is read as plain lines;
    repeated rows count under each id; a secret over several lines counts on
    its first.
    """
    found = credential_spans(spread(records, "record_kind", "record_id"), "text", "language")
    lines = F.array_distinct(F.transform(F.filter("spans", lambda s: s["rule"] != "part"), lambda s: s["line_no"]))
    return found.select("record_kind", "record_id", F.explode(lines).alias("line_no"))


def redacted(records: DataFrame, mask: str = MASK) -> DataFrame:
    """Every text with the contents of its credentials replaced: (record_kind, record_id, text, n_masked).

    A text without credentials comes back unchanged, a null one as null.
    """

    @F.pandas_udf("text string, n_masked int")
    def udf(t: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(t, lang):
            spans = find(x, y) if isinstance(x, str) and x.strip() else []
            out, at = [], 0
            for _, a, b, _rule in spans:
                out += [x[at:a], mask]
                at = b
            rows.append(("".join(out) + x[at:] if spans else x, len(spans)))
        return pd.DataFrame(rows, columns=["text", "n_masked"])

    return spread(records, "record_kind", "record_id").withColumn("_r", udf.asNondeterministic()("text", "language")).select("record_kind", "record_id", F.col("_r.text").alias("text"), F.col("_r.n_masked").alias("n_masked"))
