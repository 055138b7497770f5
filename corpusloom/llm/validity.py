"""Problem 5: source files that do not parse.

A text is cut into chunks of whole lines.  For every state that the lexer can
be in where a chunk begins (code, or inside one of the language's long
strings, comments, templates, embedded texts) a chunk has one entry of a
*state map*: the state where it ends and its *bracket summary*, the brackets
that are left when pairs within it are taken away; in XML tags are the
brackets, in JSON each level is an automaton, and blocks that are told by
their indent leave columns (``levels``).  Maps compose associatively, so the
chunks of a file are reduced in blocks, then the blocks, wherever they lie; a
file of any length is no more than its summaries in one place.

The statements are parsed in the same pass, chunk by chunk where they lie,
with a local grammar for each language, a table that one interpreter reads
(``grammar``; ``dataforms`` for JSON, TOML, XML and YAML).  What a chunk can't
tell alone is kept in its map until its neighbours are known: its first and
last token, and what is wrong only outside, or only inside, of all brackets.
All languages go this way, and no whole-file parser is used.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import effective_language
from ..sources.tables import spread
from .dataforms import MAPS as FORMS
from .dataforms import STATES, entry_for, toml_seam
from .grammar import local_map, seam
from .levels import blank_entry, join, push
from .lexer import CODE, NESTED, pattern

CHUNK = 64_000  # characters; whole lines
BLOCK = 64  # chunks whose maps are reduced together
CHECKED = [*CODE, "json", "toml", "xml", "yaml"]

# What each language can be inside of at the start of a line, and what ends it.
_STATES = {
    "python": {"td": r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""', "ts": r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"},
    "javascript": {"c": r"(?:[^*]|\*(?!/))*\*/"},
    "go": {"c": r"(?:[^*]|\*(?!/))*\*/", "t": r"[^`]*`"},
    "php": {"c": r"(?:[^*]|\*(?!/))*\*/", "d": r'(?:[^"\\]|\\[\s\S])*"', "s": r"(?:[^'\\]|\\[\s\S])*'", "m": ""},
    "rust": {"d": r'(?:[^"\\]|\\[\s\S])*"'},
    "ruby": {"b": r"(?:(?!^=end\b)[\s\S])*^=end\b[^\n]*"},
}
for _l in ("kotlin", "swift", "java", "csharp", "dart"):
    _STATES[_l] = {"c": r"(?:[^*]|\*(?!/))*\*/", "td": r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'}
for _l in ("c", "cpp", "gradle"):
    _STATES[_l] = {"c": r"(?:[^*]|\*(?!/))*\*/"}
_STATES["typescript"] = _STATES["javascript"]
_STATES["csharp"]["v"] = r'(?:[^"]|"")*"'
_STATES["cpp"] = {**_STATES["cpp"], "r": r'[\s\S]*?\)\w*"'}
# Comments that hold comments, one level as in the lexer: ``cc`` is inside the inner one.
_INNER = r"(?:[^*]|\*(?!/))*\*/"
for _l in NESTED:
    _STATES[_l] = {**_STATES[_l], "c": rf"(?:[^*/]|\*(?!/)|/(?!\*)|/\*{_INNER})*\*/", "cc": _INNER}
# Openings that the lexer does not keep together where their end lies in another chunk.
_OPENINGS = {"cpp": r'R"\w*\([\s\S]*', "rust": r'b?r\#*"[\s\S]*', "csharp": r'\$?@\$?"[\s\S]*|"""[\s\S]*', "ruby": r"^=begin\b[\s\S]*"}
_COMMENTS = ("c", "cc", "b")
_OPENED = {"/*": "c", "<!": "c", '"""': "td", "'''": "ts", "`": "t", '"': "d", "'": "s"}
_SCRIPTS = ("javascript", "typescript")
# Texts that a label on a line of its own ends.
_HERE = {
    "php": re.compile(r"<<<[ \t]*([\"']?)(?P<label>[A-Za-z_]\w*)\1(?=[ \t]*\r?\n)"),
    "ruby": re.compile(r"<<(?:[~-]|(?=[\"'`]?[A-Z_]{2}))([\"'`]?)(?P<label>[A-Za-z_]\w*)\1"),
}
_ENDLESS = re.compile(r"\s+[\w.]+[?!]?(?:\s*\([^()\n]*\))?[ \t]+=[ \t]")  # a method of Ruby that needs no end
_PHP = re.compile(r"<\?(?:php\b|=)")
_IN_TEMPLATE = re.compile(r"`|\$\{|\\[\s\S]")
_IN_CODE = re.compile(r"""`|[{}]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*[\s\S]*?\*/""")

def _base(lang: str) -> dict[str, str]:
    return _STATES.get(lang, {})


def _stacks(most: int = 5) -> list[str]:
    """What a chunk of a script may lie inside of: templates, code in them, and braces of that code."""
    out, now = [], ["`"]
    while now:
        out += now
        now = [x + y for x in now if len(x) < most for y in ("$" if x[-1] == "`" else "`{")]
    return out


def entries_of(text: str, lang: str) -> list[str]:
    """The states in which a chunk may begin; one that nothing in the chunk ends needs no entry."""
    if lang in STATES:
        return STATES[lang](text)
    out = ["", *_base(lang)]
    if lang == "rust":
        out += sorted({f"h{m}" for m in re.findall(r'"(\#*)', text)})
    if lang in _SCRIPTS and re.search(r"[`{}]", text):
        out += ["t" + s for s in _stacks()]
    if lang in _HERE:
        out += sorted({f"e{m}" for m in re.findall(r"^[ \t]*([A-Za-z_]\w*)\b", text, re.M)})
    return out


@lru_cache(maxsize=64)
def _lexer(lang: str) -> re.Pattern:
    p = pattern(lang, templates=False).pattern
    # An opening whose end lies in another chunk is not an empty string and the start of the next.
    for q, k in (('"', "td"), ("'", "ts")):
        if k in _base(lang):
            p = p.replace("(?P<s>", rf"(?P<s>(?![A-Za-z]{{0,2}}{q * 3}(?:[^{q}\\]|\\[\s\S]|{q}(?!{q}{q}))*\Z)(?:", 1).replace(")|(?P<x>", "))|(?P<x>", 1)
    if lang in _OPENINGS:
        p = p.replace("(?P<x>", f"(?P<x>{_OPENINGS[lang]}|", 1)
    if lang == "csharp":
        p = p.replace(r'(?:[^\"]|\"\")*\"', r'(?:[^\"]|\"\")*+\"', 1)
    return re.compile(p, re.M)


def _opened(piece: str, lang: str) -> str:
    """The state that an opening without its end leaves; empty if the language has none."""
    if lang == "cpp" and piece[0] == "R":
        return "r"
    if lang == "rust" and (m := re.match(r'b?r(\#*)"', piece)):
        return "h" + m[1]
    if lang == "csharp" and re.match(r'\$?@\$?"', piece):
        return "v"
    if lang == "ruby" and piece[0] == "=":
        return "b"
    piece = re.sub(r"^[A-Za-z@$]+(?=[\"'`])", "", piece)
    kind = next((_OPENED[q] for q in ('"""', "'''", "/*", "<!", "`", '"', "'") if piece.startswith(q)), "")
    return _nested(piece[2:]) if kind == "c" and lang in NESTED else kind if kind in _base(lang) else ""


def _nested(rest: str) -> str:
    return "cc" if "/*" in re.sub(rf"/\*{_INNER}", "", rest) else "c"


def _leave(text: str, lang: str, state: str) -> tuple[str, int]:
    """(state, where the string or comment ends) of a chunk that begins inside one."""
    at = 0
    if state[0] == "h":
        at = text.find('"' + state[1:])
        return ("", at + len(state)) if at >= 0 else (state, len(text))
    if state[0] == "e":
        return _here(text, 0, state[1:].split(","))
    if state[0] == "t" and lang in _SCRIPTS:
        return _template(text, 0, state[1:])
    if state == "m":
        m = _PHP.search(text)
        return ("", m.end()) if m else ("m", len(text))
    if state == "cc":
        m = re.match(_INNER, text)
        if not m:
            return state, len(text)
        at, state = m.end(), "c"
    m = re.compile(_base(lang)[state], re.M).match(text, at)
    if m:
        return "", m.end()
    return _nested(text[at:]) if state == "c" and lang in NESTED else state, len(text)


def _template(text: str, at: int, stack: str) -> tuple[str, int]:
    """(state, where the outermost template ends) from inside of the templates and braces in ``stack``."""
    while at < len(text):
        m = (_IN_TEMPLATE if stack[-1] == "`" else _IN_CODE).search(text, at)
        if not m:
            break
        at = m.end()
        sign = m[0]
        if sign == "`" and stack[-1] == "`" or sign == "}":
            stack = stack[:-1]
            if not stack:
                return "", at
        elif sign in ("`", "${", "{"):
            stack += sign[0]
    return "t" + stack, len(text)


def _here(text: str, at: int, labels: list[str]) -> tuple[str, int]:
    """(state, where the last of the texts ends that labels on lines of their own close)."""
    for i, label in enumerate(labels):
        m = re.compile(rf"^[ \t]*{label}\b", re.M).search(text, at)
        if not m:
            return "e" + ",".join(labels[i:]), len(text)
        at = m.end()
    return "", at


def scan(text: str, lang: str, state: str) -> tuple[str, list[str] | str, list[tuple[str, int, int]]]:
    """Lex a chunk from ``state``: (state at the end, brackets left or the rule that is broken, tokens).

    A string or comment that the chunk begins or ends in is a token, too.
    """
    at, left, toks, labels = 0, [], [], []
    if state:
        kind = "c" if state in _COMMENTS or state[0] == "e" else "h" if state == "m" else "s"
        state, at = _leave(text, lang, state)
        toks.append((kind, 0, at))
        if state:
            return state, left, toks
    lexer = _lexer(lang)
    while at < len(text):
        m = lexer.match(text, at)
        k, a, at = m.lastgroup if m.lastgroup != "h" else "s", m.start(), m.end()
        if k == "n":
            toks.append((k, a, at))
            if labels:
                state, at = _here(text, at, labels)
                toks.append(("c", a + 1, at))
                if state:
                    return state, left, toks
                labels = []
            continue
        if k == "w":
            continue
        if k == "x":
            kind = _opened(m[0], lang)
            if kind:
                toks.append(("c" if kind in _COMMENTS else "s", a, len(text)))
                return kind, left, toks  # goes on in the next chunk
            opened = re.sub(r"^[A-Za-z@$]+(?=[\"'`])", "", m[0])
            if lang in ("c", "cpp") and opened[0] == "'" and toks and toks[-1][0] == "d":
                at = a + 1  # digits in groups
                continue
            return "", "quote", toks
        if k == "p":
            p = m[0]
            if p == "`" and lang in _SCRIPTS:
                state, at = _template(text, at, "`")
                toks.append(("s", a, at))
                if state:
                    return state, left, toks
                continue
            if p == "?" and lang == "php" and text[at : at + 1] == ">":
                state, end = _leave(text[at + 1 :], lang, "m")
                toks.append(("h", a, at + 1 + end))
                at += 1 + end
                if state:
                    return state, left, toks
                continue
            if p == "<" and lang in _HERE and (h := _HERE[lang].match(text, a)) and not (toks and toks[-1][0] == "i" and toks[-1][2] == a):
                labels.append(h["label"])
                toks.append(("s", a, h.end()))
                at = h.end()
                continue
            if p in "([{" or p in ")]}":
                if not push(left, "code", p):
                    return "", "pair", toks
        toks.append((k, a, at))
    return "", left, toks


def ruby_blocks(text: str, toks: list[tuple[str, int, int]]) -> int:
    """Openings less ``end`` of a chunk."""
    n, start = 0, True
    for k, a, b in toks:
        if k == "n":
            start = True
            continue
        p = text[a:b]
        if k == "i" and not (a and text[a - 1] in ".:@$" or text[b : b + 1] == ":"):
            if p in ("def", "class", "module", "begin", "case", "for") and not (p == "class" and text[b : b + 1] == "."):
                n += p != "def" or not _ENDLESS.match(text, b)
            elif p == "do" and not re.search(r"^\s*(while|until|for)\b", text[text.rfind("\n", 0, a) + 1 : a]):
                n += 1
            elif p in ("if", "unless", "while", "until") and (start or text[max(0, a - 9) : a].rstrip(" ").endswith("=")):
                n += 1
            elif p == "end":
                n -= 1
        if k == "p" and p == ";":
            start = True
        elif k != "c":
            start = False
    return n


def chunks_of(text: str, size: int | None = None) -> list[str]:
    """Pieces of about CHUNK characters that end with a line feed; one behind a backslash goes on with its string."""
    size = size or CHUNK
    if len(text) <= size:
        return [text]
    out, at, line = [], 0, re.compile(r"(?<!\\)(?<!\\\r)\n")
    while at < len(text):
        m = line.search(text, min(at + size, len(text)))
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


MAPS = (
    "array<struct<enter:string,exit:string,left:array<string>,local:string,depth:int,low:int,columns:array<int>,stack:array<int>,opens:string,before:string,"
    "top:string,inner:string,roots:int,stray:boolean,ends:int,lead:string,tail:string,seen:boolean>>"
)


def chunk_map(text: str, lang: str, first: bool) -> list[dict]:
    """The map of a chunk, one entry per state that it may begin in."""
    states = ["m" if lang == "php" else ""] if first else entries_of(text, lang)
    if lang in FORMS:
        return [FORMS[lang](text, state, first) for state in states]
    if first and lang not in ("python", "php"):
        text = re.sub(r"^#![^\[\n][^\n]*", "", text.lstrip("\ufeff"))
    entries = []
    for state in states:
        exit_, left, toks = scan(text, lang, state)
        entry = local_map(text, lang, toks, first, state, _COMMENTS)
        # Brackets that don't fit decide already; the rest of the chunk was not lexed then.
        broken = left if isinstance(left, str) else ""
        entry |= {"exit": exit_, "left": [] if broken else left, "local": broken or entry["local"]}
        entry |= {"ends": ruby_blocks(text, toks) if lang == "ruby" else 0, "seen": any(k != "h" for k, _a, _b in toks)}
        entries.append(entry)
    return entries


def _maps(chunk: Column, lang: Column, no: Column) -> Column:
    """Maps of chunks.  Not told to be deterministic: a filter on them would run them again below the spreading."""

    @F.pandas_udf(MAPS)
    def udf(t: pd.Series, language: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([chunk_map(x, y, k == 0) for x, y, k in zip(t, language, n)])

    return udf.asNondeterministic()(chunk, lang, no)


KEYS = ["file_id", "repo", "language"]


def chunk_maps(files: DataFrame, size: int) -> DataFrame:
    """(file_id, repo, language, text) to one row per chunk: file_id, repo, language, chunk_no, map.

    The chunks are spread anew, so that those of a long file are lexed by as many tasks.
    """

    @F.pandas_udf("array<string>")
    def cut(t: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(x, size) for x in t])

    pieces = files.select(*KEYS, F.posexplode(cut.asNondeterministic()("text")).alias("chunk_no", "chunk"))
    return spread(pieces, "file_id", "chunk_no").select(*KEYS, "chunk_no", _maps(F.col("chunk"), F.col("language"), F.col("chunk_no")).alias("map"))


def join_maps(a: list[dict], b: list[dict], lang: str) -> list[dict]:
    """The map of two neighbours.  A state without an entry in one of them goes through it."""
    kind = lang if lang in ("json", "xml") else "code"
    known, step = {e["enter"] for e in a}, {e["enter"]: e for e in b}
    out, beginning = [], len(a) == 1  # the file's beginning has one state only
    for e in [*a, *([] if beginning else [blank_entry(s) | {"exit": s} for s in step if s not in known])]:
        n = entry_for(step, e["exit"], lang)
        if n is not None:
            rules = (("", toml_seam(e["tail"], n["lead"])) if lang == "toml" else seam(lang, e["tail"], n["lead"])) if e["tail"] and n["lead"] else ("", "")
            e = join(e, n, kind, *rules)
        out.append(e)
    return out


def _fold(parts: pd.Series, lang: pd.Series) -> pd.Series:
    """Compose the maps of neighbouring chunks, ordered by their number."""
    out = []
    for part, language in zip(parts, lang):
        maps = [list(x["map"]) for x in sorted(part, key=lambda x: x["no"])]
        out.append(reduce(lambda a, b: join_maps(a, b, language), maps) if maps else [])
    return pd.Series(out)


def reduce_maps(chunks: DataFrame) -> DataFrame:
    """One map per file: chunks go together by blocks, then blocks by file."""
    _reduced = F.pandas_udf(_fold, MAPS).asNondeterministic()
    rows = chunks.withColumn("block", F.floor(F.col("chunk_no") / BLOCK))
    part = F.collect_list(F.struct(F.col("chunk_no").alias("no"), "map"))
    blocks = rows.groupBy(*KEYS, "block").agg(part.alias("p")).withColumn("map", _reduced("p", "language")).drop("p")
    whole = blocks.groupBy(*KEYS).agg(F.collect_list(F.struct(F.col("block").cast("int").alias("no"), "map")).alias("p"))
    return whole.select(*KEYS, _reduced("p", "language").alias("map"))


def file_maps(files: DataFrame) -> DataFrame:
    """One map per file.  Files of up to CHUNK characters, nearly all, are one chunk and need no grouping."""
    size = CHUNK
    short = spread(files.where(F.length("text") <= size), "file_id").select(*KEYS, _maps(F.col("text"), F.col("language"), F.lit(0)).alias("map"))
    return short.unionByName(reduce_maps(chunk_maps(files.where(F.length("text") > size), size)))


def prepared(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, text) of the files that can be a case."""
    return files.select("file_id", "repo", effective_language("detected_language", F.regexp_replace("relative_path", r"\\", "/")).alias("language"), "text").where(F.col("language").isin(CHECKED) & F.col("text").rlike(r"\S"))


def error_of(language: Column, begin: Column) -> Column:
    """The first rule that a whole file breaks, from its only map entry; null if it breaks none."""
    form = language.isin("json", "xml")
    value = F.coalesce(F.size(begin["left"]) == 1, F.lit(False)) & F.coalesce(F.substring(F.try_element_at(begin["left"], F.lit(1)), 10, 1) == "u", F.lit(False))
    return (
        F.when(begin["local"] != "", begin["local"])
        .when(~begin["exit"].rlike("^$|^n") & ~((language == "php") & (begin["exit"] == "m")), F.lit("open"))
        .when((language == "json") & ~value, F.lit("value"))
        .when((language != "json") & (F.size(begin["left"]) > 0), F.lit("brackets"))
        .when((language == "php") & ~begin["seen"], F.lit("language"))
        .when(begin["top"] != "", begin["top"])
        .when((language == "xml") & ((begin["roots"] != 1) | begin["stray"]), F.lit("root"))
        .when((language == "python") & ((begin["opens"] == "must") | (F.size(begin["columns"]) > 1) | (F.try_element_at(begin["columns"], F.lit(1)) > 0)), F.lit("block"))
        .when((language == "yaml") & (F.size(begin["columns"]) > 1), F.lit("dedent"))
        .when(~form & begin["tail"].isin("p=", "p,") & ~language.isin("ruby"), F.lit("end"))
        .when((begin["ends"] != 0) & ~((language == "xml") & begin["seen"]), F.lit("blocks"))
    )


def verdicts(files: DataFrame) -> DataFrame:
    """One row per checked file: file_id, repo, language, error (null if it parses).

    Left out, as never a case: null and blank texts, Markdown, ini and unknown
    languages.  A file whose language is null or ``unknown`` goes by the ending
    of its path; if that is null too, it is left out.  Copies are judged each.
    """
    return file_maps(prepared(files)).select("file_id", "repo", "language", error_of(F.col("language"), F.col("map")[0]).alias("error"))


def invalid_files(files: DataFrame) -> DataFrame:
    """Ids of files that are not valid text of their language."""
    return verdicts(files).where("error is not null").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """Per repo and language: checked and invalid files and their ratio; a null repo is a group of its own."""
    bad = F.count("error")
    return verdicts(files).groupBy("repo", "language").agg(F.count("*").alias("n_files"), bad.alias("n_invalid"), (bad / F.count("*")).alias("invalid_rate"))
