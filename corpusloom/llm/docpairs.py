"""Problem 3: functions paired with their documentation.

Files are lexed and their tokens exploded into rows, white space left out and
the code between two brackets or line ends as one row.  The rest is SQL over
``(file_id, ord)``: running sums of opened and closed blocks give each row's
depth; rows that follow each other without a blank line are islands (a
running count of gaps), and lag windows over an island attach the comment
that ends right above a header, or the string that opens a Python body.  A
block's end is the next closing row at the header's depth.

Python's and Ruby's blocks have no brackets: the lexer emits rows for
indents and dedents, and for ``do``/``def``/``if`` and ``end``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import effective_language
from ..sources.tables import spread
from .lexer import CODE, lex

ROWS = "array<struct<ord:int,line:int,last:int,kind:string,text:string,step:int>>"

_STARTS = re.compile(r"^\s*(?:def|class|module|begin|case|for|while|until|if|unless)\b")
_CALLS = r"if|for|while|switch|catch|return|else|do|try|new|throw|await|yield|typeof|sizeof|using|lock|foreach|elif|match|when|function|super|this|synchronized|delete|print|assert|with|case|in|is|as|not|and|or|def|fun|func|fn|let|const|var|val|echo|guard|repeat|defer|unless|until|loop"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|readonly|export|default|synchronized|native|sealed|unsafe|extern|partial|new|inline|constexpr|const|friend|explicit|volatile|declare|get|set|mutating|open)\s+)*"
_TYPE = r"[A-Za-z_][\w.:]*(?:\s*<[^()=;]*>)?(?:\[\])*[?]?"
_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
# Name of the function that a code row heads, by language; the first group that matches holds it.
HEADERS = {
    "python": r"^(?:async\s+)?def\s+(\w+)",
    "ruby": r"^def\s+(?:self\.)?([\w?!=]+)",
    "go": r"^func\s*(?:\([^)]*\)\s*)?(\w+)",
    "rust": r"^(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\S+\s+)?)?fn\s+(\w+)",
    "kotlin": r"^(?:[\w@()]+\s+)*?fun\s+(?:<[^>]*>\s*)?(?:[\w<>?,]+\.)?(\w+)\s*\(",
    "swift": r"^(?:@\w+(?:\([^)]*\))?\s+)*(?:\w+(?:\(set\))?\s+)*?(?:func\s+([\w+*/=<>!-]+)|(init)[?!]?\s*[(<])",
    "php": r"^(?:\w+\s+)*?function\s+&?\s*(\w+)",
    "javascript": rf"^{_MODS}(?:function\s*\*?\s*([\w$]+)\s*[(<]|(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|(?:{_ARGS}|[\w$]+)\s*(?::[^=]+)?=>)|(?!(?:{_CALLS})\b)[*#]?([\w$]+)\s*(?:<[^>]*>)?{_ARGS}\s*(?::[^=;]+)?$)",
    "java": rf"^(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>]*>\s*)?(?:(?!(?:{_CALLS})\b){_TYPE}\s+)(?!(?:{_CALLS})\b)(\w+)\s*\([^;]*$|^(?:public|private|protected)\s+(\w+)\s*\([^;]*$",
    "csharp": rf"^(?:\[[^\]]*\]\s*)*{_MODS}(?:(?!(?:{_CALLS})\b){_TYPE}\s+)(?!(?:{_CALLS})\b)(\w+)\s*(?:<[^>]*>)?\([^;]*(?:=>.*)?$|^(?:public|private|protected|internal)\s+(\w+)\s*\([^;]*$",
    "c": rf"^(?!typedef\b|(?:{_CALLS})\b)(?:[A-Za-z_][\w:<>,]*[\s*&]+)+(?!(?:{_CALLS})\b)((?:\w+::)*~?\w+)\s*\([^;]*$",
}
HEADERS["typescript"] = HEADERS["javascript"]
HEADERS["cpp"] = HEADERS["c"]
HEADERS["dart"] = HEADERS["java"]
HEADERS["gradle"] = HEADERS["kotlin"]


def parameter_lists(text: str, lang: str, toks: list[tuple[str, int, int]]) -> dict[int, int]:
    """Where the parentheses of JavaScript's and TypeScript's function heads open, and where each closes."""
    if lang not in ("javascript", "typescript"):
        return {}
    out, stack, before = {}, [], ""
    seen = [(text[a:b], a) for k, a, b in toks if k not in "wnc"]
    for i, (piece, at) in enumerate(seen):
        if piece == "(":
            stack.append((at, before))
        elif piece == ")" and stack:
            start, word = stack.pop()
            after = "".join(p for p, _ in seen[i + 1 : i + 3])
            if word not in ("if", "for", "while", "switch", "with") and (after[:1] == "{" or after == "=>" or after[:1] == ":" and lang == "typescript"):
                out[start] = at
        before = piece
    return out


def rows_of(text: str, lang: str) -> list[tuple]:
    """Token rows (ord, line, last line, kind, text, step) of one file.

    Kinds: ``c`` a comment that starts its line, ``s`` a string that is a
    statement, ``k`` code, ``{`` and ``}`` block ends (step +1 and -1), ``a``
    an annotation.  Comments after code and blank lines give no row.
    """
    out, line, code, code_line, fresh, nested = [], 1, [], 0, True, 0
    indents, blocks = [0], []
    toks = lex(text, lang)
    script, heads, held, outer = lang in ("javascript", "typescript"), parameter_lists(text, lang, toks), -1, []

    def add(kind, at, last, piece, step=0):
        out.append((len(out), at, last, kind, piece, step))

    def flush():
        nonlocal code, blocks
        piece = "".join(code).strip()
        if piece:
            kind = "a" if re.match(r"@\w[\w.]*(\([^()]*\))?$|#!?\[.*\]$|\[[A-Z]\w*(\(.*\))?\]$", piece) and not (lang in ("javascript", "go") and piece[0] == "[") else "k"
            add(kind, code_line, line, piece)
        # Ruby's words that open and end blocks are part of the code row; their rows follow it.
        for at, step in blocks:
            add("{" if step > 0 else "}", at, at, "", step)
        code, blocks = [], []

    for kind, a, b in toks:
        piece = text[a:b]
        if held < 0 and a in heads:
            held = heads[a]  # the end of the head's parentheses; up to it, all is one row
        elif a > held:
            held = -1
        if kind == "n":
            if held < 0 and (nested == 0 or lang not in ("python",)):
                flush()
            elif code:
                code.append(" ")
            line += 1
            fresh = True
            continue
        if kind == "w":
            if code:
                code.append(" ")
            continue
        lines = piece.count("\n")
        if lang == "python" and fresh and kind != "c" and nested == 0:
            column = a - (text.rfind("\n", 0, a) + 1)
            if column > indents[-1]:
                indents.append(column)
                add("{", line, line, "", 1)
            while column < indents[-1]:
                indents.pop()
                add("}", line, line, "", -1)
        if kind == "c":
            if fresh and held < 0:
                add("c", line, line + lines, piece)
            line += lines
            continue
        if kind == "s" and fresh and not code and lang == "python" and nested == 0:
            add("s", line, line + lines, piece)
            line += lines
            fresh = False
            continue
        if not code:
            code_line = line
        if kind == "p" and lang not in ("python", "ruby") and piece in "{}":
            if held < 0:
                flush()
                if script:  # each block counts its own parentheses
                    if piece == "{":
                        outer.append(nested)
                    nested = outer.pop() if piece == "}" and outer else 0
                add(piece, line, line, "", 1 if piece == "{" else -1)
                fresh = False
                continue
        if kind == "p":
            nested += (piece in "([") - (piece in ")]")
            nested = max(nested, 0)
        elif kind == "i" and lang == "ruby":
            opens = piece == "do" or piece in ("def", "class", "module", "begin", "case", "for", "while", "until", "if", "unless") and fresh
            if opens and not (piece == "do" and re.match(r"\s*(while|until|for)\b", "".join(code))):
                blocks.append((line, 1))
            elif piece == "end":
                blocks.append((line, -1))
        code.append("''" if kind in "sx" else piece)
        line += lines
        fresh = False
        if lang == "go" and piece == ";" or kind == "p" and piece == ";" and lang not in ("python", "ruby", "go") and nested == 0:
            flush()
    flush()
    if lang == "python":
        for _ in indents[1:]:
            add("}", line, line, "", -1)
    return out


def token_rows(files: DataFrame) -> DataFrame:
    """(file_id, language, text) to rows of tokens.  Spread by file_id, which the windows then reuse."""

    @F.pandas_udf(ROWS)
    def udf(t: pd.Series, lang: pd.Series) -> pd.Series:
        keys = ("ord", "line", "last", "kind", "text", "step")
        return pd.Series([[dict(zip(keys, r)) for r in rows_of(x, y)] for x, y in zip(t, lang)])

    ready = spread(files.where(F.col("language").isin(CODE) & F.col("text").rlike(r"\S")), "file_id")
    return ready.select("file_id", "language", F.explode(udf("text", "language")).alias("r")).select("file_id", "language", "r.*")


def function_name(language: Column, text: Column) -> Column:
    """Name of the function that a code row heads; empty if it heads none."""
    out = F.lit("")
    for lang, pattern in HEADERS.items():
        n = re.compile(pattern).groups
        name = F.concat(*[F.regexp_extract(text, pattern, g + 1) for g in range(n)]) if n > 1 else F.regexp_extract(text, pattern, 1)
        out = F.when(language == lang, name).otherwise(out)
    return out


def functions(tokens: DataFrame) -> DataFrame:
    """One row per function: file_id, language, ord, line_no, end_line, name, header, doc (null if it has none)."""
    file = Window.partitionBy("file_id").orderBy("ord")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    so_far = file.rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("kind") == "k", function_name(F.col("language"), F.col("text"))).otherwise("")
    level = (
        tokens.withColumn("name", named)
        .withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
        .withColumn("after", F.col("depth") + F.col("step"))
        # Gaps and islands: an island is what stands on lines that follow each other and is comment or annotation.
        .withColumn("_prev_last", F.lag("last").over(file))
        .withColumn("_prev_kind", F.lag("kind").over(file))
        .withColumn("_gap", ~((F.col("line") == F.col("_prev_last") + 1) & F.col("_prev_kind").isin("c", "a")))
        .withColumn("_gap", F.coalesce("_gap", F.lit(True)) & (F.col("step") == 0))
        .withColumn("island", F.sum(F.col("_gap").cast("int")).over(so_far))
        .withColumn("_next_s", F.lead(F.struct("kind", "text"), 1).over(Window.partitionBy("file_id", F.col("kind") == "c").orderBy("ord")))
        .withColumn("_next_2", F.lead(F.struct("kind", "text"), 2).over(Window.partitionBy("file_id", F.col("kind") == "c").orderBy("ord")))
    )
    # The comment of an island, gathered up to the header that ends it.
    island = Window.partitionBy("file_id", "island").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    above = F.array_join(F.collect_list(F.when(F.col("kind") == "c", F.col("text"))).over(island), "\n")
    opening = F.when((F.col("_next_s")["kind"] == "{") & (F.col("_next_2")["kind"] == "s"), F.col("_next_2")["text"])
    # The next closing row at the same depth ends the block.
    key = F.when(F.col("name") != "", F.col("depth")).when((F.col("step") < 0), F.col("after"))
    same = Window.partitionBy("file_id", "_key").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    # Dedents are found on the line after the block, closing brackets on its last.
    closing = F.when(F.col("step") < 0, F.when(F.col("language") == "python", F.coalesce(F.col("_prev_last"), F.col("line"))).otherwise(F.col("line")))
    return (
        level.withColumn("doc", F.when(F.col("language") == "python", opening).otherwise(F.nullif(above, F.lit(""))))
        .withColumn("_key", key)
        .withColumn("end_line", F.when(F.col("_key").isNotNull(), F.first(closing, ignorenulls=True).over(same)))
        .where(F.col("name") != "")
        .select("file_id", "language", "ord", F.col("line").alias("line_no"), F.coalesce("end_line", "last").alias("end_line"), "name", F.col("text").alias("header"), "doc")
    )


_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*+(?!\*)|///?!?|//+!?|#+!?|--+|=begin|=end|<!--|-->)[ \t]?|\*+/[ \t]*$|-->[ \t]*$", re.M)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|[@\\](?:param|returns?|throws?|exception|see|since|author|version|deprecated|brief|type|arg|property|template|note)\b(?:\s*\{[^}]*\})?|\{@\w+|:(?:param|type|returns?|rtype|raises)\b[^:\n]*:|^[ \t]*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Examples?|Notes?)\s*:?[ \t]*$", re.M)
_TODO = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|TBD|WIP|BUG)\b", re.I)
_CODE = re.compile(
    r"^\s*(?:(?:return|throw|raise|break|continue|yield|await)\b[^.]*[;()\[\]%*+/-]|return\s+\S+;?$|(?:const|let|var|val|auto|int|long|float|double|string|char|bool|final|local|my)\s+\$?\w+(?:\s*:\s*\w+)?\s*:?=|[$@]?[\w.\[\]>-]+\s*(?::=|[-+*/%|&]?=)(?!=)\s*\S|(?:if|for|while|switch|foreach|elif|catch)\s*\(.*\)\s*\{?$|(?:if|for|while|elif|else)\b.*[:{]$|(?:import|from|use|using|package|require|include|#include)\s+[\w.\"'<{:]+.*;?$|(?:public|private|protected|static|async|export|def|fn|func|fun|function|class)\b.*[({:]\s*$|[\w.$>:-]+\(.*\)\s*[;{]?$|.*[;{}]$|(?:end|else|pass|}\)?|\);?)$)"
)
_CJK = re.compile(r"[㐀-鿿぀-ヿ豈-﫿ｦ-ﾟ]")
_WORD = re.compile(r"[^\W_][\w'’ऀ-ॿ�-]*|�+")


def clean_doc(doc: str) -> str:
    """A comment or docstring without its marks, commented-out code and to-do notes."""
    if re.match(r"^[rRuUbBfF]{0,2}(\"\"\"|'''|\"|')", doc):
        body = re.sub(r"^[rRuUbBfF]{0,2}(\"\"\"|'''|\"|')([\s\S]*?)\1$", r"\2", doc)
    else:
        body = _MARKS.sub("", _MARKS.sub("", doc))
    keep, skipping = [], False
    for line in body.replace("\r", "").split("\n"):
        s = line.strip()
        if not s or s[:1] in "@:":
            skipping = False
        elif _TODO.match(s):
            skipping = True  # a note goes on to the end of its paragraph
        if not skipping and not _CODE.match(s):
            keep.append(s)
    return "\n".join(keep).strip()


def is_meaningful(doc: str, name: str, header: str) -> bool:
    """At least six words, or ten Chinese or Japanese signs, beyond name, tags and parameter names."""
    text = _TAG.sub(" ", clean_doc(doc))
    inner = header[header.find(name) + len(name) :]
    inner = inner[inner.find("(") + 1 :] if "(" in inner else ""
    own = {name.lower()}
    for part in re.split(r"[,()]", inner):
        ids = re.findall(r"[A-Za-z_]\w*", part.split("=")[0].split(":")[0])
        own.update({ids[-1].lower(), ids[0].lower()} if ids and len(ids) < 4 else [])
    lost = len(re.findall(r"�", text)) // 3
    if len(_CJK.findall(text)) + (lost if re.search(r"�{36,}", text) else 0) >= 10:
        return True
    words = [w for w in _WORD.findall(_CJK.sub(" ", text)) if w.lower() not in own and re.search(r"[^\W\d_]|�", w)]
    return len(words) >= 6


def with_signatures(found: DataFrame, declarations: DataFrame) -> DataFrame:
    """Add ``signature``, as the declarations table has it for the function; null where it has none.

    Its line numbers may be stale and a name may stand in a file more than
    once: of the declarations of that name the one nearest by line is taken,
    ties by decl_id.
    """
    name = F.regexp_extract("signature", r"^(?:func\s*\([^()]*\)\s*)?.*?([\w$]+[?!]?)\s*(?:<[^<>()]*>)?\s*\(", 1)
    known = declarations.where("kind = 'function' and signature is not null").select("file_id", name.alias("name"), "decl_id", "start_line", "signature").where("name <> ''")
    far = F.coalesce(F.abs(F.col("start_line") - F.col("line_no")), F.lit(1 << 30))
    nearest = found.select("file_id", "name", "line_no").join(known, ["file_id", "name"]).groupBy("file_id", "name", "line_no").agg(F.min_by("signature", F.struct(far, F.col("decl_id"))).alias("signature"))
    return found.join(nearest, ["file_id", "name", "line_no"], "left")


def pairs(files: DataFrame, invalid: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """Functions with non-trivial documentation: file_id, line_no, end_line, name, header, description.

    ``invalid`` holds the ids of files that do not parse; none of their
    functions count.  ``repaired`` (file_id, text) replaces wrongly decoded
    texts, so that their documentation counts as the original would.  Null and
    blank texts and unknown languages give no row; copies count under each id.
    """
    ready = files.select("file_id", effective_language("detected_language", F.regexp_replace("relative_path", r"\\", "/")).alias("language"), "text").where(F.col("language").isin(CODE))
    ready = ready.join(invalid.select("file_id"), "file_id", "left_anti")
    if repaired is not None:
        ready = ready.join(repaired.select("file_id", F.col("text").alias("_fixed")), "file_id", "left").select("file_id", "language", F.coalesce("_fixed", "text").alias("text"))

    @F.pandas_udf("description string, good boolean")
    def judge(doc: pd.Series, name: pd.Series, header: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(clean_doc(d), is_meaningful(d, n, h)) for d, n, h in zip(doc, name, header)], columns=["description", "good"])

    found = functions(token_rows(ready)).where("doc is not null")
    return found.withColumn("_j", judge.asNondeterministic()("doc", "name", "header")).where("_j.good").select("file_id", "line_no", "end_line", "name", "header", F.col("_j.description").alias("description"))
