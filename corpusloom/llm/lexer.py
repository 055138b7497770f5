"""A small regular-expression lexer shared by the operators on source code.

One compiled pattern per language family cuts a text into tokens
``(kind, start, end)``.  Kinds: ``w`` white space, ``n`` line feed, ``c``
comment, ``s`` string, ``x`` string or comment that is not closed, ``d``
number, ``i`` identifier, ``p`` one sign.  The kinds cover the text without
gaps, so offsets can be used to replace parts of it.
"""

from __future__ import annotations

import re
from functools import lru_cache

SLASH = "javascript typescript java kotlin csharp go rust cpp c php swift dart gradle".split()
NESTED = {"rust", "kotlin", "swift"}
CODE = "python ruby".split() + SLASH

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"


# A template may hold templates in its ``${}``, here one level deep.
_INSIDE = r"\$\{(?:[^`{}]|\{[^{}`]*\}|`(?:[^`\\]|\\[\s\S])*+`)*+\}"
_TEMPLATE = rf"`(?:[^`\\$]|\\[\s\S]|{_INSIDE}|\$)*+`|`(?:[^`\\]|\\[\s\S])*+`"


def _rules(lang: str, templates: bool = True) -> tuple[str, str, str]:
    """Patterns of comments, closed strings and openings without an end."""
    triple = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""'
    if lang == "python":
        pre = r"(?:\b(?:[rR][bBfF]?|[bBfFuU][rR]?|[tT][rR]?))?"
        return (r"\#[^\n]*", rf"{pre}(?:{triple}|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|{_DQ}|{_SQ})", rf"{pre}(?:\"\"\"[\s\S]*|'''[\s\S]*|\"(?:[^\"\\\n]|\\[\s\S])*|'(?:[^'\\\n]|\\[\s\S])*)")
    if lang == "ruby":
        regex = r"(?:(?<=[=(,~|&!{\[])|(?<=[=(,~|&!{\[][ ])|(?<=when[ ])|(?<=if[ ])|(?<=and[ ]))/(?![ =*/])(?:[^/\\\n]|\\.)+/[a-z]*"
        words = r"(?<![\w)\]])%[wWiIqQrx]?(?:\[[^\]]*\]|\([^()]*\)|\{[^{}]*\})"
        return (r"\#[^\n]*|^=begin\b[\s\S]*?^=end\b[^\n]*", rf"{_DQ}|{_SQ}|`[^`\n]*`|{regex}|{words}", r"\"[^\n]*|'[^\n]*")
    if lang in SLASH:
        block = r"/\*(?:[^*]|\*(?!/))*\*/"
        if lang in NESTED:
            block = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
        comment = rf"//[^\n]*|{block}"
        if lang == "php":
            comment += r"|\#(?!\[)[^\n]*"
        if lang in ("javascript", "typescript"):
            regex = r"(?:(?<=[=(,:!&|?;{}\[])|(?<=[=(,:!&|?;{}\[][ ])|(?<=return[ ]))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
            if not templates:
                return (comment, rf"{_DQ}|{_SQ}|{regex}", r"/\*[\s\S]*|\"[^\n]*|'[^\n]*")
            return (comment, rf"{_DQ}|{_SQ}|{_TEMPLATE}|{regex}", r"/\*[\s\S]*|`[\s\S]*|\"[^\n]*|'[^\n]*")
        if lang == "go":
            return (comment, rf"{_DQ}|'(?:[^'\\\n]|\\[^\n])+'|`[^`]*`", r"/\*[\s\S]*|`[\s\S]*|\"[^\n]*|'[^\n]*")
        if lang == "rust":
            return (comment, r"b?r(?P<h>\#*)\"[\s\S]*?\"(?P=h)|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]+?)'", r"/\*[\s\S]*|\"[\s\S]*")
        if lang in ("java", "kotlin", "swift", "dart"):
            extra = rf"|{_SQ}" if lang != "swift" else ""
            return (comment, rf"{triple}|{_DQ}{extra}", r"/\*[\s\S]*|\"\"\"[\s\S]*|\"[^\n]*" + (r"|'[^\n]*" if extra else ""))
        if lang == "csharp":
            return (comment, rf"{triple}|\$?@\$?\"(?:[^\"]|\"\")*\"|\$?{_DQ}|{_SQ}", r"/\*[\s\S]*|@\"[\s\S]*|\"[^\n]*|'[^\n]*")
        if lang == "php":
            return (comment, r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'", r"/\*[\s\S]*|\"[\s\S]*|'[\s\S]*")
        if lang == "cpp":
            return (comment, rf"R\"\w*\([\s\S]*?\)\w*\"|{_DQ}|{_SQ}", r"/\*[\s\S]*|\"[^\n]*|'[^\n]*")
        return (comment, rf"{_DQ}|{_SQ}", r"/\*[\s\S]*|\"[^\n]*|'[^\n]*")
    if lang in ("yaml", "toml", "dockerfile", "env"):
        return (r"(?:^|(?<=\s))\#[^\n]*", rf"{triple}|{_DQ}|'(?:[^'\n]|'')*'", r"\"[^\n]*")
    if lang == "ini":
        return (r"^[ \t]*[;\#][^\n]*", rf"{_DQ}|{_SQ}", r"(?!)")
    if lang == "xml":
        return (r"<!--[\s\S]*?-->", rf"{_DQ}|'[^'\n]*'", r"<!--[\s\S]*")
    return (r"(?!)", _DQ, r"(?!)")


@lru_cache(maxsize=64)
def pattern(lang: str, templates: bool = True) -> re.Pattern:
    """The compiled lexer; without ``templates`` a back quote of a script is a sign of its own."""
    comment, string, bad = _rules(lang, templates)
    sign = r"'[^\W\d]\w*(?!')|[\s\S]" if lang == "rust" else r"[\s\S]"  # Rust's lifetimes
    name = r"[^\W\d]\w*" if lang not in ("javascript", "typescript", "php", "java") else r"(?:[^\W\d]|\$)[\w$]*"
    return re.compile(rf"(?P<n>\n)|(?P<w>[^\S\n]+)|(?P<c>{comment})|(?P<s>{string})|(?P<x>{bad})|(?P<d>\d\w*(?:\.\d\w*)?)|(?P<i>{name})|(?P<p>{sign})", re.M)


def lex(text: str, lang: str) -> list[tuple[str, int, int]]:
    """All tokens of ``text``."""
    return [(m.lastgroup, m.start(), m.end()) for m in pattern(lang).finditer(text)]
