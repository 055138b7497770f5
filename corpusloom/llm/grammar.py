"""Local grammars: what may stand beside what in a statement, and what may begin one, by language.

A grammar is a table (:class:`Grammar`); one interpreter reads all of them.
Everything is decided from a token and the one before it, from one line, or
from a line's beginning together with the brackets around it, so that a chunk
can be judged where it lies: what depends on a neighbour is kept in the
chunk's map (see ``levels``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .lexer import CODE
from .levels import Columns, blank_entry

# Words of each language that are no plain names.
_KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type print",
    "ruby": "alias and begin BEGIN break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield puts print p require require_relative include extend attr_reader attr_accessor attr_writer raise private public protected lambda proc",
    "javascript": "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface is keyof let module namespace never new null of out override private protected public readonly return satisfies set static super switch this throw true try type typeof undefined unique unknown var void while with yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package permits private protected public record return sealed short static strictfp super switch synchronized this throw throws transient try var void volatile when while yield true false null",
    "kotlin": "abstract actual annotation as break by catch class companion const constructor continue crossinline data delegate do dynamic else enum expect external false field file final finally for fun get if import in infix init inline inner interface internal is it lateinit noinline null object open operator out override package private protected public reified return sealed set super suspend tailrec this throw true try typealias typeof until downTo step to val var vararg when where while",
    "csharp": "abstract as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false file finally fixed float for foreach from get global goto if implicit in init int interface internal into is join let lock long nameof namespace new null object on operator orderby out override params partial private protected public readonly record ref required return sbyte sealed select set short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using value var virtual void volatile when where while with yield",
    "go": "any break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false",
    "rust": "Self as async await box break const continue crate dyn else enum extern false fn for if impl in let loop macro_rules match mod move mut pub ref return self static struct super trait true type union unsafe use where while",
    "cpp": "alignas auto bool break case catch char char8_t class co_await co_return co_yield concept const consteval constexpr constinit continue decltype default delete do double else enum explicit export extern false final float for friend goto if inline int long mutable namespace new noexcept nullptr operator override private protected public register requires return short signed sizeof static static_assert struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while define include ifdef ifndef endif elif pragma undef defined error once restrict _Bool",
    "php": "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum eval exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new null or print private protected public readonly require require_once return static string int float bool switch throw trait true false try unset use var void while xor yield from php mixed self",
    "swift": "Any Self actor as associatedtype async await break case catch class continue convenience default defer deinit didSet do dynamic else enum extension fallthrough false fileprivate final for func get guard if import in indirect infix init inout internal is isolated lazy let mutating nil nonisolated nonmutating open operator optional override postfix precedencegroup prefix private protocol public repeat required rethrows return self set some static struct subscript super switch throw throws true try typealias unowned var weak where while willSet",
}
_KEYWORDS["javascript"] += " asserts accessor using assert"
_KEYWORDS["python"] = _KEYWORDS["python"].replace(" print", "")
_KEYWORDS["java"] += " module open opens exports requires provides uses to with"
_KEYWORDS["csharp"] += " ascending descending by equals on scoped managed unmanaged notnull add remove nint nuint with and or not"
_KEYWORDS["rust"] += " default auto safe raw yield try gen"
_KEYWORDS["kotlin"] += " context"
_KEYWORDS["typescript"], _KEYWORDS["c"] = _KEYWORDS["javascript"], _KEYWORDS["cpp"]
_KEYWORDS["dart"] = _KEYWORDS["java"] + " required late external factory mixin on show hide covariant typedef async await sync get set part library of deferred dynamic operator in as is"
_KEYWORDS["gradle"] = _KEYWORDS["kotlin"] + " def"


@dataclass(frozen=True)
class Grammar:
    """The table of one language.

    lines: a line feed ends a statement; joins: operands (``w`` name, ``d``
    number, ``s`` string) that may follow each other without a sign between;
    names: how many names at most do so; infix: names may stand between two
    operands; call: a name may follow a closing parenthesis; top: what a line
    outside of all brackets must begin with; never: what it can't begin with;
    signs: pairs of signs that can stand here although they can't elsewhere.
    """

    lines: bool = False
    joins: str = ""
    names: int = 1
    infix: bool = False
    call: bool = True
    top: str = ""
    never: str = ""
    signs: str = ""
    words: frozenset = frozenset()


# Two signs that stand beside each other in none of the languages but those whose table names them.
SIGNS = frozenset("(, ,) ,, {% %} [, =; =) ,; (; +; *; /) %) *) .) .; (= {,".split())
_BLOCK_WORDS = "def class if elif else for while try except finally with match case async"
# Heads of statements in other languages.
_PYTHON_HEAD = r"(?:async\s+)?def\s+\w+\s*\([^{]*:\s*$|from\s+[.\w]+\s+import\b|import\s+[\w.]+\s*(?:as\s+\w+\s*)?$|(?:class|elif)\b[^{;]*:\s*$"
_GO_HEAD, _RUST_HEAD = r"func\s+(?:\([^)]*\)\s*)?\w+\s*\(|package\s+\w+\s*$", r"(?:pub\s+)?fn\s+\w+|impl\b[^;]*\{\s*$|use\s+\w+::"
_C_HEAD, _JS_HEAD, _HTML = r"\#\s*include\b", r"(?:export\s+)?(?:async\s+)?function\s*\w+\s*\(|import\s+(?:\{|\*|\w+\s+from\b)|const\s+\w+\s*=", r"<(?:!doctype|html|head|body|div|p)\b"
_PROSE = r"\#{1,6} \w|- `"


def _never(*heads: str) -> str:
    return "(?i:" + _HTML + ")|" + "|".join(heads)


_TRAIL = ",)"
GRAMMARS = {
    "python": Grammar(lines=True, joins="ss", call=False, signs=",) /)", never=_never(_GO_HEAD, _RUST_HEAD, r"(?:const|let|var)\s+\w+\s*=|function\s+\w+\s*\(|\}|using\s+\w+[.\w]*;|#include\b.*;|/\*|//\s")),
    "ruby": Grammar(lines=True, joins="ww ws wd ss sw", names=3, signs=",) %} (; =) *) .) %) /) (= *; +;", never=_never(_PYTHON_HEAD, _C_HEAD, _GO_HEAD)),
    "javascript": Grammar(lines=True, call=False, signs=",) ,, [, (; .)", never=_never(_PYTHON_HEAD, _C_HEAD, _GO_HEAD, _RUST_HEAD, r"using\s+\w+(?:\.\w+)*;|package\s+[\w.]+;?\s*$|(?:namespace|use)\s+[\w\\.:]+;|import\s+[\w.]+;\s*$|\#\s*(?:include|define)\b", _PROSE)),
    "java": Grammar(joins="ww", names=2, signs="(; *;", top=r"package\b|import\b|public\b|private\b|protected\b|class\b|interface\b|enum\b|abstract\b|final\b|static\b|record\b|sealed\b|non\b|strictfp\b|open\s+module\b|module\s|@|;|\}", never=_never(_JS_HEAD, r"import\s+[\w.]+\s*$")),
    "kotlin": Grammar(lines=True, joins="ww wd dw ws sw dd ds sd ss", infix=True, names=9, signs=",) (; *)", never=_never(_PYTHON_HEAD.replace(r"|import\s+[\w.]+\s*(?:as\s+\w+\s*)?$", ""), _C_HEAD, _GO_HEAD.replace(r"|package\s+\w+\s*$", ""), _RUST_HEAD, _JS_HEAD, r"using\s+\w+;|package\s+[\w.]+;\s*$", _PROSE)),
    "csharp": Grammar(joins="ww sw", names=2, signs="(; ,, [, *) *;", never=_never(_PYTHON_HEAD, _C_HEAD, _GO_HEAD, _RUST_HEAD, _JS_HEAD, r"import\s|package\s", _PROSE)),
    "go": Grammar(lines=True, joins="ww", names=2, signs=",) (; *) .)", top=r"package\b|import\b|func\b|var\b|const\b|type\b|\}|\)|;", never=_never(_JS_HEAD)),
    "rust": Grammar(joins="sw", call=False, signs=",) ,, [, (; *) =) (= .) .; *;", top=r"use\b|mod\b|pub\b|fn\b|struct\b|enum\b|impl\b|trait\b|const\b|static\b|type\b|extern\b|unsafe\b|async\b|union\b|macro_rules\b|default\b|auto\b|safe\b|\#|\}|;|::|\w+\s*!|\w+::", never=_never(_C_HEAD, _PROSE)),
    "cpp": Grammar(joins="ww ss sw ws", names=3, signs="(; *) .) +; (= =) %) /) *; =;", never=_never(_PYTHON_HEAD, _GO_HEAD, _RUST_HEAD, _JS_HEAD, r"package\s+[\w.]+;?\s*$|using\s+[A-Z]\w*;\s*$|\#{1,6} [A-Z]|- `")),
    "php": Grammar(joins="ww", names=2, signs=",) (; [,", never=_never(_PYTHON_HEAD, _C_HEAD)),
    "swift": Grammar(lines=True, joins="ww wd sw", names=3, signs=",) (; *) .) +; (= %) /) =) *;", never=_never(_PYTHON_HEAD.replace(r"|import\s+[\w.]+\s*(?:as\s+\w+\s*)?$", ""), _C_HEAD, r"package\s+\w+\s*$", _RUST_HEAD, _JS_HEAD, _PROSE)),
    "dart": Grammar(joins="ww ss", names=2, signs=",) (;", never=_never(_PYTHON_HEAD, _C_HEAD, _GO_HEAD, _RUST_HEAD, _PROSE)),
    "gradle": Grammar(lines=True, joins="ww wd ws ss sw", names=3, signs=",) (; *) .)", never=_never(_C_HEAD, _GO_HEAD, _RUST_HEAD)),
}
GRAMMARS["typescript"], GRAMMARS["c"] = GRAMMARS["javascript"], GRAMMARS["cpp"]
GRAMMARS = {k: Grammar(**{**g.__dict__, "words": frozenset(_KEYWORDS[k].split())}) for k, g in GRAMMARS.items()}
_JOINS = {k: frozenset(g.joins.split()) for k, g in GRAMMARS.items()}
_SIGNS = {k: SIGNS - frozenset(g.signs.split()) for k, g in GRAMMARS.items()}
_TOP = {k: (re.compile(g.top) if g.top else None, re.compile(g.never, re.M) if g.never else None) for k, g in GRAMMARS.items()}

MARK = re.compile(r"(<{7}|>{7}|\|{7})( .*)?\r?$|={7}\r?$|@@ -\d+(,\d+)? \+\d+(,\d+)? @@|(---|\+\+\+) [ab]?/|diff --git ")
_MARK_LINE = re.compile(r"^[ \t]*([<>|=@+d-][^\n]*)$", re.M)
_ENTITY = ("quot", "amp", "lt", "gt", "apos", "nbsp")


def beside(lang: str, a: str, b: str, gap: str) -> str:
    """The rule that two neighbouring tokens break, or an empty string.

    Tokens are ``w`` name, ``k`` word of the language, ``d``, ``s``, or ``p``
    and a sign; gap is what stands between: nothing, a blank or a line feed.
    """
    if a[0] == "p" and b[0] == "p":
        two = a[1:] + b[1:]
        if two in _SIGNS[lang]:
            return "signs" + two
        return "signs==" if two == "==" and gap == " " else "escape" if two == "&;" and lang not in ("c", "cpp") else ""
    g = GRAMMARS[lang]
    if a[0] in "wds" and b[0] in "wds" and gap and a[0] + b[0] not in _JOINS[lang] and not (gap == "\n" and g.lines and lang != "python"):
        return "names" if a[0] == b[0] == "w" else "operand"
    if a == "p)" and b == "w" and gap != "\n" and not g.call:
        return "after"
    return ""


def local_map(text: str, lang: str, toks: list[tuple[str, int, int]], first: bool, enter: str = "", comments: tuple = ()) -> dict:
    """What the local grammar says of a chunk: fields of its map (see ``levels``)."""
    out = blank_entry(enter)
    quiet = enter in comments or enter[:1] == "e"  # what ends on the first line is no part of a statement
    run = _Run(text, lang, quiet)
    out["local"] = _marks(text, toks) or run.all(toks, bool(enter) and enter != "m" and not quiet)
    out |= {"depth": run.depth, "low": run.low, "top": run.top, "inner": run.inner, "lead": run.lead, "tail": run.tail, **run.columns.summary()}
    return out


def _marks(text: str, toks: list[tuple[str, int, int]]) -> str:
    """Marks of a merge or patch that stand outside of strings and comments."""
    hidden = None
    for m in _MARK_LINE.finditer(text):
        if MARK.match(m[1]):
            hidden = hidden if hidden is not None else [(a, b) for k, a, b in toks if k in "sc"]
            if not any(a <= m.start(1) < b for a, b in hidden):
                return "marker"
    return ""


class _Run:
    """The interpreter of the tables over the tokens of a chunk."""

    def __init__(self, text: str, lang: str, in_comment: bool):
        self.text, self.lang, self.g = text, lang, GRAMMARS[lang]
        self.sure = not in_comment  # whether a line's first token is known
        self.depth = self.low = 0
        self.top = self.inner = self.lead = self.tail = self.local = ""
        self.columns = Columns()
        self.closed = self._row = ""
        self.at_low, self.head, self.colon, self.goes_on = True, "", True, False

    def all(self, toks: list[tuple[str, int, int]], in_string: bool) -> str:
        text, lang, words = self.text, self.lang, self.g.words
        python, infix = lang == "python", self.g.infix
        top, never = _TOP[lang]
        previous, row, line_start, run = "", "", True, 0
        start = len(toks) and toks[0][1]
        if in_string:
            self.lead, self.tail, previous = "-", "s", "s"
            line_start, toks, row = False, toks[1:], "s"
            start = len(toks) and toks[0][1]
        gap, last, opened, before, directive = "", start, [], "", False
        for k, a, b in toks:
            if k == "n":
                if directive:  # a line of the preprocessor is no part of a statement
                    directive = text[max(0, a - 2) : a].rstrip("\r")[-1:] == "\\"
                    line_start = True
                    continue
                if infix and len(row) > 1 and self._infix(row):
                    return "names"
                row, run, gap, self.sure = "", 0, "\n", True
                if python and not self.goes_on:
                    self._end_line(previous)
                line_start = True
                continue
            if directive and k != "n":
                continue
            if k == "h":  # text between programs ends a statement
                previous, row, run, line_start = "", "", 0, True
                continue
            if k == "c":
                gap = gap or " "
                continue
            piece = text[a:b]
            if piece == "#" and line_start and lang in ("c", "cpp", "csharp"):
                directive = True
                if self.depth == self.low and not self.top and never and never.match(text, a):
                    self.top = "head"
                continue
            gap = gap or (" " if a > last else "")
            last = b
            now = "p" + piece if k == "p" else "k" if k == "i" and (piece in words or previous == "p@" and not gap) else "w" if k == "i" else k
            if now == "p." and previous == "d" and not gap:
                now = "d"  # a number that ends with its point
            if not gap and now in ("p+", "p-", "p.") and (previous == now or previous == "k" and text[a - 1] == piece):
                now = "k"  # signs of several characters: ++, --, .., ...
            if now == "p\\" and text[b : b + 1] in "\r\n":
                self.goes_on, gap = True, " "
                continue
            self.lead = self.lead or now
            if line_start and not self.goes_on and self.sure and self.depth <= self.low:
                # The first token of a line outside of the brackets that this chunk opens.
                if python:
                    self._begin_line(a, piece)
                if self.depth == self.low and not self.top and k in "ip":
                    end = text.find("\n", a)
                    if never and never.match(text, a, end if end >= 0 else len(text)) or top and not top.match(text, a):
                        self.top = "head"
            if previous and not (gap == "\n" and self.goes_on):
                rule = self._beside(previous, now, gap, a, piece)
                if rule:
                    if gap != "\n" or not python or self.depth > self.low:
                        return rule
                    self.inner = self.inner or rule
            self.goes_on = False
            if k == "i":
                run = run + 1 if now == "w" else 0
                if run > self.g.names and not infix:
                    return "prose"
            else:
                run = 0
            row = row + now if now in ("w", "d", "s") and gap else now if now in ("w", "d", "s") else ""
            if infix and not row and len(self._row) > 1 and self._infix(self._row):
                return "names"
            self._row = row
            if k == "p":
                if piece in "([{":
                    self.depth += 1
                    opened.append(before if piece == "(" else "")
                elif piece in ")]}":
                    self.depth -= 1
                    self.closed = opened.pop() if opened else ""
                    if self.depth < self.low:  # what stood before was inside of brackets
                        if self.inner:
                            return self.inner
                        self.low, self.top, self.columns, self.at_low, self.head, self.colon = self.depth, "", Columns(), True, "", True
                elif piece == ":" and self.depth == self.low:
                    self.colon = True
            previous, before, line_start, gap = now, now, False, ""
        self.tail = previous or self.tail
        if infix and len(row) > 1 and self._infix(row):
            return "names"
        if python and previous and not line_start and not self.goes_on:
            self._end_line(previous)
        return ""

    @staticmethod
    def _infix(row: str) -> bool:
        """Operands in a row fit if every second one is a name and the last is none of these."""
        return len(row) % 2 == 0 or any(x != "w" for x in row[1::2])

    def _beside(self, a: str, b: str, gap: str, at: int, piece: str) -> str:
        text, lang = self.text, self.lang
        rule = beside(lang, a, b, gap)
        if not rule:
            if b == "p;" and a == "w" and any(text.endswith(f"&{x}", 0, at) for x in _ENTITY):
                return "escape"
            return ""
        if rule == "operand" or rule == "names":
            if gap == " " and piece[0] in "`$" and lang in ("javascript", "typescript", "php"):
                return ""  # a tagged template, a typed variable
            if lang == "go" and b == "s" and (piece[0] == "`" or re.search(r"(^|\n)[ \t]*(import[ \t]+)?[\w.]+[ \t]*$", text[max(0, at - 200) : at])):
                return ""  # a field's tag, an import under another name
        # A statement may follow the condition of one, and a name a decorator.
        return "" if rule == "after" and self.closed not in ("w", "p)", "p=") else rule

    # ---- lines of Python ---------------------------------------------------

    def _begin_line(self, at: int, piece: str) -> None:
        column = len(self.text[self.text.rfind("\n", 0, at) + 1 : at].expandtabs())
        wrong = self.columns.line(column) if self.depth == self.low else ""
        self.top = self.top or wrong
        self.head, self.colon, self.at_low = piece, False, True

    def _end_line(self, previous: str) -> None:
        if self.depth != self.low or not self.at_low or not previous:
            return
        if previous == "p:":
            self.columns.open = "must"
            if self.head and self.head not in _BLOCK_WORDS.split():
                self.top = self.top or "block"
        elif self.head in ("def", "class", "if", "elif", "else", "for", "while", "try", "except", "finally", "with") and not self.colon:
            self.top = self.top or "colon"
        elif previous in ("p=", "p+", "p-", "p/", "p%", "p&", "p|", "p^", "p<", "p>", "p@"):
            self.top = self.top or "operand"
        self.at_low = False


def seam(lang: str, tail: str, lead: str) -> tuple[str, str]:
    """The rules that the last token of a chunk and the first of the next break: anywhere, and inside of brackets."""
    rule = beside(lang, tail, lead, "\n") if tail and lead and lang in CODE else ""
    return ("", rule) if lang == "python" else (rule, "")
