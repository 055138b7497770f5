"""Chunks of JSON, TOML, XML and YAML as maps, like those of program text.

Each language has the states in which a chunk of whole lines may begin, and
for each of them what the chunk does: the state at its end, what it leaves
open or closes of its neighbours, and the first rule that it breaks.

* JSON: every nesting level is an automaton (keys, colons, values, commas).  A
  level that began in an earlier chunk is kept as a function on the states.
* XML: start and end tags are the brackets.
* TOML: brackets, and productions for the lines outside of them.
* YAML: brackets in flow text, and columns of lines as a stack elsewhere.
"""

from __future__ import annotations

import re

from .levels import PAIRS, Columns, blank_entry, push

_MARK = re.compile(r"(<{7}|>{7}|\|{7})( .*)?\r?$|={7}\r?$|@@ -\d+(,\d+)? \+\d+(,\d+)? @@|diff --git ")

# ---- JSON ----------------------------------------------------------------------

_JSON = re.compile(r'(?P<w>[ \t\r\n]+)|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)(?!\w))|(?P<p>[{}\[\],:])')


def json_map(text: str, state: str, first: bool) -> dict:
    e, left, at = blank_entry(state), [], 0
    if first:
        text = text.lstrip("\ufeff")
    for m in _JSON.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        if m.lastgroup != "w" and not push(left, "json", m[0] if m.lastgroup == "p" else m.lastgroup):
            return e | {"local": "value"}
    return e | {"left": left, "local": "" if at == len(text) else "sign"}


# ---- XML -----------------------------------------------------------------------

_NAME = r"[^\W\d][\w.:-]*"
_REF = r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z_][\w.-]*);"
_ATTRS = re.compile(rf"""\s+(?P<n>{_NAME})\s*=\s*(?:"(?:[^<&"]|{_REF})*"|'(?:[^<&']|{_REF})*')""")
_XML = re.compile(rf"<!--|<!\[CDATA\[|<\?|<!DOCTYPE\b|</(?P<close>{_NAME})\s*>|<(?P<open>{_NAME})|(?P<ref>{_REF})|(?P<bad>[<&])|(?P<text>[^<&]+)")
# Inside of what a chunk may begin, and what ends it.
_XML_ENDS = {"c": "-->", "k": "]]>", "p": "?>"}
_TAG_END = re.compile(r"\s*(/?>)")


_UNKNOWN = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z_]")


def _tag(text: str, at: int, seen: set) -> tuple[int, str]:
    """Attributes from ``at``: (place behind the tag or the text's end, ``>``, ``/>``, ``t`` if it goes on, ``!`` if wrong)."""
    while True:
        m = _TAG_END.match(text, at)
        if m:
            return m.end(), m[1]
        m = _ATTRS.match(text, at)
        if not m:
            rest = text[at:]
            # A quoted value or the space before an attribute may end in the next chunk.
            open_ = re.fullmatch(rf"""\s*|\s+{_NAME}\s*|\s+{_NAME}\s*=\s*|\s+{_NAME}\s*=\s*(?P<q>["'])(?:(?!(?P=q))[^<])*""", rest)
            return len(text), "!" if not open_ else {'"': "td", "'": "ts"}.get(open_["q"], "t=" if rest.rstrip()[-1:] == "=" else "tn" if rest.strip() else "t")
        if m["n"] in seen:
            return at, "!"
        seen.add(m["n"])
        at = m.end()


def _doctype(text: str, at: int, inside: bool) -> tuple[int, str]:
    """(end of a document type or -1, the state if the text ends before)."""
    for m in re.compile(r"[\[\]>]").finditer(text, at):
        if m[0] == ">" and not inside:
            return m.end(), ""
        inside = m[0] == "[" or inside and m[0] == ">"
    return -1, "ds" if inside else "d"


def xml_map(text: str, state: str, first: bool) -> dict:
    e, left, at = blank_entry(state), [], 0
    roots, depth, low, stray = 0, 0, 0, False
    if first:
        text = text.lstrip("\ufeff")
        if re.match(r"\s+<\?xml", text):
            return e | {"local": "declaration"}
    # Entities that only a document type can declare.
    e |= {"ends": len(_UNKNOWN.findall(re.sub(r"<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<!--[\s\S]*?(?:-->|\Z)", "", text))) if state in ("", "t", "td", "ts", "t=", "tn") else 0, "seen": state in ("d", "ds")}
    go_on = "t" if state[:1] == "t" else ""
    if state in ("d", "ds"):
        at, inside = _doctype(text, 0, state == "ds")
        if at < 0:
            return e | {"exit": inside}
    elif state in _XML_ENDS:
        end = text.find(_XML_ENDS[state])
        if state == "c" and "--" in text[: end if end >= 0 else len(text)]:
            return e | {"local": "comment"}
        if end < 0:
            return e | {"exit": state}
        at = end + len(_XML_ENDS[state])
    elif go_on:
        # What was cut is put together again from its kind: a value, its name, or nothing.
        lead = {"td": ' _="', "ts": " _='", "t=": " _=", "tn": " _", "t": " "}[state]
        text = lead + text
    while at < len(text):
        if go_on:
            at, how = _tag(text, at, set())
        else:
            m = _XML.match(text, at)
            at = m.end()
            if m["text"]:
                stray = stray or depth == low and bool(m["text"].strip())
                if "]]>" in m["text"]:
                    return e | {"local": "cdata"}
                continue
            if m["ref"]:
                stray = stray or depth == low
                continue
            if m["bad"]:
                return e | {"local": "sign"}
            if m["close"]:
                depth -= 1
                if depth < low:
                    low, roots, stray = depth, 0, False
                if not push(left, "xml", "/" + m["close"]):
                    return e | {"local": "pair"}
                continue
            if not m["open"]:
                kind = {"<!--": "c", "<![": "k", "<?": "p"}.get(m[0][:4] if m[0] == "<!--" else m[0][:3] if m[0][:3] == "<![" else m[0][:2])
                if kind is None:
                    e["seen"] = True
                    at, inside = _doctype(text, at, False)
                    if at < 0:
                        return e | {"exit": inside, "left": left, "depth": depth, "low": low, "roots": roots, "stray": stray}
                    continue
                end = text.find(_XML_ENDS[kind], at)
                if kind == "c" and "--" in text[at : end if end >= 0 else len(text)]:
                    return e | {"local": "comment"}
                if end < 0:
                    return e | {"exit": kind, "left": left, "depth": depth, "low": low, "roots": roots, "stray": stray}
                at = end + len(_XML_ENDS[kind])
                continue
            roots += depth == low
            depth += 1
            push(left, "xml", "<" + m["open"])
            at, how = _tag(text, at, set())
        go_on = ""
        if how == "!":
            return e | {"local": "attribute"}
        if how[0] == "t":
            return e | {"exit": how, "left": left, "depth": depth, "low": low, "roots": roots, "stray": stray}
        if how == "/>":
            depth -= 1
            if depth < low:
                low, roots, stray = depth, 0, False
            push(left, "xml", "/>")
    return e | {"left": left, "depth": depth, "low": low, "roots": roots, "stray": stray}


# ---- TOML ----------------------------------------------------------------------

_KEY = r"(?:[A-Za-z0-9_-]+|s)(?:[ \t]*\.[ \t]*(?:[A-Za-z0-9_-]+|s))*"
_TOML = re.compile(
    r'(?P<long>"""|\'\'\')|(?P<s>"(?:[^"\\\n]|\\(?:[btnfr"\\e]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|\'[^\'\n]*\')|(?P<c>\#[^\n]*)|(?P<n>\r?\n)|(?P<w>[ \t]+)'
    r"|(?P<b>[A-Za-z0-9_+-][\w+.:-]*(?: \d\d:[\d:.Z+-]+)?)|(?P<p>[\[\]{}=,.])|(?P<bad>[\s\S])"
)
_TOML_VALUE = re.compile(
    r"true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?"
)
_TOML_LONG = {"td": (r'(?:[^"\\]|\\[\s\S]|"(?!""))*"{3,5}', '"""'), "ts": (r"(?:[^']|'(?!''))*'{3,5}", "'''")}
_LINE = re.compile(rf"\[[ \t]*{_KEY}[ \t]*\]|\[\[[ \t]*{_KEY}[ \t]*\]\]|{_KEY}=(?:[sv]|[\[{{].*[\]}}])|")
# What may not stand beside each other in values: the signs, and names for values and line feeds.
_TOML_PAIRS = {",,", "[,", "{,", "==", "=,", "=]", "=}", "=n", "vv", "v[", "v{"}


def toml_map(text: str, state: str, first: bool) -> dict:
    e, left, at = blank_entry(state), [], 0
    depth = low = 0
    top = inner = local = lead = ""
    line: list[str] = []
    previous, between, whole = "", True, True
    if first:
        text = text.lstrip("\ufeff")
    if state:
        m = re.match(_TOML_LONG[state][0], text)
        if not m:
            return e | {"exit": state}
        at, previous, between, whole, lead = m.end(), "v", False, False, "-"

    def end_line() -> str:
        """The production of a line outside of brackets; one that began in an earlier chunk isn't known here."""
        return "" if not whole or _LINE.fullmatch("".join(line)) else "line"

    exit_ = ""
    while at < len(text):
        m = _TOML.match(text, at)
        at, kind, piece = m.end(), m.lastgroup, m[0]
        if kind == "long":
            k = "td" if piece[0] == '"' else "ts"
            m = re.compile(_TOML_LONG[k][0]).match(text, at)
            exit_ = "" if m else k
            at, kind, piece = m.end() if m else len(text), "s", "s"
        if kind in "cw":
            continue
        if kind == "bad" or kind == "n" and previous == "=":
            return e | {"local": "sign"}
        if kind == "n":
            if depth == low:
                top = top or end_line()
                line, whole = [], True
            between = True
            continue
        now = piece if kind == "p" else "v"
        lead = lead or now
        if ("v" if previous in ("]", "}") else previous) + now in _TOML_PAIRS:
            if not between or depth > low:
                return e | {"local": "signs"}
            inner = inner or "signs"
        if kind == "b" and not _TOML_VALUE.fullmatch(piece) and previous in ("=", ",", "[") and (previous == "=" or not re.match(r"[ \t]*[.=\]]", text[at:])):
            return e | {"local": "value"}
        if kind == "p" and piece in "[{":
            push(left, "code", piece)
            depth += 1
        elif kind == "p" and piece in "]}":
            if not push(left, "code", piece):
                return e | {"local": "pair"}
            depth -= 1
            if depth < low:  # all before was inside of brackets
                low, top, local, inner, line, whole = depth, "", local or inner, "", [], False
        line.append(piece if kind == "p" else "s" if kind == "s" else "v" if previous == "=" else piece)
        previous, between = now, False
    if previous == "=":
        return e | {"local": "value"}
    if depth == low and line and not exit_:
        top = top or end_line()
    return e | {"exit": exit_, "left": left, "depth": depth, "low": low, "top": top, "inner": inner, "local": local, "lead": lead, "tail": "-" if exit_ else previous}


def toml_seam(tail: str, lead: str) -> str:
    return "signs" if ("v" if tail in ("]", "}") else tail) + lead in _TOML_PAIRS else ""


# ---- YAML ----------------------------------------------------------------------

_PROPS = re.compile(r"(?:[&!][^\s,\[\]{}]*(?:[ \t]+|$))+")
_PLAIN_KEY = re.compile(r"""(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=[^\s])|\*(?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)\#)*?[ \t]*:(?=\s|$)""")
_QUOTED = {'"': re.compile(r'(?:[^"\\]|\\.)*+"'), "'": re.compile(r"(?:[^']|'')*+'")}
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*(?:\s\#.*)?$")
_REST = re.compile(r"[ \t]*(?:(?:^|(?<=\s))\#.*)?$")
_FLOW = re.compile(r"""(?P<s>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*+')|(?P<open>["'](?=.*$))|(?P<c>(?:^|(?<=\s))\#.*$)|(?P<p>[\[\]{},])|(?P<w>\s+)|(?P<t>[^\s\[\]{},"'][^\s\[\]{},]*)""")


class _Yaml:
    """One pass over the lines of a chunk from one state.

    States: ``b7`` in a block text under column 7, ``n7`` in a plain text that
    lines right of column 7 go on with, ``d`` and ``s`` in quotes (``fd2``:
    those in flow text two brackets deep), ``f2`` in flow text.
    """

    def __init__(self, state: str):
        self.kind, self.n = state[:1], int(state[1:] or 0) if state[:1] in "bn" and state else 0
        self.quote = ""
        self.flow = 0
        if state[:1] == "f":
            self.quote = {"d": '"', "s": "'"}.get(state[1:2], "")
            self.flow = int(state.lstrip("fds"))
        elif state in ("d", "s"):
            self.quote = {"d": '"', "s": "'"}[state]
        self.kind = self.kind if self.kind in "bn" else ""
        self.left: list[str] = []
        self.columns = Columns()

    def state(self) -> str:
        q = {'"': "d", "'": "s"}.get(self.quote, "")
        return f"f{q}{self.flow}" if self.flow else q or (f"{self.kind}{self.n}" if self.kind else "")

    def line(self, raw: str) -> str:
        """The rule that a line breaks, or an empty string."""
        body = raw.lstrip(" ")
        column = len(raw) - len(body)
        if self.quote:
            m = _QUOTED[self.quote].match(raw)
            if not m:
                return ""
            self.quote = ""
            return self._in_flow(raw[m.end() :]) if self.flow else "" if _REST.match(raw[m.end() :]) else "quote"
        if not body.strip():
            return ""
        if self.flow:
            return "marker" if _MARK.match(body) else self._in_flow(raw)
        if self.kind == "b" and column > self.n:
            return ""
        if _MARK.match(body):
            return "marker"
        if body[0] == "#":
            self.kind = "" if self.kind == "b" else self.kind
            return ""
        if body.startswith("\t"):
            return "tab"
        if self.kind == "n" and column > self.n and not re.match(r"---(\s|$)|\.\.\.(\s|$)", raw):
            return "colon" if re.search(r":(\s|$)", re.sub(r"\s#.*", "", body)) else ""
        self.kind = ""
        if column == 0 and re.match(r"%[A-Z]", raw):
            return ""
        if column == 0 and (m := re.match(r"(---|\.\.\.)(?:\s+|$)", raw)):
            self.columns.reset()
            body = raw[m.end() :]
            return "" if not body or body[0] == "#" else self._value(body, -1)
        dash, opens = -1, None
        while m := re.match(r"[-?:](?:[ \t]+|$)", body):
            if wrong := self.columns.line(column, opens):
                return wrong
            self.columns.open, opens, dash = "may", "may", column
            body, column = body[m.end() :], column + m.end()
            if not body or body[0] == "#":
                return ""
        props = _PROPS.match(body)
        if props and not props[0].strip() == body.strip() and not body[props.end() :].startswith("#"):
            body, column = body[props.end() :], column + (props.end() if dash >= 0 else 0)
        elif props:
            if dash < 0 and (wrong := self.columns.line(column, opens)):
                return wrong
            self.columns.open = "may"
            return ""
        key = 0
        if body[0] in _QUOTED:
            m = _QUOTED[body[0]].match(body, 1)
            if m and (k := re.compile(r"[ \t]*:(?=\s|$)").match(body, m.end())):
                key = k.end()
        elif m := _PLAIN_KEY.match(body):
            key = m.end()
        if wrong := self.columns.line(column, opens) if dash < 0 or key else "":
            return wrong
        if not key:
            return self._value(body, dash if dash >= 0 else column - 1)
        value = body[key:].strip(" \t\r")
        if re.match(r"[-?]\s", value):
            return "dash"
        if props := _PROPS.match(value):
            value = value[props.end() :]
        if not value or value[0] == "#":
            self.columns.open = "may"
            return ""
        return self._value(value, column)

    def _value(self, value: str, column: int) -> str:
        """A node that begins on this line, below what stands in ``column``."""
        value = value.rstrip("\r")
        self.columns.open = "no"
        c = value[0]
        if c in "|>":
            self.kind, self.n = "b", column
            return "" if _BLOCK.match(value) else "scalar"
        if c in _QUOTED:
            m = _QUOTED[c].match(value, 1)
            if not m:
                self.quote = c
                return ""
            return "" if _REST.match(value[m.end() :]) else "quote"
        if c in "[{":
            return self._in_flow(value)
        if c in "@`%}],":
            return "scalar"
        plain = re.sub(r"\s+#.*$", "", value)
        if re.search(r":(\s|$)", plain):
            return "colon"
        if c != "*" and plain == value:  # a comment ends a plain text
            self.kind, self.n = "n", column
        return ""

    def _in_flow(self, text: str) -> str:
        previous = ""
        at = 0
        while at < len(text):
            if not self.flow and at and previous in "]}":
                return "" if _REST.match(text[at:]) or re.match(r"[ \t]*:(\s|$)", text[at:]) else "flow"
            m = _FLOW.match(text, at)
            at = m.end()
            if m.lastgroup in "cw":
                continue
            if m.lastgroup == "open":
                self.quote = m[0]
                return ""
            if m.lastgroup == "p":
                if m[0] in "[{":
                    self.flow += 1
                    push(self.left, "code", m[0])
                elif m[0] in "]}":
                    self.flow -= 1
                    if not push(self.left, "code", m[0]):
                        return "flow"
                elif previous in (",", "[", "{"):
                    return "flow"
            previous = m[0][-1:] if m.lastgroup == "p" else "t"
        return ""


def yaml_map(text: str, state: str, first: bool) -> dict:
    e = blank_entry(state)
    if first:
        text = text.lstrip("\ufeff")
    run = _Yaml(state)
    for raw in text.split("\n"):
        if wrong := run.line(raw):
            return e | {"local": wrong}
    closed = sum(p in PAIRS for p in run.left)
    return e | {"exit": run.state(), "left": run.left, "depth": len(run.left) - 2 * closed, "low": -closed, **run.columns.summary()}


def _yaml_states(text: str) -> list[str]:
    """States that end somewhere in a chunk: for texts under a column only the columns at which they end count."""
    out, least = ["", "d", "s", "n-1"], 1 << 30
    for raw in text.split("\n"):
        if not raw.strip():
            continue
        column = len(raw) - len(raw.lstrip(" "))
        if column < least:
            least = column
            out += [f"b{column}", f"n{column}"]
    depth = least = 0
    for c in re.findall(r"[\[\]{}]", text):
        depth += 1 if c in "[{" else -1
        least = min(least, depth)
    deep = 1 - least if re.search(r"[\[\]{}\"']", text) else 0
    return out + [f"f{q}{n}" for n in range(1, min(deep, 40) + 1) for q in ("", "d", "s")]


STATES = {"json": lambda t: [""], "xml": lambda t: ["", "c", "k", "p", "d", "ds", "t", "td", "ts", "t=", "tn"], "toml": lambda t: ["", "td", "ts"], "yaml": _yaml_states}
MAPS = {"json": json_map, "xml": xml_map, "toml": toml_map, "yaml": yaml_map}


def entry_for(step: dict[str, dict], state: str, lang: str) -> dict | None:
    """The entry of a chunk for a state; None if the chunk lies inside of it as a whole."""
    if state in step or lang != "yaml" or state[:1] not in "bn":
        return step.get(state)
    # A text under column n ends at the first line that stands no further right.
    below = [int(s[1:]) for s in step if s[:1] == state[0] and int(s[1:]) <= int(state[1:])]
    one = step[f"{state[0]}{max(below)}"] if below else None
    return one | {"exit": state} if one and one["exit"] == "n-1" else one  # the plain text goes on
