"""What a chunk of text leaves open for its neighbours, and how neighbours are put together.

* :func:`push` keeps a list of brackets that are open or closed beyond the
  chunk; the brackets of XML are tags, those of JSON levels with an automaton.
* :class:`Columns` keeps the columns of lines that are open or were left, for
  languages whose blocks are indented.
* ``top`` and ``inner`` are the first rules that lines at the least depth
  break if they stand outside of all brackets, and if they stand inside.
* ``depth`` and ``low`` are the brackets opened less closed, at the end and at
  the least.  What is said of lines outside of all brackets (columns, heads,
  roots) counts at the least depth only: in a file whose brackets fit, that
  is depth 0, and chunks that never come back to it say nothing.
"""

from __future__ import annotations

PAIRS = {")": "(", "]": "[", "}": "{"}

# States of a JSON level: in an object at its start, behind a key, a colon, a
# value, a comma; in an array at its start, behind a value, a comma; at the
# top at its start, behind the value.  ``!`` is none.
_LEVEL = "01234abctu"
_MOVES = {"s": "1!3!1b!bu!", "v": "!!3!!b!bu!", ",": "!!!4!!c!!!", ":": "!2!!!!!!!!"}


def _then(f: str, g: str) -> str:
    return "".join("!" if s == "!" else g[_LEVEL.index(s)] for s in f)


def _json(left: list[str], sign: str) -> bool:
    """Signs of JSON: ``{`` and ``[`` carry the state of their level, a level that began earlier is ``=`` and a function."""
    if sign in ("{", "["):
        left.append(sign + ("0" if sign == "{" else "a"))
        return True
    if sign in ("}", "]"):
        top = left[-1] if left else ""
        if top[:1] in ("{", "["):
            if top[0] != PAIRS[sign] or top[1] not in ("03" if sign == "}" else "ab"):
                return False
            left.pop()
            return _json(left, "v")
        if top[:1] == "=" and all(s == "!" for s in (top[1 + _LEVEL.index(x)] for x in ("01234" if sign == "}" else "abc"))):
            return False
        left.append(sign)
        return _json(left, "v")
    move = sign[1:] if sign[0] == "=" else _MOVES[sign]
    if left and left[-1][0] in "{[":
        state = move[_LEVEL.index(left[-1][1])]
        left[-1] = left[-1][0] + state
        return state != "!"
    if left and left[-1][0] == "=":
        left[-1] = "=" + _then(left[-1][1:], move)
        return set(left[-1][1:]) != {"!"}
    left.append("=" + move)
    return True


def push(left: list[str], kind: str, sign: str) -> bool:
    """Add a sign to what is left open or closed; False if it does not fit."""
    if kind == "json":
        if sign[0] in "{[" and len(sign) == 2:  # a level of another chunk, with its state
            left.append(sign)
            return True
        return _json(left, sign)
    if kind == "xml":
        if sign[0] == "<":
            left.append(sign)
        elif left and left[-1][0] == "<":
            return left.pop()[1:] == sign[1:] or sign == "/>"
        else:
            left.append(sign)
        return True
    if sign in PAIRS:
        if left and left[-1] in "([{":
            return left.pop() == PAIRS[sign]
    left.append(sign)
    return True


def compose(a: list[str], b: list[str], kind: str) -> list[str] | None:
    """What two neighbours leave; None if they do not fit.

    JSON: a chunk's own closing signs have put a value on the level below
    already, so only the sign itself is checked and the level taken over.
    """
    left = list(a)
    for sign in b:
        if kind == "json" and sign in ("}", "]"):
            top = left[-1] if left else ""
            if top[:1] in ("{", "["):
                if top[0] != PAIRS[sign] or top[1] not in ("03" if sign == "}" else "ab"):
                    return None
                left.pop()
            else:
                left.append(sign)
        elif not push(left, kind, sign):
            return None
    return left


def complete(left: list[str], kind: str) -> bool:
    """Whether a whole file leaves nothing open."""
    if kind == "json":
        return len(left) == 1 and left[0][0] == "=" and left[0][1 + _LEVEL.index("t")] == "u"
    return not left


class Columns:
    """The columns of lines: ``left`` those that a chunk went back to below its first line, ``stack`` those open at its end.

    ``open`` says whether the last line opens a block: ``must`` (the next line
    has to stand further right), ``may``, or ``no``; ``before`` the same of a
    line that ends in the chunk but began in an earlier one.
    """

    def __init__(self, left: list[int] = (), stack: list[int] = (), open_: str = "", before: str = ""):
        self.left, self.stack, self.open, self.before = list(left), list(stack), open_, before

    def reset(self) -> None:
        """A new document of a file."""
        if self.left:
            self.stack, self.open = [], "may"
            if self.left[-1] > 0:
                self.left.append(0)

    def line(self, column: int, opens: str | None = None) -> str:
        """Add a line; the rule that it breaks, or an empty string."""
        opens = opens or self.open
        self.open = "no"
        if not self.left:
            self.left, self.before = [column], opens
            return ""
        now = self.stack[-1] if self.stack else self.left[-1]
        if column > now:
            self.stack.append(column)
            return "" if opens in ("must", "may") else "indent"
        if opens == "must":
            return "block"
        while self.stack and self.stack[-1] > column:
            self.stack.pop()
        now = self.stack[-1] if self.stack else self.left[-1]
        if now < column:
            return "dedent"
        if now > column:
            self.left.append(column)
        return ""

    def then(self, other: Columns) -> str:
        """Put a neighbour's lines behind one's own."""
        for i, column in enumerate(other.left):
            if wrong := self.line(column, "no" if i else other.before or None):
                return wrong
        self.stack += other.stack
        self.open = other.open or self.open
        return ""

    def summary(self) -> dict:
        return {"columns": self.left, "stack": self.stack, "opens": self.open, "before": self.before}


BLANK = {
    "exit": "", "left": [], "local": "", "depth": 0, "low": 0, "columns": [], "stack": [], "opens": "", "before": "",
    "top": "", "inner": "", "roots": 0, "stray": False, "ends": 0, "lead": "", "tail": "", "seen": False,
}


def blank_entry(state: str) -> dict:
    """The map entry of a chunk that says nothing."""
    return {"enter": state, **{k: list(v) if isinstance(v, list) else v for k, v in BLANK.items()}}


_LEVEL_FIELDS = ("columns", "stack", "opens", "before", "top", "inner", "roots", "stray")


def join(a: dict, b: dict, kind: str, seam: str = "", seam_inner: str = "") -> dict:
    """The entries of two neighbours, the second from the state in which the first ends.

    seam: the rule that the last sign of one and the first of the other break;
    seam_inner: the same if they stand inside of brackets.
    """
    left = compose(a["left"], b["left"], kind)
    floor = a["depth"] + b["low"]
    low = min(a["low"], floor)
    local = a["local"] or seam or b["local"] or ("pair" if left is None else "")
    out = {**a, "exit": b["exit"], "left": left or [], "depth": a["depth"] + b["depth"], "low": low, "ends": a["ends"] + b["ends"], "seen": a["seen"] or b["seen"], "lead": a["lead"] or b["lead"], "tail": b["tail"] or a["tail"]}
    inside = a["depth"] > low  # the seam is inside of brackets
    if floor < a["low"]:
        return out | {k: b[k] for k in _LEVEL_FIELDS} | {"local": local or a["inner"] or seam_inner}
    if floor > a["low"]:
        return out | {"local": local or seam_inner or b["inner"]}
    both = Columns(a["columns"], a["stack"], a["opens"], a["before"])
    wrong = both.then(Columns(b["columns"], b["stack"], b["opens"], b["before"]))
    return out | both.summary() | {
        "local": local or (seam_inner if inside else ""), "top": a["top"] or wrong or b["top"], "inner": a["inner"] or ("" if inside else seam_inner) or b["inner"],
        "roots": a["roots"] + b["roots"], "stray": a["stray"] or b["stray"],
    }
