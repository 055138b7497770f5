"""Problem 4: text that was decoded with the wrong encoding.

Every text gives its distinct tokens that hold other than ASCII signs.  Those
that look like words (one script, sound upper and lower case), pairs of
neighbouring Chinese or Japanese signs, and single signs are the corpus's
clean vocabulary, with the number of files of each.  For every vocabulary
entry the garbled forms under all encoding chains are generated, and the
tokens that look wrong are hash-joined against these forms.  A match counts
if the original is more frequent in the corpus than its form and, for forms
so short that they could be chance, if the file has two of them.  The
originals are then put back, longest stretch first.

Replacement signs come from a chain of their own, decoding UTF-8 as ASCII,
and match as forms where letters are left; stretches of nothing but
replacement signs tell that text is lost, unless a program names a single one
as a string literal.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread, written

# (encoded as, decoded as); the last two repeat the first mistake.
CHAINS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"),
    ("utf-8", "cp866"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"), ("utf-8", "iso8859-15"), ("utf-8", "gbk"), ("utf-8", "shift_jis"), ("utf-8", "euc_kr"),
    ("utf-8", "big5"), ("gbk", "latin-1"), ("gbk", "cp1252"), ("euc_jp", "latin-1"), ("euc_jp", "cp1252"), ("shift_jis", "latin-1"), ("shift_jis", "cp1252"),
    ("euc_jp", "gbk"), ("gbk", "euc_jp"), ("shift_jis", "gbk"), ("gbk", "shift_jis"), ("big5", "gbk"), ("gbk", "big5"), ("big5", "latin-1"), ("gbk", "cp1251"),
    ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("koi8-r", "latin-1"), ("koi8-r", "cp1252"),
    ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("mac_roman", "cp1252"),
    ("utf-8", "ascii"), ("latin-1", "utf-8"), ("utf-8+utf-8", "cp1252"), ("utf-8+utf-8", "latin-1"),
]

_CJK = "㐀-鿿豈-﫿぀-ゟ゠-ヿ、-〟＀-￯"
_TOKEN = re.compile(r"[A-Za-z]*(?:[^\x00-\x7f]+[A-Za-z]*)+")
_CLEAN = re.compile(
    r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿœŒšžčćđğışłńśźżěřůășțąęő]+(?:[’-][A-Za-zß-öø-ÿÉÀ]+)*|[A-ZÀ-ÖØ-Þ]{2,}|[A-Za-z]u?[’][A-Za-zß-öø-ÿéÉ]+"
    r"|[А-ЯЁІЇЄҐ]?[а-яёіїєґ]+(?:[’-][а-яёіїєґ]+)*|[А-ЯЁІЇЄҐ]{2,}|[ऀ-ॿ]+|[Α-Ωά-ώ][α-ώ]*"
    r"|[‐-‧‰-⁞←-⇿─-╿•§«»°±·×÷€™©®¿¡º…]+"
)
_CJK_RUN = re.compile(rf"[{_CJK}]+")
_LATIN_MIX = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")
ROWS = "array<struct<piece:string,kind:int>>"
WORD, TOKEN, PART, PAIR, TRIPLE, SIGN = range(6)
# How many signs the forms of single signs and of pairs take under the chains, the last seven under those that repeat the mistake.
LENGTHS = (2, 3, 4, 5, 6, 12, 13, 14, 15, 16, 17, 18)
_HALF = re.compile(r"[｡-ﾟ]")
_LITERAL = re.compile(r"([\"'`])�(?:\1|[ \t]*;?[ \t]*\r?$)", re.M)


def sound(word: str) -> bool:
    """Whether a token looks like a word of one script as people write it."""
    if not _CLEAN.fullmatch(word):
        return False
    if _LATIN_MIX.match(word) and not word.islower():
        wide = sum(1 for c in word if ord(c) > 127 and c.isalpha())
        return wide <= max(1, (len(word) + 1) // 2)
    if _LATIN_MIX.match(word):
        return sum(1 for c in word if ord(c) > 127 and c.isalpha()) <= max(1, len(word) // 2)
    return True


def tokens_of(text: str) -> list[tuple[str, int]]:
    """Distinct pieces of a text with their kind; see the module."""
    out = set()
    for token in set(_TOKEN.findall(text)):
        for run in _CJK_RUN.findall(token):
            out.update((run[i : i + 2], PAIR) for i in range(len(run) - 1))
            out.update((run[i : i + 3], TRIPLE) for i in range(len(run) - 2))
            # A pair's form of more than three such signs has single bytes, half-width kana.
            out.update((x, PART) for n in (4, 5, 6) for i in range(len(run) - n + 1) if _HALF.search(x := run[i : i + n]))
        rest = _CJK_RUN.sub("", token)
        if not rest.isascii():
            if sound(token):
                out.add((token, WORD))
                out.update((c, SIGN) for c in token if ord(c) > 127)
                continue
            out.add((token, TOKEN))
            for run in re.findall(r"[^\x00-\x7f]+", token):
                for n in LENGTHS:
                    out.update((x, PART) for i in range(len(run) - n + 1) if (x := run[i : i + n]).strip("�"))
    return sorted(out)


def _decode(data: bytes, codec: str, strict: bool = False) -> str:
    if codec == "cp1252" and not strict:  # the five bytes without a sign stay control characters, as most programs do
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)
    if codec == "cp1250":
        return "".join(bytes([b]).decode("cp1250", "ignore") or chr(b) for b in data)
    return data.decode(codec, "replace")


def _encode(text: str, codec: str) -> bytes:
    if codec in ("cp1252", "cp1250"):
        return b"".join(c.encode(codec) if c.encode(codec, "ignore") else bytes([ord(c)]) if ord(c) < 256 else c.encode(codec) for c in text)
    return text.encode(codec)


def garble(text: str, chain: int, strict: bool = False) -> str | None:
    """The form a text takes under a chain; None if it can't be encoded so or doesn't change.

    strict: bytes without a sign in cp1252 become replacement signs.
    """
    first, second = CHAINS[chain]
    try:
        if first == "utf-8+utf-8":
            return _decode(_decode(text.encode(), second, strict).encode(), second, strict)
        form = _decode(_encode(text, first), second, strict)
    except (UnicodeError, ValueError):
        return None
    return form if form != text else None


def restore(text: str, chain: int) -> str | None:
    """The inverse of :func:`garble` where nothing was lost; verified by garbling again."""
    first, second = CHAINS[chain]
    if first == "latin-1" or second == "ascii":
        return None
    try:
        if first == "utf-8+utf-8":
            out = _encode(_encode(text, second).decode(), second).decode()
        else:
            out = _encode(text, second).decode(first)
    except (UnicodeError, ValueError):
        return None
    return out if garble(out, chain) == text else None


def tokens(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, piece, kind) for every distinct token of other than ASCII signs."""

    @F.pandas_udf(ROWS)
    def udf(t: pd.Series) -> pd.Series:
        return pd.Series([[{"piece": p, "kind": k} for p, k in tokens_of(x)] for x in t])

    wide = files.where(F.col(text).rlike(r"[^\x00-\x7f]")).select("file_id", text)
    return spread(wide, "file_id").select("file_id", F.explode(udf(text)).alias("t")).select("file_id", "t.*")


def forms_of(vocabulary: DataFrame) -> DataFrame:
    """(form, original, chain, files, short) of every vocabulary entry (piece, kind, files) under all chains."""

    @F.pandas_udf("array<struct<form:string,chain:int>>")
    def udf(piece: pd.Series, kind: pd.Series) -> pd.Series:
        out = []
        for p, k in zip(piece, kind):
            forms = []
            for c, (first, second) in enumerate(CHAINS):
                # A single sign is told by its form only where that form takes two signs at least.
                if k == SIGN and not (first == "utf-8" and second in ("cp1252", "latin-1", "cp437")):
                    continue
                made = [garble(p, c), garble(p, c, True) if second == "cp1252" and k != SIGN else None]
                for form in dict.fromkeys(made):
                    if form and not form.isascii() and len(form) > 1 and (k != SIGN or len(form) in (2, 3)) and form.strip("�"):
                        forms.append({"form": form, "chain": c})
            out.append(forms)
        return pd.Series(out)

    made = vocabulary.withColumn("f", F.explode(udf("piece", "kind")))
    return made.select(F.col("f.form").alias("form"), F.col("piece").alias("original"), F.col("f.chain").alias("chain"), "files", (F.col("kind") == PAIR).alias("short"))


def matches(rows: DataFrame) -> DataFrame:
    """(file_id, form, original, chain) of the tokens that are garbled forms of more frequent clean ones.

    ``rows`` is read several times; give a written table.
    """
    counts = rows.groupBy("piece", "kind").agg(F.count("*").alias("files"))
    # The byte order mark is nobody's word, but its form starts many a file.
    mark = rows.sparkSession.range(1).select(F.lit("\ufeff").alias("piece"), F.lit(SIGN).alias("kind"), F.lit(1 << 40).alias("files"))
    clean = counts.where(F.col("kind").isin(WORD, PAIR, SIGN)).unionByName(mark)
    wrong = counts.where(F.col("kind").isin(TOKEN, PART, TRIPLE)).groupBy("piece").agg(F.max("files").alias("form_files"))
    hits = wrong.join(forms_of(clean), wrong["piece"] == F.col("form")).where("files > form_files or (not short and files >= form_files)")
    # Among chains that give the same form the most frequent original wins; ties go to the first chain.
    best = hits.groupBy("form").agg(F.max_by(F.struct("original", "chain", "short"), F.struct("files", -F.col("chain"))).alias("b"), (F.min("original") == F.max("original")).alias("one"))
    # A form that lost signs tells its original only if no other has it.
    best = best.where(F.col("one") | ~F.contains(F.col("form"), F.lit("�"))).select("form", "b.*")
    suspects = rows.where(F.col("kind").isin(TOKEN, PART, TRIPLE)).select("file_id", "piece").distinct()
    found = suspects.join(best, suspects["piece"] == best["form"]).select("file_id", "form", "original", "chain", "short")
    # Forms of two Chinese signs under one chain may be chance; two different ones in a file are not.
    per = found.groupBy("file_id", "chain").agg(F.count(F.when(F.col("short"), 1)).alias("n_short"))
    return found.join(per, ["file_id", "chain"]).where("not short or n_short >= 2").select("file_id", "form", "original", "chain", "short")


def lost(files: DataFrame, text: str = "text") -> DataFrame:
    """Ids of files with replacement signs other than single ones that are string literals."""
    left = F.regexp_replace(F.col(text), r"(?m)([\"'`])�(?:\1|[ \t]*;?[ \t]*\r?$)", "")
    return files.where(F.contains(F.col(text), F.lit("�"))).where(F.contains(left, F.lit("�"))).select("file_id")


def garbled_files(files: DataFrame) -> DataFrame:
    """Ids (file_id) of files with at least one wrongly decoded stretch.

    Null and blank texts give no row; an empty table an empty result; copies
    are found under each id.
    """
    rows = written(tokens(files), "p4-tokens")
    return matches(rows).select("file_id").unionByName(lost(files)).distinct()


def _done(run: str) -> bool:
    return sound(run) or bool(_CJK_RUN.fullmatch(run))


def _partly(run: str, chain: int) -> str | None:
    """Undo a UTF-8 chain where some signs are lost; each of them leaves a replacement sign."""
    first, second = CHAINS[chain]
    if first != "utf-8" or "�" not in run:
        return None
    try:
        data = b"".join(b"\xff" if c == "�" else _encode(c, second) for c in run)
    except (UnicodeError, ValueError):
        return None
    out = re.sub(r"�+", "�", data.decode("utf-8", "replace"))
    return out if sum(1 for c in out if c > "\x7f" and c != "�") > out.count("�") else None


def undone(run: str, chain: int) -> str | None:
    """A stretch put back under a chain; mistakes of UTF-8 are undone as often as they were made."""
    out, (first, second) = restore(run, chain), CHAINS[chain]
    if not first.startswith("utf-8") or second == "ascii":
        return out
    one = CHAINS.index(("utf-8", second))
    out = out or restore(run, one) or _partly(run, one)
    while out is not None and not _done(out):
        more = restore(out, one) or _partly(out, one)
        if more is None or len(more) >= len(out):
            break
        out = more
    return out


def repair(text: str, pairs: list[tuple[str, str, int]]) -> str:
    """Put originals back: forms with lost signs, then whole stretches by the chains seen in the file, then single forms."""
    votes: dict[int, int] = {}
    for form, _o, chain in pairs:
        votes[chain] = votes.get(chain, 0) + len(form)
    chains = sorted(votes, key=lambda c: (-votes[c], c))
    forms = {f: o for f, o, _c in sorted(pairs, key=lambda p: len(p[0]))}

    def whole(m: re.Match) -> str:
        run = m[0]
        if not sound(run):
            for c in chains:
                out = undone(run, c)
                if out is not None and out != run:
                    return out
        return run

    def put(text: str, left: list[str]) -> str:
        left = [f for f in sorted(left, key=len, reverse=True) if f in text and not sound(f)]
        return re.sub("|".join(map(re.escape, left)), lambda m: forms[m[0]], text) if left else text

    def run_of(m: re.Match) -> str:
        # Signs that are lost come back only from the forms that hold them.
        known = put(m[0], lossy) if "�" in m[0] or "ï¿½" in m[0] else m[0]
        if known == m[0]:
            return whole(m)
        return re.sub(rf"[^\x00-\x7f{_CJK}]+", whole, known)

    lossy = [f for f in forms if ("�" in f or "ï¿½" in f) and not _CJK_RUN.search(f)]
    fixed = re.sub(r"[^\x00-\x7f]+", run_of, text)
    # What is left are stretches that lost a sign or stand next to sound ones.
    return put(fixed, list(forms))


def restored(files: DataFrame) -> DataFrame:
    """(file_id, text, is_whole) of every garbled file: the original text as far as it is not lost."""
    rows = written(tokens(files), "p4-tokens")
    found = matches(rows).groupBy("file_id").agg(F.collect_list(F.struct("form", "original", "chain")).alias("pairs"))
    ids = found.select("file_id").unionByName(lost(files)).distinct()

    @F.pandas_udf("string")
    def fix(t: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([repair(x, [(p["form"], p["original"], p["chain"]) for p in (ps if ps is not None else [])]) for x, ps in zip(t, pairs)])

    out = files.select("file_id", "text").join(ids, "file_id").join(found, "file_id", "left").select("file_id", fix("text", "pairs").alias("text"))
    return out.withColumn("is_whole", ~F.contains(F.regexp_replace("text", r"(?m)([\"'`])�(?:\1|[ \t]*;?[ \t]*\r?$)", ""), F.lit("�")))
