"""Problem 8: missing or wrong language labels, and texts of several languages.

Evidence is fused by Bayes' rule, for a document as for each segment of it:

* the text's likelihood, a naive Bayes model over short runs of characters,
  whose counts are grouped aggregates over labelled documents;
* the declared label, right with probability LABEL_RIGHT;
* the address: the language's share among labelled documents with the same
  ending of the path, and among those of the same repo, smoothed towards the
  repo's source and that towards all documents.

Code fences, log lines and inline code are of no language and left out before.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import lookup, spread, written

FIT_DOCUMENTS = 20_000  # labelled documents that the model of characters is fitted on, at most
FIT_FEATURES = 6_000  # most frequent features kept for each language
LABEL_RIGHT = 0.9
SMOOTH = 20.0  # documents that the wider group counts for in the narrower
TEMPER = 0.35  # runs of characters overlap, so their evidence counts for less
KEPT_WORDS = 200_000  # words whose evidence a worker keeps
QUOTE_WORDS = 10  # a quote of fewer words is of no language
MIN_WORDS, MIN_SIGNS = 20, 40  # running text of a further language

# Names and codes of languages in labels.
CODES = {
    "en": "eng english", "ru": "rus russian русский", "zh": "zho chi chinese cn mandarin 中文", "ja": "jpn japanese jp 日本語", "hi": "hin hindi हिन्दी",
    "de": "deu ger german deutsch", "es": "spa spanish español espanol castellano", "pt": "por portuguese português portugues", "fr": "fra fre french français francais",
    "uk": "ukr ukrainian українська", "it": "ita italian italiano", "nl": "nld dut dutch", "pl": "pol polish", "cs": "ces cze czech", "sv": "swe swedish", "da": "dan danish",
    "fi": "fin finnish", "no": "nor norwegian nb nn", "tr": "tur turkish", "ar": "ara arabic", "he": "heb hebrew", "fa": "fas per persian", "ko": "kor korean kr", "vi": "vie vietnamese",
    "th": "tha thai", "id": "ind indonesian", "el": "ell gre greek", "hu": "hun hungarian", "ro": "ron rum romanian", "bg": "bul bulgarian", "sr": "srp serbian", "hr": "hrv croatian",
    "sk": "slk slovak", "be": "bel belarusian", "bn": "ben bengali", "ta": "tam tamil", "te": "tel telugu", "ur": "urd urdu", "ca": "cat catalan", "la": "lat latin",
}
_NAMES = {n: code for code, names in CODES.items() for n in [code, *names.split()]}

SIGNS = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
_LOG = re.compile(r"^\s*(?:\[?\d{1,4}[-:./]\d{1,2}[-:./]\d{1,4}[^\s]*\]?\s|\[?(?:\d{2}:){2}\d{2}|(?:ERR|ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL)\b|\S+=\S+(?:\s+\S+=\S+)+\s*$|\s*at [\w$.]+\(|Traceback|File \"|\$ |>>> |(?:[+-]{3}|@@) )")
_SENTENCE = re.compile(r"[^.!?。！？।;；\n]*(?:[.!?;；](?=[\s»”\"')\]]|$)|[。！？।]|\n|[.!?;；](?=\S))?")
_SIGN_RUN = re.compile(rf"[{SIGNS}]+")
_QUOTE = re.compile(r"^\s*[«“„\"'「『].*[»”“\"'」』][.,;:]?\s*$")
_NO_TEXT = re.compile(r"`[^`]*`|https?://\S+|\b\w+[_/]\w[\w/]*|\b[\w-]+\(\)|^[\s#>*•+-]+")
_INDENTED = re.compile(r"^(?: {4,}|\t)\S.*[;{}()=]\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_WORD = re.compile(rf"(?:(?![{SIGNS}])[^\W\d_])[^\W\d_{SIGNS}'’ऀ-ॿ]*(?:['’ऀ-ॿ](?:(?![{SIGNS}])[^\W\d_]|[ऀ-ॿ])*)*")


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any notation; null if it names no language."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), head)


def segments_of(text: str) -> list[tuple[int, int]]:
    """Places of the sentences of running text."""
    out, at, fence = [], 0, ""
    for line in text.split("\n"):
        stop = at + len(line)
        m = _FENCE.match(line)
        if m:
            fence = "" if fence == m[1] else fence or m[1]
        elif not fence and line.strip() and not _LOG.match(line) and not _INDENTED.match(line):
            for s in _SENTENCE.finditer(line):
                if s[0].strip():
                    out.append((at + s.start(), at + s.end()))
        at = stop + 1
    return out


def plain(piece: str) -> str:
    """A segment without inline code, addresses and list marks, in lower case."""
    return _NO_TEXT.sub(" ", piece).lower()


def features(piece: str) -> list[str]:
    """Runs of characters: signs alone and in pairs where words aren't spaced, else words and their triples."""
    out = []
    for run in _SIGN_RUN.findall(piece):
        out += list(run)
        out += [run[i : i + 2] for i in range(len(run) - 1)]
    for w in _WORD.findall(piece):
        w = f" {w} "
        out.append(w)
        out += [w[i : i + 3] for i in range(len(w) - 2)]
    return out


def fit(keys: DataFrame, texts: DataFrame, documents: int = FIT_DOCUMENTS, keep: int = FIT_FEATURES) -> dict:
    """The model of characters: {"langs": [...], "scores": {feature: [log-likelihoods]}}.

    ``keys``: (doc_id, code) of labelled documents, ``texts``: (doc_id, text).
    It is fitted on at most ``documents`` of them, evenly over languages and
    chosen by a hash of the id, and holds at most ``keep`` features of each
    language, whatever the corpus's size.
    """
    sizes = keys.groupBy("code").agg(F.count("*").alias("_n"))
    per = F.lit(documents) / F.greatest(F.count("*").over(Window.partitionBy()), F.lit(1))
    sizes = sizes.withColumn("_per", F.floor(F.greatest(per, F.lit(1.0))))  # a row a language
    # A cut on the hash leaves about `per` of a language before any rows are ordered.
    ranked = keys.select("doc_id", "code").withColumn("_h", F.xxhash64("doc_id"))
    near = ranked.join(F.broadcast(sizes), "code").where((F.col("_n") <= F.col("_per")) | (F.pmod("_h", F.lit(1_000_000)) < F.lit(1_100_000.0) * F.col("_per") / F.col("_n")))
    picked = near.withColumn("_k", F.row_number().over(Window.partitionBy("code").orderBy("_h", "doc_id"))).where(F.col("_k") <= F.col("_per")).select("doc_id", "code")
    sample = texts.where("text is not null").join(F.broadcast(picked), "doc_id")  # at most `documents` ids

    @F.pandas_udf("array<string>")
    def grams(t: pd.Series) -> pd.Series:
        return pd.Series([[g for a, b in segments_of(x) for g in features(plain(x[a:b]))] for x in t])

    counts = spread(sample.select("doc_id", "code", "text"), "doc_id").select("code", F.explode(grams("text")).alias("g")).groupBy("code", "g").count()
    top = counts.withColumn("_k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("count"), "g"))).where(F.col("_k") <= keep)
    by: dict[str, dict[str, int]] = {}
    for r in top.select("code", "g", "count").collect():  # at most `keep` rows a language
        by.setdefault(r[0], {})[r[1]] = r[2]
    names = sorted(by)
    total = {c: sum(v.values()) for c, v in by.items()}
    every = {g for v in by.values() for g in v}
    scores = {g: [math.log((by[c].get(g, 0) + 0.5) / (total[c] + 0.5 * (len(every) + 1))) for c in names] for g in every}
    return {"langs": names, "scores": scores}


def priors(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shares of languages, smoothed from all documents to sources to repos, and by ending of the path.

    Each is one row per group: the group's columns and ``p``, a map from code to share.
    """

    def shares(groups: list[str], wider: DataFrame | None, key: list[str]) -> DataFrame:
        n = labelled.groupBy(*groups, "code").agg(F.count("*").alias("n"))
        if wider is None:
            whole = n.agg(F.sum("n").alias("t"))
            return n.join(F.broadcast(whole)).select("code", (F.col("n") / F.col("t")).alias("share"))
        sizes = n.groupBy(*groups).agg(F.sum("n").alias("t"))
        spine = sizes.join(wider, key) if key else sizes.join(F.broadcast(wider))
        on = F.lit(True)
        full = spine.join(n, [*groups, "code"], "left").where(on)
        return full.select(*groups, "code", ((F.coalesce("n", F.lit(0)) + SMOOTH * F.col("share")) / (F.col("t") + SMOOTH)).alias("share"))

    base = shares([], None, [])
    source = shares(["source_key"], base, [])
    repo = shares(["source_key", "repo_key"], source, ["source_key"])
    ending = shares(["ending"], base, [])
    as_map = F.map_from_entries(F.collect_list(F.struct("code", "share"))).alias("p")
    return repo.groupBy("source_key", "repo_key").agg(as_map.alias("repo_p")), ending.groupBy("ending").agg(as_map.alias("ending_p"))


SEGMENTS = "array<struct<start:int,stop:int,lang:string,confidence:double,words:int,signs:int>>"
LANGS = "array<struct<lang:string,confidence:double,words:int,signs:int>>"
SLICE = 500  # documents judged in one matrix


def judged(documents: DataFrame, with_segments: bool = True) -> DataFrame:
    """Every document with non-blank text: doc_id, label (code or null), segments, langs.

    ``langs`` lists the languages of its running text with their confidence:
    those of at least MIN_WORDS words or MIN_SIGNS signs, or the one there is
    most of.  It is empty if all of the text is code, log lines or numbers.
    Null sources, repos and paths are groups of their own; an empty table, or
    one without any label, gives an empty result.  ``segments`` is left out if
    it isn't wanted.
    """
    evidence = [
        label_code(F.col("lang")).alias("label"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.coalesce("repo", F.lit("")).alias("repo_key"),
        F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"((?:\.[^./]*)?\.[^./]*)$", 1)).alias("ending"),
    ]
    # Written without the texts: model and priors read it several times.
    keys = written(documents.select("doc_id", *evidence).where("label is not null").withColumnRenamed("label", "code"), "p8-keys")
    model = fit(keys, documents.select("doc_id", "text"))
    by_repo, by_ending = (written(x, "p8-prior") for x in priors(keys))
    some = documents.where(F.col("text").rlike(r"\S")).select("doc_id", "text", *evidence)
    width = 40 * len(model["langs"]) + 100  # bytes of a row of shares
    rows = lookup(lookup(spread(some, "doc_id"), by_repo, ["source_key", "repo_key"], width=width, salt="doc_id"), by_ending, ["ending"], width=width, salt="doc_id")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf((f"segments {SEGMENTS}, " if with_segments else "") + f"langs {LANGS}")
    def decide(text: pd.Series, label: pd.Series, repo_p: pd.Series, ending_p: pd.Series) -> pd.DataFrame:
        found = []
        for at in range(0, len(text), SLICE):
            part = slice(at, at + SLICE)
            found += _decide(shared.value, list(text[part]), list(label[part]), list(repo_p[part]), list(ending_p[part]), with_segments)
        return pd.DataFrame(found, columns=["segments", "langs"])[["segments", "langs"] if with_segments else ["langs"]]

    # Not told to be deterministic: a filter on the result would run the model twice.
    return rows.withColumn("_d", decide.asNondeterministic()("text", "label", "repo_p", "ending_p")).select("doc_id", "label", "_d.*")


def _prior(langs: list[str], shares) -> np.ndarray:
    p = dict(shares) if shares is not None else {}
    return np.log(np.array([p.get(c, 0.0) for c in langs]) + 1e-3)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _likelihoods(model: dict, pieces: list[list[str]]) -> np.ndarray:
    """Tempered log-likelihoods of segments, given by their words and runs of signs; a word's are kept, as words come again and again."""
    scores, n = model["scores"], len(model["langs"])
    known = model.setdefault("words", {})
    if len(known) > KEPT_WORDS:
        known.clear()
    zero, rows, starts = np.zeros(n), [], []
    for piece in pieces:
        starts.append(len(rows))
        for run in piece:
            v = known.get(run)
            if v is None:
                got = [scores[f] for f in features(run) if f in scores]
                v = known[run] = np.sum(got, axis=0) if got else zero
            rows.append(v)
        if starts[-1] == len(rows):
            rows.append(zero)
    return TEMPER * np.add.reduceat(np.array(rows), starts, axis=0)


def _decide(model: dict, texts: list[str], labels: list, repo_ps: list, ending_ps: list, with_segments: bool) -> list[tuple]:
    """(segments, langs) of each document; the documents' segments are the rows of one matrix."""
    langs = model["langs"]
    n = len(langs)
    parts, pieces, doc = [], [], []
    for d, text in enumerate(texts):
        for a, b in segments_of(text) if n else ():
            piece = plain(text[a:b])
            runs = _WORD.findall(piece)
            words, signs = len(runs), 0
            if not piece.isascii():
                more = _SIGN_RUN.findall(piece)
                signs = sum(map(len, more))
                runs += more
            if words + signs and not (_QUOTE.match(text[a:b]) and words + signs / 2 < QUOTE_WORDS):
                parts.append((a, b, words, signs))
                pieces.append(runs)
                doc.append(d)
    out: list[tuple] = [([], []) for _ in texts]
    if not parts:
        return out
    like, doc = _likelihoods(model, pieces), np.array(doc)
    outside = math.log((1 - LABEL_RIGHT) / max(1, n - 1))
    context = np.zeros((len(texts), n))
    for d in np.unique(doc):
        context[d] = 0.5 * (_prior(langs, repo_ps[d]) + _prior(langs, ending_ps[d]))
        if labels[d]:
            context[d] += [math.log(LABEL_RIGHT) if c == labels[d] else outside for c in langs]
    # How much of the text each language explains by itself, as the prior of a segment.
    alone = _softmax(like + context[doc])
    weight = np.array([w + s / 2 for _a, _b, w, s in parts])
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    mass = np.add.reduceat(alone * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
    inside = np.repeat(np.log(mass + 1e-3), np.diff(np.append(first, len(doc))), axis=0)
    near, step = np.zeros_like(like), 0.3 * np.log(alone + 1e-2)
    same = doc[1:] == doc[:-1]
    near[1:][same] += step[:-1][same]
    near[:-1][same] += step[1:][same]
    post = _softmax(like + inside + near)
    best = post.argmax(axis=1)
    sure = post[np.arange(len(best)), best]
    for lo, hi in zip(first, np.append(first[1:], len(doc))):
        sums: dict[str, list] = {}
        for k in range(lo, hi):
            s = sums.setdefault(langs[best[k]], [0, 0, 0.0, 0.0])
            s[0] += parts[k][2]
            s[1] += parts[k][3]
            s[2] += weight[k] * sure[k]
            s[3] += weight[k]
        found = [c for c, s in sums.items() if (s[1] >= MIN_SIGNS if c in ("zh", "ja") else s[0] >= MIN_WORDS)]
        found = found or [max(sums, key=lambda c: (sums[c][3], c))]
        segs = [dict(zip(("start", "stop", "lang", "confidence", "words", "signs"), (a, b, langs[best[k]], float(sure[k]), w, g))) for k, (a, b, w, g) in zip(range(lo, hi), parts[lo:hi])] if with_segments else []
        out[doc[lo]] = (segs, [{"lang": c, "confidence": float(sums[c][2] / sums[c][3]), "words": sums[c][0], "signs": sums[c][1]} for c in sorted(found)])
    return out


def relabelled(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, label): documents without label, with a wrong one, or of several languages; a row for each language."""
    j = judged(documents, with_segments=False).where(F.size("langs") > 0)
    wrong = F.col("label").isNull() | ~F.exists("langs", lambda x: x["lang"] == F.col("label")) | (F.size("langs") > 1)
    return j.where(wrong).select("doc_id", F.explode("langs").alias("l"), "label").select("doc_id", "l.lang", "l.confidence", "label")


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, start, stop, lang, confidence) of every segment of running text."""
    return judged(documents).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.start", "s.stop", "s.lang", "s.confidence")
