"""Problem 6: passages of evaluation items in training documents.

Each task indexes the documents it holds, shard by shard, once: the words of a
shard are numbered by the vocabulary of all items, its suffixes sorted by
prefix doubling, and their Burrows-Wheeler transform stored as a wavelet matrix
with running ranks.  All phrases of PHRASE words of all items are searched at once, word
by word from the back, as vectors of intervals.  Positions are sampled; those
of hits are found by stepping back to the next sample.  Hits of neighbouring
phrases are merged into spans to remove.

The items are the stated query set.  Their phrases go to the tasks as
broadcasts of about BLOCK items each, which a shard's index is asked one after the
other, however many there are; the documents are read once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

PHRASE = 13  # consecutive words that make a leak
BLOCK = 5_000  # items whose phrases are searched together
SHARD = 1_000_000  # words indexed together
SAMPLE = 16  # every so many-th position is kept

_WORD = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯ­​-‍⁠﻿])*")
_SOFT = re.compile(r"[­​-‍⁠﻿]")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words (runs of letters or digits, case and composition aside) and their places."""
    words, places = [], []
    plain = text.isascii()
    for m in _WORD.finditer(text):
        w = m[0]
        words.append(w.lower() if plain else unicodedata.normalize("NFC", _SOFT.sub("", w)).casefold())
        places.append(m.span())
    return words, places


class Index:
    """An FM-index over the numbered words of one shard; 0 ends a document."""

    def __init__(self, codes: np.ndarray, sigma: int):
        n = len(codes)
        self.n, self.levels = n, max(1, int(sigma - 1).bit_length())
        order = self._suffixes(codes)
        bwt = codes[order - 1]
        self.first = np.searchsorted(codes[order], np.arange(sigma + 1))
        # Beginnings of documents are kept too, so a walk never steps over an end.
        self.sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]
        self.bits, self.ones, self.zeros = [], [], []
        current = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level & 1).astype(np.int8)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.bits.append(bit)
            self.zeros.append(n - int(bit.sum()))
            current = np.concatenate((current[bit == 0], current[bit == 1]))
        symbols = np.arange(sigma)
        self.start = self._down(symbols, np.zeros(sigma, np.int64))

    @staticmethod
    def _suffixes(codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        # Each end of a document is a sign of its own, so no suffix runs into the next document.
        ends = codes == 0
        rank = codes + n
        rank[ends] = np.arange(int(ends.sum()))
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank * (n + 2) + second
            order = np.argsort(key, kind="stable")
            changed = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = changed
            if changed[-1] == n - 1 or step >= n:
                return order
            step *= 2

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        return self._down(symbol, at) - self.start[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with each row of ``phrases``."""
        lo, hi = self.first[phrases[:, -1]], self.first[phrases[:, -1] + 1]
        alive = np.flatnonzero(hi > lo)
        for k in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[alive, k]
            a = self.first[symbol] + self.rank(symbol, lo[alive])
            b = self.first[symbol] + self.rank(symbol, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[b > a]
        out = np.zeros(len(phrases), bool)
        out[alive] = True
        return np.where(out, lo, 0), np.where(out, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the shard of suffixes given by their place in the order."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            symbol = self._symbol(at[todo])
            at[todo] = self.first[symbol] + self.rank(symbol, at[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.samples[self.sample_rank[at]] + steps

    def _symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, ones = self.bits[k][at], self.ones[k][at]
            out = out << 1 | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out


def _phrases(items: list[tuple[int, str]], vocabulary: dict[str, int]) -> tuple[np.ndarray, list[list[int]]]:
    """The distinct phrases of items, as numbers of the vocabulary, which grows, and the items that hold each."""
    seen: dict[tuple[int, ...], list[int]] = {}
    for item, text in items:
        codes = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words_of(text)[0]]
        for i in range(len(codes) - PHRASE + 1):
            owners = seen.setdefault(tuple(codes[i : i + PHRASE]), [])
            if item not in owners:
                owners.append(item)
    return np.array(list(seen), np.int32).reshape(-1, PHRASE), list(seen.values())


def _search_shard(docs: list, vocabulary: dict, blocks: list) -> list[tuple]:
    """Spans (doc_id, item_id, first word, words, start, stop) of one shard."""
    codes, places, starts = [], [], []
    for _doc, text in docs:
        words, spans = words_of(text)
        starts.append(len(codes))
        codes += [vocabulary.get(w, 1) for w in words]
        codes.append(0)
        places.append(spans)
    index = Index(np.array(codes, np.int64), len(vocabulary) + 2)
    hits = set()
    for block in blocks:
        phrases, owners = block.value
        lo, hi = index.search(phrases)
        found = np.flatnonzero(hi > lo)
        if len(found):
            rows = np.concatenate([np.arange(a, b) for a, b in zip(lo[found], hi[found])])
            at = index.locate(rows)
            doc = np.searchsorted(starts, at, side="right") - 1
            hits |= {(int(d), item, int(p) - starts[d]) for d, p, w in zip(doc, at, np.repeat(found, hi[found] - lo[found])) for item in owners[w]}
    out: list[list[int]] = []
    for d, item, p in sorted(hits):
        if out and out[-1][:2] == [d, item] and p <= out[-1][3]:
            out[-1][3] = p + PHRASE
        else:
            out.append([d, item, p, p + PHRASE])
    return [(docs[d][0], item, a, b - a, places[d][a][0], places[d][b - 1][1]) for d, item, a, b in out]


SPANS = "doc_id long, item_id long, first_word int, n_words int, start int, stop int"


def leaked_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Spans of ``documents`` (doc_id, text) that hold PHRASE or more consecutive words of an item's text.

    Columns: doc_id, item_id, first_word, n_words, start, stop (characters of
    the text).  Null and blank texts have no words; items of fewer than PHRASE
    words can't leak; items that share words give a span each; repeated
    documents are found under each id.
    """
    known = items.select("item_id", "text").where("text is not null")
    n = -(-known.count() // BLOCK) or 1
    sc, vocabulary, blocks = documents.sparkSession.sparkContext, {}, []
    for k in range(n):
        block = known if n == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        made = _phrases([tuple(r) for r in block.orderBy("item_id").toLocalIterator()], vocabulary)
        if len(made[0]):
            blocks.append(sc.broadcast(made))
    shared = sc.broadcast(vocabulary)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def searched(shard: list) -> pd.DataFrame:
            return pd.DataFrame(_search_shard(shard, shared.value, blocks), columns=[c.split()[0] for c in SPANS.split(", ")])

        shard, size = [], 0
        for batch in batches if blocks else ():
            for d, t in zip(batch["doc_id"], batch["text"]):
                shard.append((d, t))
                size += t.count(" ") + 2
                if size >= SHARD:
                    yield searched(shard)
                    shard, size = [], 0
        if shard:
            yield searched(shard)

    return spread(documents.select("doc_id", "text").where(F.col("text").rlike(r"\S")), "doc_id").mapInPandas(find, SPANS)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document with each item it leaks."""
    return leaked_spans(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start, stop): what to cut from each document, spans of all items merged where they meet."""
    spans = leaked_spans(documents, items).select("doc_id", "start", "stop").distinct()
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s")).select(
        "doc_id",
        F.explode(
            F.aggregate(
                F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))),
                F.array(F.element_at("s", 1)),
                lambda done, x: F.when(
                    x["start"] <= F.element_at(done, -1)["stop"],
                    F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop")))),
                ).otherwise(F.concat(done, F.array(x))),
            )
        ).alias("s"),
    ).select("doc_id", "s.start", "s.stop")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, split, n_documents): the items that leaked, with how many documents hold them."""
    return leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n_documents")).join(items.select("item_id", "suite", "split"), "item_id").select("item_id", "suite", "split", "n_documents")
