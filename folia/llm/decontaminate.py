"""Benchmark decontamination: BM25 over an inverted index of test items, by block-max WAND.

Documents are cut into overlapping passages; each passage is a query, and every unit of a test
item whose score reaches ``REACH`` of what the unit scores against itself is retrieved. Scores
are stored divided by that threshold, so one threshold, 1, holds for all units. Retrieved items
are verified on the document's words: shares of the word pairs of the item, of its question and
of its answer that occur in order near the passage.

All passages of a text are first bounded at once, in numpy, by the block maxima of their words:
where no block can reach the threshold no pivot could be found, and the passage is done. The others
are run through the index one by one: cursors on the postings of their words, a pivot where the
lists' maxima reach the threshold, a look at the maxima of the blocks there, and either the scores
of the pivot or a skip beyond those blocks.

The index is built of test items, not of documents. It is cut into pieces of about
``PIECE_BYTES`` of item text by the hash of item_id; each piece is sent to the executors by
itself and all documents are run against it, so any number of items is covered. Counts of units and
of the units that have a word, and the mean length, are those of all pieces, so scores don't
depend on the cut. The items' words pass through the driver.

A null or empty text holds nothing, and a null or word-less item is found nowhere; without items or
documents nothing is found. Texts are taken whole, however long. An item of fewer than ``SHORT``
words counts only where all its words stand in sequence. Repeated rows repeat their results; of the
passages that hold an item the one of the greatest overlap is told, and of equals the first. Columns
of any other names are left alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import groupby, repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import bounded, slices, struct_type, table, utf8

K1, B = 1.2, 0.75
#: Words of a unit, of a passage and between passages: a unit's copy lies whole in some passage.
UNIT, PASSAGE, STRIDE = 48, 96, 48
REACH, BLOCK, SHORT = 0.6, 2, 5
#: A term in more than 1 / COMMON of the blocks is common; passages whose blocks are summed up at once.
COMMON, SPAN = 3, 256
#: Least shares of word pairs: of the item, of its question, and of its answer (or of the item, if the answer is worded anew).
ITEM, QUESTION, ANSWER, ITEM_ALONE = 0.6, 0.5, 0.5, 0.75
PIECE_BYTES = 8 << 20

#: For ASCII texts: A-Z to a-z and all that is not alphanumeric to spaces, as one translation of bytes.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() else 32 for c in range(256))
#: Alphanumeric characters (of any script) in sequence.
_WORD = re.compile(r"[^\W_]+")

HIT = struct_type(
    item_id=T.LongType(), score=T.DoubleType(), overlap=T.DoubleType(), question_overlap=T.DoubleType(), answer_overlap=T.DoubleType(),
    first_word=T.LongType(), last_word=T.LongType(),
)


def words_of(b: bytes) -> list[str]:
    """Words by Unicode case folding and compatibility forms, split at every character that is not alphanumeric."""
    if b.isascii():
        return b.translate(_PLAIN).decode("ascii").split()
    # Folding can take composed characters apart, so the text is normalized before and after.
    return _WORD.findall(normalize("NFKC", normalize("NFKC", b.decode("utf-8", "replace")).casefold()))


def question_and_answer(text: str) -> tuple[str, str]:
    """A test item's parts: the answer follows the last question mark, or is the last line, the last sentence or the last third."""
    text = text.strip()
    for pattern in (r"\?", r"\n", r"[.!]\s"):
        ends = [m.end() for m in re.finditer(pattern, text) if _WORD.search(text, m.end()) and _WORD.search(text, 0, m.end())]
        if ends:
            return text[: ends[-1]], text[ends[-1] :]
    words = words_of(text.encode("utf-8", "replace"))
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _pairs(words: list[str]) -> list:
    return list(zip(words, words[1:])) or words


def units_of(text: str | None) -> list[Counter]:
    """An item's units, of about equal length."""
    words = words_of((text or "").encode("utf-8", "replace"))
    count = math.ceil(len(words) / UNIT)
    return [Counter(words[len(words) * k // count : len(words) * (k + 1) // count]) for k in range(count)]


class Statistics:
    """What BM25 asks of all units: their number, their words in all, and in how many each word is."""

    def __init__(self):
        self.units = self.words = 0
        self.df: Counter = Counter()

    def add(self, items: list[tuple[int, str]]) -> "Statistics":
        for _, text in items:
            for u in units_of(text):
                self.units += 1
                self.words += sum(u.values())
                self.df.update(u.keys())
        return self

    def impacts(self, u: Counter) -> dict[str, float]:
        norm = K1 * (1 - B + B * sum(u.values()) * self.units / self.words)
        rarity = {w: math.log1p((self.units - self.df[w] + 0.5) / (self.df[w] + 0.5)) for w in u}
        return {w: rarity[w] * tf * (K1 + 1) / (tf + norm) for w, tf in u.items()}


class Index:
    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        statistics = statistics or Statistics().add(items)
        self.items: list[tuple] = []  # item_id, words, pairs of the item, the question, the answer
        self.unit_item: list[int] = []
        units: list[Counter] = []
        for item_id, text in items:
            own = units_of(text)
            if not own:
                continue
            words = words_of(text.encode("utf-8", "replace"))
            q, a = (words_of(x.encode("utf-8", "replace")) for x in question_and_answer(text))
            self.items.append((item_id, words, _pairs(words), _pairs(q), _pairs(a)))
            units += own
            self.unit_item += [len(self.items) - 1] * len(own)
        self.terms = {w: i for i, w in enumerate(sorted({w for u in units for w in u}))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, u in enumerate(units):
            impact = statistics.impacts(u)
            threshold = REACH * sum(impact.values())
            for w, x in impact.items():
                lists[self.terms[w]].append((i, x / threshold))
        self.postings = [([i for i, _ in x], [s for _, s in x]) for x in lists]
        self.blocks = max(1, math.ceil(len(units) / BLOCK))
        maxima = [[(k, max(s for _, s in g)) for k, g in groupby(x, lambda p: p[0] // BLOCK)] for x in lists]
        self.maxima = [dict(x) for x in maxima]
        self.most = [max(x.values()) for x in self.maxima]
        # Terms in many blocks add their bound to all; the others' block maxima are one array, from starts[t] to starts[t + 1].
        often = np.array([len(x) > max(COMMON, self.blocks // COMMON) for x in maxima] + [False])
        most = np.array([*self.most, 0.0])
        self.common, self.rare = np.where(often, most, 0.0), np.where(often, 0.0, most)
        kept = [[] if o else x for x, o in zip(maxima, often)] + [[]]
        self.starts = np.cumsum([0, *map(len, kept)])
        self.block = np.array([k for x in kept for k, _ in x], np.int64)
        self.block_max = np.array([s for x in kept for _, s in x], np.float64)

    def live(self, ids: np.ndarray):
        """The start of each passage with a block whose maxima over the passage's distinct words sum up to 1."""
        n = len(ids)
        if n <= PASSAGE:
            starts, size = np.zeros(1, np.int64), n
        else:
            starts, size = np.append(np.arange(0, n - PASSAGE, STRIDE), n - PASSAGE), PASSAGE
        order = np.argsort(ids, kind="stable")
        last = np.full(n, -1)
        same = ids[order[1:]] == ids[order[:-1]]
        last[order[1:][same]] = order[:-1][same]
        for a in range(0, len(starts), SPAN):
            first = starts[a : a + SPAN]
            spot = first[:, None] + np.arange(size)
            terms = np.where(last[spot] < first[:, None], ids[spot], len(self.terms))
            base = self.common[terms].sum(axis=1)
            may = np.nonzero(base + self.rare[terms].sum(axis=1) >= 1.0)[0]
            if not len(may):
                continue
            terms = terms[may]
            length = (self.starts[1:] - self.starts[:-1])[terms].ravel()
            total = int(length.sum())
            within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
            at = np.repeat(self.starts[:-1][terms].ravel(), length) + within
            cell = np.repeat(np.repeat(np.arange(len(may)), terms.shape[1]), length) * self.blocks + self.block[at]
            sums = np.bincount(cell, self.block_max[at], len(may) * self.blocks).reshape(len(may), self.blocks)
            hot = sums >= 1.0 - base[may][:, None] - 1e-9
            yield from first[may[hot.any(axis=1)]].tolist()

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """(unit, score) of every unit that scores 1 or more for distinct terms, by block-max WAND."""
        found, at = [], dict.fromkeys(terms, 0)
        now = {t: self.postings[t][0][0] for t in terms}  # the unit under each term's cursor

        def move(t: int, unit: int) -> None:
            """The term's cursor to the first unit from ``unit`` on."""
            own = self.postings[t][0]
            at[t] = bisect_left(own, unit, at[t])
            if at[t] < len(own):
                now[t] = own[at[t]]
            else:
                del now[t]

        while now:
            order = sorted(now, key=now.__getitem__)
            total, last = 0.0, -1
            for k, t in enumerate(order):
                total += self.most[t]
                if total >= 1.0 - 1e-9:
                    last = k
                    break
            if last < 0:  # no pivot: what is left of the lists can't reach the threshold
                break
            pivot = now[order[last]]
            while last + 1 < len(order) and now[order[last + 1]] == pivot:
                last += 1
            ahead, block = order[: last + 1], pivot // BLOCK
            if sum(self.maxima[t].get(block, 0.0) for t in ahead) < 1.0 - 1e-9:
                # Beyond the blocks, or to the next list's unit if that comes first.
                beyond = (block + 1) * BLOCK
                if last + 1 < len(order):
                    beyond = min(beyond, now[order[last + 1]])
                for t in ahead:
                    move(t, beyond)
            elif now[order[0]] == pivot:
                score = sum(self.postings[t][1][at[t]] for t in ahead)
                if score >= 1.0:
                    found.append((pivot, score))
                for t in ahead:
                    move(t, pivot + 1)
            else:
                for t in ahead:
                    if now[t] < pivot:
                        move(t, pivot)
        return found

    def search(self, b: bytes) -> list[tuple]:
        words = words_of(b)
        if not words or not self.terms:
            return []
        none = len(self.terms)
        ids = np.fromiter(map(self.terms.get, words, repeat(none)), np.int64, len(words))
        best: dict[int, tuple] = {}
        for start in self.live(ids):
            near = np.unique(ids[start : start + PASSAGE]).tolist()
            if near[-1] == none:
                near.pop()
            for unit, score in self.retrieve(near):
                k = self.unit_item[unit]
                if (hit := self.verify(k, words, start, score * REACH)) and (k not in best or hit[2] > best[k][2]):
                    best[k] = hit
        return [best[k] for k in sorted(best)]

    def verify(self, k: int, words: list[str], start: int, score: float) -> tuple | None:
        item_id, own, *parts = self.items[k]
        first, last = max(0, start - len(own)), min(len(words), start + PASSAGE + len(own))
        near = words[first:last]
        if len(own) < SHORT:
            at = [i for i in range(len(near) - len(own) + 1) if near[i : i + len(own)] == own]
            return (item_id, score, 1.0, 1.0, 1.0, first + at[0], first + at[0] + len(own)) if at else None
        pairs, single = set(zip(near, near[1:])), set(near)
        item, question, answer = (sum(p in (pairs if isinstance(p, tuple) else single) for p in part) / max(1, len(part)) for part in parts)
        if item >= ITEM and question >= QUESTION and (answer >= ANSWER or item >= ITEM_ALONE):
            met = [i for i, p in enumerate(zip(near, near[1:])) if p in set(parts[0])]
            return item_id, score, item, question, answer, first + met[0], first + met[-1] + 2
        return None


def _searched(spark: SparkSession, items: list[tuple[int, str]], statistics: Statistics):
    index = spark.sparkContext.broadcast(Index(items, statistics))

    @F.arrow_udf(T.ArrayType(HIT))
    def search(texts: pa.Array) -> pa.Array:
        names = HIT.fieldNames()
        rows = [[dict(zip(names, hit)) for hit in index.value.search(b)] for part in slices(texts) for b in part]
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.array(rows, pa.list_(pa.struct(list(zip(names, kinds)))))

    return search


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", piece_bytes: int = PIECE_BYTES) -> Column:
    """A column of all verified hits of a row of docs: an array, empty for clean rows."""
    bounded(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    total = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    pieces = max(1, math.ceil(total / piece_bytes))
    part = lambda k: [(r.item_id, r["item"]) for r in (items if pieces == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(pieces)) == k)).collect()]
    statistics = Statistics()
    for k in range(pieces):
        statistics.add(part(k))
    columns = [_searched(docs.sparkSession, part(k), statistics)(utf8(text)) for k in range(pieces)]
    return columns[0] if pieces == 1 else F.concat(*columns)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and each item found in the row: its scores, shares and place in words; clean rows give none."""
    found = docs.select("doc_id", hits(docs, benchmark, text).alias("hits")).filter(F.size("hits") > 0)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows that hold no test item, with their own columns."""
    return docs.filter(F.size(hits(docs, benchmark, text)) == 0)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL: dict[str, str] = {}
