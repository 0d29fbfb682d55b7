"""Passages of held-out evaluation items in a corpus: n-gram seeds, then local alignment.

Every n-gram of an item is a seed where edited copies are looked for. Where
only whole windows of ``span`` words count, the rarest n-gram of each is enough,
so no copied window goes unseen. Around its seeds a document is cut into
passages, as long as an alignment through a seed can be, and these are scored
against the item by Smith-Waterman alignment of the words.

Words are compared by their number in the vocabulary of the items; a word that
no item has is 0. A corpus is read and cut into words once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.session import materialize

#: Runs of characters of the categories L and N.
WORD = re.compile(r"[^\W_]+")
SPAN, GRAM = 12, 6
#: Alignment scores of equal words, of different words and of a word left out.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of a diagonal of all pairs that are aligned at once, words that are looked at together.
CELLS, WORDS = 24_576, 500_000
#: Words of the items that are sent to all executors at once; more are taken block by block.
MOST_ITEM_WORDS = 1_000_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of the lower-cased text; none of a null one."""
    return WORD.findall(text.lower()) if text else []


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` words."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    codes, h = codes.astype(np.uint64), np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ codes[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


# alignment


def align_diagonals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest run of equal words, best score and words of ``b`` that it takes, for each row of ``a`` (p, m) and ``b`` (p, n).

    The cells of a diagonal hang only on those of the two before it, so a step
    is done for all columns of all pairs. A cell holds its score and, in the low
    bits, the column where its alignment begins; the greatest is the best score
    that begins last.
    """
    (p, m), n = a.shape, b.shape[1]
    low = int(n + 1).bit_length()
    most = (MATCH * min(m, n) + 2) << low
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    one, narrow = kind(1 << low), np.int16 if max(m, n) < 2**15 else np.int32
    if max(int(a.max()), int(b.max())) < 2**15:
        a, b = a.astype(np.int16), b.astype(np.int16)
    # pairs are the inner axis, so that a shift by a column is one stretch of memory
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    padded = np.zeros((m + 2 * (n - 1), p), a.dtype)
    padded[n - 1 : n - 1 + m] = a[::-1]
    fresh = np.arange(n + 1, dtype=kind)[:, None]
    last, before = np.repeat(fresh, p, 1), np.repeat(fresh, p, 1)
    best, cell, other = last.copy(), np.empty((n, p), kind), np.empty((n, p), kind)
    run, longest, same = [np.zeros((n + 1, p), narrow) for _ in range(3)], np.zeros((n, p), narrow), np.empty((n, p), bool)
    for d in range(m + n - 1):
        r = m + n - 2 - d
        np.equal(padded[r : r + n], b, out=same)
        np.multiply(same, one * kind(MATCH - MISMATCH), out=cell)
        cell += before[:-1]
        cell += one * kind(MISMATCH)
        np.maximum(last[1:], last[:-1], out=other)
        other += one * kind(GAP)
        np.maximum(cell, other, out=cell)
        np.maximum(cell, fresh[1:], out=before[1:])
        last, before = before, last
        np.maximum(best, last, out=best)
        new = run[d % 3][1:]
        np.add(run[(d - 2) % 3][:-1], 1, out=new)
        new *= same
        np.maximum(longest, new, out=longest)
    at = best.argmax(0)
    top = best[at, np.arange(p)]
    return longest.max(0).astype(np.int64), (top >> low).astype(np.int64), (at - (top & (one - 1))).astype(np.int64)


def align_cut(a: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`align_diagonals` of the stretches of ``a`` and ``b``, those of alike lengths side by side.

    Equal numbers are equal words, save that 0 in ``a`` is like no word.
    """
    m, n = a_to - a_from, b_to - b_from
    out = np.zeros((3, len(m)), np.int64)
    order = np.lexsort((m, n))
    order = order[(m[order] > 0) & (n[order] > 0)]
    t = 0
    while t < len(order):
        z = min(len(order), t + max(1, CELLS // int(n[order[t]])))
        z = t + max(1, int(np.searchsorted(n[order[t:z]], n[order[t]] * 5 // 4, side="right")))
        some = order[t:z]
        i, j = np.arange(int(m[some].max())), np.arange(int(n[some].max()))
        x = np.where(i < m[some, None], a[np.minimum(a_from[some, None] + i, len(a) - 1)], 0)
        y = np.where(j < n[some, None], b[np.minimum(b_from[some, None] + j, len(b) - 1)], -1)
        out[:, some] = align_diagonals(x, y)
        t = z
    return out[0], out[1], out[2]


def align(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of arrays of words: longest run of equal words, best local alignment score, words of the item that it takes."""
    if not docs:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    _, words = np.unique(np.concatenate([*docs, *items]), return_inverse=True)
    size = np.array([len(x) for x in [*docs, *items]])
    end = np.cumsum(size)
    words, k = np.append(words + 1, 0), len(docs)
    return align_cut(words, (end - size)[:k], end[:k], words, (end - size)[k:], end[k:])


# seeds


def seeds(item: np.ndarray, frequency: dict[int, int], span: int = SPAN, n: int = GRAM) -> set[int]:
    """The rarest n-gram that the corpus has of each window of ``span`` words; of equally rare ones the smallest hash.

    A window without any that the corpus has is in no document.
    """
    grams = gram_codes(item, n)
    found = np.array([frequency.get(int(g), 0) for g in grams])
    if len(grams) < span - n + 1:
        return set()
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, np.where(found > 0, found, np.iinfo(np.int64).max)))] = np.arange(len(grams))
    wide = np.lib.stride_tricks.sliding_window_view(rank, span - n + 1)
    best = np.unique(wide.argmin(1) + np.arange(len(wide)))
    return set(grams[best[found[best] > 0]].tolist())


@dataclass
class Items:
    """A block of items: their words one after the other, and the places of all their n-grams by size, sorted by hash."""

    number: dict[str, int]
    names: np.ndarray
    words: np.ndarray
    start: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list, span: int | None, n: int) -> Items:
        """Of ``(item_id, text)`` rows those that have words, ``span`` of them at least. Items of fewer than ``n`` words are a seed as a whole."""
        number: dict[str, int] = {}
        texts = [(r[0], [number.setdefault(w, len(number) + 1) for w in words_of(r[1])]) for r in rows]
        texts = [(i, np.array(w, np.int32)) for i, w in texts if len(w) >= (span or 1)]
        start = np.cumsum([0, *[len(w) for _, w in texts]])
        made: dict[int, list] = {}
        for k, (_, w) in enumerate(texts):
            size = min(n, len(w))
            made.setdefault(size, []).append((gram_codes(w, size), k))
        grams = {size: _table(np.concatenate([g for g, _ in some]), np.concatenate([np.full(len(g), k) for g, k in some]), np.concatenate([np.arange(len(g)) for g, _ in some])) for size, some in made.items()}
        return cls(number, np.array([i for i, _ in texts], np.int64), np.concatenate([w for _, w in texts]) if texts else np.empty(0, np.int32), start, grams)

    def only(self, wanted: list[set[int]], n: int) -> Items:
        """The same items, with the ``wanted`` n-grams of each as its only seeds."""
        if n not in self.grams:
            return self
        known, first, item, place = self.grams[n]
        hashes = np.repeat(known, np.diff(first))
        ok = np.array([int(g) in wanted[k] for g, k in zip(hashes, item)], bool)
        return Items(self.number, self.names, self.words, self.start, {n: _table(hashes[ok], item[ok], place[ok])})

    def numbers(self, text: str | None) -> list[int]:
        """Numbers of the words of a text; 0 for one that no item has."""
        get = self.number.get
        return [get(w, 0) for w in words_of(text)]

    def hits(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``words`` of n-grams that are seeds, and the number of the seed."""
        known = self.grams[size][0]
        if len(words) < size or not len(known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        unknown = np.concatenate([[0], np.cumsum(words == 0)])
        p = np.flatnonzero(unknown[size:] == unknown[:-size])
        g = gram_codes(words, size)[p]
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        ok = known[at] == g
        return p[ok], at[ok]


def _table(hashes: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    known, first = np.unique(hashes[order], return_index=True)
    return known, np.append(first, len(hashes)), item[order], place[order]


def passages(doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches ``low`` to ``high`` of a document and item, overlapping ones joined: ``(doc, item, from, to)``.

    ``length`` is three times that of the item, more than an alignment takes of a
    document. Longer stretches are cut into ones of twice that, each half in
    two of them, so that any alignment is whole in one.
    """
    order = np.lexsort((low, item, doc))
    doc, item, low, high, length = (x[order] for x in (doc, item, low, high, length))
    if not len(doc):
        return doc, item, low, high
    group = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    far = int(high.max()) + 1
    reach = np.maximum.accumulate(high + group * far) - group * far
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (low[1:] > reach[:-1])])
    a, z = low[first], np.maximum.reduceat(high, first)
    doc, item, length = doc[first], item[first], length[first]
    many = np.maximum(1, -(-(z - a - length) // length))
    each = np.repeat(np.arange(len(a)), many)
    step = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    a_cut = a[each] + step * length[each]
    return doc[each], item[each], a_cut, np.minimum(z[each], a_cut + 2 * length[each])


def aligned(words: np.ndarray, end: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]], items: Items) -> tuple[np.ndarray, ...]:
    """``(doc, item, run, score, took)`` of each pair with a seed; ``words`` are those of documents that end at ``end``, with a 0 between them."""
    doc, item, low, high, length = [], [], [], [], []
    for size, (p, at) in hits.items():
        _, first, who, place = items.grams[size]
        many = first[at + 1] - first[at]
        each = np.repeat(np.arange(len(p)), many)
        o = first[at][each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        k, q, at_ = who[o], place[o], p[each]
        n = items.start[k + 1] - items.start[k]
        d = np.searchsorted(end, at_, side="right")
        begin = np.where(d > 0, end[d - 1] + 1, 0)
        doc.append(d)
        item.append(k)
        # what an alignment takes on a side of a seed: the item's words there, and as many gaps as they can pay for
        low.append(np.maximum(begin, at_ - 3 * q))
        high.append(np.minimum(end[d], at_ + size + 3 * (n - q - size)))
        length.append(3 * n)
    if not doc:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    d, k, a, z = passages(*map(np.concatenate, (doc, item, low, high, length)))
    run, score, took = align_cut(words, a, z, items.words, items.start[k], items.start[k + 1])
    order = np.lexsort((took, -score, k, d))
    d, k, run, score, took = (x[order] for x in (d, k, run, score, took))
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]) if len(d) else np.empty(0, np.int64)
    return d[first], k[first], np.maximum.reduceat(run, first) if len(d) else run, score[first], took[first]


def _together(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of several documents with a 0 after each, and where each ends."""
    size = np.array([len(t) for t in texts]) + 1
    words = np.zeros(int(size.sum()), np.int32)
    end = np.cumsum(size) - 1
    for t, e in zip(texts, end):
        words[e - len(t) : e] = t
    return words, end


def _some(docs: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents together that have ``WORDS`` words or are one."""
    names, texts, held = [], [], 0
    for name, words in docs:
        names.append(name)
        texts.append(words)
        held += len(words)
        if held >= WORDS:
            yield names, texts
            names, texts, held = [], [], 0
    if names:
        yield names, texts


FOUND = "doc_id string, item_id bigint, run int, score int, share double"


def _rows(names: list, found: tuple[np.ndarray, ...], items: Items) -> pd.DataFrame:
    d, k, run, score, took = found
    size = np.maximum(items.start[k + 1] - items.start[k], 1) if len(k) else k
    return pd.DataFrame({"doc_id": np.array(names, object)[d], "item_id": items.names[k], "run": run, "score": score, "share": np.minimum(1.0, took / size) if len(k) else took.astype(float)})


def seeded(documents: DataFrame, items: Items, n: int = GRAM) -> DataFrame:
    """``(doc_id, words, grams)`` of the documents with an n-gram of an item: numbers of their words, and of the n-grams they have."""
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items_ = shared.value
        for b in batches:
            for names, texts in _some((d, np.array(items_.numbers(t), np.int32)) for d, t in zip(b["doc_id"], b["text"])):
                words, end = _together(texts)
                p, at = items_.hits(words, n)
                doc = np.searchsorted(end, p, side="right")
                some, first = np.unique(doc, return_index=True)
                own = [np.unique(x).astype(np.int32) for x in np.split(at, first[1:])] if len(some) else []
                yield pd.DataFrame({"doc_id": [names[i] for i in some], "words": [texts[i].tobytes() for i in some], "grams": [x.tobytes() for x in own]}, dtype=object)

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id string, words binary, grams binary")


def frequencies(found: DataFrame, items: Items, n: int = GRAM) -> dict[int, int]:
    """Number of documents of each n-gram of the items; what the driver gets is bounded by their number."""
    known = items.grams[n][0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(known), np.int64)
        for b in batches:
            if len(b):
                total += np.bincount(np.frombuffer(b"".join(b["grams"]), np.int32), minlength=len(known))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"at": some, "n": total[some]})

    counted = found.select("grams").mapInPandas(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    return {int(known[r["at"]]): r.n for r in counted}


def _leaks_of(documents: DataFrame, items: Items, span: int | None, n: int) -> DataFrame:
    spark = documents.sparkSession
    if span is None:
        shared = spark.sparkContext.broadcast(items)

        def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items_ = shared.value
            for b in batches:
                for names, texts in _some((d, np.array(items_.numbers(t), np.int32)) for d, t in zip(b["doc_id"], b["text"])):
                    words, end = _together(texts)
                    yield _rows(names, aligned(words, end, {size: items_.hits(words, size) for size in items_.grams}, items_), items_)

        return documents.select("doc_id", "text").mapInPandas(direct, FOUND)
    found = materialize(seeded(documents, items, n), "seeded")
    frequency = frequencies(found, items, n)
    chosen = [seeds(items.words[a:z], frequency, span, n) for a, z in zip(items.start, items.start[1:])]
    rare = spark.sparkContext.broadcast(items.only(chosen, n))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items_ = rare.value
        for b in batches:
            for names, texts in _some((d, np.frombuffer(w, np.int32)) for d, w in zip(b["doc_id"], b["words"])):
                words, end = _together(texts)
                yield _rows(names, aligned(words, end, {n: items_.hits(words, n)}, items_), items_)

    return found.select("doc_id", "words").mapInPandas(score, FOUND)


def leaks(documents: DataFrame, items: DataFrame, span: int | None = None, n: int = GRAM, most_words: int = MOST_ITEM_WORDS) -> DataFrame:
    """``(doc_id, item_id, run, score, share)`` of each document and item that share an n-gram; an item of fewer words has to be in the document.

    ``score`` is that of the best local alignment through such a seed, ``share``
    the part of the item's words that it takes and ``run`` the number of
    successive words in common. A copy that is edited in one word of seven or
    fewer, evenly or not, has a seed of 6. Items without an id, and null or
    empty texts, give no row. Repeated documents or items each give their own
    rows. With a ``span``, only pairs with so many successive words in common
    are sure to have a row.

    Items go to all executors in blocks of about ``most_words`` words, by a
    hash of their ids; each block is a pass over the documents.
    """
    spark = documents.sparkSession
    held = items.where(F.col("item_id").isNotNull()).select("item_id", "text")
    size = held.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"))).alias("n")).first().n or 0
    blocks = 1 if size <= most_words else -(-2 * size // most_words)
    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = spark.createDataFrame([], FOUND)
    for i in range(blocks):
        rows = (held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)).collect()
        block = Items.of(rows, span, n)
        if len(block.names):
            found = found.unionByName(_leaks_of(docs, block, span, n))
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def exact_leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, n: int = GRAM) -> DataFrame:
    """Documents and items with ``span`` successive words in common.

    Such a pair has an alignment that scores as much as these words; pairs that
    reach it are then checked exactly.
    """
    reached = leaks(documents, items, span, n).where(F.col("score") >= MATCH * span)
    return reached.where(F.col("run") >= span).select("doc_id", "item_id").distinct()
