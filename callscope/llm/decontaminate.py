"""Benchmark decontamination by winnowing: least k-gram hash of each window, joined, and hits extended."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, flat, kgrams, mix, pick, place, small_batches, word_hashes

K, WINDOW = 4, 5  # every shared run of K + WINDOW - 1 words is found
SHARED_LIMIT = 4_000_000  # words of the benchmark up to which its index is broadcast
OUT = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint"


def winnow(h: np.ndarray, off: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (hash, flat place): the least k-gram of each run of w; of equal ones the last place."""
    g, at = kgrams(h, off, k)
    if not len(g):
        return g, at
    text = np.searchsorted(off, at, "right")
    # the order of grams: hash, then later place first; a window is the w grams up to here, shorter at the start of a text
    best = np.arange(len(g))
    reach = np.arange(len(g)) - np.searchsorted(text, text, "left")
    for step in range(1, w):
        prev = np.arange(len(g)) - step
        ok = reach >= step
        cand = np.where(ok, prev, best)
        best = np.where(g[cand] < g[best], cand, best)
    last = np.append(text[1:] != text[:-1], True)
    keep = np.unique(best[(reach >= w - 1) | last])
    return g[keep], at[keep]


def stretches(g: np.ndarray, at: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints in the order of places: where stretches begin, how many are in them, and their step.

    In a stretch one hash comes again at equal steps of at most k words, as in a text that repeats itself; each other
    fingerprint is alone, with step 0.
    """
    n = len(g)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    step = np.zeros(n, np.int64)  # to the next one, 0 where that is no repetition
    step[:-1] = np.where((g[1:] == g[:-1]) & (text[1:] == text[:-1]) & (at[1:] - at[:-1] <= k), at[1:] - at[:-1], 0)
    before = np.append(0, step[:-1])
    begin = np.flatnonzero((before == 0) | (step != before) & (step > 0))
    count = np.diff(np.append(begin, n))
    # where the step changes the old stretch ends with the fingerprint before
    return begin, count, np.where(count > 1, step[begin], 0)


class Index:
    """A benchmark's words and fingerprints; finds every maximal shared run of at least k + w - 1 words."""

    def __init__(self, ids: list[int], texts: list[str], k: int, w: int):
        self.k, self.w, self.ids = k, w, np.array(ids, np.int64)
        self.h, self.off = word_hashes(texts)
        g, at = winnow(self.h, self.off, k, w)
        begin, count, step = stretches(g, at, np.searchsorted(self.off, at, "right"), k)
        o = np.argsort(g[begin], kind="stable")
        self.g, self.at, self.count, self.step = g[begin][o], at[begin][o], count[o], step[o]

    def _seeds(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the texts, place in the items, words that are surely equal from there on).

        Of two stretches of the same hash and step only the cells of the first row and column are seeds: all others lie on
        their diagonals, in the same run.
        """
        g, at = winnow(h, off, self.k, self.w)
        begin, count, step = stretches(g, at, np.searchsorted(off, at, "right"), self.k)
        g, at = g[begin], at[begin]
        lo = np.searchsorted(self.g, g, "left")
        n = np.searchsorted(self.g, g, "right") - lo
        if not n.sum():
            return (np.empty(0, np.int64),) * 3
        x = np.repeat(np.arange(len(g)), n)
        y = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, ca, sa, b, cb, sb = at[x], count[x], step[x], self.at[y], self.count[y], self.step[y]
        alike = (sa == sb) | (ca == 1) | (cb == 1)
        out = []
        for sel, cells in ((alike, ca + cb - 1), (~alike, ca * cb)):
            if not sel.any():
                continue
            m = cells[sel]
            r = np.repeat(np.flatnonzero(sel), m)
            c = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
            if sel is alike:
                i, j = np.where(c < ca[r], c, 0), np.where(c < ca[r], 0, c - ca[r] + 1)
                more = np.where((sa[r] == sb[r]), np.minimum(ca[r] - 1 - i, cb[r] - 1 - j) * sa[r], 0)
            else:
                i, j, more = c // cb[r], c % cb[r], 0
            out.append(np.stack([a[r] + i * sa[r], b[r] + j * sb[r], self.k + more + np.zeros(len(r), np.int64)]))
        return tuple(np.concatenate(out, 1))

    def hits(self, h: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Of each maximal run: text, item, word in the text, word in the item, length."""
        a, b, sure = self._seeds(h, off)
        if not len(a):
            return [np.empty(0, np.int64)] * 5
        ta, tb = np.searchsorted(off, a, "right") - 1, np.searchsorted(self.off, b, "right") - 1
        o = np.lexsort((a, a - b, tb, ta))
        a, b, sure, ta, tb = a[o], b[o], sure[o], ta[o], tb[o]
        same = (ta[1:] == ta[:-1]) & (tb[1:] == tb[:-1]) & (a[1:] - b[1:] == a[:-1] - b[:-1])
        # a seed is extended to the next one of its diagonal at most, and the first of a run to the left
        stop = np.minimum(off[ta + 1], a + self.off[tb + 1] - b)
        stop[:-1] = np.where(same, np.minimum(stop[:-1], np.maximum(a[1:], a[:-1] + sure[:-1])), stop[:-1])
        end = np.minimum(a + sure, stop)
        live = np.flatnonzero(end < stop)
        while len(live):
            ok = h[end[live]] == self.h[b[live] + end[live] - a[live]]
            live = live[ok]
            end[live] += 1
            live = live[end[live] < stop[live]]
        joined = np.append(False, same & (end[:-1] >= a[1:]))
        first = np.flatnonzero(~joined)
        top = np.maximum.reduceat(end, first)
        a, b, ta, tb = a[first], b[first], ta[first], tb[first]
        start, least = a.copy(), np.maximum(off[ta], a - (b - self.off[tb]))
        live = np.flatnonzero(start > least)
        while len(live):
            ok = h[start[live] - 1] == self.h[b[live] + start[live] - 1 - a[live]]
            live = live[ok]
            start[live] -= 1
            live = live[start[live] > least[live]]
        keep = top - start >= self.k + self.w - 1
        rows = np.stack([ta, tb, start - off[ta], b + start - a - self.off[tb], top - start], 1)[keep]
        return list(np.unique(rows, axis=0).T) if len(rows) else [np.empty(0, np.int64)] * 5


_KEPT: dict[str, Index] = {}


def _index(name: str, items: tuple[list, list], k: int, w: int) -> Index:
    """Built once a worker."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Index(*items, k, w)
    return _KEPT[name]


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, shared_limit: int = SHARED_LIMIT) -> DataFrame:
    """Every maximal run of at least k + window - 1 words that a document shares with a benchmark item.

    Columns: doc_id, item_id, doc_word and item_word (0-based place of the run's first word), n_words. Words are
    lower-cased and punctuation is ignored. Null or short texts share nothing; rows with a null id are left out; repeated
    rows give their runs once; texts are taken whole, and the time for one follows its length and that of what it shares; of equal hashes in a
    window the last counts on both sides; other columns are ignored; empty tables give no rows. A benchmark of at most
    shared_limit words is broadcast as an index, a larger one is joined by fingerprint.
    """
    docs = pick(docs, doc_id="bigint", text="string").where("doc_id is not null and text is not null")
    items = pick(benchmark, item_id="bigint", text="string").where("item_id is not null and text is not null").dropDuplicates()
    size = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] / 2
    return (_broadcast if size <= shared_limit else _shuffled)(docs, items, k, window).dropDuplicates()


def _batch(index: Index, ids: list[int], texts: list[str]) -> pa.RecordBatch:
    t, i, x, y, n = index.hits(*word_hashes(texts))
    own = np.array(ids, np.int64)
    cols = [own[t] if len(t) else t, index.ids[i] if len(i) else i, x, y, n]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])


def _broadcast(docs: DataFrame, items: DataFrame, k: int, w: int) -> DataFrame:
    got = items.orderBy("item_id", "text").collect()
    shared, own = docs.sparkSession.sparkContext.broadcast(([r[0] for r in got], [r[1] for r in got])), uuid.uuid4().hex

    def rows(batches):
        index = _index(own, shared.value, k, w)
        for b in small_batches(batches):
            yield _batch(index, column(b, "doc_id"), column(b, "text"))

    return docs.mapInArrow(rows, OUT)


def _prints(df: DataFrame, k: int, w: int) -> DataFrame:
    def rows(batches):
        for b in small_batches(batches):
            h, off = word_hashes(column(b, "text"))
            g, at = winnow(h, off, k, w)
            key = np.unique(np.stack([np.array(column(b, b.schema.names[0]), np.int64)[np.searchsorted(off, at, "right") - 1], mix(g).view(np.int64)], 1), axis=0) if len(g) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1])], ["id", "g"])

    return df.mapInArrow(rows, "id bigint, g bigint")


def _shuffled(docs: DataFrame, items: DataFrame, k: int, w: int) -> DataFrame:
    a = _prints(docs, k, w).select(F.col("id").alias("doc_id"), "g")
    b = _prints(items, k, w).select(F.col("id").alias("item_id"), "g")
    pairs = a.join(b, "g").select("doc_id", "item_id").distinct()
    both = pairs.join(docs.withColumnRenamed("text", "doc_text"), "doc_id").join(items.withColumnRenamed("text", "text"), "item_id").select("doc_id", "item_id", "doc_text", "text")

    def rows(batches):
        for b in small_batches(batches, "doc_text"):
            for d, i, x, y in zip(*(column(b, c) for c in ("doc_id", "item_id", "doc_text", "text"))):
                yield _batch(Index([i], [y], k, w), [d], [x])

    return both.mapInArrow(rows, OUT)


def clean(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, shared_limit: int = SHARED_LIMIT) -> DataFrame:
    """The rows whose text shares no run with the benchmark, with all their columns, whatever their names.

    Each row is judged by its own text: repeated rows and null ids stay or go alike. Null, empty and short texts stay; texts are read
    whole; without a text column or a benchmark all rows stay; an empty table gives an empty table. With a benchmark of at most
    shared_limit words the rows are filtered where they are read; else by hash of the text.
    """
    at = place(docs, "text")
    if at is None:
        return docs
    items = pick(benchmark, item_id="bigint", text="string").where("item_id is not null and text is not null").dropDuplicates()
    own, name = flat(docs), f"c{at}"
    if items.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] / 2 > shared_limit:
        hashed = own.withColumn("_hash", F.xxhash64(F.col(name).cast("string")))
        texts = hashed.select(F.col("_hash").alias("doc_id"), F.col(name).alias("text")).dropDuplicates(["doc_id"])
        hit = decontaminate(texts, items, k, window, shared_limit).select(F.col("doc_id").alias("_hash")).distinct()
        return hashed.join(hit, "_hash", "left_anti").drop("_hash").toDF(*docs.columns)
    got = items.orderBy("item_id", "text").collect()
    shared, key = docs.sparkSession.sparkContext.broadcast(([r[0] for r in got], [r[1] for r in got])), uuid.uuid4().hex

    def rows(batches):
        index = _index(key, shared.value, k, window)
        for b in small_batches(batches, name):
            keep = np.ones(b.num_rows, bool)
            keep[index.hits(*word_hashes(column(b, name)))[0]] = False
            yield b.filter(pa.array(keep))

    return own.mapInArrow(rows, own.schema).toDF(*docs.columns)
