"""License scans by patience alignment: anchors are words unique to both sides, the gaps between them are aligned alike."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, pick, small_batches, words
from .licenses import TEMPLATES

MIN_COVERAGE, MIN_DENSITY = 0.85, 0.6
OUT = "doc_id bigint, license string, coverage double, density double, first_word bigint, n_words bigint"


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by the first number, the longest run that increases in the second."""
    ends: list[int] = []
    last: list[int] = []
    prev = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(ends, y)
        prev[i] = last[k - 1] if k else -1
        ends[k : k + 1] = [y]
        last[k : k + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = prev[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of a and b, increasing in both; equal words at both ends of a gap are aligned as they stand."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        at = {b[y]: y for y in range(k, m) if cb[b[y]] == 1}
        anchors = increasing([(x, at[a[x]]) for x in range(i, j) if ca[a[x]] == 1 and a[x] in at])
        if not anchors:
            continue
        out += anchors
        edges = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


def densest(pairs: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The aligned words without stray ones at the ends, as long as at least so many are left and it makes them denser."""
    p = list(pairs)
    while len(p) > max(least, 2):
        left, right = p[1][0] - p[0][0], p[-1][0] - p[-2][0]
        gap = max(left, right)
        if gap <= max(2, len(p) // 4):
            break
        p = p[1:] if left >= right else p[:-1]
    return p


class Scanner:
    """Templates as word numbers; a text is looked at in windows that start a quarter of a template's length apart.

    The wider ones hold whole any occurrence that is as stretched as the density allows; narrower ones, of one and a half
    times the length, tell repeated notices apart. Windows that can't reach the coverage, as too few of the template's words
    are in them, are passed over: none is lost by it.
    """

    def __init__(self, templates: dict[str, list[str]], min_coverage: float, min_density: float):
        self.coverage, self.density = min_coverage, min_density
        self.names, self.lists, self.number = [], [], {}
        for name, texts in sorted(templates.items()):
            for t in texts:
                w = words(t)
                if w:
                    self.names.append(name)
                    self.lists.append([self.number.setdefault(x, len(self.number)) for x in w])
        self.counts = np.zeros((len(self.lists), len(self.number)), np.int64)
        for k, t in enumerate(self.lists):
            np.add.at(self.counts[k], t, 1)
        self.need = np.array([int(np.ceil(min_coverage * len(t) - 1e-9)) for t in self.lists], np.int64)

    def scan(self, text: str | None) -> list[tuple[str, float, float, int, int]]:
        """(license, coverage, density, first word, words) of each place where a license is found."""
        if not text or not self.lists:
            return []
        w = words(text)
        ids = np.fromiter((self.number.get(x, -1) for x in w), np.int64, len(w))
        there = np.bincount(ids[ids >= 0], minlength=len(self.number))
        places = set()
        for k in np.flatnonzero(np.minimum(there, self.counts).sum(1) >= self.need).tolist():
            m, step = len(self.lists[k]), max(1, len(self.lists[k]) // 4)
            for wide in {m + (m + 1) // 2, int(np.ceil(m / self.density)) + step}:
                places.update((-got[0] * got[1], -got[3], got[2], self.names[k], got) for got in self._windows(ids, k, wide, step))
        starts: list[int] = []
        ends: list[int] = []
        out: list[tuple] = []
        for *_, name, got in sorted(places):
            i = bisect_left(starts, got[2])
            if (i and ends[i - 1] > got[2]) or (i < len(starts) and starts[i] < got[2] + got[3]):
                continue
            starts.insert(i, got[2])
            ends.insert(i, got[2] + got[3])
            out.append((name, *got))
        return sorted(out, key=lambda r: (r[0], r[3]))

    def _windows(self, ids: np.ndarray, k: int, wide: int, step: int):
        t, need = self.lists[k], int(self.need[k])
        m = len(t)
        inside = np.append(0, np.cumsum((ids >= 0) & (self.counts[k][np.maximum(ids, 0)] > 0)))
        starts = np.arange(0, max(1, len(ids) - wide + step), step)
        stops = np.minimum(starts + wide, len(ids))
        ok = inside[stops] - inside[starts] >= need
        for a, z in zip(starts[ok].tolist(), stops[ok].tolist()):
            part = ids[a:z]
            if np.minimum(np.bincount(part[part >= 0], minlength=len(self.number)), self.counts[k]).sum() < need:
                continue
            p = densest(patience(part.tolist(), t), need)
            if len(p) < need:
                continue
            n = p[-1][0] - p[0][0] + 1
            if len(p) >= self.density * n:
                yield len(p) / m, len(p) / n, a + p[0][0], n


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, min_coverage: float = MIN_COVERAGE, min_density: float = MIN_DENSITY) -> DataFrame:
    """One row for each place where a license is found in a document: doc_id, license, coverage, density, first_word, n_words.

    coverage is the share of the template's words that are aligned, density the share of aligned words in the run of the
    text (first_word, from 0, and n_words) that they lie in. Of all places of all templates that overlap, that of the greatest
    product of both counts, then the longest, then the first, then the first name. Words are lower-cased and punctuation is
    ignored. Texts are taken whole, of any length. Null and empty texts give no rows; repeated rows give their rows each; null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)

    def rows(batches):
        scanner = Scanner(shared.value, min_coverage, min_density)
        for b in small_batches(batches):
            got = [(d, *r) for d, t in zip(column(b, "doc_id"), column(b, "text")) for r in scanner.scan(t)]
            cols = list(zip(*got)) if got else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "license", "coverage", "density", "first_word", "n_words"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(rows, OUT)
