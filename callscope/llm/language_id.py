"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

Both states run through the whole text: what the network says of a byte depends on all bytes before and after it. It is
trained on spans of several words, half of them of two languages. Every byte gets a label; a document's probabilities are
the mean of its bytes'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_length, column, flat, pick, place, sample_ids

HIDDEN = 8
TRAIN_DOCS, TRAIN_SPANS, SPAN = 800, 2400, 96  # bounds of the labelled sample that the network is fitted on; characters
EPOCHS, BATCH, RATE = 5, 32, 0.01
MIN_PROB = 0.4  # mean over all bytes; an even guess among four languages is 0.25
CELLS = 8 << 20  # bytes times labels that are read at once
RUN = 16_411  # bytes that are worked on at once between them


def _sig(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiGRU:
    """Weights and passes of the network. Spans are rows of bytes, padded, sorted by falling length."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        r = np.random.default_rng(seed)
        h, c = hidden, len(labels)
        self.labels, self.hidden = labels, hidden
        self.w = {}
        for d in "fb":
            self.w["E" + d] = r.normal(0, 0.3, (256, 3 * h)).astype("f4")  # bytes' inputs to the three gates, bias included
            self.w["U" + d] = (r.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype("f4")
            self.w["V" + d] = (r.normal(0, 1, (h, c)) / np.sqrt(h)).astype("f4")
        self.w["v"] = np.zeros(c, "f4")

    def _run(self, x, n, d, keep):
        h, (rows, steps) = self.hidden, x.shape
        state, out, saved = np.zeros((rows, h), "f4"), np.zeros((rows, steps, h), "f4"), []
        E, U = self.w["E" + d], self.w["U" + d]
        for t in range(steps):
            live = int(np.searchsorted(-n, -t, "left"))  # rows longer than t
            at = t if d == "f" else n[:live] - 1 - t
            b = x[np.arange(live), at]
            prev, e = state[:live], E[b]
            u = prev @ U
            g = _sig(e[:, : 2 * h] + u[:, : 2 * h])
            r, z = g[:, :h], g[:, h:]
            q = np.tanh(e[:, 2 * h :] + r * u[:, 2 * h :])
            new = q + z * (prev - q)
            if keep:
                saved.append((b, at, prev.copy(), r, z, q, u[:, 2 * h :]))
            state[:live] = new
            out[np.arange(live), at] = new
        return out, saved

    def _ready(self, dirs: str):
        """Weights of both directions with the gates' halves folded in: a gate is (tanh + 1) / 2."""
        h = self.hidden
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype("f4")
        E = np.stack([(self.w["E" + d] * half).T for d in dirs])
        U = np.stack([(self.w["U" + d] * 0.5).T for d in dirs])
        return np.ascontiguousarray(E), np.ascontiguousarray(U), np.stack([self.w["V" + d].T for d in dirs])

    def steps(self, dirs: str, x: list[np.ndarray], live: np.ndarray, state: np.ndarray, scores: np.ndarray | None = None, spots: list[np.ndarray] = ()):
        """Last states, of packed bytes: live[t] rows at step t. The labels' scores at each cell are added to those at its spot.

        Rows lie last in all arrays, so that numpy's loops are long: states are (directions, hidden, rows). What needs no state
        is done for a run of steps at once.
        """
        h, (E, U, V) = self.hidden, self._ready(dirs)
        state, at, t = state.copy(), 0, 0
        first = np.append(0, np.cumsum(live))
        while t < len(live):
            end = max(t + 1, int(np.searchsorted(first, at + RUN, "right")) - 1)
            cells = int(first[end] - at)
            e = np.empty((len(dirs), 3 * h, cells), "f4")
            for k in range(len(dirs)):
                np.take(E[k], x[k][at : at + cells], 1, out=e[k], mode="clip")
            seen = np.empty((len(dirs), h, cells), "f4")
            a = 0
            for n in live[t:end].tolist():
                if n < state.shape[2]:
                    state = np.ascontiguousarray(state[:, :, :n])
                z = a + n
                u = np.matmul(U, state)
                g = u[:, : 2 * h]
                g += e[:, : 2 * h, a:z]
                np.tanh(g, out=g)
                g += 1
                q = g[:, :h] * u[:, 2 * h :]
                q += e[:, 2 * h :, a:z]
                np.tanh(q, out=q)
                state -= q
                state *= g[:, h:]
                state *= 0.5
                state += q
                seen[:, :, a:z] = state
                a = z
            for k, spot in enumerate(spots):
                here = spot[at : at + cells]
                for total, more in zip(scores, V[k] @ seen[k]):
                    total[here] += more
            at, t = at + cells, end
        return state

    def _shares(self, s: np.ndarray) -> np.ndarray:
        """(labels, cells) of scores (labels, cells), in place."""
        s += self.w["v"][:, None]
        s -= s.max(0)
        np.exp(s, out=s)
        s /= s.sum(0)
        return s

    def probs(self, texts: list[bytes]):
        """(first byte, (labels, bytes)) in runs of the bytes of texts that are not empty, one after the other; all texts go
        through the network together."""
        n = np.array(list(map(len, texts)))
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(n), np.int32)
        rank[order] = np.arange(len(n), dtype=np.int32)
        live = np.searchsorted(-n[order], -np.arange(n.max()), "left")  # rows longer than t
        before = (np.cumsum(live) - live).astype(np.int32)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        x, spots = [np.empty(len(flat), np.uint8) for _ in "fb"], [np.empty(len(flat), np.int32) for _ in "fb"]
        for r, m, z in zip(rank.tolist(), n.tolist(), np.cumsum(n).tolist()):
            cells, own = before[:m] + np.int32(r), np.arange(z - m, z, dtype=np.int32)
            for k, at in enumerate((own, own[::-1])):
                x[k][cells], spots[k][cells] = flat[at], at
        s = np.zeros((len(self.labels), len(flat)), "f4")
        self.steps("fb", x, live, np.zeros((2, self.hidden, len(n)), "f4"), s, spots)
        for a in range(0, len(flat), RUN):
            yield a, self._shares(s[:, a : a + RUN].copy())

    def long_probs(self, text: bytes, room: int):
        """(labels, bytes) of one text in runs of room bytes, last run first; states are carried over from run to run."""
        runs = [np.frombuffer(text[a : a + room], np.uint8) for a in range(0, len(text), room)]
        zero = np.zeros((1, self.hidden, 1), "f4")
        fore, back = [zero], zero
        for x in runs[:-1]:
            fore.append(self.steps("f", [x], np.ones(len(x), int), fore[-1]))
        for x, state in zip(runs[::-1], fore[::-1]):
            one, at, s = np.ones(len(x), int), np.arange(len(x)), np.zeros((len(self.labels), len(x)), "f4")
            self.steps("f", [x], one, state, s, [at])
            back = self.steps("b", [x[::-1]], one, back, s, [at[::-1]])
            yield self._shares(s)

    def gradients(self, x, n, y):
        """Loss (mean cross entropy of the bytes) and gradients, by backpropagation through time. y: a label a row, or a byte."""
        w, h = self.w, self.hidden
        y = np.broadcast_to(y if y.ndim > 1 else y[:, None], x.shape)
        cell = np.arange(x.shape[0])[:, None], np.arange(x.shape[1]), y
        outs, tapes = {}, {}
        for d in "fb":
            outs[d], tapes[d] = self._run(x, n, d, True)
        s = outs["f"] @ w["Vf"] + outs["b"] @ w["Vb"] + w["v"]
        s -= s.max(-1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(-1, keepdims=True)
        mask = np.arange(x.shape[1]) < n[:, None]
        total = mask.sum()
        loss = -np.log(np.maximum(p[cell], 1e-9))[mask].sum() / total
        ds = p.copy()
        ds[cell] -= 1
        ds *= mask[:, :, None] / np.float32(total)
        g = {"v": ds.sum((0, 1))}
        for d in "fb":
            g["V" + d] = np.einsum("nth,ntc->hc", outs[d], ds)
            dout = ds @ w["V" + d].T
            gE, gU, carry = np.zeros_like(w["E" + d]), np.zeros_like(w["U" + d]), np.zeros((len(n), h), "f4")
            for b, at, prev, r, z, q, uq in reversed(tapes[d]):
                live = len(b)
                dn = dout[np.arange(live), at] + carry[:live]
                dq = dn * (1 - z) * (1 - q * q)
                dz = dn * (prev - q) * z * (1 - z)
                dr = dq * uq * r * (1 - r)
                de = np.concatenate([dr, dz, dq], 1)
                du = np.concatenate([dr, dz, dq * r], 1)
                np.add.at(gE, b, de)
                gU += prev.T @ du
                carry[:live] = dn * z + du @ w["U" + d].T
            g["E" + d], g["U" + d] = gE, gU
        return loss, g

    def fit(self, spans: list[bytes], y: list[np.ndarray], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 0):
        r = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step = 0
        size = np.array([len(w) for w in spans])
        for epoch in range(epochs):
            o = r.permutation(len(spans))
            o = o[np.argsort(size[o] // 3, kind="stable")]  # spans of like length together
            cuts = [o[a : a + batch] for a in range(0, len(o), batch)]
            for i in r.permutation(len(cuts)):
                pickd = cuts[i][np.argsort(-size[cuts[i]], kind="stable")]
                x, n = padded([spans[j] for j in pickd])
                marks = np.zeros(x.shape, int)
                for k, j in enumerate(pickd):
                    marks[k, : n[k]] = y[j]
                _, g = self.gradients(x, n, marks)
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for k, v in self.w.items():
                    a, b = m[k]
                    a += 0.1 * (g[k] - a)
                    b += 0.01 * (g[k] * g[k] - b)
                    v -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype("f4")
        return self


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words])
    width = int(n.max())
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.intp), n


class Reader:
    """The network over whole texts."""

    def __init__(self, model: BiGRU):
        self.model = model
        self.room = max(1 << 16, CELLS // max(1, len(model.labels)))  # bytes

    def read(self, texts: list) -> tuple[np.ndarray, list[bytes]]:
        """Mean probabilities of each text (zeros if it is empty), and the label number of each of its bytes."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        if not self.model.labels:
            return np.zeros((len(raw), 1)), [b""] * len(raw)
        means, labels = np.zeros((len(raw), len(self.model.labels))), [b""] * len(raw)
        short = [i for i, t in enumerate(raw) if 0 < len(t) <= self.room]
        if short:
            n = np.array([len(raw[i]) for i in short])
            own, best = np.repeat(np.arange(len(short), dtype=np.int32), n), np.empty(n.sum(), np.uint8)
            for a, p in self.model.probs([raw[i] for i in short]):
                z = a + p.shape[1]
                best[a:z] = p.argmax(0)
                low, high = own[a], own[z - 1] + 1
                for k in range(len(p)):
                    means[short[low:high], k] += np.bincount(own[a:z] - low, p[k], high - low)
            means[short] /= n[:, None]
            for i, a, z in zip(short, (np.cumsum(n) - n).tolist(), np.cumsum(n).tolist()):
                labels[i] = best[a:z].tobytes()
        for i, t in enumerate(raw):
            if len(t) > self.room:
                marks = []
                for p in self.model.long_probs(t, self.room):
                    means[i] += p.sum(1, dtype=np.float64) / len(t)
                    marks.append(p.argmax(0).astype(np.uint8).tobytes())
                labels[i] = b"".join(marks[::-1])
        return means, labels


def spans(texts: list[list[str]], n: int, r: np.random.Generator) -> tuple[list[bytes], list[np.ndarray]]:
    """n spans of the languages' texts, each language as often, and the labels of their bytes; every other span has two halves.

    A span begins after a space if there is one near, and never inside a character.
    """

    def piece(k: int, size: int) -> bytes:
        t = texts[k][r.integers(len(texts[k]))]
        a = int(r.integers(max(1, len(t) - size)))
        space = t.find(" ", a, a + size // 2) if a else -1
        return t[space + 1 if space >= 0 else a :][:size].encode("utf-8", "replace")

    out, y = [], []
    for i in range(n):
        cut = [(i % len(texts), SPAN)] if i // len(texts) % 2 else [(i % len(texts), SPAN // 2), (int(r.integers(len(texts))), SPAN // 2)]
        got = [(k, piece(k, size)) for k, size in cut]
        out.append(b" ".join(p for _, p in got))
        y.append(np.concatenate([np.full(len(p) + (j > 0), k) for j, (k, p) in enumerate(got)]))
    return out, y


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_spans: int = TRAIN_SPANS, hidden: int = HIDDEN, epochs: int = EPOCHS) -> BiGRU:
    """A network fitted to max_spans spans of at most max_docs rows that carry a language, those of the least hashed ids.

    Without such rows it knows no language, and identifies none.
    """
    docs = pick(docs, doc_id="bigint", text="string", lang="string")
    have = docs.where("lang is not null and doc_id is not null and text is not null")
    last = sample_ids(have.select("doc_id"), max_docs)
    rows = sorted(have.where(F.col("doc_id").isin(last)).orderBy(F.xxhash64("doc_id"), "doc_id", "lang", F.xxhash64("text")).limit(max_docs).collect(), key=lambda r: (r["doc_id"], r["lang"], r["text"])) if last else []
    labels = sorted({r["lang"] for r in rows})
    model = BiGRU(labels, hidden)
    texts = [(k, [r["text"] for r in rows if r["lang"] == lab and r["text"]]) for k, lab in enumerate(labels)]
    texts = [(k, t) for k, t in texts if t]
    if not texts:
        return model
    cut, y = spans([t for _, t in texts], max_spans, np.random.default_rng(1))
    number = np.array([k for k, _ in texts])
    return model.fit(cut, [number[v] for v in y], epochs)


def identify(docs: DataFrame, model: BiGRU | None = None, min_prob: float = MIN_PROB) -> DataFrame:
    """One row a document: doc_id, language, prob, accepted, probs (in the order of languages), languages, labels.

    labels has one byte for each byte of the UTF-8 text: the number of its language in languages. A document is accepted if
    the mean probability of its best language is at least min_prob; ties go to the language first in alphabetical order.
    Null and empty texts have no language, prob 0, empty labels, and are not accepted; nor is any text if no row that could
    be learned from carries a language. With one language only, every text is in it. Texts are read whole: long ones in runs that carry
    the states over. Repeated rows and null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    docs = pick(docs, doc_id="bigint", text="string", lang="string")
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.hidden, model.w))

    def rows(batches):
        labels, hidden, w = shared.value
        net = BiGRU(labels, hidden)
        net.w = w
        reader = Reader(net)
        for b in by_length(batches, limit=reader.room):
            probs, marks = reader.read(column(b, "text"))
            best = probs.argmax(1)
            top = probs[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([labels[k] if p > 0 else None for k, p in zip(best, top)], pa.string()),
                    pa.array(top, pa.float64()),
                    pa.array((top >= min_prob) & (top > 0), pa.bool_()),
                    pa.array(list(probs), pa.list_(pa.float64())),
                    pa.array([labels] * len(best), pa.list_(pa.string())),
                    pa.array(marks, pa.binary()),
                ],
                ["doc_id", "language", "prob", "accepted", "probs", "languages", "labels"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, language string, prob double, accepted boolean, probs array<double>, languages array<string>, labels binary")


def accepted(docs: DataFrame, min_prob: float = MIN_PROB, model: BiGRU | None = None) -> DataFrame:
    """The rows whose text is accepted (see identify), with all their columns as they were, whatever their names.

    Null and empty texts go; repeated rows and null ids stay or go by their text; without a text column, or without any
    language to learn from, no row is left; an empty table gives an empty table.
    """
    at = place(docs, "text")
    if at is None:
        return docs.limit(0)
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.hidden, model.w))
    own, name = flat(docs), f"c{at}"

    def rows(batches):
        labels, hidden, w = shared.value
        net = BiGRU(labels, hidden)
        net.w = w
        reader = Reader(net)
        for b in by_length(batches, name, reader.room):
            p = reader.read(column(b, name))[0].max(1)
            yield b.filter(pa.array((p >= min_prob) & (p > 0)))

    return own.mapInArrow(rows, own.schema).toDF(*docs.columns)
