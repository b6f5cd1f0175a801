"""Public byte-pair tokens of whole texts, with a memo of space-delimited chunks."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_LIMIT = 100_000
STEP = 1 << 15  # chunks whose ids are copied at once


class Encoder:
    """Token ids as little-endian unsigned 16-bit bytes.

    A piece of the pattern never spans the place before a single space, so the text is cut there and each chunk's ids are
    remembered. Where runs of white space touch a chunk's edge, the whole text is encoded at once: ids are always those of
    the plain tokenizer.
    """

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.size = max(ranks.values()) + 1
        if self.size >= 1 << 16:
            raise ValueError("the vocabulary must fit 16 bits")
        self.end = self.size  # free id, ends a document
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.n_bytes = np.zeros(self.size + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.n_bytes[i] = len(b)
        outer = self

        class Memo(dict):
            def __missing__(self, chunk: str):
                if len(self) >= MEMO_LIMIT:
                    self.clear()
                edge = not chunk or chunk[0].isspace() or chunk[-1].isspace()
                v = self[chunk] = None if edge else outer.raw(" " + chunk)
                return v

        self.memo = Memo()

    def raw(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), "<u2").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return self.raw(text)
        try:
            return self.raw(head) + b"".join(map(self.memo.__getitem__, rest))
        except TypeError:  # a chunk with white space at its edge
            return self.raw(text)

    def flat(self, texts: pa.Array | Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text in them (one more than texts).

        Chunks that the texts share are encoded once, all distinct ones in one call: by the rule above they don't touch.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return np.empty(0, "<u2"), np.zeros(1, np.int64)
        chunks = pc.split_pattern(texts, " ")
        last = np.cumsum(pc.list_value_length(chunks).to_numpy(), dtype=np.int64)
        head = np.concatenate([[0], last[:-1]])
        chunks = chunks.flatten()
        rest = np.ones(len(chunks), bool)
        rest[head] = False
        coded = chunks.filter(pa.array(rest)).dictionary_encode()
        at, size = coded.indices.to_numpy(), pc.binary_length(coded.dictionary).to_numpy()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(size)], coded.dictionary), " ")[0].as_py().split(" ") if len(size) else []
        bad = np.array([not c or len(c.strip()) != len(c) for c in distinct], bool)  # white space at an edge: these would touch
        own = self.plain.encode_to_numpy(" " + " ".join(c for c, x in zip(distinct, bad.tolist()) if not x)).astype("<u2") if not bad.all() else np.empty(0, "<u2")
        ends = np.cumsum(np.where(bad, 0, size + np.int64(1)))
        edges = np.concatenate([[0], np.searchsorted(np.cumsum(self.n_bytes[own]), ends, "right")])
        # each chunk's ids are a slice of own or, for the first of a text, of what follows it: that chunk's or, if any is bad, the whole text's
        begin, n, edge = (np.zeros(len(chunks), t) for t in (np.int32, np.int32, bool))
        begin[rest], n[rest], edge[rest] = edges[:-1].astype(np.int32)[at], np.diff(edges).astype(np.int32)[at], bad[at]
        first = chunks.take(pa.array(head)).to_pylist()
        del chunks, coded, distinct, at
        edge[head] = [not c or c[-1].isspace() for c in first]
        whole = np.logical_or.reduceat(edge, head)
        n[np.repeat(whole, last - head)] = 0
        parts = [self.raw(texts[i].as_py() if w else c) for i, (c, w) in enumerate(zip(first, whole.tolist()))]
        n[head] = [len(p) // 2 for p in parts]
        begin[head] = len(own) + np.cumsum(n[head], dtype=np.int64) - n[head]
        ids = np.concatenate([own, np.frombuffer(b"".join(parts), "<u2")])
        out = np.empty(n.sum(), "<u2")
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        for a in range(0, len(n), STEP):
            own, size = total[a : a + STEP + 1], n[a : a + STEP]
            out[own[0] : own[-1]] = ids[np.repeat(begin[a : a + STEP] - own[:-1], size) + np.arange(own[0], own[-1])]
        return out, np.concatenate([[0], total[last]])

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes_of.get(int(i), b"") for i in ids)


@lru_cache(2)
def encoder(path: str = TOKENIZER) -> Encoder:
    return Encoder(path)
