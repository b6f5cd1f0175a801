"""Token counts under edits: a segment tree over a document's pre-tokens, of which an edit re-encodes the touched part."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pick, small_batches
from .tokens import PATTERN, TOKENIZER, encoder

LEAF = 64  # pre-tokens of a leaf as it is built; a leaf of twice as many is still one
CONTEXT = 3  # a pre-token is settled by its own characters and so many after it ("'ll" is the longest that is looked for)
_PIECES = regex.compile(PATTERN)
MEMO_LIMIT = 100_000

#: Personal data and secrets that a scrub replaces, in order of precedence.
SCRUB = regex.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+)|(?P<key>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{16,})\b)"
    r"|(?P<ip>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<card>\b\d{13,19}\b)|(?P<phone>(?<!\w)\+?\d{1,3}[ -]?\(\d{3}\)[ -]?\d{3}-\d{4}\b)"
)


class PieceCounts(dict):
    """Pre-token -> its number of tokens; emptied when full."""

    def __init__(self, enc):
        super().__init__()
        self.count = lambda p: len(enc.plain.encode_ordinary(p))  # a pre-token by itself is one again

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        n = self[piece] = self.count(piece)
        return n


class Tree:
    """Pre-tokens in leaves of about LEAF; inner nodes hold sums of characters, tokens and pre-tokens."""

    def __init__(self, text: str, counts: PieceCounts):
        self.counts, self.reencoded = counts, 0
        self._build(_PIECES.findall(text))

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [[] for _ in range(self.width - len(self.leaves))]
        self.chars, self.tokens, self.size = ([0] * (2 * self.width) for _ in range(3))
        for i, leaf in enumerate(self.leaves):
            self._sum(i, leaf)
        for k in range(self.width - 1, 0, -1):
            self._join(k)

    def _sum(self, i: int, leaf: list[str]) -> None:
        k = self.width + i
        self.chars[k], self.tokens[k], self.size[k] = sum(map(len, leaf)), sum(map(self.counts.__getitem__, leaf)), len(leaf)

    def _join(self, k: int) -> None:
        for s in (self.chars, self.tokens, self.size):
            s[k] = s[2 * k] + s[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character pos (the last that has any, at the end), and where it starts."""
        k, start = 1, 0
        pos = max(0, min(pos, self.chars[1] - 1))
        while k < self.width:
            k *= 2
            if pos - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start to stop of the present text."""
        total = self.chars[1]
        start = max(0, min(start, total))
        stop = max(start, min(stop, total))
        first, at = self._find(start - CONTEXT - 1)
        last, end_at = self._find(max(stop, start))
        end = end_at + self.chars[self.width + last]
        old = [p for leaf in self.leaves[first : last + 1] for p in leaf]
        # the pre-tokens before the first that the edit could change stay
        keep, pos = 0, at
        while keep < len(old) and pos + len(old[keep]) + CONTEXT <= start:
            pos += len(old[keep])
            keep += 1
        edges, p = set(), at
        for piece in old:
            edges.add(p)
            p += len(piece)
        edges.add(end)
        gone = stop - start
        body = "".join(old[keep:])
        text = body[: start - pos] + new + body[stop - pos :]
        fresh: list[str] = []
        spot, ahead = 0, last + 1
        while True:  # until a new edge falls on an old one after the edit: from there on nothing changes
            for m in _PIECES.finditer(text, spot):
                old_pos = pos + m.start() - len(new) + gone
                if m.start() >= start - pos + len(new) and old_pos in edges:
                    tail, q = [], at
                    for piece in old:
                        if q >= old_pos:
                            tail.append(piece)
                        q += len(piece)
                    return self._put(first, last, old[:keep] + fresh + tail, len(fresh))
                more = ahead < self.width and any(self.leaves[ahead:])
                if m.end() + CONTEXT > len(text) and more:
                    spot = m.start()
                    break
                fresh.append(m[0])
                spot = m.end()
            else:
                return self._put(first, last, old[:keep] + fresh, len(fresh))
            leaf = self.leaves[ahead]
            for piece in leaf:
                edges.add(end)
                end += len(piece)
            edges.add(end)
            old += leaf
            text += "".join(leaf)
            last, ahead = ahead, ahead + 1

    def _put(self, first: int, last: int, pieces: list[str], fresh: int) -> None:
        self.reencoded += fresh
        count = last - first + 1
        per = max(1, -(-len(pieces) // count))
        for i in range(count):
            self.leaves[first + i] = pieces[i * per : (i + 1) * per]
            self._sum(first + i, self.leaves[first + i])
        lo, hi = self.width + first, self.width + last
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            for k in range(lo, hi + 1):
                self._join(k)
        if max(len(self.leaves[first + i]) for i in range(count)) > 64 * LEAF:  # a long insertion: build it anew
            self._build([p for leaf in self.leaves for p in leaf])

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def scrubs(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace personal data and secrets by their kind, last first, so that places stay right."""
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in SCRUB.finditer(text)][::-1]


OUT = "doc_id bigint, n_edits int, tokens_before bigint, tokens_after bigint, pieces bigint, reencoded bigint"


def edited_counts(docs: DataFrame, edits: DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a document: doc_id, n_edits, tokens_before, tokens_after, pieces (pre-tokens at the end), reencoded.

    edits has doc_id, seq, start, stop, text: applied in the order of seq (ties: by start, stop, text), each to the text as
    it then is, places clipped to it; a null text deletes. Without edits, each document's personal data and secrets are
    replaced. Texts are taken whole. Null texts count as empty; repeated rows each get all of their id's edits; edits of a null or unknown id do
    nothing; other columns are ignored; an empty table gives no rows. pieces and reencoded are 0 where nothing is edited.
    """
    docs = pick(docs, doc_id="bigint", text="string")
    given = edits is not None
    if given:
        e = pick(edits, doc_id="bigint", seq="bigint", start="bigint", stop="bigint", text="string").where("doc_id is not null and start is not null and stop is not null")
        e = e.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", F.coalesce("text", F.lit("")).alias("text")))).alias("edits"))
        docs = docs.join(e, "doc_id", "left")

    def rows(batches):
        enc = encoder(tokenizer)
        counts = PieceCounts(enc)
        for b in small_batches(batches):
            out = []
            todo = column(b, "edits") if given else None
            for i, (d, t) in enumerate(zip(column(b, "doc_id"), column(b, "text"))):
                t = t or ""
                own = [(x["start"], x["stop"], x["text"]) for x in todo[i] or []] if given else scrubs(t)
                if not own:
                    n = len(enc.encode(t)) // 2
                    out.append((d, 0, n, n, 0, 0))
                    continue
                tree = Tree(t, counts)
                before = tree.n_tokens
                for x in own:
                    tree.edit(*x)
                out.append((d, len(own), before, tree.n_tokens, tree.size[1], tree.reencoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], [f.split()[0] for f in OUT.split(", ")])

    return docs.mapInArrow(rows, OUT)
