"""Mixing sources to target weights: fixed blocks of tokens, multinomial counts, pseudorandom index permutations, one join."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import column, pick, small_batches, written
from .tokens import TOKENIZER, encoder

BLOCK, SHARD, ALPHA, SEED = 1024, 256, 0.5, 20240
GROUP, GROUPS = 1024, 4096  # shards that are planned at once; sums of counts that reach the driver at most, for each source
SENT = 500_000  # rows that are broadcast
HELD = 20_000  # sources of which a task keeps a block that is not full; of more, it hands on what it has to be packed again
LAST = 2**31 - 1  # the part of blocks made of what tasks have left
BLOCKS = "source string, part int, seq bigint, lang string, n int, ids binary"


def key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def permute(x: np.ndarray, n: int, k: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a Feistel network over the next power of four, walked until it is under n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def once(v):
        a, b = v >> half, v & mask
        for r in range(4):
            f = (b + np.uint64((k >> (16 * r)) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(k)
            f ^= f >> np.uint64(32)
            a, b = b, a ^ (f & mask)
        return (a << half) | b

    out = once(np.asarray(x, np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


class Packer:
    """Runs of one source's tokens, cut into blocks of a fixed number of slots; what is left of one is kept by document.

    A block ends a few tokens early where a character would be torn apart.
    """

    def __init__(self, enc, block: int):
        self.enc, self.block = enc, block
        self.begins = np.array([i == enc.end or (enc.bytes_of[i][0] & 0xC0) != 0x80 for i in range(enc.size + 1)])
        self.held: dict = {}

    def add(self, source, lang, ids: np.ndarray):
        parts, n = self.held.pop(source, ([], 0))
        parts.append((lang, ids))
        n += len(ids)
        if n < self.block:
            self.held[source] = (parts, n)
            return
        flat, at, lang0 = np.concatenate([x for _, x in parts]), 0, parts[0][0]
        while len(flat) - at >= self.block:
            end = at + self.block
            for back in range(4):
                if end < len(flat) and self.begins[flat[end - back]]:
                    end -= back
                    break
            yield source, lang0, flat[at:end]
            at, lang0 = end, lang
        if at < len(flat):
            self.held[source] = ([(lang, flat[at:])], len(flat) - at)

    def rest(self):
        """What is left: (source, lang, ids) of each document in it."""
        for source, (parts, _) in self.held.items():
            for lang, ids in parts:
                yield source, lang, ids
        self.held = {}

    def last(self):
        """What is left, a block a source."""
        for source, (parts, _) in self.held.items():
            yield source, parts[0][0], np.concatenate([x for _, x in parts])
        self.held = {}


def blocks(docs: DataFrame, block: int = BLOCK, tokenizer: str = TOKENIZER) -> DataFrame:
    """Blocks of each source's documents in the order they are read, each document with an end id after it.

    What tasks have left of a source is gathered and packed again, so that one block a source at most is not full.
    """

    def packed(got, part, seq, enc, full):
        source, lang, ids, n, num = [], [], [], [], []
        for s, g, x in got:
            source.append(s)
            lang.append(g)
            n.append(len(x))
            ids.append((np.concatenate([x, np.full(block - len(x), enc.end, "<u2")]) if full else x).astype("<u2").tobytes())
            num.append(seq.get(s, 0))
            seq[s] = num[-1] + 1
        return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array([part] * len(n), pa.int32()), pa.array(num, pa.int64()), pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array([full] * len(n), pa.bool_())], ["source", "part", "seq", "lang", "n", "ids", "whole"])

    def cut(batches):
        enc = encoder(tokenizer)
        packer, part, seq, left = Packer(enc, block), TaskContext.get().partitionId(), {}, {}
        for b in small_batches(batches):
            got, (flat, off) = [], enc.flat(b.column(0))
            for s, g, a, z in zip(column(b, "source"), column(b, "lang"), off.tolist(), off[1:].tolist()):
                if z > a:
                    got += packer.add(s or "", g, np.append(flat[a:z], np.uint16(enc.end)))
            if got:
                yield packed(got, part, seq, enc, True)
            if len(packer.held) > HELD:
                yield packed(packer.rest(), part, left, enc, False)
        if packer.held:
            yield packed(packer.rest(), part, left, enc, False)

    def again(batches):
        enc = encoder(tokenizer)
        packer, seq = Packer(enc, block), {}
        for b in small_batches(batches, "ids"):
            got = []
            for s, g, raw in zip(column(b, "source"), column(b, "lang"), column(b, "ids")):
                if packer.held and s not in packer.held:
                    got += packer.last()
                got += packer.add(s, g, np.frombuffer(raw, "<u2"))
            if got:
                yield packed(got, LAST, seq, enc, True)
        if packer.held:
            yield packed(packer.last(), LAST, seq, enc, True)

    schema = BLOCKS + ", whole boolean"
    made = written(pick(docs, text="string", lang="string", source="string").mapInArrow(cut, schema), "blocks")
    left = made.where("not whole").repartition("source").sortWithinPartitions("source", "part", "seq")
    return made.where("whole").union(written(left.mapInArrow(again, schema), "last-blocks")).drop("whole")


def targets(sizes: dict[str, int], weights: dict[str, float] | None, alpha: float) -> list[tuple[str, int, float]]:
    """(source, blocks, share) of sources that have blocks and a weight; without weights, blocks ** alpha."""
    w = {s: (n**alpha if weights is None else max(0.0, weights.get(s, 0.0))) for s, n in sizes.items() if n}
    total = sum(w.values())
    return [(s, sizes[s], v / total) for s, v in sorted(w.items()) if v > 0]


def draw(shard: int, slots: int, shares: np.ndarray, seed: int) -> np.ndarray:
    """How many slots of an output shard each source gets."""
    return np.random.default_rng([seed, shard]).multinomial(slots, shares)


def plan(spark, sources: list[tuple[str, int, float]], slots: int, shard: int, seed: int) -> DataFrame:
    """(shard, slot, source, index) for every output slot: the counts are multinomial, the k-th draw of a source over all
    shards is the k-th of its permutation, and each time around the permutation is another."""
    shares, sizes, names = np.array([p for *_, p in sources]), [n for _, n, _ in sources], [s for s, *_ in sources]
    shards = -(-slots // shard)
    wide = GROUP * max(1, -(-shards // (GROUP * GROUPS)))

    def take(j):
        return draw(j, min(shard, slots - j * shard), shares, seed)

    def sums(batches):
        for b in batches:
            g = b.column(0).to_numpy()
            total = [sum(take(j) for j in range(int(x) * wide, min(shards, (int(x) + 1) * wide))).tolist() for x in g]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.list_(pa.int64()))], ["id", "n"])

    groups = spark.range(0, -(-shards // wide), 1, max(1, -(-shards // wide)))
    got = sorted(groups.mapInArrow(sums, "id bigint, n array<bigint>").collect())
    before = np.concatenate([np.zeros((1, len(names)), np.int64), np.cumsum([r[1] for r in got], 0)])
    shared = spark.sparkContext.broadcast(before)

    def rows(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                at = shared.value[x].copy()
                for low in range(x * wide, min(shards, (x + 1) * wide), GROUP):
                    out = []
                    for j in range(low, min(shards, (x + 1) * wide, low + GROUP)):
                        c = take(j)
                        order = np.random.default_rng([seed, j, 1]).permutation(int(c.sum()))
                        src = np.repeat(np.arange(len(c)), c)
                        k = np.arange(len(src)) - np.repeat(np.cumsum(c) - c, c) + at[src]
                        out.append(np.stack([np.full(len(src), j), order, src, k], 1))
                        at += c
                    r = np.concatenate(out)
                    index = np.empty(len(r), np.int64)
                    for s in np.unique(r[:, 2]):
                        own = r[:, 2] == s
                        turn, spot = r[own, 3] // sizes[s], r[own, 3] % sizes[s]
                        found = np.empty(len(spot), np.int64)
                        for t in np.unique(turn):
                            found[turn == t] = permute(spot[turn == t], sizes[s], key(seed, names[s], int(t)))
                        index[own] = found
                    yield pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.array(r[:, 1].astype(np.int32)), pa.array([names[s] for s in r[:, 2]], pa.string()), pa.array(index)], ["shard", "slot", "source", "index"])

    return groups.mapInArrow(rows, "shard bigint, slot int, source string, index bigint")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, slots: int | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """Output slots filled with blocks of the sources at their target shares.

    Columns: shard, slot, source, index (block of the source), lang (of the document that the block begins in), n_tokens,
    ids (16-bit token ids, filled with the end id to the block's length). As many slots as there are blocks, unless slots
    says otherwise. weights maps sources to shares; without, a source weighs its blocks ** alpha. A null source counts as
    the source "". Null and empty texts give no tokens; repeated rows count as often as they occur; other columns are
    ignored; an empty table, or one without weighted sources, gives no rows. A source weighted beyond its blocks repeats
    them in another order each time around. Blocks are cut in the order rows are read, and written before they are indexed; at most
    one block a source is not full, however the rows are laid out. Texts are taken whole.
    """
    spark = docs.sparkSession
    made = blocks(docs, block, tokenizer)
    count = made.groupBy("source", "part").count()
    first = count.withColumn("before", F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("source", "part", F.coalesce("before", F.lit(0)).alias("before"))
    sizes = {r[0]: r[1] for r in count.groupBy("source").agg(F.sum("count")).collect()}
    sources = targets(sizes, weights, alpha)
    out = "shard bigint, slot int, source string, index bigint, lang string, n_tokens int, ids binary"
    if not sources:
        return spark.createDataFrame([], out)
    first = F.broadcast(first) if count.count() <= SENT else first.hint("merge")
    numbered = made.join(first, ["source", "part"]).select("source", (F.col("before") + F.col("seq")).alias("index"), "lang", F.col("n").alias("n_tokens"), "ids")
    wanted = plan(spark, sources, sum(sizes.values()) if slots is None else slots, shard, seed)
    # both sides have a row a slot or block: neither may be sent whole, whatever their sizes are guessed to be
    return wanted.hint("merge").join(numbered.hint("merge"), ["source", "index"]).select(*[f.split()[0] for f in out.split(", ")])


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, tokenizer: str = TOKENIZER, **kw) -> DataFrame:
    """The same as documents, one a slot: doc_id is its number over all shards, and the text is its block's.

    End ids between documents become line ends. Nulls, empty and repeated rows, clashing columns and empty tables as in mix; the columns are
    those of documents.
    """

    def rows(batches):
        enc = encoder(tokenizer)
        for b in small_batches(batches, "ids", 4 << 20):
            text = []
            for raw, n in zip(column(b, "ids"), column(b, "n_tokens")):
                ids = np.frombuffer(raw, "<u2")[:n]
                text.append("\n".join(enc.decode(x[x != enc.end].tolist()).decode("utf-8", "replace") for x in np.split(ids, np.flatnonzero(ids == enc.end)) if (x != enc.end).any()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), b.column(1), b.column(2), pa.array([len(t) for t in text], pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])

    got = mix(docs, block=block, shard=shard, tokenizer=tokenizer, **kw)
    got = got.select((F.col("shard") * shard + F.col("slot")).alias("doc_id"), "lang", "source", "n_tokens", "ids")
    return got.mapInArrow(rows, T.StructType.fromDDL("doc_id bigint, text string, lang string, source string, n_chars bigint"))
