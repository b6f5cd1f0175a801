"""Jaccard self-join of documents' word n-gram sets by extended prefixes.

Grams are put in one order, rare ones first: by their count over all documents, as a table of hash slots knows it. A document of s grams that is to share at least ceil(J s) of them can miss
at most s - ceil(J s); its prefix goes on until more would have to be missed. Rare grams are signatures by themselves.
Frequent grams fall in hashed groups; of a group of class k every k grams of the prefix together are one signature, so a
group's first k - 1 grams can't count and the prefix is longer by as many. Two documents over the threshold share a
signature in any case, whichever grams are called frequent; the classes only keep the lists of a signature short.

Documents with the same set of grams are one set, named by a hash of 96 bits: sets are what meets in lists, is compared and
linked, however many copies stand for one. Lists and groups beyond BLOCK sets are compared block against block, in tasks of
their own.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, flat, kgrams, mix, pick, place, small_batches, word_hashes, written

N, THRESHOLD = 2, 0.7
FREQUENT, VERY_FREQUENT = 64, 2048  # documents from which grams count in twos, and in threes
FREQUENT_LIMIT = 4_000_000  # frequent grams that are broadcast; more of them, and the bound for being frequent is doubled
SLOT_BITS = 25  # counts of grams by so many upper bits of their hash; of several grams in a slot the highest counts
SENT = 500_000  # keys of rows that are broadcast
ROUND = 2_000_000  # grams gathered by a task before it hands them on
BLOCK = 4096  # sets that are compared in one place
NAME = "S12"  # a set's name: 12 bytes
PLAIN = 8  # steps of a size's logarithm


def gram_sets(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted; flat and offsets. A text of 1 to n - 1 words is one gram."""
    h, off = word_hashes(texts)
    g, at = kgrams(h, off, n)
    doc = np.searchsorted(off, at, "right") - 1
    size = np.diff(off)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(h[off[i] : off[i + 1]].tobytes(), seed=n) for i in short], np.uint64)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, short])
    o = np.lexsort((g, doc))
    g, doc = g[o], doc[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(texts) + 1))


def _buckets(df: DataFrame) -> int:
    """How many packed pieces each task's output is cut into: a power of two, following the shuffle's partitions."""
    return 1 << max(6, math.ceil(math.log2(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted 64-bit keys: the buckets by upper bits, and where each starts."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return edges, np.append(edges[1:], len(keys))


def frequent_grams(docs: DataFrame, n: int, least: int = FREQUENT, limit: int = FREQUENT_LIMIT, slot_bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, count) of grams, by their upper bits, that are in at least so many documents; exact counts over all documents.

    The bound is doubled until no more than limit are left. The third array has the highest count (255 at most) of the
    grams of each hash slot: 1 means that no two documents share one. What is broadcast has a fixed size at any scale.
    """
    buckets = _buckets(docs)
    bits = buckets.bit_length() - 1
    shift = np.uint64(32 - bits)  # keys are bits + 32 of the 64
    own = max(0, min(slot_bits - bits, 32))  # upper bits of a key that number the slots of its bucket

    def count(batches):
        held, size = [], 0

        def out():
            keys, num = np.unique(np.concatenate(held), return_counts=True)
            keys = np.ascontiguousarray(keys)
            rows = {"b": [], "one": [], "many": [], "n": []}
            for b, (a, z) in enumerate(zip(*_cut(keys, bits))):
                if z > a:
                    low, c = (keys[a:z] >> shift).astype("<u4"), num[a:z]
                    rows["b"].append(b)
                    rows["one"].append(low[c == 1].tobytes())
                    rows["many"].append(low[c > 1].tobytes())
                    rows["n"].append(c[c > 1].astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["b"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("one", "many", "n"))], ["b", "one", "many", "n"])

        for b in small_batches(batches):
            g, _ = gram_sets(column(b, "text"), n)
            if len(g):
                held.append(g)
                size += len(g)
            if size >= ROUND:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def merge(t):
        one = [np.frombuffer(x, "<u4") for x in t.column("one").to_pylist()]
        many = [np.frombuffer(x, "<u4") for x in t.column("many").to_pylist()]
        num = [np.frombuffer(x, "<u4") for x in t.column("n").to_pylist()]
        keys = np.concatenate([*one, *many])
        c = np.concatenate([np.ones(sum(map(len, one)), np.int64), *num])
        o = np.argsort(keys, kind="stable")
        keys, c = keys[o], c[o]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(c, start)
        big = total >= least
        key = (np.uint64(t.column("b")[0].as_py()) << np.uint64(32)) | keys[start][big].astype(np.uint64)
        place = (keys[start] >> np.uint32(32 - own)).astype(np.int64) if own else np.zeros(len(start), np.int64)
        run = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        slots = np.zeros(1 << own, np.uint8)
        slots[place[run]] = np.maximum.reduceat(np.minimum(total, 255), run)
        rows = pa.table({"key": pa.array(key.view(np.int64)), "n": pa.array(total[big].astype(np.int64)), "slots": pa.nulls(len(key), pa.binary())})
        return pa.concat_tables([rows, pa.table({"key": t.column("b").slice(0, 1).cast(pa.int64()), "n": pa.nulls(1, pa.int64()), "slots": pa.array([slots.tobytes()], pa.binary())})])

    made = written(docs.select("text").mapInArrow(count, "b int, one binary, many binary, n binary").groupBy("b").applyInArrow(merge, "key bigint, n bigint, slots binary"), "frequent")
    slots = np.zeros((buckets, 1 << own), np.uint8)
    for r in made.where("slots is not null").select("key", "slots").toLocalIterator():
        slots[r["key"]] = np.frombuffer(r["slots"], np.uint8)
    got = made.where("slots is null").select("key", "n")
    sizes = dict(got.groupBy(F.floor(F.log2("n")).cast("int").alias("l")).count().collect())
    level = math.log2(least)
    while sum(c for l, c in sizes.items() if l >= level) > limit:
        level += 1
    t = got.where(F.col("n") >= F.lit(float(2**level))).toArrow()
    key, num = t["key"].to_numpy().astype(np.uint64), t["n"].to_numpy()
    o = np.argsort(key)
    discard(made)
    return key[o], num[o], slots.ravel()


def signatures(g: np.ndarray, level: np.ndarray, threshold: float, count: np.ndarray | None = None) -> np.ndarray:
    """Signatures of one document: its sorted distinct grams, and the class (1, 2 or 3) and count of each.

    Grams with a count of 1 take their place in the prefix, but nothing can meet there: they aren't given out.
    """
    s = len(g)
    need = s - math.ceil(threshold * s - 1e-9) + 1
    rare = g[level == 1]
    if count is not None:
        own = count[level == 1]
        o = np.argsort(own, kind="stable")
        if len(rare) >= need:
            o = o[:need]
        rare, shared = rare[o], rare[o][own[o] > 1]
    else:
        rare = shared = rare[:need] if len(rare) >= need else rare
    if len(rare) >= need:
        return shared
    out = [shared]
    f, k = g[level > 1], level[level > 1].astype(np.int64)
    o = np.lexsort((f, k))
    f, k = f[o], k[o]
    c = s.bit_length() - 1
    while True:
        base = 1 << c
        room = threshold * threshold * base - 1  # least number of grams that any document of this base shares, less one
        g2, g3 = int(room // 2), int(room // 8)
        kk = np.where((k == 3) & (g3 > 0), 3, np.where(g2 > 0, 2, 1))
        group = mix(f ^ np.uint64(0x5851F42D4C957F2D)) % np.where(kk == 3, max(g3, 1), max(g2, 1)).astype(np.uint64) + (kk == 3) * np.uint64(1 << 40)
        group = np.where(kk == 1, f, group)
        by = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))
        rank = np.empty(len(f), np.int64)
        rank[by] = np.arange(len(f)) - np.repeat(first, np.diff(np.append(first, len(f))))
        sure = np.cumsum(rank >= kk - 1)
        end = int(np.searchsorted(sure, need - len(rare))) + 1
        pf, pg, pk = f[:end], group[:end], kk[:end]
        singles = pf[pk == 1]
        out.append(singles)
        found: dict[int, list] = {}
        for x, y, z in zip(pf.tolist(), pg.tolist(), pk.tolist()):
            if z > 1:
                found.setdefault(y, [z]).append(x)
        sig = [xxhash.xxh3_64_intdigest(np.array(q, np.uint64).tobytes(), seed=c) for z, *xs in found.values() for q in combinations(sorted(xs), z)]
        out.append(np.array(sig, np.uint64))
        c += 1
        if (1 << c) > s / threshold:
            break
    return np.unique(np.concatenate(out))


def scale(size: np.ndarray) -> np.ndarray:
    """Sizes in steps of an eighth of a doubling."""
    return np.floor(np.log2(np.maximum(size, 1)) * PLAIN).astype(np.uint8)


def _signed(docs: DataFrame, n: int, threshold: float, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], very: int) -> DataFrame:
    """From one look at each text, written: signatures packed by bucket (b, sig, near, who), and its own row.

    The own row has the set's name, its size (0 and no name without words), its sketch, and docs' other columns.
    """
    spark, bits = docs.sparkSession, _buckets(docs).bit_length() - 1
    shared = spark.sparkContext.broadcast((frequent[0], np.where(frequent[1] >= very, 3, 2).astype(np.uint8), frequent[2]))
    shift, keys = np.uint64(32 - bits), [c for c in docs.columns if c != "text"]
    names = ["b", "sig", "near", "who", "set", "size", "bits", *keys]

    def sign(batches):
        known, cls, slots = shared.value
        spot = np.uint64(65 - len(slots).bit_length())
        held, sizes, ids, size = [], [], [], 0

        def out():
            sig = np.concatenate(held)
            name, first, rank = np.unique(np.array(ids, NAME), return_index=True, return_inverse=True)
            who, near = np.repeat(rank.astype(np.uint32), list(map(len, held))), np.array(sizes, np.uint8)[first]
            held.clear()  # a signature takes 12 bytes until its set's name is put beside it, bucket by bucket
            o = np.lexsort((who, sig))
            sig, who = sig[o], who[o]
            del o
            new = np.append(True, (sig[1:] != sig[:-1]) | (who[1:] != who[:-1]))[: len(sig)]  # most copies in a task come as one
            sig, who = sig[new], who[new]
            at = [(b, a, z) for b, (a, z) in enumerate(zip(*_cut(sig, bits))) if z > a]
            cols = (lambda a, z: (sig[a:z] >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7], lambda a, z: near[who[a:z]], lambda a, z: name[who[a:z]])
            rows = len(at)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in at], pa.int32()), *(pa.array([x(a, z).tobytes() for _, a, z in at], pa.binary()) for x in cols), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), *(pa.nulls(rows, pa.int64()) for _ in keys)], names)

        for b in small_batches(batches):
            g, off = gram_sets(column(b, "text"), n)
            level = np.ones(len(g), np.uint8)
            if len(known) and len(g):
                k = g >> shift
                p = np.minimum(np.searchsorted(known, k), len(known) - 1)
                level = np.where(known[p] == k, cls[p], 1).astype(np.uint8)
            num, q = slots[(g >> spot).astype(np.int64)], scale(np.diff(off))
            own, bitmaps = [], []
            for i, (x, y) in enumerate(zip(off, off[1:])):
                if y == x:
                    own.append(None)
                    bitmaps.append(None)
                    continue
                own.append(xxhash.xxh3_128_digest(g[x:y].tobytes())[:12])
                bitmaps.append(sketch(g[x:y]))
                s = signatures(g[x:y], level[x:y], threshold, num[x:y])
                held.append(s)
                sizes.append(q[i])
                ids.append(own[-1])
                size += len(s)
            nothing = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(own, pa.binary()), pa.array(np.diff(off), pa.int64()), pa.array(bitmaps, pa.binary()), *(b.column(b.schema.get_field_index(c)) for c in keys)], names)
            if size >= ROUND:
                yield out()
                held, sizes, ids, size = [], [], [], 0
        if held:
            yield out()

    kinds = "b int, sig binary, near binary, who binary, set binary, size bigint, bits binary" + "".join(f", {c} bigint" for c in keys)
    return written(docs.mapInArrow(sign, kinds), "signed")


def blocks(names: np.ndarray) -> np.ndarray:
    """Numbers by which names are spread: their first eight bytes."""
    return np.ascontiguousarray(names).view(np.uint8).reshape(-1, 12)[:, :8].copy().view("<u8").ravel()


def _names(raw: list) -> np.ndarray:
    return np.frombuffer(b"".join(raw), NAME)


def _lists(signed: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Sets that share a signature and are of like size, as (part, one, other): all of one are to be compared with all of
    other, or with each other where other is empty. Lists of a leader, the first name in it, have the same part."""
    reach = math.ceil(-math.log2(threshold) * PLAIN) + 1

    def merge(t):
        raw = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, 7)
        sig = np.zeros((len(raw), 8), np.uint8)
        sig[:, :7] = raw
        sig = sig.view("<u8").ravel()
        q, who = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint8), _names(t.column("who").to_pylist())
        o = np.argsort(sig, kind="stable")  # only what occurs twice needs an order by size and name
        s = sig[o]
        same = s[1:] == s[:-1]
        keep = np.append(False, same) | np.append(same, False)
        s, q, (all_, w) = s[keep], q[o[keep]].astype(np.int64), np.unique(who[o[keep]], return_inverse=True)
        o = np.lexsort((w, q, s))
        s, q, w = s[o], q[o], w[o]
        new = np.append(True, (s[1:] != s[:-1]) | (w[1:] != w[:-1]))[: len(s)]
        s, q, w = s[new], q[new], w[new]
        run = np.cumsum(np.append(True, (s[1:] != s[:-1]) | (q[1:] - q[:-1] > reach))[: len(s)])
        o = np.lexsort((w, run))
        w, run = w[o], run[o]
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.empty(0, np.int64)
        seen = set()
        for a, z in zip(start, np.append(start[1:], len(w))):
            if z - a > BLOCK:
                cuts = [all_[w[x : min(z, x + BLOCK)]] for x in range(a, z, BLOCK)]
                for i, x in enumerate(cuts):
                    for j in range(i, len(cuts)):
                        seen.add((xxhash.xxh3_64_intdigest(cuts[0][:1].tobytes() + bytes(f"{i} {j}", "ascii")) % parts, x.tobytes(), cuts[j].tobytes() if j > i else b""))
            elif z - a > 1:
                m = all_[w[a:z]].tobytes()
                seen.add((xxhash.xxh3_64_intdigest(m[:12]) % parts, m, b""))
        return pa.table([pa.array([x[k] for x in seen], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["part", "one", "other"])

    rows = signed.where("b is not null").select("b", "sig", "near", "who")
    return written(rows.groupBy("b").applyInArrow(merge, "part bigint, one binary, other binary").distinct(), "signature-lists")


def sketch(g: np.ndarray) -> bytes:
    """Parities of the counts of a set's grams by their low bits: at least two bits a gram, a power of two of them."""
    b = max(128, 1 << (2 * len(g) - 1).bit_length())
    odd = np.bincount((g & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Bounds from below for how many grams are in one of two sets only: parities that differ, at the smaller width."""

    def __init__(self, bits: list[bytes]):
        self.cls = np.array([len(x).bit_length() for x in bits], np.int64)
        self.own, self.half, self.rows = np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64), {}
        for c in sorted(set(self.cls.tolist()), reverse=True):
            at = np.flatnonzero(self.cls == c)
            m = np.frombuffer(b"".join([bits[i] for i in at.tolist()]), "<u8").reshape(len(at), -1)
            w = m.shape[1] // 2
            self.own[at], self.half[at] = self._put(c, m), self._put(c - 1, m[:, :w] ^ m[:, w:])

    def _put(self, c: int, m: np.ndarray) -> np.ndarray:
        old = self.rows.get(c, np.empty((0, m.shape[1]), np.uint64))
        self.rows[c] = np.concatenate([old, m])
        return np.arange(len(old), len(old) + len(m))

    def apart(self, i: int, js: np.ndarray) -> np.ndarray:
        """For sets whose sizes differ by a factor of two at most."""
        out, c = np.zeros(len(js), np.int64), int(self.cls[i])
        for step in (-1, 0, 1):
            at = np.flatnonzero(self.cls[js] == c + step)
            if len(at):
                m = self.rows[min(c, c + step)]
                mine = m[self.half[i] if step < 0 else self.own[i]]
                out[at] = np.bitwise_count(m[(self.half if step > 0 else self.own)[js[at]]] ^ mine).sum(1)
        return out


def nearby(lists: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray, sketches: Sketches, threshold: float):
    """(place, higher places) of sets that share a list and can still be over the threshold.

    lists have places that are compared with places: others, or the same ones.
    """
    member: list[list[int]] = [[] for _ in size]
    for k, (x, _) in enumerate(lists):
        for p in x.tolist():
            member[p].append(k)
    for i, own in enumerate(member):
        if not own:
            continue
        js = np.unique(np.concatenate([lists[k][1] for k in own])) if len(own) > 1 else lists[own[0]][1]
        js = js[js > i]
        js = js[np.minimum(size[js], size[i]) >= threshold * np.maximum(size[js], size[i]) - 1e-9]
        if len(js):
            js = js[sketches.apart(i, js) <= (1 - threshold) / (1 + threshold) * (size[i] + size[js]) + 1e-6]
        if len(js):
            yield i, js


def overlaps(wanted: list[tuple[int, np.ndarray]], g: np.ndarray, off: np.ndarray, threshold: float, skip=None):
    """Of each (place, places to compare it with): it, those over the threshold, and the grams shared with them.

    skip(place, places) may say which need no look.
    """
    local = np.unique(g)
    gid = np.searchsorted(local, g)
    size = np.diff(off)
    mark = np.zeros(len(local), np.int32)
    for i, js in wanted:
        if skip is not None:
            js = skip(i, js)
        if not len(js):
            continue
        mine = gid[off[i] : off[i + 1]]
        mark[mine] = 1
        n = size[js]
        at = np.repeat(off[js] - np.cumsum(n) + n, n) + np.arange(n.sum())
        inter = np.add.reduceat(mark[gid[at]], np.cumsum(n) - n)
        mark[mine] = 0
        ok = inter >= threshold * (size[i] + n - inter) - 1e-9
        if ok.any():
            yield i, js[ok], inter[ok]


def _near(sets: DataFrame, lists: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(high, lead, others) packed: the sets of lower names that one is to be compared with; lead is the first of them."""

    def need(batches):
        for b in batches:
            got = {(p, x[k : k + 12]) for c in ("one", "other") for p, x in zip(column(b, "part"), column(b, c)) for k in range(0, len(x), 12)}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["part", "set"])

    def packed(r: np.ndarray, names: np.ndarray):
        """Rows of (high, low) places, sorted and distinct, as high and lows."""
        start = np.flatnonzero(np.append(True, r[1:, 0] != r[:-1, 0])) if len(r) else np.empty(0, np.int64)
        return [names[r[x, 0]].ljust(12, b"\0") for x in start], [names[r[x:y, 1]].tobytes() for x, y in zip(start, np.append(start[1:], len(r)))]

    def compare(a, b):
        b = b.sort_by("set")
        ids, size = _names(b.column("set").to_pylist()), b.column("size").to_numpy().astype(np.int64)
        lists = []
        for x, y in sorted(set(zip(a.column("one").to_pylist(), a.column("other").to_pylist()))):
            x, y = np.searchsorted(ids, np.frombuffer(x, NAME)), np.searchsorted(ids, np.frombuffer(y, NAME))
            lists += [(x, y), (y, x)] if len(y) else [(x, x)]
        out = [np.empty((0, 2), np.int64)]
        for i, js in nearby(lists, size, Sketches(b.column("bits").to_pylist()), threshold):
            out.append(np.stack([js, np.full(len(js), i)], 1))
        r = np.concatenate(out)
        high, low = packed(r[np.lexsort((r[:, 1], r[:, 0]))], ids)
        return pa.table({"high": pa.array(high, pa.binary()), "others": pa.array(low, pa.binary())})

    def gather(t):
        high, low = t.column("high").to_pylist(), [np.frombuffer(x, NAME) for x in t.column("others").to_pylist()]
        ids, at = np.unique(np.concatenate([np.array(high, NAME), *low]), return_inverse=True)
        r = np.unique(np.stack([np.repeat(at[: len(high)], [len(x) for x in low]), at[len(high) :]], 1), axis=0)
        high, low = packed(r, ids)
        return pa.table({"high": pa.array(high, pa.binary()), "lead": pa.array([x[:12] for x in low], pa.binary()), "others": pa.array(low, pa.binary())})

    wanted = lists.mapInArrow(need, "part bigint, set binary").distinct()
    drawn = wanted.join(sets.select("set", "size", "bits"), "set")
    pairs = lists.groupBy("part").cogroup(drawn.groupBy("part")).applyInArrow(compare, "high binary, others binary")
    return written(pairs.withColumn("p", F.pmod(F.xxhash64("high"), F.lit(parts))).groupBy("p").applyInArrow(gather, "high binary, lead binary, others binary"), "near")


def _verified(docs: DataFrame, sets: DataFrame, near: DataFrame, n: int, threshold: float, parts: int, forest: bool) -> DataFrame:
    """(set, root, links): the sets that are over the threshold with another; written.

    Of each place that sets met in there is a row for each: the first set it is connected with there, and the documents that
    its partners there stand for. With forest the links aren't counted, and sets that are connected are not compared.
    The text of one document of each set goes to the place of its least candidate, so groups of copies meet there once; a
    lead that more than BLOCK sets meet at has a place for each pair of blocks.
    """

    def spread(batches):
        for b in batches:
            rows = []
            for high, lead, raw, k in zip(*(column(b, c) for c in ("high", "lead", "others", "k"))):
                if k == 1:
                    rows.append((xxhash.xxh3_64_intdigest(lead) % parts, high, raw))
                    continue
                others = np.frombuffer(raw, NAME)
                own, of = int(blocks(np.array([high], NAME))[0] % np.uint64(k)), blocks(others) % np.uint64(k)
                for x in np.unique(of).tolist():
                    rows.append((xxhash.xxh3_64_intdigest(lead + bytes(f"{min(own, x)} {max(own, x)}", "ascii")) % parts, high, others[of == x].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["part", "high", "others"])

    def need(batches):
        for b in batches:
            got = {(p, x[k : k + 12]) for p, h, o in zip(*(column(b, c) for c in ("part", "high", "others"))) for x in (h, o) for k in range(0, len(x), 12)}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["part", "set"])

    many = near.groupBy("lead").count().where(F.col("count") > BLOCK).select("lead", F.ceil(F.col("count") / BLOCK).cast("int").alias("k"))
    near = near.join(many, "lead", "left").withColumn("k", F.coalesce("k", F.lit(1))).mapInArrow(spread, "part bigint, high binary, others binary")
    wanted = near.mapInArrow(need, "part bigint, set binary").distinct().join(sets.select("set", "h1", "h2", "n"), "set")
    # texts whose hash falls in a slot of a wanted one are all that moves; there are at most 2 ** 20 slots
    slot = F.shiftrightunsigned("h1", 44)
    texts = docs.join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    texts = wanted.join(texts, ["h1", "h2"]).select("part", "set", "n", "text")

    def check(a, b):
        b = b.sort_by("set")
        ids, n_docs = _names(b.column("set").to_pylist()), b.column("n").to_numpy()
        g, off = gram_sets(b.column("text").to_pylist(), n)
        find = lambda x: np.searchsorted(ids, np.frombuffer(x, NAME))
        wanted = [(int(find(h)[0]), find(o)) for h, o in sorted(zip(a.column("high").to_pylist(), a.column("others").to_pylist()))]
        links, top, met = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.zeros(len(ids), bool)

        def root(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        def apart(i, js):
            own = root(i)
            return js[[root(j) != own for j in js.tolist()]]

        for i, js, _ in overlaps(wanted, g, off, threshold, apart if forest else None):
            met[i] = met[js] = True
            links[i] += n_docs[js].sum()
            links[js] += n_docs[i]
            for j in js.tolist():
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
        at = np.flatnonzero(met)
        name = lambda x: pa.array([ids[i].ljust(12, b"\0") for i in x], pa.binary())
        return pa.table({"set": name(at), "root": name([root(i) for i in at]), "links": pa.array(links[at], pa.int64())})

    return written(near.groupBy("part").cogroup(texts.groupBy("part")).applyInArrow(check, "set binary, root binary, links bigint"), "near-links")


def _joined(docs: DataFrame, n: int, threshold: float, frequent: int, very: int, limit: int, forest: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs has text and whole numbers, among them doc_id. Gives (own rows, sets, links), all written.

    Own rows: docs' other columns and their set, null without words. Sets: set, n (documents) and the columns that find a
    text of it. Links as in _verified.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold is from 0.5 to 1")
    docs = docs.where("text is not null").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    parts = 4 * _buckets(docs)
    signed = _signed(docs, n, threshold, frequent_grams(docs, n, frequent, limit), very)
    lists = _lists(signed, threshold, parts)
    rows = signed.where("b is null").drop("b", "sig", "near", "who")
    sets = rows.where("set is not null").groupBy("set").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.min(F.struct("h1", "h2")).alias("h"))
    n_docs = rows.where("set is not null").select("set", "doc_id").distinct().groupBy("set").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    sets = written(sets.join(n_docs, "set").select("set", "size", "bits", "h.h1", "h.h2", "n", "least"), "sets")
    near = _near(sets, lists, threshold, parts)
    discard(lists)
    links = _verified(docs, sets, near, n, threshold, parts, forest)
    discard(near)
    return signed, sets, links


def _components(links: DataFrame) -> DataFrame:
    """(set, root): of all sets that a chain of rows (set, root) connects the first name; written."""
    edges = written(links.where("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")).distinct(), "near-edges")
    before = None
    while True:  # large star, then small star
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, edges = edges, written(small.toDF("a", "b"), "near-edges")
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == before:
            return edges.toDF("set", "root")
        before = now


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, frequent: int = FREQUENT, very: int = VERY_FREQUENT, limit: int = FREQUENT_LIMIT) -> DataFrame:
    """The self-join of documents' sets of word n-grams at a Jaccard similarity of at least threshold, one row a document.

    Columns: doc_id; class_id, the least id of the documents that a chain of links leads to from it (its own, where none
    does); set_id, the least id of those with the same grams; links, the other documents over the threshold, each counted.
    A document is an id with one set of grams: repeated rows count once, and several texts with one id are documents of
    their own, unless their grams are the same. Words are lower-cased, punctuation is ignored; a text of fewer than n words is
    one gram. Null texts and texts without words have no links and are their own class and set; rows with a null id are left
    out; texts of any length are taken whole; other columns are ignored; an empty table gives no rows.
    """
    docs = pick(docs, doc_id="bigint", text="string").where("doc_id is not null")
    signed, sets, links = _joined(docs, n, threshold, frequent, very, limit, False)
    count = links.groupBy("set").agg(F.sum("links").alias("links"))
    root = _components(links)
    near = sets.select("set", "n", F.col("least").alias("set_id")).join(count, "set", "left").join(root, "set", "left").withColumn("root", F.coalesce("root", "set"))
    first = near.groupBy("root").agg(F.min("set_id").alias("class_id"))
    near = near.join(first, "root").select("set", "class_id", "set_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    rows = signed.where("b is null").select("doc_id", "set")
    with_words = rows.where("set is not null").distinct().join(near, "set").select("doc_id", "class_id", "set_id", "links")
    none = rows.where("set is null").select("doc_id").union(docs.where("text is null").select("doc_id")).distinct()
    return with_words.union(none.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("bigint").alias("links")))


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, frequent: int = FREQUENT, very: int = VERY_FREQUENT, limit: int = FREQUENT_LIMIT) -> DataFrame:
    """The documents without those that a chain of links leads from to another row of a lower id; null ids come last.

    Documents are rows: of repeated rows (same id and text) one stays, whichever; of several texts with one id each is judged
    by itself; of texts with one id and the same grams the one of the least hash stays. Null texts and texts without words stay, as often as they
    occur. All columns are kept as they are, whatever their names; an empty table gives an empty table. Up to SENT keys of
    rows that go are sent to all executors; with more, both sides are shuffled.
    """
    at, text = place(docs, "doc_id"), place(docs, "text")
    if text is None:
        return docs
    rows = flat(docs)
    own = rows.select((F.lit(None) if at is None else F.col(f"c{at}")).cast("bigint").alias("doc_id"), F.col(f"c{text}").cast("string").alias("text"))
    signed, sets, links = _joined(own, n, threshold, frequent, very, limit, True)
    root = _components(links)
    member = signed.where("set is not null").groupBy("set", "doc_id", "h1", "h2").agg(F.count("*").alias("rows"))
    member = written(member.join(root, "set", "left").select(F.coalesce("root", "set").alias("root"), "doc_id", "h1", "h2", "rows"), "near-members")
    best = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("at"), F.count("*").alias("all"))
    far = member.join(best.where(F.col("all") > 1), "root").where(~F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2").eqNullSafe(F.col("at")))
    gone = written(far.select("doc_id", "h1", "h2"), "near-gone")
    again = written(member.join(gone.withColumn("x", F.lit(1)).withColumnsRenamed({"doc_id": "d"}).alias("g"), (F.col("g.h1") == member["h1"]) & (F.col("g.h2") == member["h2"]) & F.col("g.d").eqNullSafe(member["doc_id"]), "left_anti").where(F.col("rows") > 1).select("doc_id", "h1", "h2"), "near-repeated")
    discard(signed, sets, links, root, member)
    body = F.col(f"c{text}").cast("string")
    keyed = rows.withColumns({"_d": (F.lit(None) if at is None else F.col(f"c{at}")).cast("bigint"), "_1": F.xxhash64(body), "_2": F.xxhash64(F.lit(1), body)})

    def hit(few):
        few = few.toDF("_kd", "_k1", "_k2")
        return F.broadcast(few) if few.count() <= SENT else few

    same = (F.col("_1") == F.col("_k1")) & (F.col("_2") == F.col("_k2")) & F.col("_d").eqNullSafe(F.col("_kd"))
    kept = keyed.join(hit(gone), same, "left_anti")
    if again.limit(1).count():
        key = hit(again)
        kept = kept.join(key, same, "left_anti").union(kept.join(key, same, "left_semi").dropDuplicates(["_d", "_1", "_2"]))
    return kept.drop("_d", "_1", "_2").toDF(*docs.columns)
