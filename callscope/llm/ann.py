"""Approximate nearest neighbours: a tree of k-means, searched best bin first, leaf visits widened to a calibrated recall."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pick

NEIGHBOURS, TARGET, EVERY = 10, 0.95, 20  # rows whose id is divisible by EVERY are queries
LEAF, MAX_LEAVES, BRANCH = 512, 262_144, 8
SAMPLE, CELL_ROWS = 32_768, 65_536  # rows that the upper tree, and each cell's, are fitted on at most; rows a cell should have
LEAST_FIT = 16  # rows of a sample for each leaf that is fitted on it
CHUNK = 65_536  # rows of a leaf that are looked at in one place
PROBES = 256  # queries that the number of visits is calibrated on, against brute force over all rows
SEED = 3


def kmeans(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of at most k groups; fewer if there are fewer distinct rows."""
    c = np.unique(x[r.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, own, x)
        c = (total[n > 0] / n[n > 0, None]).astype("f4")
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(np.einsum("ij,ij->i", c, c) - 2 * x[a : a + 8192] @ c.T).argmin(1) for a in range(0, len(x), 8192)]) if len(x) else np.empty(0, np.int64)


def split(x: np.ndarray, leaf: int, r: np.random.Generator) -> list:
    """A node of rows: (centre, children or None, places of rows)."""

    def grow(at):
        centre = x[at].mean(0)
        if len(at) <= leaf:
            return centre, None, at
        c = kmeans(x[at], min(BRANCH, math.ceil(len(at) / leaf) + 1), r)
        own = nearest(x[at], c)
        groups = [at[own == j] for j in range(len(c)) if (own == j).any()]
        if len(groups) < 2:  # equal rows
            return centre, None, at
        return centre, [grow(g) for g in groups], at

    return grow(np.arange(len(x)))


class Tree:
    """Nodes by number, the root first: centres, and each node's children, padded with -1. Nodes without any are leaves."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres = np.ascontiguousarray(centres, "f4")
        self.children = np.full((len(children), max([1, *map(len, children)])), -1, np.int64)
        for i, c in enumerate(children):
            self.children[i, : len(c)] = c
        self.leaves = np.flatnonzero(self.children[:, 0] < 0)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from node to the nearest child, all rows a level at a time."""
        at = np.zeros(len(x), np.int64)
        for a in range(0, len(x), 4096):
            own, live = at[a : a + 4096], np.arange(min(4096, len(x) - a))
            while len(live := live[self.children[own[live], 0] >= 0]):
                c = self.children[own[live]]
                d = ((self.centres[c] - x[a + live, None]) ** 2).sum(2)
                d[c < 0] = np.inf
                own[live] = np.take_along_axis(c, d.argmin(1)[:, None], 1)[:, 0]
        return at

    def search(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves of one query, best bin first: of the open nodes in the queue the nearest is next, and only its children
        are measured."""
        heap, got = [(0.0, 0)], []
        while heap and len(got) < visits:
            _, k = heapq.heappop(heap)
            c = self.children[k]
            c = c[c >= 0]
            if not len(c):
                got.append(k)
                continue
            d = self.centres[c] - q
            for far, node in zip(np.einsum("ij,ij->i", d, d).tolist(), c.tolist()):
                heapq.heappush(heap, (far, node))
        return got


def grown(x: np.ndarray, leaves: int, r: np.random.Generator) -> tuple[list, list[list[int]]]:
    """Centres and children of a tree over rows with about so many leaves."""
    centres: list = []
    children: list[list[int]] = []

    def walk(node) -> int:
        k = len(centres)
        centres.append(node[0])
        children.append([])
        children[k] = [walk(c) for c in node[1] or []]
        return k

    walk(split(x, max(1, math.ceil(len(x) / max(1, leaves))), r))
    return centres, children


def alike(x: np.ndarray, ids: np.ndarray, most: int | None) -> Iterable[tuple[int, np.ndarray]]:
    """Of each distinct row its first place and, sorted, its (most lowest) ids."""
    if not len(x):
        return
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
    _, first, of = np.unique(raw.view(f"V{raw.shape[1]}").ravel(), return_index=True, return_inverse=True)
    o = np.lexsort((ids, of))
    cuts = np.flatnonzero(np.append(True, of[o][1:] != of[o][:-1]))
    for p, a, z in zip(first, cuts, np.append(cuts[1:], len(o))):
        yield p, np.unique(ids[o[a:z]])[:most]


def top(q: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k rows nearest to each query; -1 where there are fewer. Ties: lower id."""
    o = np.argsort(vid, kind="stable")
    v, vid = v[o], vid[o]
    ids, far = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf, "f4")
    vv = np.einsum("ij,ij->i", v, v)
    step = max(1, (2 << 20) // max(1, len(v)))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        d = np.maximum(np.einsum("ij,ij->i", part, part)[:, None] + vv - 2 * part @ v.T, 0)
        if d.shape[1] > k:
            worst = np.partition(d, k - 1, 1)[:, k - 1 : k]
            d = np.where(d <= worst, d, np.inf)
        best = np.argsort(d, 1, kind="stable")[:, :k]
        dd = np.take_along_axis(d, best, 1)
        ids[a : a + step, : best.shape[1]] = np.where(np.isfinite(dd), vid[best], -1)
        far[a : a + step, : best.shape[1]] = dd
    return ids, far


def merge(ids: list[np.ndarray], far: list[np.ndarray], k: int) -> list[tuple[int, float]]:
    i, d = np.concatenate(ids), np.concatenate(far)
    i, d = i[i >= 0], d[i >= 0]
    o = np.lexsort((i, d))
    seen, out = set(), []
    for j in o:
        if i[j] not in seen:
            seen.add(int(i[j]))
            out.append((int(i[j]), float(d[j])))
            if len(out) == k:
                break
    return out


def _matrix(batch, name: str = "embedding") -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(name))
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return np.array(c.flatten().to_numpy(zero_copy_only=False), "f4").reshape(len(c), -1) if len(c) else np.empty((0, 0), "f4")


def _rows(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows that count, and how many there are."""
    v = pick(vectors, vec_id="bigint", embedding="array<float>").where("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    width = v.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return v.where(F.size("embedding") == (width["w"] if width else 0)), width["count"] if width else 0


def build(rows: DataFrame, n: int, leaf: int = LEAF, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> Tree:
    """The tree that all rows are put in; its centres, at most about MAX_LEAVES leaves' of them, are sent to every task.

    Upper levels are fitted on a sample of at most `sample` rows. With more than cell_rows rows, each cell of them gets a tree
    of its own, fitted in a task on about as many rows at most, drawn by hash from those that fall in it. Leaves have about `leaf`
    rows, more beyond leaf x MAX_LEAVES rows.
    """
    spark, leaf = rows.sparkSession, max(leaf, math.ceil(n / MAX_LEAVES))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = _matrix(got)[np.argsort(got["vec_id"].to_numpy(), kind="stable")]
    most = max(1, len(x) // LEAST_FIT) if n > len(x) else math.ceil(len(x) / leaf)
    cells = math.ceil(n / (cell_rows if n > cell_rows else leaf))
    centres, children = grown(x, min(cells, most), np.random.default_rng(SEED))
    if n <= cell_rows:
        return Tree(np.array(centres), children)
    shared = spark.sparkContext.broadcast(Tree(np.array(centres), children))

    def celled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(_matrix(b)), pa.int64()), b.column(0), b.column(1), b.column(2)], ["cell", "vec_id", "embedding", "u"])

    def counted(batches):
        for b in batches:
            c, k = np.unique(shared.value.assign(_matrix(b)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(k)], ["cell", "n"])

    sizes = {r[0]: r[1] for r in rows.select("vec_id", "embedding").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect()}
    share = spark.createDataFrame([(c, k, min(1.0, sample / k)) for c, k in sizes.items()], "cell bigint, n bigint, share double")
    few = rows.withColumn("u", drawn).mapInArrow(celled, "cell bigint, vec_id bigint, embedding array<float>, u double").join(F.broadcast(share), "cell").where("u < share")

    def grow(t):
        t = t.combine_chunks().sort_by("vec_id")
        cell, size = t["cell"][0].as_py(), t["n"][0].as_py()
        c, below = grown(_matrix(t), max(1, min(math.ceil(size / leaf), t.num_rows // LEAST_FIT)), np.random.default_rng([SEED, cell]))
        return pa.table({"cell": pa.array([cell] * len(c), pa.int64()), "node": pa.array(range(len(c)), pa.int64()), "centre": pa.array([v.tolist() for v in c], pa.list_(pa.float32())), "below": pa.array(below, pa.list_(pa.int64()))})

    made = few.select("cell", "n", "vec_id", "embedding").groupBy("cell").applyInArrow(grow, "cell bigint, node bigint, centre array<float>, below array<bigint>").orderBy("cell", "node").collect()
    base = 0
    for r in made:  # a cell's root is the cell itself
        if r["node"] == 0:
            base = len(centres) - 1
        at = [base + c for c in r["below"]]
        if r["node"] == 0:
            children[r["cell"]] = at
        else:
            centres.append(r["centre"])
            children.append(at)
    return Tree(np.array(centres, "f4"), children)


def calibrate(rows: DataFrame, tree, k: int, target: float, every: int, probes: int = PROBES) -> tuple[int, float, dict[int, int]]:
    """(visits, recall, rows by leaf): the least number of leaf visits at which the probes' recall reaches target.

    The probes are queries of the least hashed ids; their true neighbours come from all rows by brute force. Visits are widened until the
    recall is there.
    """
    sample = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(probes).collect()
    q, qid = np.array([r["embedding"] for r in sample], "f4"), np.array([r["vec_id"] for r in sample], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((q, qid))

    def scan(batches):
        q, qid = shared.value
        best: dict[int, tuple] = {}
        total: dict[int, int] = {}
        for b in batches:
            x, vid = _matrix(b), b.column(0).to_numpy()
            leaf = tree.value.assign(x)
            for c, n in zip(*np.unique(leaf, return_counts=True)):
                total[int(c)] = total.get(int(c), 0) + int(n)
            if not len(q):
                continue
            kept = [(x[p], d, leaf[p]) for p, ds in alike(x, vid, k + 1) for d in ds.tolist()]
            y, yid, of = np.array([r[0] for r in kept]), np.array([r[1] for r in kept]), {}
            for _, d, c in kept:
                of.setdefault(d, int(c))
            ids, far = top(q, y, yid, k + int(np.unique(yid, return_counts=True)[1].max()))
            for i in range(len(q)):
                own = merge([ids[i]], [far[i]], k + 1)
                own = [(d, e, of[e]) for e, d in own if e != qid[i]]
                best[i] = sorted({*best.get(i, ()), *own})[:k]
        rows = [(i, e, d, c) for i, own in best.items() for d, e, c in own] + [(-1, c, float(n), c) for c, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["q", "vec_id", "far", "leaf"])

    got = rows.mapInArrow(scan, "q bigint, vec_id bigint, far double, leaf bigint")
    first = F.array_sort(F.collect_list(F.struct("far", "vec_id", "leaf")))
    out = got.where("q >= 0").groupBy("q").agg(F.slice(first, 1, k).alias("best"))
    sizes = got.where("q < 0").groupBy("leaf").agg(F.sum("far").alias("n"))
    both = out.select("q", F.explode("best").alias("x")).select("q", "x.leaf", "x.far").unionByName(sizes.select(F.lit(-1).cast("bigint").alias("q"), "leaf", F.col("n").alias("far"))).collect()
    best, total = [(r["q"], r["leaf"]) for r in both if r["q"] >= 0], {r["leaf"]: int(r["far"]) for r in both if r["q"] < 0}
    wide, least = min(16, len(tree.value.leaves)), math.ceil(target * len(best))
    while True:
        order = [{c: i for i, c in enumerate(tree.value.search(x, wide))} for x in q]
        need = np.sort([order[i].get(c, wide) + 1 for i, c in best])
        if not len(need) or need[least - 1] <= wide:
            break
        wide = min(2 * wide, len(tree.value.leaves))
    visits = int(need[least - 1]) if len(need) else 1
    return visits, float((need <= visits).mean()) if len(need) else 1.0, total


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, target: float = TARGET, every: int = EVERY, leaf: int = LEAF, visits: int | None = None) -> DataFrame:
    """The k nearest of all rows (Euclidean; for unit vectors the same as by cosine) to each row whose id `every` divides.

    Columns: vec_id, rank (1 is nearest), neighbour, distance, visits, recall: the leaves that each query looked at, and the share of true
    neighbours that the calibration found with as many. Ties go to the lower id. Rows with a null id, a null, empty,
    NaN or infinite vector, or another length than most are neither queries nor neighbours; rows of one id and vector count
    once, of several vectors with one id each is a query and the nearest k over them are kept; no id is its own neighbour; other
    columns are ignored; fewer other ids than k give fewer neighbours; an empty table gives no rows. Rows with the same
    vector are one while they travel: as neighbours the k + 1 lowest ids stand for them, as queries they are asked once a batch. Leaves
    beyond CHUNK rows are looked at in parts.
    """
    rows, n = _rows(vectors)
    out = "vec_id bigint, rank int, neighbour bigint, distance double, visits int, recall double"
    spark = vectors.sparkSession
    if n < 2:
        return spark.createDataFrame([], out)
    tree = spark.sparkContext.broadcast(build(rows, n, leaf))
    wide, recall, sizes = calibrate(rows, tree, k, target, every)
    if visits:
        wide, recall = visits, None
    parts = {c: -(-m // CHUNK) for c, m in sizes.items() if m > CHUNK}

    def route(batches):
        for b in batches:
            x = _matrix(b)
            got = [(c, s, p, ids.astype("<i8").tobytes()) for p, ids in alike(x, b.column(0).to_numpy(), None) for c in tree.value.search(x[p], wide) for s in range(parts.get(c, 1))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.binary()), pa.array([x[g[2]].tobytes() for g in got], pa.binary())], ["leaf", "part", "ids", "vector"])

    def shelve(batches):
        for b in batches:
            x = _matrix(b)
            of = tree.value.assign(x)
            got = [(int(of[p]), d % parts.get(int(of[p]), 1), d, x[p].tobytes()) for p, ids in alike(x, b.column(0).to_numpy(), k + 1) for d in ids.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["leaf", "part", "vec_id", "vector"])

    def visit(a, b):
        width = len(b["vector"][0].as_py()) // 4 if b.num_rows else 1
        v, vid = np.frombuffer(b"".join(b["vector"].to_pylist()), "<f4").reshape(-1, width), b["vec_id"].to_numpy()
        rows = []
        if len(vid) and a.num_rows:
            keep = [(p, d) for p, ids in alike(v, vid, k + 1) for d in ids.tolist()]
            v, vid = v[[p for p, _ in keep]], np.array([d for _, d in keep])
            q = np.frombuffer(b"".join(a["vector"].to_pylist()), "<f4").reshape(-1, width)
            ids, far = top(q, v, vid, k + int(np.unique(vid, return_counts=True)[1].max()))
            for i, own in enumerate(a["ids"].to_pylist()):
                for d in np.frombuffer(own, "<i8"):
                    at = np.flatnonzero((ids[i] != d) & (ids[i] >= 0))[: k + 1]
                    rows.append((int(d), ids[i][at].tobytes(), far[i][at].tobytes()))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["vec_id", "ids", "far"])

    def best(batches):
        for b in batches:
            got = [merge([np.frombuffer(x, np.int64) for x in i], [np.frombuffer(x, "f4") for x in f], k) for i, f in zip(column(b, "ids"), column(b, "far"))]
            flat = [(d, j + 1, e, math.sqrt(y), wide, recall) for d, g in zip(column(b, "vec_id"), got) for j, (e, y) in enumerate(g)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.float64()))], ["vec_id", "rank", "neighbour", "distance", "visits", "recall"])

    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(route, "leaf bigint, part bigint, ids binary, vector binary")
    shelved = rows.mapInArrow(shelve, "leaf bigint, part bigint, vec_id bigint, vector binary")
    found = asked.groupBy("leaf", "part").cogroup(shelved.groupBy("leaf", "part")).applyInArrow(visit, "vec_id bigint, ids binary, far binary")
    return found.groupBy("vec_id").agg(F.collect_list("ids").alias("ids"), F.collect_list("far").alias("far")).mapInArrow(best, out)
