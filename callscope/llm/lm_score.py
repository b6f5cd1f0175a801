"""Perplexity under a hierarchical Pitman-Yor model of token pairs, its seating sampled by Gibbs.

Each previous token is a restaurant; all of them share the root restaurant of single tokens, whose base is uniform over the
vocabulary. Every pair in the corpus is a customer; a restaurant's tables are the root's customers. Restaurants live in
the buckets that pairs are shuffled to; the root and the restaurants' table totals have the size of the vocabulary and are
all that is exchanged between sweeps.

A sweep takes all customers of a dish from its restaurant and seats them again, given all others. Of the tables t of a dish
with c customers the odds are S(c, t) (theta + d ...)(t times) G^t, S a generalised Stirling number. A gamma variable for each
restaurant, drawn from its total of tables, makes the dishes independent: S(c, t) (d g G)^t. These odds are drawn from where
S is tabled; of larger dishes a new seating is proposed by a Chinese restaurant whose concentration is fitted to them, and
taken by Metropolis-Hastings, so they are exact at any count. G is the root's prediction after the sweep before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, mix, pick, small_batches, written
from .tokens import TOKENIZER, encoder

BURN_IN, SAMPLES, SEED = 3, 4, 11
STRENGTH = 1.0
ROUND = 4_000_000  # tokens counted by a task before it hands its pairs on
SMALL, STEPS = 256, 8  # customers of a dish whose tables are drawn from their odds at once; proposals for more
MODEL_LIMIT = 20_000_000  # pairs whose probabilities are broadcast; more are joined


def pair_codes(texts: list, enc) -> tuple[np.ndarray, np.ndarray]:
    """previous << 16 | token for every token and the end of each text that has any, flat; and offsets."""
    flat, off = enc.flat(texts)
    size = np.diff(off)
    has = size > 0
    new = np.concatenate([[0], np.cumsum(size + has)])
    ids = np.full(new[-1], enc.end, np.uint32)
    ids[np.arange(len(flat)) + np.repeat(new[:-1] - off[:-1], size)] = flat
    prev = np.empty_like(ids)
    prev[1:] = ids[:-1]
    if len(ids):
        prev[new[:-1][has]] = enc.end
    return (prev << np.uint32(16)) | ids, new


def _buckets(docs: DataFrame) -> int:
    return 1 << max(5, math.ceil(math.log2(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _home(code: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair: that of its previous token."""
    return (mix((code >> np.uint32(16)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def pairs(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """All pairs of the corpus with exact counts, packed by bucket; a restaurant is whole in its bucket."""
    buckets = _buckets(docs)

    def count(batches):
        enc = encoder(tokenizer)
        held, size = [], 0

        def out():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            b = _home(code, buckets)
            o = np.argsort(b, kind="stable")
            edges = np.searchsorted(b[o], np.arange(buckets + 1))
            rows = [(k, code[o[a:z]].astype("<u4").tobytes(), n[o[a:z]].astype("<i8").tobytes()) for k, (a, z) in enumerate(zip(edges, edges[1:])) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["b", "code", "n"])

        for batch in small_batches(batches):
            code, _ = pair_codes(column(batch, "text"), enc)
            if len(code):
                held.append(code)
                size += len(code)
            if size >= ROUND:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def merge(t):
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), "<u4")
        n = np.frombuffer(b"".join(t.column("n").to_pylist()), "<i8")
        o = np.argsort(code, kind="stable")
        code, n = code[o], n[o]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        return pa.table({"b": t.column("b").slice(0, 1), "code": pa.array([code[start].tobytes()], pa.binary()), "n": pa.array([np.add.reduceat(n, start).tobytes()], pa.binary())})

    schema = "b int, code binary, n binary"
    return written(docs.select("text").mapInArrow(count, schema).groupBy("b").applyInArrow(merge, schema), "pairs")


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, x > 0: Stirling's series from 10 on."""
    x = np.array(x, float)
    back = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        back[low] += np.log(x[low])
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.91893853320467274 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x - back


@lru_cache(4)
def stirling(d: float) -> list[np.ndarray]:
    """Logs of S(c, 1), ..., S(c, c) at discount d, for c up to SMALL."""
    out, s = [np.empty(0)], np.zeros(1)
    for n in range(1, SMALL + 1):
        out.append(s)
        stay = np.append(s[:-1] + np.log(np.maximum(n - d * np.arange(1, n), 1e-300)), s[-1] + np.log(max(n - d * n, 1e-300)))
        s = np.logaddexp(np.append(stay, -np.inf), np.append(-np.inf, s))
    return out


def expected(c: np.ndarray, a: np.ndarray, d: float) -> np.ndarray:
    """About how many tables have the highest odds S(c, t) a^t, by the saddle point of their generating function."""
    low, high = np.zeros(len(c)), np.full(len(c), 80.0)
    for _ in range(40):
        y = (low + high) / 2
        over = np.log(-np.expm1(-y)) + np.log(a) + (1 - d) * y > np.log(c)
        low, high = np.where(over, low, y), np.where(over, y, high)
    lam = np.maximum(a / d * -np.expm1(-d * y), 1e-9)
    return np.clip(lam / -np.expm1(-lam), 1, c)


def seat(c: np.ndarray, o: np.ndarray, d: float, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables when c customers sit down one by one in a restaurant without discount: with n seated the next opens one with
    odds o : n. Also the log of what a discount d would change in the odds of this very seating.

    The number seated until the next new table is drawn at once: none of k opens one with probability B(o, n + k) / B(o, n),
    which is a geometric draw whose chance is drawn from Beta(o, n).
    """
    t, log = np.ones(len(c), np.int64), np.zeros(len(c))
    live, n = np.arange(len(c)), np.ones(len(c))
    while len(live):
        with np.errstate(divide="ignore"):
            k = np.floor(np.log1p(-r.random(len(live))) / np.log1p(-np.clip(r.beta(o[live], n), 1e-300, 1 - 1e-16)))
        k = np.minimum(k, c[live] - n)
        x = n - d * t[live]
        log[live] += lgamma(x + k) - lgamma(x) - lgamma(n + k) + lgamma(n)
        n = n + k
        ok = n < c[live]
        live, n = live[ok], n[ok] + 1
        t[live] += 1
    return t, log


def reseat(c: np.ndarray, t: np.ndarray, log: np.ndarray, a: np.ndarray, d: float, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """All customers of each dish leave and sit down again, for odds S(c, t) a^t. log is seat()'s of the present seating.

    Up to SMALL customers their tables are drawn from the odds; of more, seatings are proposed by seat() and taken by
    Metropolis-Hastings, STEPS times.
    """
    t, log, a = t.copy(), log.copy(), np.maximum(a, 1e-12)
    known = stirling(d)
    order = np.argsort(c, kind="stable")
    order = order[(c[order] > 1) & (c[order] <= SMALL)]
    cuts = np.flatnonzero(np.diff(c[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        n = int(c[at[0]])
        for own in np.array_split(at, max(1, len(at) * n >> 20)):
            odds = known[n] + np.arange(1, n + 1) * np.log(a[own])[:, None]
            np.exp(odds - odds.max(1, keepdims=True), out=odds)
            np.cumsum(odds, 1, out=odds)
            t[own] = np.minimum((odds < r.random(len(own))[:, None] * odds[:, -1:]).sum(1), n - 1) + 1
    at = np.flatnonzero(c > SMALL)
    if len(at):
        n, b, x, y = c[at], a[at], t[at], log[at]
        mean, low, high = expected(n, b, d), np.full(len(at), -14.0), np.full(len(at), 25.0)
        for _ in range(40):  # a concentration that opens as many tables
            o = np.exp((low + high) / 2)
            over = 1 + o * np.log((o + n) / (o + 1)) > mean
            low, high = np.where(over, low, np.log(o)), np.where(over, np.log(o), high)
        for _ in range(STEPS):
            new, own = seat(n, o, d, r)
            ok = ~(np.log(r.random(len(at))) >= own - y + (new - x) * np.log(b / o))
            x, y = np.where(ok, new, x), np.where(ok, own, y)
        t[at], log[at] = x, y
    return t, log


def first_seats(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What sweeps begin with: a table a dish, and no seating yet, so that the first proposal is taken."""
    return np.minimum(c, 1), np.full(len(c), np.nan)


@dataclass
class State:
    """After a sweep: the root's predictions and each restaurant's tables."""

    root: np.ndarray
    tables: np.ndarray


@dataclass
class Model:
    states: list[State]
    customers: np.ndarray
    discount: float
    strength: float

    def weight(self, s: State) -> np.ndarray:
        """Share that each restaurant leaves to the root."""
        return (self.strength + self.discount * s.tables) / (self.strength + self.customers)

    def seen(self, s: State, u: np.ndarray, w: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Predictions of pairs with n customers at t tables."""
        return (n - self.discount * t) / (self.strength + self.customers[u]) + self.weight(s)[u] * s.root[w]

    def unseen(self, code: np.ndarray) -> np.ndarray:
        u, w = code >> np.uint32(16), code & np.uint32(0xFFFF)
        return sum(np.where(self.customers[u] > 0, self.weight(s)[u], 1.0) * s.root[w] for s in self.states) / len(self.states)


def _arrays(row_code: bytes, row_n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code, n = np.frombuffer(row_code, "<u4"), np.frombuffer(row_n, "<i8")
    return code, n, (code >> np.uint32(16)).astype(np.int64), (code & np.uint32(0xFFFF)).astype(np.int64)


class Root:
    """The root restaurant's seating, kept by the driver: it has the size of the vocabulary."""

    def __init__(self, size: int, discount: float, strength: float):
        self.size, self.d, self.strength = size, discount, strength
        self.customers, self.tables, self.log = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)

    def sweep(self, customers: np.ndarray, r: np.random.Generator) -> np.ndarray:
        """Predictions after all of its customers, the tables below, were seated again."""
        other = customers != self.customers  # dishes of which customers came or went begin anew
        t, log = first_seats(customers)
        t, log = np.where(other, t, self.tables), np.where(other, log, self.log)
        g = r.gamma(self.strength / self.d + t.sum())
        self.customers, (self.tables, self.log) = customers, reseat(customers, t, log, np.full(self.size, self.d * g / self.size), self.d, r)
        return (customers - self.d * self.tables + (self.strength + self.d * self.tables.sum()) / self.size) / (self.strength + customers.sum())


STATE = "b int, code binary, n binary, t binary, log binary, p binary"


def fit(types: DataFrame, size: int, burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, seed: int = SEED) -> tuple[Model, DataFrame]:
    """Gibbs sweeps over all pairs; the predictions of the last `samples` are averaged. The discount is estimated from
    pairs seen once and twice. Gives the model and, written, each bucket's pairs with their last tables and summed predictions."""
    spark = types.sparkSession

    def totals(batches):
        c, first, one, root = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(3, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for x, y in zip(column(b, "code"), column(b, "n")):
                code, n, u, w = _arrays(x, y)
                c += np.bincount(u, n, size).astype(np.int64)
                first += np.bincount(u, minlength=size)
                root += np.bincount(w, minlength=size)
                one += [(n == 1).sum(), (n == 2).sum(), 0]
        yield _sparse(("c", c), ("t", first), ("k", one), ("w", root))

    got = _gather(types.mapInArrow(totals, "kind string, id int, n bigint"))
    customers, tables = _dense(got, "c", size), _dense(got, "t", size)
    ones, twos, _ = _dense(got, "k", 3)
    d = float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))
    model, root = Model([], customers, d, strength), Root(size, d, strength)
    state = State(root.sweep(_dense(got, "w", size), np.random.default_rng([seed, 1 << 20])), tables)
    seats = None
    for sweep in range(burn_in + samples):
        g = np.random.default_rng([seed, sweep, 2 << 20]).gamma(strength / d + state.tables)
        shared = spark.sparkContext.broadcast((state, g, model, sweep > burn_in))

        def run(batches, shared=shared, sweep=sweep, first=seats is None):
            s, g, m, counts = shared.value
            for b in batches:
                for i, (k, x, y) in enumerate(zip(column(b, "b"), column(b, "code"), column(b, "n"))):
                    _, n, u, w = _arrays(x, y)
                    r = np.random.default_rng([seed, sweep, k])
                    if first:
                        (t, log), p = first_seats(n), np.zeros(len(n))
                    else:
                        t, log, p = (np.frombuffer(b.column(j)[i].as_py(), kind) for j, kind in ((3, "<i8"), (4, "<f8"), (5, "<f8")))
                    p = p + m.seen(s, u, w, n, t) if counts else p
                    t, log = reseat(n, t, log, d * g[u] * s.root[w], d, r)
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((k, x, y, t.astype("<i8").tobytes(), log.astype("<f8").tobytes(), p.astype("<f8").tobytes()), (pa.int32(), *[pa.binary()] * 5))], ["b", "code", "n", "t", "log", "p"])

        def sums(batches):
            t_u, c_w = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for b in batches:
                for x, y, z in zip(column(b, "code"), column(b, "n"), column(b, "t")):
                    _, _, u, w = _arrays(x, y)
                    t = np.frombuffer(z, "<i8")
                    t_u += np.bincount(u, t, size).astype(np.int64)
                    c_w += np.bincount(w, t, size).astype(np.int64)
            yield _sparse(("t", t_u), ("w", c_w))

        old, seats = seats, written((types if seats is None else seats).mapInArrow(run, STATE), "seats")
        if old is not None:
            discard(old)
        got = _gather(seats.mapInArrow(sums, "kind string, id int, n bigint"))
        state = State(root.sweep(_dense(got, "w", size), np.random.default_rng([seed, sweep, 1 << 20])), _dense(got, "t", size))
        if sweep >= burn_in:
            model.states.append(state)
    return model, seats


def _sparse(*kinds) -> pa.RecordBatch:
    at = [(k, np.flatnonzero(v), v) for k, v in kinds]
    return pa.RecordBatch.from_arrays([pa.array([k for k, i, _ in at for _ in i], pa.string()), pa.array(np.concatenate([i for _, i, _ in at]), pa.int32()), pa.array(np.concatenate([v[i] for _, i, v in at]), pa.int64())], ["kind", "id", "n"])


def _gather(df: DataFrame) -> pa.Table:
    return df.groupBy("kind", "id").agg(F.sum("n").alias("n")).toArrow()


def _dense(t: pa.Table, kind: str, size: int) -> np.ndarray:
    own = t.filter(pc.equal(t["kind"], kind))
    out = np.zeros(size, np.int64)
    out[own["id"].to_numpy()] = own["n"].to_numpy()
    return out


def predictions(model: Model, seats: DataFrame) -> DataFrame:
    """Each bucket's pairs with the logs of their predictive probabilities, averaged over the samples: b, code, logp (packed), n."""
    shared = seats.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = shared.value
        for b in batches:
            for k, x, y, z, q in zip(*(column(b, c) for c in ("b", "code", "n", "t", "p"))):
                code, n, u, w = _arrays(x, y)
                p = np.frombuffer(q, "<f8") + m.seen(m.states[-1], u, w, n, np.frombuffer(z, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x], pa.binary()), pa.array([np.log(p / len(m.states)).tobytes()], pa.binary()), pa.array([n.sum()], pa.int64()), pa.array([len(n)], pa.int64())], ["b", "code", "logp", "n", "pairs"])

    return seats.mapInArrow(rows, "b int, code binary, logp binary, n bigint, pairs bigint")


def lm_score(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = MODEL_LIMIT, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_tokens (with its end), log_prob (natural), perplexity, under a model of all documents.

    Null and empty texts have 0 tokens, log_prob 0 and no perplexity; they teach the model nothing. Repeated rows count as
    often as they occur and each gets its row; null ids are kept; texts are taken whole; other columns are ignored; an empty table gives no rows.
    The pairs' probabilities are broadcast if there are at most limit of them, else asked by bucket, with the same results.
    """
    docs = pick(docs, doc_id="bigint", text="string")
    types = pairs(docs, tokenizer)
    model, seats = fit(types, encoder(tokenizer).size + 1, burn_in, samples, seed=seed)
    table = written(predictions(model, seats), "pair-probabilities")
    discard(types, seats)
    size = table.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    return (_broadcast if size <= limit else _joined)(docs, table, tokenizer)


OUT = "doc_id bigint, n_tokens bigint, log_prob double, perplexity double"


def _broadcast(docs: DataFrame, table: DataFrame, tokenizer: str) -> DataFrame:
    got = table.select("code", "logp").toArrow()
    code = np.frombuffer(b"".join(got["code"].to_pylist()), "<u4")
    o = np.argsort(code)
    shared = docs.sparkSession.sparkContext.broadcast((code[o], np.frombuffer(b"".join(got["logp"].to_pylist()), "<f8")[o]))

    def rows(batches):
        enc = encoder(tokenizer)
        known, logp = shared.value
        for b in small_batches(batches):
            code, off = pair_codes(column(b, "text"), enc)
            own, back = np.unique(code, return_inverse=True)
            total = np.zeros(len(code) + 1)
            if len(own):  # every pair of the corpus has its place
                np.cumsum(logp[np.searchsorted(known, own)][back], out=total[1:])
            yield _scored(b.column(0), np.diff(off), total[off[1:]] - total[off[:-1]])

    return docs.mapInArrow(rows, OUT)


def _scored(ids: pa.Array, n: np.ndarray, lp: np.ndarray) -> pa.RecordBatch:
    with np.errstate(over="ignore"):
        ppl = np.exp(-lp / np.maximum(n, 1))
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(lp, pa.float64()), pa.array(ppl, pa.float64(), mask=n == 0)], ["doc_id", "n_tokens", "log_prob", "perplexity"])


def _joined(docs: DataFrame, table: DataFrame, tokenizer: str) -> DataFrame:
    """Packed by the pairs' buckets: a batch's texts send each bucket its distinct pairs once, and which texts have them how
    often; sums a text come back. A bucket that holds more than its share of the corpus is asked in as many parts."""
    buckets = _buckets(docs)
    share = {r["b"]: r["n"] for r in table.select("b", "n").collect()}
    total = max(1, sum(share.values()))
    parts = {b: max(1, -(-n * buckets // total)) for b, n in share.items()}
    kinds = "b int, part int, code binary, at binary, n binary, rows binary, row bigint, doc_id bigint, n_tokens bigint"

    def ask(batches):
        enc = encoder(tokenizer)
        for turn, b in enumerate(small_batches(batches)):
            code, off = pair_codes(column(b, "text"), enc)
            row = b.column(2).to_numpy()
            each = np.repeat(np.arange(b.num_rows, dtype=np.uint64), np.diff(off))
            both, n = np.unique((code.astype(np.uint64) << np.uint64(32)) | each, return_counts=True)
            code = (both >> np.uint64(32)).astype(np.uint32)
            home = _home(code, buckets)
            o = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[o], np.arange(buckets + 1))
            at = [(k, o[x:y]) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
            got = []
            for k, i in at:
                texts, place = np.unique((both[i] & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
                got.append((k, (int(row[0]) + turn) % parts.get(k, 1), code[i].astype("<u4").tobytes(), place.astype("<u4").tobytes(), n[i].astype("<u4").tobytes(), row[texts].astype("<i8").tobytes()))
            types = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([*(pa.array([g[j] for g in got], t) for j, t in enumerate(types)), *(pa.nulls(len(got), pa.int64()) for _ in range(3))], [f.split()[0] for f in kinds.split(", ")])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(b.num_rows, t) for t in types), b.column(2), b.column(0), pa.array(np.diff(off), pa.int64())], [f.split()[0] for f in kinds.split(", ")])

    def answer(a, b):
        out = []
        if a.num_rows and b.num_rows:
            known, logp = np.frombuffer(b["code"][0].as_py(), "<u4"), np.frombuffer(b["logp"][0].as_py(), "<f8")
            for code, at, n, rows in zip(*(a[c].to_pylist() for c in ("code", "at", "n", "rows"))):
                lp = logp[np.searchsorted(known, np.frombuffer(code, "<u4"))] * np.frombuffer(n, "<u4")
                row = np.frombuffer(rows, "<i8")
                out.append((row, np.bincount(np.frombuffer(at, "<u4"), lp, len(row))))
        row, lp = (np.concatenate([x[j] for x in out]) if out else np.empty(0) for j in (0, 1))
        row, back = np.unique(row.astype(np.int64), return_inverse=True)
        return pa.table({"row": row, "lp": np.bincount(back, lp, len(row)).astype(float)})

    asked = written(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(ask, kinds), "asked-pairs")
    wide = table.select("b", "code", "logp").join(table.sparkSession.createDataFrame([(b, p) for b, n in parts.items() for p in range(n)] or [(-1, 0)], "b int, part int"), "b")
    found = asked.where("b is not null").select("b", "part", "code", "at", "n", "rows").groupBy("b", "part").cogroup(wide.groupBy("b", "part")).applyInArrow(answer, "row bigint, lp double")
    total = found.groupBy("row").agg(F.sum("lp").alias("lp"))
    own = asked.where("b is null").select("row", "doc_id", "n_tokens").join(total, "row", "left")
    lp = F.coalesce("lp", F.lit(0.0))
    return own.select("doc_id", "n_tokens", lp.alias("log_prob"), F.when(F.col("n_tokens") > 0, F.exp(-lp / F.col("n_tokens"))).alias("perplexity"))
