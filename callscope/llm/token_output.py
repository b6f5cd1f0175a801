"""Token ids as frequency-ranked integers in a byte-aligned variable-length code with separate control bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, column, kept, pick, small_batches, written
from .tokens import TOKENIZER, encoder

_LENS = np.array([[1 + ((c >> (2 * i)) & 3) for i in range(4)] for c in range(256)], np.int64)


def pack(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, their offsets, data bytes, their offsets; one pair of streams for each slice of values.

    A control byte holds the lengths less one (2 bits each, lowest first) of four values; the last is filled with zeros.
    """
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    n = np.diff(off)
    quads = (n + 3) // 4
    coff = np.concatenate([[0], np.cumsum(quads)])
    place = np.arange(len(v)) + np.repeat(4 * coff[:-1] - off[:-1], n)
    full = np.zeros(4 * coff[-1], np.uint8)
    full[place] = code
    q = full.reshape(-1, 4)
    control = q[:, 0] | (q[:, 1] << 2) | (q[:, 2] << 4) | (q[:, 3] << 6)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    size = np.concatenate([[0], np.cumsum(code, dtype=np.int64)]) + np.arange(len(v) + 1)
    return control.astype(np.uint8), coff, data, size[off]


def unpack(n: int, control: bytes, data: bytes) -> np.ndarray:
    """The n values: lengths by table lookup of the control bytes, then one gather of bytes."""
    if not n:
        return np.empty(0, np.uint32)
    lens = _LENS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(lens) - lens
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for i in range(4):
        m = lens > i
        out[m] |= d[start[m] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def token_output(docs: DataFrame, tokenizer: str = TOKENIZER, beside: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_tokens, control, data (binary), n_vocab, ranking.

    Ids are ranks: 0 for the token most frequent over all documents; ties go to the smaller token id; tokens that never
    occur come last by id. ranking names a Parquet table (rank, token_id, n) that says which token each rank is: it is
    written to the path `beside`, or to the shared folder, and stays there; `decoded` reads both. Null and empty texts give 0 tokens and
    empty streams; repeated rows and null ids are kept as they are; texts are taken whole; other columns are dropped; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ids = written(_ids(docs, tokenizer), "token-ids")
    rank, n = ranking(ids, tokenizer)
    beside = beside or kept(spark, "token-ranking")
    order = np.argsort(rank)
    spark.createDataFrame(pa.table({"rank": np.arange(len(rank), dtype=np.int64), "token_id": order.astype(np.int64), "n": n[order]})).coalesce(1).write.mode("overwrite").parquet(beside)
    return encode_ids(ids, rank, beside)


def decoded(output: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of token_output's rows, by the rankings that they name."""
    spark = output.sparkSession
    paths = [r[0] for r in output.select("ranking").distinct().collect()]
    shared = spark.sparkContext.broadcast({p: spark.read.parquet(p).orderBy("rank").toArrow()["token_id"].to_numpy() for p in paths})

    def rows(batches):
        enc = encoder(tokenizer)
        for b in small_batches(batches, "data"):
            text = [enc.decode(shared.value[p][unpack(n, c, d)]).decode("utf-8", "replace") for n, c, d, p in zip(*(column(b, c) for c in ("n_tokens", "control", "data", "ranking")))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return output.select("doc_id", "n_tokens", "control", "data", "ranking").mapInArrow(rows, "doc_id bigint, text string")


def _ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    def rows(batches):
        enc = encoder(tokenizer)
        for b in small_batches(batches):
            flat, off = enc.flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), binary_array(flat, off)], ["doc_id", "ids"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(rows, "doc_id bigint, ids binary")


def ranking(ids: DataFrame, tokenizer: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """rank[token id] and how often it occurs, from counts over all documents; what reaches the driver has the size of the vocabulary."""
    size = encoder(tokenizer).size + 1

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=size) if len(x.as_buffer()) > 2 * size else 0
            small = b"".join(x.as_py() for x in b.column(0) if x.is_valid and len(x.as_buffer()) <= 2 * size)
            total += np.bincount(np.frombuffer(small, "<u2"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    got = ids.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size, np.int64)
    n[got["id"].to_numpy()] = got["n"].to_numpy()
    rank = np.empty(size, np.uint32)
    rank[np.lexsort((np.arange(size), -n))] = np.arange(size, dtype=np.uint32)
    return rank, n


def encode_ids(ids: DataFrame, rank: np.ndarray, beside: str) -> DataFrame:
    shared = ids.sparkSession.sparkContext.broadcast(rank)

    def rows(batches):
        r = shared.value
        for b in small_batches(batches, "ids", 4 << 20):
            raw = column(b, "ids")
            off = np.cumsum(np.array([0, *(len(x or b"") // 2 for x in raw)], np.int64))
            control, coff, data, doff = pack(r[np.frombuffer(b"".join(x or b"" for x in raw), "<u2")], off)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off), pa.int64()), binary_array(control, coff), binary_array(data, doff), pa.array(np.full(len(raw), len(r)), pa.int32()), pa.array([beside] * len(raw), pa.string())],
                ["doc_id", "n_tokens", "control", "data", "n_vocab", "ranking"],
            )

    return ids.mapInArrow(rows, "doc_id bigint, n_tokens bigint, control binary, data binary, n_vocab int, ranking string")


def decode(n: int, control: bytes, data: bytes, rank: np.ndarray) -> np.ndarray:
    """Token ids of one document, given the ranking it was coded with."""
    back = np.empty(len(rank), np.uint32)
    back[rank] = np.arange(len(rank), dtype=np.uint32)
    return back[unpack(n, control, data)]
