"""Packing documents into sequences along a space-filling curve.

A document's token ids are hashed to buckets; a fixed random projection of the bucket counts gives a
few coordinates, and these a key on a Hilbert curve, so that documents of like tokens lie close
together on it. Documents are range-partitioned and sorted by (key, doc_id), laid end to end along
the curve and cut every `length` ids. Only the last sequence could be short of full; it is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed, partitions, stage, work_dir
from .segments import REMEMBERED
from .token_files import worker_encoder

DIMENSIONS, BITS, BUCKETS = 4, 8, 1 << 12


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys of points (n, d) with coordinates below 2**bits: their places on a Hilbert curve.

    From the highest bit down, the part of the curve in a cell is a turned and mirrored copy of the
    whole: each coordinate's bit tells how the lower bits of the first one are mirrored or swapped.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for k in range(bits - 1, 0, -1):
        bit, low = 1 << k, (1 << k) - 1
        for i in range(d):
            on = x[i] & bit != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    # from reflected binary code to numbers, over all bits of all coordinates
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        flip ^= np.where(x[d - 1] & (1 << k) != 0, (1 << k) - 1, 0)
    x ^= flip
    key = np.zeros(len(points), np.int64)
    for k in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> k & 1)
    return key


def projection() -> np.ndarray:
    """The fixed directions: a row of +1 and -1 for each bucket."""
    return np.random.default_rng(17).choice(np.array([-1, 1], np.int8), (DIMENSIONS, BUCKETS))


def curve_keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Curve keys of documents with these ids, one after the other. No ids: the middle of the cube."""
    bucket = (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(32 - 12)).astype(np.int16)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    at = np.zeros((len(sizes), DIMENSIONS))
    for k, row in enumerate(projection()):
        if len(full):
            at[full, k] = np.add.reduceat(row.take(bucket), starts, dtype=np.int64) / sizes[full]
    return hilbert(((0.5 + 0.5 * np.tanh(4 * at)) * (1 << BITS)).clip(0, (1 << BITS) - 1), BITS)


def tail_starts(total: int, length: int) -> list[int]:
    """Where the sequences of the rest beyond full sequences begin: its powers of two, falling."""
    out, at = [], total - total % length
    for k in range(length.bit_length(), -1, -1):
        if total % length >> k & 1:
            out.append(at)
            at += 1 << k
    return out


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents; returns the pieces: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and with_ids: the ids as little-endian uint32).

    A null or empty text has the one id end_id. Every row is a document of its own, repeated rows too.
    All sequences have `length` ids but for at most log2(length) last ones, whose lengths are powers of
    two; none is padded. An empty table has no pieces.
    """
    spark = df.sparkSession
    folder = work_dir(spark) + "/pack"
    n_parts = partitions(spark)
    docs = keyed(df, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())

    def encode(batches):
        encoder = worker_encoder(tokenizer, REMEMBERED)
        for batch in batches:
            at = 0
            for ids, sizes in encoder.batch(batch.column(1)):
                keys = curve_keys(ids, sizes)
                ends = np.cumsum(sizes)
                kind = np.uint16 if not len(ids) or int(ids.max()) < 1 << 16 else np.uint32
                data = ids.astype(kind).tobytes()
                w = kind().nbytes
                cuts = list(zip((w * (ends - sizes)).tolist(), (w * ends).tolist(), strict=True))
                some = batch.slice(at, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [some.column(2), some.column(0), pa.array(keys), pa.array(sizes + 1, pa.int64()), pa.array([w] * len(sizes), pa.int32()), pa.array([data[a:b] for a, b in cuts], pa.binary())],
                    names=["row", "doc_id", "key", "doc_tokens", "width", "ids"],
                )
                at += len(sizes)

    encoded = stage(docs.mapInArrow(encode, "row long, doc_id long, key long, doc_tokens long, width int, ids binary"), f"{folder}/ids")

    def lay(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = at + np.cumsum(batch.column(1).to_numpy())
            if len(ends):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(ends), pa.int64()), pa.array(ends - batch.column(1).to_numpy())], names=["row", "n", "part", "first"])
                at = int(ends[-1])

    # only these narrow rows are sorted
    order = encoded.select("row", "doc_tokens", "key", "doc_id").repartitionByRange(n_parts, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    laid = stage(order.mapInArrow(lay, "row long, n long, part long, first long"), f"{folder}/laid")
    starts, total = {}, 0
    for part, n in sorted(tuple(r) for r in laid.groupBy("part").agg(F.sum("n")).collect()):  # a row per partition
        starts[part], total = total, total + n
    tails = tail_starts(total, length)
    ends = [*tails[1:], total]

    def cut(batches):
        for batch in batches:
            rows = {name: [] for name in names}
            for doc, tokens, width, data, part, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.concatenate([np.frombuffer(data, np.uint16 if width == 2 else np.uint32).astype("<u4"), np.array([end_id], "<u4")])
                start, stop = starts[part] + first, starts[part] + first + tokens
                at = start
                while at < stop:
                    if tails and at >= tails[0]:
                        k = int(np.searchsorted(tails, at, side="right")) - 1
                        sequence, begin, until = total // length + k, tails[k], ends[k]
                    else:
                        sequence = at // length
                        begin, until = sequence * length, (sequence + 1) * length
                    until = min(stop, until)
                    piece = ids[at - start : until - start].tobytes()
                    for name, v in zip(names, (doc, at - start, until - at, zlib.crc32(piece), tokens, sequence, at - begin, piece), strict=False):
                        rows[name].append(v)
                    at = until
            if rows["doc_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)
    both = encoded.join(laid.drop("n"), "row").select("doc_id", "doc_tokens", "width", "ids", "part", "first")
    return both.mapInArrow(cut, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

