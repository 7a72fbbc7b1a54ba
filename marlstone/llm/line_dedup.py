"""Dropping lines that many documents share, by a sharded minimal perfect hash over all distinct lines.

A line's key is the line without white space at its ends, A-Z in lower case; it is held as a 64-bit
hash (among 10 billion distinct lines, about 3 pairs are expected to collide). The distinct hashes
are cut into shards by their top bits. A shard has a minimal perfect hash (levels of bits: a key sits
at the first level where no other key has its place), and two arrays in its order: a fingerprint of
16 bits and the number of documents, which stops at 65535. Documents look up their lines in the
arrays; lines are never joined, and neither they nor their hashes are sent anywhere for it. A task
gathers the distinct hashes of a large block of text, in order, so that it goes through the shards
once a block and holds one of them at a time, mapped into memory where the store allows it; the
block's rows wait compressed.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import T, delete, documents, field, keyed, partitions, publish, release, stage, to_uri, work_dir
from .segments import cut, slices

LEVELS, SPACING = 48, 2
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes and lines of a block: a task reads the index once for each. More memory for a task allows larger blocks.
BLOCK_BYTES, BLOCK_LINES = 192 << 20, 1 << 22


def spread(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of 64-bit hashes for each seed."""
    x = (h ^ np.uint64((seed + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * ODD
    x ^= x >> np.uint64(32)
    return x * ODD


class PerfectHash:
    """Distinct 64-bit hashes to 0 .. n - 1, with a fingerprint and a count for each."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray, left: np.ndarray, marks: np.ndarray, counts: np.ndarray):
        """words: the bits of all levels; ranks: ones before each word; left: the keys of no level, sorted."""
        self.sizes, self.words, self.ranks, self.left, self.marks, self.counts = sizes, words, ranks, left, marks, counts
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> PerfectHash:
        keys = keys.astype(np.uint64)
        sizes, parts, rest = [], [], keys
        for level in range(LEVELS):
            if not len(rest):
                break
            m = -(-SPACING * len(rest) // 64) * 64
            at = (spread(rest, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        ranks = np.concatenate([[0], ones]).astype("<u4")
        out = cls(sizes, words, ranks, np.sort(rest), np.zeros(len(keys), "<u2"), np.zeros(len(keys), "<u2"))
        at = out._place(keys)
        out.marks[at] = (spread(keys, LEVELS) >> np.uint64(48)).astype("<u2")
        out.counts[at] = np.minimum(counts, 65535)
        return out

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """A key's place; of a hash that is no key any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            at = (spread(keys[open_], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = word >> bit & np.uint64(1) != 0
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[at[hit] >> 6].astype(np.int64) + np.bitwise_count(below)
            open_ = open_[~hit]
        if len(open_) and len(self.left):
            at = np.searchsorted(self.left, keys[open_])
            ok = (at < len(self.left)) & (self.left[np.minimum(at, len(self.left) - 1)] == keys[open_])
            out[open_[ok]] = int(self.ranks[-1]) + at[ok]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys; 0 of hashes whose fingerprint isn't there."""
        keys = keys.astype(np.uint64)
        at = self._place(keys)
        found = at >= 0
        found[found] = self.marks[at[found]] == (spread(keys[found], LEVELS) >> np.uint64(48)).astype(np.uint16)
        return np.where(found, self.counts[np.maximum(at, 0)] if len(self.counts) else 0, 0)

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<4sIIQ{len(self.sizes)}Q", b"MPH2", len(self.sizes), len(self.left), len(self.marks), *self.sizes)
        return b"".join([head, self.words.tobytes(), self.ranks.tobytes(), self.left.astype("<u8").tobytes(), self.marks.tobytes(), self.counts.astype("<u2").tobytes()])

    @classmethod
    def from_bytes(cls, data) -> PerfectHash:
        """The shard in a file's bytes, or in a buffer of them, of which only what is looked at is read."""
        _, levels, left, n = struct.unpack_from("<4sIIQ", data)
        sizes = list(struct.unpack_from(f"<{levels}Q", data, 20))
        at, parts = 20 + 8 * levels, []
        for kind, k in (("<u8", sum(sizes) // 64), ("<u4", sum(sizes) // 64 + 1), ("<u8", left), ("<u2", n), ("<u2", n)):
            parts.append(np.frombuffer(data, kind, k, at))
            at += parts[-1].nbytes
        return cls(sizes, *parts)


@dataclass(frozen=True)
class LineIndex:
    """Where the shards are: a file per shard, named by it; `bits` top bits of a hash are its shard."""

    folder: str
    bits: int
    n_bytes: int
    n_lines: int


class Shards:
    """A task's view of an index, a shard at a time. reads: how many have been opened."""

    def __init__(self, index: LineIndex):
        from pyarrow import fs as pafs

        self.index, self.reads = index, 0
        self.store, self.base = pafs.FileSystem.from_uri(index.folder)
        self.mapped = isinstance(self.store, pafs.LocalFileSystem)

    def shard(self, k: int) -> PerfectHash | None:
        """Shard k; none if no line has a hash of it."""
        path = posixpath.join(self.base, f"{k:08d}.mph")
        self.reads += 1
        try:
            if self.mapped:
                return PerfectHash.from_bytes(pa.memory_map(path).read_buffer())
            with self.store.open_input_file(path) as f:
                return PerfectHash.from_bytes(f.read_buffer())
        except FileNotFoundError:
            return None

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of hashes in ascending order, so that each shard's are together."""
        out = np.zeros(len(hashes), np.int64)
        of = shard_of(hashes, self.index.bits)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b and (s := self.shard(int(of[a]))) is not None:
                out[a:b] = s.lookup(hashes[a:b])
        return out


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def lines_of(texts: pa.Array, min_chars: int):
    """Of a slice of texts: the lines, a code of each line's key, the keys' hashes, which keys count
    (min_chars code points or more), lines per text."""
    import xxhash

    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    keys = pc.ascii_lower(pc.ascii_trim_whitespace(lines))
    codes, words, per_text = cut(pa.ListArray.from_arrays(lists.offsets, keys))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    return lines, codes, hashes, np.fromiter((len(w) >= min_chars for w in words), bool, len(words)), per_text


def index_lines(df: DataFrame, folder: str, text: str = "text", min_chars: int = 1, keys_per_shard: int = 1 << 19) -> LineIndex:
    """Counts the documents (rows) of every distinct line key and writes the shards below folder.

    Lines whose key has fewer than min_chars code points aren't counted. Null texts have one empty line.
    """
    spark = df.sparkSession

    def count(batches):
        release()
        for batch in batches:
            for texts in slices(batch.column(0)):
                _, codes, hashes, long_, per_text = lines_of(texts, min_chars)
                pairs = np.unique(np.repeat(np.arange(len(per_text)), per_text) * len(hashes) + codes)
                n = np.bincount(pairs % len(hashes), minlength=len(hashes)) * long_
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(n[at], pa.int64())], names=["h", "n"])

    found = keyed(df, text=text).mapInArrow(count, "h long, n long")
    counted = stage(found.groupBy("h").agg(F.sum("n").alias("n")), f"{folder}-counts")
    total = counted.count()
    bits = max(0, (max(1, total // keys_per_shard) - 1).bit_length())
    root = to_uri(folder)

    def write(batches):
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        rows: list[tuple[int, int, int]] = []

        def flush(shard: int, parts: list[pa.RecordBatch]):
            if not parts:
                return
            h = np.concatenate([p.column(0).to_numpy() for p in parts]).view(np.uint64)
            data = PerfectHash.build(h, np.concatenate([p.column(1).to_numpy() for p in parts])).to_bytes()
            own = posixpath.join(base, f"_{shard:08d}.{os.getpid()}.{os.urandom(4).hex()}")
            with store.open_output_stream(own) as out:
                out.write(data)
            publish(store, own, posixpath.join(base, f"{shard:08d}.mph"))  # a task run again writes the same bytes
            rows.append((shard, len(h), len(data)))

        shard, parts = -1, []
        for batch in batches:
            of = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if of[a] != shard:
                    flush(shard, parts)
                    shard, parts = int(of[a]), []
                parts.append(batch.slice(a, b - a))
        flush(shard, parts)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["shard", "n", "size"])

    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = counted.withColumn("shard", shard).repartition(max(1, min(1 << bits, 8 * partitions(spark))), "shard").sortWithinPartitions("shard")
    size = stage(dealt.mapInArrow(write, "shard long, n long, size long"), f"{folder}-shards").agg(F.sum("size")).first()[0] or 0
    delete(spark, f"{folder}-counts")
    return LineIndex(root, bits, int(size), total)


def drop_lines(df: DataFrame, index: LineIndex, text: str = "text", min_docs: int = 10, min_chars: int = 1, digest: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with n_lines, n_dropped and its texts without the lines whose key min_docs documents have.

    The other lines stay as they are, joined by newlines; a null text counts as one empty line and
    becomes the empty text. digest: the name of a column of the kept text's SHA-256 (hex of UTF-8) to
    return in the text's place. The index must be of these texts, with the same min_chars. Columns of
    the added names, in any case, are replaced; of an empty table nothing comes.
    """
    added = {"n_lines": "long", "n_dropped": "long", (digest or text): "string"}
    lower = {a.lower() for a in added}
    keep = [c for c in df.columns if c.lower() not in lower and c != text]
    df = df.select(*[df[c] for c in [*keep, text]])
    schema = T.StructType([df.schema[c] for c in keep] + [field(n, k) for n, k in added.items()])
    names = [*keep, *added]

    def settle(block: list[Waiting], shards: Shards) -> Iterator[pa.RecordBatch]:
        hashes = np.unique(np.concatenate([part.hashes for w in block for part in w.parts]))
        often = hashes[shards.counts(hashes) >= min_docs]
        for w in block:
            batch = w.batch()
            n_lines, n_dropped, out = [], [], []
            for texts, part in zip(slices(batch.column(len(keep))), w.parts, strict=True):
                drop = np.isin(part.hashes, often)[part.codes] & part.counts[part.codes]
                ends = np.cumsum(part.per_text)
                dropped = np.add.reduceat(drop.astype(np.int64), ends - part.per_text).tolist()
                flat = pc.split_pattern(texts, "\n").flatten() if any(dropped) else None
                n_lines += part.per_text.tolist()
                n_dropped += dropped
                for i, (stop, n, k) in enumerate(zip(ends.tolist(), part.per_text.tolist(), dropped, strict=True)):
                    kept = "\n".join(flat.slice(stop - n, n).filter(pa.array(~drop[stop - n : stop])).to_pylist()) if k else texts[i].as_py()
                    out.append(hashlib.sha256(kept.encode()).hexdigest() if digest else kept)
            cols = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shards, block, size, lines = Shards(index), [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for texts in slices(batch.column(len(keep))):
                _, codes, hashes, counts, per_text = lines_of(texts, min_chars)
                parts.append(Lines(codes, hashes, counts, per_text))
                lines += len(codes)
            block.append(Waiting(parts, batch))
            size += batch.nbytes
            if size >= block_bytes or lines >= BLOCK_LINES:
                yield from settle(block, shards)
                block, size, lines = [], 0, 0
        if block:
            yield from settle(block, shards)

    return df.mapInArrow(run, schema)


@dataclass
class Lines:
    """A slice's lines: the code of each line's key, the keys' hashes, whether a key counts, lines per text."""

    codes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    per_text: np.ndarray


class Waiting:
    """A batch whose lines have been read, compressed until its block is looked up."""

    def __init__(self, parts: list[Lines], batch: pa.RecordBatch):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        self.parts, self.data = parts, sink.getvalue()

    def batch(self) -> pa.RecordBatch:
        return pa.ipc.open_stream(self.data).read_next_batch()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_lines, n_dropped and kept_sha256 of every document; a null text is one empty line, never dropped."""
    docs = keyed(documents(spark, sf_dir), doc_id="doc_id", text="text")
    index = index_lines(docs, work_dir(spark) + "/lines")
    return drop_lines(docs, index, digest="kept_sha256").select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, r, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM cut),
keys AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keys WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keys.*, often.k IS NOT NULL AS gone FROM keys LEFT JOIN often ON keys.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, r
"""
