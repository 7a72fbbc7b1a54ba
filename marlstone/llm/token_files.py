"""Token ids in files: one wavelet matrix per file, read back as it was written.

A file holds the ids of a run of documents in order. Bit plane k has bit k (from the highest) of
every id; before each next plane the ids are stably sorted by the bits so far, zeros first. A plane is
cut into blocks of 64 Ki positions; a block holds its bits and, for every 512th position, the ones
before it in the block, and is compressed by itself. The header's directory has each block's place in
the file and the ones before it in the plane. So an id is found by one rank per plane, and a rank reads
one block; an id's occurrences up to a position take two ranks per plane, and its n-th occurrence goes
back up with select, a block per plane again.
"""

from __future__ import annotations

import json
import posixpath
import struct
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, held, keyed, partitions, stage, to_uri, work_dir
from .segments import REMEMBERED, WHITE_SPACE_RE2, TextEncoder

MAGIC = b"MWM2"
#: Positions of a block and of its parts whose ranks are stored.
BLOCK, PART = 1 << 16, 512
#: Ids that are sorted at a time: they stay in a processor's cache.
STEP = 1 << 15


class Plane:
    """A bit plane in blocks. before: ones before each block, and in all; get(b): block b's ranks and bits."""

    def __init__(self, n: int, before: np.ndarray, get: Callable[[int], tuple[np.ndarray, np.ndarray]]):
        self.n, self.before, self.get = n, before, get

    @classmethod
    def of(cls, bits: np.ndarray, n: int) -> Plane:
        """From packed bits, lowest first."""
        blocks = -(-n // BLOCK)
        all_bits = np.zeros((blocks, BLOCK // 8), np.uint8)
        all_bits.ravel()[: len(bits)] = bits
        per = np.bitwise_count(all_bits.view(np.uint64)).reshape(blocks, BLOCK // PART, PART // 64).sum(axis=2, dtype=np.int64)
        ranks = (np.cumsum(per, axis=1) - per).astype("<u2")
        before = np.concatenate([[0], np.cumsum(per.sum(axis=1))])
        return cls(n, before, lambda b: (ranks[b], all_bits[b]))

    def bit(self, i: int) -> int:
        bits = self.get(i // BLOCK)[1]
        return int(bits[i % BLOCK // 8]) >> (i % 8) & 1

    def rank(self, i: int) -> int:
        """Ones among the first i bits."""
        b, j = divmod(i, BLOCK)
        if not j:
            return int(self.before[b])
        ranks, bits = self.get(b)
        part = j // PART
        rest = int(bits[j // 8]) & ((1 << j % 8) - 1) if j % 8 else 0
        return int(self.before[b]) + int(ranks[part]) + int(np.bitwise_count(bits[part * PART // 8 : j // 8]).sum()) + rest.bit_count()

    def select(self, one: bool, j: int) -> int:
        """Position of the j-th (from 0) one or zero."""
        before = self.before if one else np.arange(len(self.before)) * BLOCK - self.before
        b = int(np.searchsorted(before[:-1], j, side="right")) - 1
        ranks, bits = self.get(b)
        ranks = ranks.astype(np.int64) if one else np.arange(len(ranks)) * PART - ranks
        j -= int(before[b])
        part = int(np.searchsorted(ranks, j, side="right")) - 1
        own = np.unpackbits(bits[part * PART // 8 : (part + 1) * PART // 8], bitorder="little")
        return b * BLOCK + part * PART + int(np.flatnonzero(own == one)[j - int(ranks[part])])


class WaveletMatrix:
    """Access, rank, select and count over a sequence of unsigned ids."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes, self.bits = n, planes, len(planes)
        self.zeros = [n - int(p.before[-1]) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.ascontiguousarray(ids, dtype=np.uint32)
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        if bits <= 16:
            ids = ids.astype(np.uint16)
        planes = []
        for k in range(bits - 1, -1, -1):
            b = (ids & ids.dtype.type(1 << k)).astype(bool)
            planes.append(Plane.of(np.packbits(b, bitorder="little"), len(ids)))
            zero, one = 0, len(ids) - int(np.count_nonzero(b))
            out = np.empty_like(ids)
            for i in range(0, len(ids), STEP):
                x, bit = ids[i : i + STEP], b[i : i + STEP]
                for at, n in ((zero, np.flatnonzero(~bit)), (one, np.flatnonzero(bit))):
                    x.take(n, out=out[at : at + len(n)], mode="clip")
                ones = len(n)
                zero, one = zero + len(x) - ones, one + ones
            ids = out
        return cls(len(ids), planes)

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k, p in enumerate(self.planes):
            bit, r = p.bit(i), p.rank(i)
            i = self.zeros[k] + r if bit else i - r
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value among the first i ids."""
        if value >> self.bits:
            return 0
        lo = 0
        for k, p in enumerate(self.planes):
            a, b = p.rank(lo), p.rank(i)
            lo, i = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (lo - a, i - b)
        return i - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of value; IndexError if there is none."""
        if not 0 <= j < self.count(value):
            raise IndexError(j)
        lo = 0
        for k, p in enumerate(self.planes):
            a = p.rank(lo)
            lo = self.zeros[k] + a if value >> (self.bits - 1 - k) & 1 else lo - a
        at = lo + j
        for k in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - k) & 1
            at = self.planes[k].select(bool(one), at - self.zeros[k] if one else at)
        return at

    def all(self) -> np.ndarray:
        """All ids, by undoing the sorts from the last plane up."""
        out = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for k in range(self.bits - 1, -1, -1):
            up, bit = np.empty_like(out), out.dtype.type(1 << (self.bits - 1 - k))
            zero, one = 0, self.zeros[k]
            for i in range(0, self.n, STEP):
                if i % BLOCK == 0:
                    bits = self.planes[k].get(i // BLOCK)[1]
                b = np.unpackbits(bits[i % BLOCK // 8 : (i % BLOCK + STEP) // 8], count=min(STEP, self.n - i), bitorder="little").view(bool)
                ones, zeros, part = np.flatnonzero(b), np.flatnonzero(~b), up[i : i + STEP]
                part[zeros] = out[zero : zero + len(zeros)]
                part[ones] = out[one : one + len(ones)] | bit
                zero, one = zero + len(zeros), one + len(ones)
            out = up
        return out.astype(np.uint32)


def dump(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file's bytes: magic, length of the header, JSON header, then zstd sections: doc_id and length of
    each document (int64), the directory (ends of all blocks after it, and of each plane the ones before
    each block), and the planes' blocks, each its ranks (uint16) and bits."""
    matrix = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    blocks = []
    for p in matrix.planes:
        for b in range(len(p.before) - 1):
            ranks, bits = p.get(b)
            blocks.append(pack(ranks.tobytes() + bits.tobytes()))
    ends = np.cumsum([len(b) for b in blocks], dtype="<i8")
    directory = b"".join([ends.tobytes(), *(p.before.astype("<i8").tobytes() for p in matrix.planes)])
    null = [i for i, d in enumerate(doc_ids) if d is None]
    sections = [pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), pack(np.array(lengths, "<i8").tobytes()), pack(directory)]
    header = json.dumps({"docs": len(doc_ids), "ids": matrix.n, "bits": matrix.bits, "null": null, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections, *blocks])


class TokenFile:
    """A file that dump() has made, or a part of one at a time: read(start, size) gives its bytes.

    Only the header, the directory and the blocks that are asked for are read; the last `kept` of these
    stay unpacked. reads: how many have been read.
    """

    def __init__(self, source: bytes | Callable[[int, int], bytes], kept: int = 64):
        read = source if callable(source) else (lambda start, size: source[start : start + size])
        head = read(0, 8)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<I", head[4:8])[0]
        head = json.loads(read(8, size))
        at = (8 + size + np.cumsum([0, *head["sections"]])).tolist()
        unpack = zstandard.ZstdDecompressor().decompress
        ids, lengths, directory = (unpack(read(a, b - a)) for a, b in zip(at, at[1:], strict=False))
        null = set(head["null"])
        self.doc_ids = [None if i in null else int(d) for i, d in enumerate(np.frombuffer(ids, "<i8"))]
        self.lengths, self.reads = np.frombuffer(lengths, "<i8"), 0
        n, planes = head["ids"], head["bits"]
        per = -(-n // BLOCK)
        ends = np.frombuffer(directory, "<i8", planes * per)
        before = np.frombuffer(directory, "<i8", planes * (per + 1), ends.nbytes).reshape(planes, per + 1)

        @lru_cache(maxsize=kept)
        def block(k: int) -> tuple[np.ndarray, np.ndarray]:
            self.reads += 1
            start = int(ends[k - 1]) if k else 0
            data = unpack(read(at[-1] + start, int(ends[k]) - start))
            return np.frombuffer(data, "<u2", BLOCK // PART), np.frombuffer(data, np.uint8, offset=2 * (BLOCK // PART))

        self.matrix = WaveletMatrix(n, [Plane(n, before[k], lambda b, k=k: block(k * per + b)) for k in range(planes)])


def worker_encoder(path: str, remembered: int) -> TextEncoder:
    """A worker process's encoder: later tasks find the words that earlier ones have met."""
    return held(("library", path, remembered), lambda: library_encoder(path, remembered))


def library_encoder(path: str, remembered: int = REMEMBERED) -> TextEncoder:
    """Ids by the tokenizers library as little-endian uint32 bytes, without added special tokens.

    Segments that are one space and no other white space are encoded many to a text: each begins at a
    border of the split pattern there too, and the lengths of the tokens show whose they are.
    """
    import json as js
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs in parallel
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    if (js.loads(t.to_str())["pre_tokenizer"] or {}).get("type") != "ByteLevel":
        raise ValueError("a byte-level model is needed")
    size = np.zeros(t.get_vocab_size(), np.int64)  # of each token in bytes: one character a byte
    for token, i in t.get_vocab(with_added_tokens=False).items():
        size[i] = len(token)
    joins = f"^ [^{WHITE_SPACE_RE2}]+$"  # and no special token, as texts with one come alone

    def encode(segments: list[str]) -> list[bytes]:
        if len(segments) == 1:
            return [array("I", t.encode(segments[0], add_special_tokens=False).ids).tobytes()]
        column = pa.array(segments, pa.string())
        fits = pc.match_substring_regex(column, joins).to_numpy(zero_copy_only=False)
        out: list = [None] * len(segments)
        hard = np.flatnonzero(~fits).tolist()
        for i, e in zip(hard, t.encode_batch_fast([segments[i] for i in hard], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        easy = np.flatnonzero(fits).tolist()
        if easy:
            some = [segments[i] for i in easy]
            joined = t.encode_batch_fast(["".join(some[i : i + 200]) for i in range(0, len(some), 200)], add_special_tokens=False)
            ids = np.array(list(chain.from_iterable([e.ids for e in joined])), "<u4")
            ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)[fits])
            cuts = (4 * (1 + np.searchsorted(np.cumsum(size[ids]), ends))).tolist()
            data = ids.tobytes()
            for i, a, b in zip(easy, [0, *cuts], cuts, strict=False):
                out[i] = data[a:b]
        return out

    return TextEncoder(encode, special, remembered)


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text", docs_per_shard: int = 8192, ids_per_file: int = 1 << 22) -> DataFrame:
    """Encodes the texts and writes their ids, ascending by doc_id, in files below folder.

    Returns the manifest, one row per file: shard, part, path, n_docs, n_ids. In a file name, shard and
    part are in the order of doc_id, nulls first; equal doc_ids are ordered by their texts (and are in
    one task, as doc_ids are taken to be nearly unique). A document
    with a null or empty text has no ids but end_id. One document's ids are never cut: a file has
    ids_per_file at most, but for a document that is longer. An empty table gives no file.
    """
    spark = df.sparkSession
    df = keyed(df, doc_id=doc_id, text=text)
    shards = max(partitions(spark), -(-df.count() // docs_per_shard))
    dealt = df.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    root = to_uri(folder)

    def run(batches):
        import os

        from pyarrow import fs as pafs
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer, 1_100_000)
        end = np.array([] if end_id is None else [end_id], "<u4")
        store, base = pafs.FileSystem.from_uri(root)
        state = {"shard": TaskContext.get().partitionId(), "part": 0, "docs": [], "lengths": [], "ids": [], "n": 0}

        def flush():
            if not state["docs"]:
                return []
            name = f"{state['shard']:08d}-{state['part']:06d}-{os.urandom(8).hex()}.mwm"
            data = dump(state["docs"], state["lengths"], np.concatenate(state["ids"]))
            # every attempt writes a file of its own; the manifest, which Spark commits, names those that count
            with store.open_output_stream(posixpath.join(base, name)) as out:
                out.write(data)
            row = (state["shard"], state["part"], f"{root}/{name}", len(state["docs"]), state["n"])
            state.update(part=state["part"] + 1, docs=[], lengths=[], ids=[], n=0)
            return [row]

        store.create_dir(base, recursive=True)
        rows = []
        for batch in batches:
            docs = batch.column(0).to_pylist()
            at = 0
            for ids, sizes in encoder.batch(batch.column(1)):
                ends = np.cumsum(sizes).tolist()
                for start, stop in zip([0, *ends], ends, strict=False):
                    d, m = docs[at], stop - start + len(end)
                    at += 1
                    if state["n"] + m > ids_per_file:
                        rows += flush()
                    state["docs"].append(d)
                    state["lengths"].append(m)
                    state["ids"] += [ids[start:stop], end]
                    state["n"] += m
        rows += flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=["shard", "part", "path", "n_docs", "n_ids"])

    manifest = dealt.mapInArrow(run, "shard long, part long, path string, n_docs long, n_ids long")
    return stage(manifest, f"{folder}-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it, in all files),
    n_tokens and ids (little-endian uint32)."""
    # a row per file; the sums before each are taken in one pass over these
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))

    def run(batches):
        from pyarrow import fs as pafs

        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as f:
                    data = f.read()
                file = TokenFile(data)
                ids = file.matrix.all().astype("<u4")
                ends = np.cumsum(file.lengths)
                for k in range(0, len(file.doc_ids), 2048):
                    some = slice(k, k + 2048)
                    starts, stops = (ends[some] - file.lengths[some]).tolist(), ends[some].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[some], pa.int64()), pa.array([before + a for a in starts], pa.int64()), pa.array(file.lengths[some], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    # files are of about one size, so each is a partition's equal part
    return files.repartition(4 * partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; null texts have the end id alone.

    Rows of one doc_id are documents of their own, in the order of their texts.
    """
    import public_tokenizers

    manifest = write_token_files(documents(spark, sf_dir), work_dir(spark) + "/ids", public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

