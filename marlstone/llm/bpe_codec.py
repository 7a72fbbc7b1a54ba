"""Byte-level BPE by sentencepiece: a model file written straight from a vocabulary of ranks.

The model has a piece per rank, the token's bytes as characters (byte b is one fixed character that
is no white space), scored by the negative rank, and no normalisation. Merging the best-scored pair
first is then the same as merging by the lowest rank. Each match of the split pattern is encoded by
itself; decoding maps pieces back to bytes and joins them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, extend, held, keyed
from .segments import WHITE_SPACE, TextEncoder, gather

#: Characters of the 256 bytes: a block of letters-like symbols without white space or combining marks.
FIRST_CHAR = 0x4E00


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, of a file with lines of base64 and rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for t, r in pairs:
        tokens[int(r)] = base64.b64decode(t)
    if not all(tokens) or len(set(tokens)) != len(tokens):
        raise ValueError("ranks have gaps or repeat a token")
    return tokens


def to_chars(b: bytes) -> str:
    return "".join(chr(FIRST_CHAR + x) for x in b)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (field 1), trainer (2) and normaliser (3) settings.

    The last piece is the unknown one, which the library asks for; its id is no rank.
    """

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def nested(number: int, body: bytes) -> bytes:
        return varint(number << 3 | 2) + varint(len(body)) + body

    def number(n: int, value: int) -> bytes:
        return varint(n << 3) + varint(value)

    def piece(text: str, score: float, kind: int) -> bytes:
        return nested(1, nested(1, text.encode()) + struct.pack("<Bf", 2 << 3 | 5, score) + number(3, kind))

    normal, unknown, bpe = 1, 2, 2
    pieces = [piece(to_chars(t), -float(r), normal) for r, t in enumerate(tokens)]
    trainer = number(3, bpe) + number(40, len(tokens)) + number(41, (1 << 64) - 1) + number(42, (1 << 64) - 1) + number(43, (1 << 64) - 1)
    normaliser = nested(1, b"identity") + number(3, 0) + number(4, 0) + number(5, 0)
    return b"".join([*pieces, piece("<unk>", 0.0, unknown), nested(2, trainer), nested(3, normaliser)])


class ByteBPE:
    """encode() and decode() of the vocabulary in a rank file, special strings being plain text."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.tokens = read_ranks(ranks)
        self.model = SentencePieceProcessor(model_proto=serialise(self.tokens))
        # the pattern's \s means the property White_Space; Python's \s has four characters more
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]"))
        self.chars = [chr(FIRST_CHAR + b) for b in range(256)]
        self.table = {b: FIRST_CHAR + b for b in range(256)}
        self.texts = TextEncoder(self._segments, remembered=900_000)
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.pool = (np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(self.tokens), np.uint8))

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Ids (uint32 bytes) of each segment: its matches of the pattern, each by itself."""
        found = [self.split.findall(s) for s in segments]
        words = [w.encode("utf-8").decode("latin-1").translate(self.table) for ws in found for w in ws]
        ids = iter(self.model.encode(words, num_threads=1) if words else [])
        return [array("I", [i for _ in ws for i in next(ids)]).tobytes() for ws in found]

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in order; null and empty texts have none."""
        for ids, sizes in self.texts.batch(texts):
            ends = np.cumsum(sizes).tolist()
            yield from (ids[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return gather(ids, *self.pool).tobytes()


def codec_of(ranks: str, pattern: str) -> ByteBPE:
    """A worker process's codec: later tasks find the words that earlier ones have met."""
    return held(("ranks", ranks, pattern), lambda: ByteBPE(ranks, pattern))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of ids (binary, little-endian uint32) of its texts. A null text has no ids."""

    def make():
        codec = codec_of(ranks, pattern)

        def step(batch):
            return {ids: [x.tobytes() for x in codec.encode_batch(batch.column(batch.schema.get_field_index(text)))]}

        return step

    return extend(df, {ids: "binary"}, make, [text])


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with a column of the bytes (binary) that its ids stand for; null ids are none."""

    def make():
        codec = codec_of(ranks, pattern)
        return lambda batch: {decoded: [codec.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]}

    return extend(df, {decoded: "binary"}, make, [ids])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: encode, decode what was encoded, and keep the digests."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def make():
        codec = codec_of(ranks, pattern)

        def step(batch):
            texts = batch.column(batch.schema.get_field_index("text"))
            rows = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()) for ids in codec.encode_batch(texts)]
            n, a, b = zip(*rows, strict=True)
            return {"n_tokens": list(n), "ids_sha256": list(a), "decoded_sha256": list(b)}

        return step

    docs = keyed(documents(spark, sf_dir), doc_id="doc_id", text="text")
    return extend(docs, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, make, ["text"], keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
