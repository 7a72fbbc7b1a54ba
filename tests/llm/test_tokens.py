import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from marlstone.llm import bpe_codec, packing, token_counts, token_files

from .helpers import ODD, fuzz, odd_documents

JSON, RANKS, MODEL = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_library_ids_of_whole_texts(library):
    texts = [*ODD, *fuzz(3000), *fuzz(300)]
    out = []
    for ids, sizes in token_files.library_encoder(JSON).batch(pa.array(texts, pa.string())):
        out += np.split(ids, np.cumsum(sizes)[:-1])
    assert [x.tolist() for x in out] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_rank_codec_is_tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, texts = bpe_codec.ByteBPE(RANKS, P.PATTERN), [t or "" for t in ODD] + fuzz(3000, 2)
    for t, ids in zip(texts, codec.encode_batch(pa.array(texts)), strict=True):
        assert ids.tolist() == own.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_counts_are_sentencepiece(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    machine = token_counts.CountTransducer(token_counts.read_pieces(MODEL))
    texts = [t or "" for t in ODD] + fuzz(3000, 3) + [" " * k + "x" * (k % 2) for k in range(70)]
    want = [len(x) for x in sp.encode(texts)]
    assert machine.counts(pa.array(texts)) == want
    monkeypatch.setattr(token_counts, "CHUNK", 7)  # every text in chunks whose maps are composed
    assert [machine.count(t) for t in texts] == want
    monkeypatch.setattr(token_counts, "STATES", 50)
    assert machine.counts(pa.array(texts)) == want


def test_compose_is_associative():
    m = token_counts.CountTransducer(token_counts.read_pieces(MODEL))
    rng = random.Random(4)
    for _ in range(50):
        a, b, c = (m.chunk_map("".join(rng.choice("ab▁▁tion") for _ in range(rng.randint(1, 9)))) for _ in range(3))
        x, y = m.compose(m.compose(a, b), c), m.compose(a, m.compose(b, c))
        run = lambda t: (m.run(m.begin, t[0])[1] + t[1], t[2] if t[2] is not None else m.run(m.begin, t[0])[0])
        assert run(x) == run(y)


def test_count_operator(spark):
    got = token_counts.count_tokens(odd_documents(spark), MODEL, limit=100)
    assert got.columns == ["doc_id", "text", "lang", "kept", "n_bytes", "n_tokens", "over_limit"]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in got.collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(sp.encode(r.text or "")))
        assert r.over_limit == (r.n_tokens > 100)
    assert token_counts.count_tokens(odd_documents(spark).limit(0), MODEL).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([5]), rng.integers(0, 70, 3000), rng.integers(0, 1 << 20, 700), np.zeros(600, int)):
        f = token_files.TokenFile(token_files.dump([1, None], [len(ids), 0], ids))
        m = f.matrix
        assert m.all().tolist() == ids.tolist() and f.doc_ids == [1, None]
        for i in range(0, len(ids), 97):
            v = int(ids[i])
            before = int((ids[:i] == v).sum())
            assert (m.access(i), m.rank(v, i), m.select(v, before), m.count(v)) == (v, before, i, int((ids == v).sum()))
        assert m.count(1 << 22) == 0
        with pytest.raises(IndexError):
            m.select(3, len(ids))


def test_one_id_reads_a_block_per_plane():
    """Of a file of several blocks a plane, access reads one block of each, select two, count none twice."""
    ids = np.random.default_rng(2).integers(0, 50_000, 200_001)
    data = token_files.dump([1], [len(ids)], ids)
    spans = []

    def read(start, size):
        spans.append(size)
        return data[start : start + size]

    f = token_files.TokenFile(read)
    bits = f.matrix.bits
    assert bits == 16 and f.reads == 0 and sum(spans) < len(data) / 20
    assert f.matrix.access(123_456) == ids[123_456] and f.reads <= bits
    v = int(ids[77_777])
    f = token_files.TokenFile(read)
    assert f.matrix.count(v) == (ids == v).sum() and f.reads <= 2 * bits
    j = int((ids[:77_777] == v).sum())
    f = token_files.TokenFile(read)
    assert f.matrix.select(v, j) == 77_777 and f.reads <= 4 * bits
    assert (f.matrix.all() == ids).all()


def table(spark, tmp_path, docs):
    docs.select("doc_id", "text").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_op8_query(spark, tmp_path, library):
    """The query itself, also where rows share a doc_id or have none: these come first."""
    docs = odd_documents(spark, fuzz(30, 8)).select("doc_id", "text").union(spark.createDataFrame([(None, "b"), (3, "zz"), (3, None), (3, "aa"), (3, "aa")], "doc_id long, text string"))
    got = sorted(map(tuple, token_files.op8_token_files(spark, table(spark, tmp_path, docs)).collect()), key=lambda r: r[1])
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    assert got == brute(library, order, 2, key=lambda x: 0)


def test_op6_query(spark, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = odd_documents(spark, fuzz(200, 9) + ["word, " * 4000])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op6_token_counts(spark, table(spark, tmp_path, docs)).collect()}
    want = {d: (len(t.encode()), len(sp.encode(t))) for d, t in texts.items()}
    assert got == {d: (b, n, n > 4096) for d, (b, n) in want.items()} and any(o for _, _, o in got.values())


def test_op9_query(spark, tmp_path, library):
    """Every id of every document in one piece, gapless sequences, short only by powers of two; repeated ids too."""
    docs = odd_documents(spark, fuzz(100, 10) + ["some words " * 3000]).select("doc_id", "text").union(spark.createDataFrame([(3, "aa"), (3, "bb"), (None, None)], "doc_id long, text string"))
    ids = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    rows = packing.op9_packing(spark, table(spark, tmp_path, docs)).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.doc_tokens, r.start, r.length, r.ids_crc32))
    sizes = []
    for s in range(len(by_seq)):
        at = 0
        for offset, n in sorted(by_seq[s]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sum(sizes) == sum(len(x) for _, x in ids) and all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    for d, x in ids:
        if d is None or sum(e == d for e, _ in ids) > 1:
            continue
        at = 0
        for tokens, start, n, crc in sorted(by_doc[d]):
            assert (tokens, start, crc) == (len(x), at, zlib.crc32(np.array(x[at : at + n], "<u4").tobytes()))
            at += n
        assert at == len(x)
    assert sorted(t for t, s, _, _ in by_doc[3] if s == 0) == sorted(len(x) for d, x in ids if d == 3) and len(by_doc[None]) == 1


def brute(library, docs, end, key=lambda x: x[0]):
    rows, start = [], 0
    for d, t in sorted(docs, key=key):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        rows.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return rows


def test_token_files(spark, tmp_path, library):
    docs = odd_documents(spark, fuzz(60, 5)).repartition(3)
    m = token_files.write_token_files(docs, f"file://{tmp_path}/a", JSON, 2, docs_per_shard=9, ids_per_file=4000)
    assert m.count() > 5
    got = token_files.read_token_files(spark, m).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS crc").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(library, [(r.doc_id, r.text) for r in docs.collect()], 2)
    none = token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/b", JSON, 2)
    assert token_files.read_token_files(spark, none).count() == 0


def test_codec_operators(spark):
    df = bpe_codec.decode(bpe_codec.encode(odd_documents(spark), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in df.collect())


def test_op10_digests(spark, tmp_path):
    docs = odd_documents(spark)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    codec = bpe_codec.ByteBPE(RANKS, P.PATTERN)
    want = {r.doc_id: next(codec.encode_batch(pa.array([r.text or ""]))).tobytes() for r in docs.collect()}
    for r in bpe_codec.op10_byte_bpe(spark, str(tmp_path)).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]) // 4, hashlib.sha256(want[r.doc_id]).hexdigest())


def test_hilbert_walks_to_neighbours():
    for d, bits in ((2, 4), (3, 2), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), axis=-1).reshape(-1, d)
        walk = points[np.argsort(packing.hilbert(points, bits))]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark, library):
    docs = odd_documents(spark, fuzz(40, 6)).repartition(3)
    rows = packing.pack(docs, JSON, length=64, with_ids=True).collect()
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 and r.doc_tokens == len(want[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, ids in want.items():
        pieces = sorted(by_doc[d])
        assert [s for s, _ in pieces] == [sum(len(p) for _, p in pieces[:i]) for i in range(len(pieces))]
        assert [i for _, p in pieces for i in p] == ids
    sizes = []
    for s in range(len(by_seq)):
        at = 0
        for offset, n in sorted(by_seq[s]):
            assert offset == at
            at += n
        sizes.append(at)
    short = [n for n in sizes if n != 64]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 6 and short == sizes[len(sizes) - len(short) :]
    assert packing.pack(docs.limit(0), JSON).count() == 0
