import hashlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import line_dedup

from .helpers import odd_documents

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_docs, min_chars=1):
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


MORE = [f"Shared LINE{' ' * (i % 3)}\nown {i}\n\ttwice {i % 4} \r" for i in range(40)] + ["shared line\nshared line\n\xa0shared line", "ÉÉ\néé"] * 3


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        h = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(keys, np.arange(len(keys)) + 1).to_bytes())
        assert sorted(h._place(keys)) == list(range(len(keys)))
        assert (h.lookup(keys) == np.minimum(np.arange(len(keys)) + 1, 65535)).all()
        other = rng.integers(2**63, 2**64, 5000, dtype=np.uint64)
        assert (h.lookup(other) > 0).mean() < 0.001


@pytest.mark.parametrize("min_docs, min_chars, block", [(10, 1, 1 << 30), (3, 1, 1 << 30), (3, 9, 1), (3, 1, 1), (1, 2, 1 << 30)])
def test_drop_lines(spark, tmp_path, min_docs, min_chars, block):
    docs = odd_documents(spark, MORE)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    index = line_dedup.index_lines(docs, f"file://{tmp_path}/i", min_chars=min_chars, keys_per_shard=16)
    assert index.bits > 1 or min_chars > 1
    got = line_dedup.drop_lines(docs, index, min_docs=min_docs, min_chars=min_chars, block_bytes=block)
    assert set(got.columns) == {"doc_id", "text", "lang", "N_Tokens", "kept", "n_lines", "n_dropped"}
    rows = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect())
    assert rows == brute([(r.doc_id, r.text) for r in docs.collect()], min_docs, min_chars)


def test_a_block_reads_each_shard_once(spark, tmp_path):
    """Whatever the size of the index, and never a shard that the block has no line of."""
    docs = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i, i + 40))) for i in range(300)], "doc_id long, text string")
    index = line_dedup.index_lines(docs, f"file://{tmp_path}/i", keys_per_shard=8)
    shards = line_dedup.Shards(index)
    assert index.bits >= 5 and index.n_lines == 339
    _, _, hashes, _, _ = line_dedup.lines_of(pa.array([r.text for r in docs.collect()]), 1)
    n = shards.counts(np.sort(hashes))
    assert shards.reads <= 1 << index.bits and sorted(n.tolist())[-1] == 40
    before = shards.reads
    shards.counts(np.sort(hashes)[:3])
    assert shards.reads - before <= 3


def test_a_file_of_another_attempt(tmp_path):
    from pyarrow import fs

    from marlstone.llm.common import publish

    class Strict(fs.LocalFileSystem):
        def move(self, a, b):
            raise OSError("it is there")

    for name, data in (("x", b"abc"), ("own", b"abc"), ("other", b"ab")):
        (tmp_path / name).write_bytes(data)
    publish(Strict(), f"{tmp_path}/own", f"{tmp_path}/x")
    assert not (tmp_path / "own").exists() and (tmp_path / "x").read_bytes() == b"abc"
    with pytest.raises(OSError):
        publish(Strict(), f"{tmp_path}/other", f"{tmp_path}/x")


def test_no_documents(spark, tmp_path):
    docs = odd_documents(spark).limit(0)
    index = line_dedup.index_lines(docs, f"file://{tmp_path}/i")
    assert line_dedup.drop_lines(docs, index).count() == 0


def test_sql(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark, MORE).where("text IS NULL OR NOT contains(text, char(0))").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows, 10)]
    assert sorted(map(tuple, line_dedup.op1_line_dedup(spark, str(tmp_path)).collect())) == want
    assert sorted(duckdb.sql(line_dedup.SQL).fetchall()) == want
