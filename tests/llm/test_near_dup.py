import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import near_dup
from marlstone.llm.components import components

from .helpers import odd_documents


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, rule):
    sets = {d: shingles(t, rule.words) for d, t in rows}
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= rule.percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets.items())


def family(seed, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 5000)}"
        out.append(" ".join(w))
    return out


def test_shingles():
    texts = ["A b  c\td", "a B C d", "one", "one two", "", None, "a b c a b c", "é É"]
    got = list(near_dup.shingle_sets(pa.array(texts), 3))
    assert [len(s) for s in got] == [len(shingles(t, 3)) for t in texts]
    assert (got[0] == got[1]).all() and not (got[2] == got[3][:1]).any()


def test_all_signatures_within_the_distance_meet():
    rule, rng = near_dup.CONTRACT, np.random.default_rng(1)
    kept = [np.array(k) for k in rule.keys()]
    assert rule.missed() < 2e-6 and near_dup.Rule().missed() < 2e-6
    for _ in range(300):
        a = rng.integers(0, 256, rule.indexed)
        b = a.copy()
        b[rng.choice(rule.indexed, rule.distance, replace=False)] += 1
        assert (near_dup.key_hashes(a[None].astype(np.uint64), kept) == near_dup.key_hashes(b[None].astype(np.uint64), kept)).any()


@pytest.mark.parametrize("rule", [near_dup.CONTRACT, near_dup.Rule()])
def test_against_all_pairs(spark, rule):
    texts = [*family(1, 25, 9), *family(2, 25, 14), *family(3, 12, 3), *family(3, 3, 0), "a b", "A  b", "x y z"]
    docs = odd_documents(spark, texts).repartition(3)
    got = sorted(map(tuple, near_dup.near_duplicates(docs, rule).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], rule)


def test_dropping(spark):
    docs = odd_documents(spark, family(5, 6, 0))
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    keep = {d for d, _, _, kept in brute([(r.doc_id, r.text) for r in docs.collect()], near_dup.Rule()) if kept}
    assert {r.doc_id for r in left.collect()} == keep
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 16, 1000])
def test_blocks_of_a_large_key(spark, block):
    """Pairs across components come out whole, each pair once, whatever the block size and the largest component."""
    rule = near_dup.CONTRACT
    salt = near_dup.salts(rule.indexed)
    sets = list(near_dup.shingle_sets(pa.array(family(8, 40, 4)), 3))
    sig = near_dup.symbols(raw := [near_dup.signature(s, salt) for s in sets])
    key = int(near_dup.key_hashes(sig[:1].astype(np.uint64), [np.array(k) for k in rule.keys()])[0, 0].view(np.int64))
    same = [i for i in range(40) if (sig[i] == sig[0])[list(rule.keys()[0])].all()]
    of = {i: 0 if i % 5 < 3 else i % 5 for i in same}
    size = {i: 110 if i % 7 else 200 for i in same}
    outside = sum(c > 0 for c in of.values())
    assert 3 < outside < len(same) / 2
    members = spark.createDataFrame([(key, i, of[i], 0, len(same), outside, bytearray(raw[i]), size[i], bytearray(near_dup.bucket_counts(sets[i]))) for i in same], "key long, id long, component long, center long, n long, outside long, signature binary, size long, counts binary")
    count = np.array([np.bincount((x >> np.uint64(55)).astype(int), minlength=512) for x in sets])
    most = lambda a, b: int(np.minimum(count[a], count[b]).sum())
    want = {(a, b) for a, b in combinations(same, 2) if of[a] != of[b] and size[a] == size[b] and (sig[a] != sig[b]).sum() <= rule.distance and 100 * most(a, b) >= 85 * (size[a] + size[b] - most(a, b))}
    assert len(want) > 20
    got = [tuple(r) for r in near_dup.across(members, rule, block).collect()]
    assert set(got) == want and len(got) == len(want)


def test_bucket_counts_bound_what_is_common():
    rng = np.random.default_rng(4)
    for n in (1, 50, 3000, 400_000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], rng.integers(0, 2**64, n // 10 + 1, dtype=np.uint64)]))
        x, y = (np.frombuffer(near_dup.bucket_counts(s), np.uint8)[None] for s in (a, b))
        both = len(np.intersect1d(a, b))
        assert near_dup.may_share(x, y)[0] >= both and (n > 100_000 or near_dup.may_share(x, y)[0] <= both + n / 10 + 1)


def test_a_large_group_that_its_first_member_does_not_hold_together(spark):
    """A chain of edits: most members are far from the smallest one, and some from all that were tried."""
    rng = random.Random(21)
    words, texts = [f"w{i}" for i in range(150)], []
    for _ in range(120):
        for _ in range(2):
            words[rng.randrange(150)] = f"e{rng.randint(0, 9999)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, near_dup.near_duplicates(docs, near_dup.CONTRACT).collect())) == brute(list(enumerate(texts)), near_dup.CONTRACT)


def test_repeated_and_null_ids(spark):
    """Every row is a document: two texts of one id are judged each by itself, rows without an id take no part."""
    a, b, c = family(31, 1, 0)[0], family(32, 1, 0)[0], family(33, 1, 0)[0]
    rows = [(2, a), (2, b), (1, b), (5, a), (5, a), (None, a), (None, a), (7, c), (7, c), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(shingles(a, 3))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, near_dup.CONTRACT).collect()), key=str)
    want = [(2, n, 2, True), (2, n, 1, False), (1, n, 1, True), (5, n, 2, False), (5, n, 2, False), (None, n, None, True), (None, n, None, True), (7, n, 7, True), (7, n, 7, True), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    left = sorted((tuple(r) for r in near_dup.drop_near_duplicates(docs, near_dup.CONTRACT).collect()), key=str)
    assert left == sorted((r for r in rows if r[0] != 5), key=str)


def test_components(spark, tmp_path):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 105), (105, 103), (7, 7), (200, 150)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 103: 100, 105: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/e").count() == 0


def test_components_of_a_shuffled_path(spark, tmp_path):
    ids = random.Random(1).sample(range(1000), 1000)
    path = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long").coalesce(1)
    got = components(path, f"file://{tmp_path}/p").collect()
    assert len(got) == 1000 and {r.component for r in got} == {0}


def test_small_tables_are_not_sent_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    rows = [(i, text) for i, text in enumerate([*family(1, 30, 2), *family(2, 30, 8)])]
    near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.CONTRACT).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList()
    nodes = [graph.apply(k).name() for i in range(before, done.size()) for graph in [store.planGraph(done.apply(i).executionId()).allNodes()] for k in range(graph.size())]
    assert "SortMergeJoin" in nodes and not {"BroadcastExchange", "BroadcastHashJoin"} & set(nodes)


def test_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*family(11, 9, 7), *family(12, 4, 2), None, "", "a b", "a B"])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(duckdb.sql(near_dup.SQL).fetchall()) == sorted(map(tuple, near_dup.op7_near_duplicates(spark, str(tmp_path)).collect())) == brute(rows, near_dup.CONTRACT)
