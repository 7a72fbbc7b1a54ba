import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v], "x", 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, v string, node int")


def test_few_vectors_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).astype(np.float32).astype(float)
    x[10:25] = x[3]  # equal vectors: ties by id
    df = frame(spark, range(60), x)
    assert found(ann.search(df, F.col("vec_id") % 20 == 0, k=7)) == brute(np.arange(60), x, [0, 20, 40], 7)


def test_recall_with_lengths(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32).astype(float)
    got = found(ann.search(frame(spark, range(1500), x), F.col("vec_id") % 100 == 0, k=10))
    want = brute(np.arange(1500), x, range(0, 1500, 100), 10)
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.95 * 150


def test_who_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (20, [0.5, 0.5]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(ann.search(df, F.col("vec_id") % 20 == 0)) == {0: [8, 20, 7], 20: [8, 0, 7]}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_scores_are_exact(spark):
    x = np.random.default_rng(4).normal(size=(30, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.search(df, F.col("vec_id") == 4, k=5).collect():
        assert r.score == pytest.approx(float(x[4] @ x[r.vec_id]), abs=1e-12)


def test_beam_and_steps_follow_the_count(spark, tmp_path):
    """A walk along a chain of 30 nodes, one in a step, comes to its end."""
    assert ann.Settings().among(80_000).beam >= 400
    rows = [(i, [float(np.cos(i / 30)), float(np.sin(i / 30))]) for i in range(30)]
    nodes = spark.createDataFrame(rows, "node long, v array<double>").coalesce(1)
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(29)], "u long, n long, d double").coalesce(1)
    root = ann.write_graph(chain, nodes, f"file://{tmp_path}/g", ann.Settings(), "<f8")
    graph = ann.Graph(root, "<f8")
    assert [x.tolist() for x in graph.links(np.array([0, 7, 29]))] == [[1], [6, 8], [28]]
    y = np.array([rows[29][1], rows[3][1]])
    got = ann.walk(graph, y, np.array([0, 3]), np.array([[0], [20]]), ann.Settings(beam=2, expand=1))
    assert got[0][0].tolist() == [29, 28] and got[1][0][0] == 3
    assert got[0][1].tolist() == pytest.approx([1.0, np.cos(1 / 30)], abs=1e-12)


def test_graph_in_many_files(spark, tmp_path, monkeypatch):
    """Nodes without links and stores that can't be mapped, with little to hold, read alike."""
    monkeypatch.setattr(ann, "RANGE", 8)
    x = np.random.default_rng(8).normal(size=(61, 5))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>").repartition(3)
    links = spark.createDataFrame([(i, (i * 7 + j) % 60, float(j)) for i in range(60) for j in (1, 2)], "u long, n long, d double")
    root = ann.write_graph(links, nodes, f"file://{tmp_path}/g", ann.Settings(back=1), "<f8")
    monkeypatch.setattr(ann, "HELD", 1)
    graph = ann.Graph(root, "<f8")
    graph.mapped = False
    for got, i in zip(graph.links(np.arange(61)), range(61), strict=True):
        own = {(i * 7 + j) % 60 for j in (1, 2)} if i < 60 else set()
        assert own <= set(got.tolist()) and len(got) <= len(own) + 1
    n, of = np.array([60, 3, 3, 17]), np.array([0, 1, 0, 1])
    assert np.allclose(graph.products(n, of, x[:2]), (x[n] * x[of]).sum(axis=1))
    assert len(graph.held) == 1


def test_whole_query(spark):
    """The query on a whole table: recall against all pairs, and exact scores, order and ranks."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    hits = asked = 0
    got = {}
    for r in ann.op4_nearest_neighbours(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(ids[ids % 20 == 0].tolist())
    for i in np.flatnonzero(ids % 20 == 0).tolist():
        s = x @ x[i]
        mine = sorted(got[ids[i]])
        assert [k for k, _, _ in mine] == list(range(1, 21)) and [(-z, v) for _, v, z in mine] == sorted((-z, v) for _, v, z in mine)
        assert all(abs(z - s[ids == v][0]) < 1e-12 for _, v, z in mine)
        best = {int(ids[j]) for j in [j for j in np.lexsort((ids, -s)).tolist() if j != i][:20]}
        hits, asked = hits + len(best & {v for _, v, _ in mine}), asked + 20
    assert hits >= 0.95 * asked


@pytest.mark.parametrize("longer", [1.0, 3000.0, 1e8])
def test_recall_with_one_long_vector(spark, longer):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[11] *= longer
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(ann.search(df, F.col("vec_id") % 100 == 0))
    want = brute(np.arange(2000), x, range(0, 2000, 100), 20)
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.95 * 400


def test_common_vectors_repeated_ids_and_ragged_rows(spark):
    """A third of the rows are one vector; ids come twice; vectors of another size take no part."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(90, 4))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(6, x[0].tolist()), (7, x[7].tolist()), (100, [1.0, 2.0]), (101, [])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 6 == 0, k=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(by) == list(range(0, 90, 6)) and len(by[6]) == 10
    for q, pairs in by.items():
        s = sorted((-float(np.dot(v, x[q])), i) for i, v in rows[:92] if i != q)[:5]
        assert sorted(set(pairs)) == [(k + 1, i) for k, (_, i) in enumerate(s)] or [round(z, 9) for z, _ in s] == [round(-float(x[i] @ x[q]), 9) for _, i in sorted(set(pairs))]


def test_links_stay_new_until_they_have_met(spark, tmp_path):
    """After one round (stop 2 ends it), a node has no more old links than were let meet."""
    x = np.random.default_rng(5).normal(size=(40, 4))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>").coalesce(1)
    points = ann.points_of(nodes, float(np.linalg.norm(x, axis=1).max()))
    s = ann.Settings(degree=24, sample=4, stop=2)
    graph = ann.neighbour_graph(points, 40, f"file://{tmp_path}/g", s).collect()
    assert max(sum(r.u == u and not r.new for r in graph) for u in range(40)) <= s.sample


def test_one_long_vector(spark):
    """Of nodes that meet, each learns of its nearest, also where one vector is 10,000 times as long."""
    x = np.random.default_rng(6).normal(size=(60, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 10_000
    sq = (x * x).sum(axis=1)
    rest = np.sqrt(np.maximum(sq.max() - sq, 0))
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) + (rest[:, None] - rest[None]) ** 2
    np.fill_diagonal(d, np.inf)
    want = {(u, int(n)) for u in range(60) for n in np.argsort(d[u])[:5]}
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>").coalesce(1)
    meeting = spark.createDataFrame([(0, i, 1e30, True) for i in range(60)], "place long, n long, far double, new boolean").coalesce(1)
    got = ann.local_join(meeting, ann.points_of(nodes, float(np.sqrt(sq.max()))), ann.Settings(degree=5)).collect()
    assert {(r.u, r.n) for r in got} == want
