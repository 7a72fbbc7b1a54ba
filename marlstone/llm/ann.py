"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node. Inner products become distances by one more coordinate, the square root
of the greatest squared length less the vector's own; for a query, whose extra coordinate is 0, nearer
is then exactly a larger inner product. The neighbour graph begins with the best among nodes that lie
next to each other in the order of a few space-filling keys of random projections; in each round every
node's neighbours, and those it is a neighbour of, are brought together in one place with their
vectors, and each learns of the better ones among the others. What travels for this is each vector's
direction in 32 bits and its length beside it; distances are taken from these in double precision, so
that a long vector doesn't blur the others.

The finished graph is written by ranges of nodes, each node's vector and links in one file. Each query
walks it: it looks at the neighbours of the best nodes that it hasn't looked at yet, and keeps the
best, until none of them is new. A task walks with a block of queries at a time, in step, and maps the
files; no vector is sent for it. Scores are of the original vectors in double precision.
"""

from __future__ import annotations

import math
import os
import posixpath
import struct
from collections import OrderedDict
from dataclasses import dataclass, replace
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, keyed, partitions, publish, stage, to_uri, work_dir


@dataclass(frozen=True)
class Settings:
    """degree: neighbours of a node; tables, window: keys at first, and nodes next to each other by a
    key that are compared; sample: neighbours of a node that meet in a round, each way; stop: rounds end
    when fewer than this share of the links are new, that is, have not met others yet; back: links to a
    node that it can be left by, besides its own; beam: nodes that a query keeps; expand: nodes that it
    looks at in a step; block: queries that walk together."""

    degree: int = 32
    tables: int = 4
    window: int = 256
    sample: int = 14
    stop: float = 0.1
    back: int = 64
    beam: int = 160
    expand: int = 32
    block: int = 128

    def among(self, count: int) -> Settings:
        """From 10,000 nodes on, a query keeps more of them, as the square root of their count."""
        beam = max(self.beam, math.ceil(1.6 * math.sqrt(count)))
        return replace(self, beam=beam, expand=max(self.expand, beam // 5))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part: no null, non-finite or all-zero vectors, no null ids."""
    v = F.transform(vector, lambda x: x.cast("double"))
    ok = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.withColumn("v", v).where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), "v")


def points_of(nodes: DataFrame, longest: float) -> DataFrame:
    """node, x, len: the vector's direction as float32 bytes, and its length as a share of the greatest."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, length = directions(stack(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(length / longest)], names=["node", "x", "len"])

    return nodes.select("node", "v").mapInArrow(run, "node long, x binary, len double")


def stack(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def longest_of(nodes: DataFrame) -> float:
    """The greatest length of a vector."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(directions(stack(batch.column(0)))[1].max())])], names=["len"])

    return nodes.select("v").mapInArrow(run, "len double").agg(F.max("len")).first()[0]


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its direction (float32) and length; scaled first, so that no square is lost."""
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / length).astype(np.float32), (length * top)[:, 0]


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).astype(np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Squared distances, with the extra coordinate, of all pairs: no term is a difference of large numbers."""
    sq = (x * x).sum(axis=1)
    apart = np.maximum(sq[:, None] + sq[None] - 2 * (x @ x.T), 0)
    less = length[:, None] - length[None]
    rest = np.sqrt(np.maximum((1 - length) * (1 + length), 0))
    both = rest[:, None] + rest[None]
    # the difference of the extra coordinates, from that of their squares
    extra = np.divide(less * (length[:, None] + length[None]), both, out=np.zeros_like(both), where=both > 0)
    return length[:, None] * length[None] * apart + less * less + extra * extra


def local_join(meeting: DataFrame, points: DataFrame, s: Settings) -> DataFrame:
    """Of each place's nodes: pairs (u, n, d) that are nearer than u's furthest neighbour.

    meeting: place, n, far (the distance of n's furthest neighbour), new (n came in the last round).
    """
    sent = meeting.join(points.withColumnRenamed("node", "n"), "n").select("place", "n", "far", "new", "x", "len").repartition(2 * partitions(points.sparkSession), "place").sortWithinPartitions("place", "n")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def settle(part: pa.RecordBatch):
            places, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
            far, new, x = part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False), matrix(part.column(4))
            length = part.column(5).to_numpy()
            cuts = np.flatnonzero(np.diff(places)) + 1
            us, ns, ds = [], [], []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
                if b - a < 2 or not new[a:b].any():
                    continue
                d = distances(x[a:b], length[a:b])
                np.fill_diagonal(d, np.inf)
                ok = (d < far[a:b, None]) & (new[a:b, None] | new[None, a:b])
                i, j = np.nonzero(ok)
                us.append(ids[a:b][i])
                ns.append(ids[a:b][j])
                ds.append(d[i, j])
            if us:
                u, n, d = np.concatenate(us), np.concatenate(ns), np.concatenate(ds)
                # each pair once, and of a node's finds the best ones
                order = np.lexsort((n, d, u))
                u, n, d = u[order], n[order], d[order]
                fresh = np.ones(len(u), bool)
                fresh[1:] = (u[1:] != u[:-1]) | (n[1:] != n[:-1])
                u, n, d = u[fresh], n[fresh], d[fresh]
                starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                place = np.arange(len(u)) - np.repeat(starts, np.diff([*starts.tolist(), len(u)]))
                few = place < s.degree
                yield pa.RecordBatch.from_arrays([pa.array(u[few]), pa.array(n[few]), pa.array(d[few])], names=["u", "n", "d"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # a place's rows may go on in the next batch
            held.append(batch)
            rows += batch.num_rows
            if rows > 20_000:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                p = whole.column(0).to_numpy()
                cut = int(np.searchsorted(p != p[-1], False)) if p[0] == p[-1] else int(np.flatnonzero(p != p[-1])[-1]) + 1
                if p[0] != p[-1]:
                    yield from settle(whole.slice(0, cut))
                    held, rows = [whole.slice(cut)], whole.num_rows - cut
        if rows:
            yield from settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return sent.mapInArrow(run, "u long, n long, d double")


def curve_places(x: np.ndarray, table: int, dims: int = 16, bits: int = 3) -> np.ndarray:
    """Keys of directions on a Z-order curve through `dims` random projections, others for each table."""
    axes = np.random.default_rng(table).standard_normal((x.shape[1], dims))
    at = x @ (axes / np.linalg.norm(axes, axis=0)) * math.sqrt(x.shape[1])
    cell = ((0.5 + 0.5 * np.tanh(0.8 * at)) * (1 << bits)).clip(0, (1 << bits) - 1).astype(np.int64)
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for j in range(dims):
            key = key << 1 | (cell[:, j] >> b & 1)
    return key


def first_links(points: DataFrame, s: Settings) -> DataFrame:
    """u, n, d: for each node the best among those next to it in the order of a table's keys."""
    keep = max(4, math.ceil(1.5 * s.degree / s.tables))

    def key(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                for t in range(s.tables):
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pa.array(curve_places(x, t)), *batch.columns], names=["t", "key", "node", "x", "len"])

    def compare(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 16 * s.window:
                whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                # the last window waits for what may be a short rest
                cut = (whole.num_rows // s.window - 1) * s.window
                yield from windows(whole.slice(0, cut))
                waiting = [whole.slice(cut)]
        if waiting:
            yield from windows(pa.Table.from_batches(waiting).combine_chunks())

    def windows(part):
        n = part.num_rows
        cuts = list(range(0, n, s.window)) + [n]
        if len(cuts) > 2 and n - cuts[-2] < s.window // 2:
            del cuts[-2]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            rows = part.slice(a, b - a)
            rows = rows.combine_chunks().to_batches()[0] if isinstance(rows, pa.Table) else rows
            ids, x, length = rows.column(0).to_numpy(), matrix(rows.column(1)), rows.column(2).to_numpy()
            d = distances(x, length)
            d[ids[:, None] == ids[None]] = np.inf
            few = min(keep, len(ids) - 1)
            near = np.argpartition(d, few - 1, axis=1)[:, :few]
            u, n_, d_ = np.repeat(ids, few), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()
            ok = np.isfinite(d_)
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(n_[ok]), pa.array(d_[ok])], names=["u", "n", "d"])

    placed = points.select("node", "x", "len").mapInArrow(key, "t int, key long, node long, x binary, len double")
    dealt = placed.repartitionByRange(2 * partitions(points.sparkSession), "t", "key", "node").sortWithinPartitions("t", "key", "node")
    return dealt.select("node", "x", "len").mapInArrow(compare, "u long, n long, d double")


def neighbour_graph(points: DataFrame, count: int, folder: str, s: Settings) -> DataFrame:
    """u, n, d: each node's nearest found, `degree` of them. Nodes are numbered 0 .. count - 1."""
    k = min(s.degree, count - 1)
    w = Window.partitionBy("u").orderBy("d", "n")
    begin = first_links(points, s).groupBy("u", "n").agg(F.min("d").alias("d")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    graph = stage(_drawn(begin.withColumn("new", F.lit(True)), 1, s), f"{folder}/graph-0")
    # ends by itself: a link comes only in place of a longer one
    for r in count_from(1):
        far = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(1e30)).alias("far"))
        # what meets at a place: those of its neighbours that go, and some of those it is a neighbour of, new ones first
        back = graph.select(F.col("n").alias("place"), F.col("u").alias("n"), "new")
        met = graph.where("go").select(F.col("u").alias("place"), "n", "new").union(_few(back, r, s)).groupBy("place", "n").agg(F.max("new").alias("new"))
        meeting = met.join(far.withColumnRenamed("u", "n"), "n")
        found = local_join(meeting, points, s)
        # a link that didn't go stays new
        old = graph.select("u", "n", "d", (F.col("new") & ~F.col("go")).alias("new"))
        # rank by distance; a pair that was there keeps its age
        every = old.union(found.select("u", "n", "d", F.lit(True).alias("new"))).groupBy("u", "n").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        ranked = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
        graph = stage(_drawn(ranked, r + 1, s), f"{folder}/graph-{r}")
        delete(points.sparkSession, f"{folder}/graph-{r - 1}")
        if graph.where("new").count() < s.stop * k * count:
            return graph


def _salted(place: str, other: str, r: int) -> Column:
    """The order in which the links of a place are drawn in round r: new ones first, by a hash."""
    return F.when(F.col("new"), F.lit(0.0)).otherwise(F.lit(1.0)) + F.pmod(F.xxhash64(place, other, F.lit(r)), F.lit(1 << 20)) / float(1 << 20)


def _drawn(graph: DataFrame, r: int, s: Settings) -> DataFrame:
    """graph with go: the link is one of the `sample` of its node that meet in round r."""
    w = Window.partitionBy("u").orderBy(_salted("u", "n", r), "n")
    return graph.withColumn("go", F.row_number().over(w) <= s.sample)


def _few(back: DataFrame, r: int, s: Settings) -> DataFrame:
    """place, n, new: the `sample` first of each place."""
    w = Window.partitionBy("place").orderBy(_salted("place", "n", r), "n")
    return back.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.sample).drop("rank")


#: Nodes of a graph file, and bytes of files that a worker holds where the store can't map them.
RANGE, HELD = 1 << 14, 256 << 20


def write_graph(graph: DataFrame, nodes: DataFrame, folder: str, s: Settings, kind: str) -> str:
    """Writes files of RANGE nodes each: every node's vector (numbers of `kind`), its own links, and
    `back` of those that lead to it (the nearest; their other ends keep theirs). Returns the folder."""
    spark = nodes.sparkSession
    w = Window.partitionBy("from").orderBy("d", "n")
    back = graph.select(F.col("n").alias("from"), F.col("u").alias("n"), "d").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.back).select("from", "n")
    links = graph.select(F.col("u").alias("from"), "n").union(back).distinct().groupBy("from").agg(F.sort_array(F.collect_list("n")).alias("links"))
    rows = nodes.select("node", "v").join(links, F.col("node") == F.col("from"), "left").select(F.shiftright("node", RANGE.bit_length() - 1).alias("range"), "node", "v", F.coalesce("links", F.array().cast("array<long>")).alias("links"))
    root = to_uri(folder)

    def run(batches):
        from pyarrow import fs as pafs

        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        at, parts = None, []

        def flush():
            n = sum(p.num_rows for p in parts)
            data = np.concatenate([stack(p.column(2)) for p in parts]).astype(kind)
            sizes = np.concatenate([[0], *(np.diff(p.column(3).offsets.to_numpy()) for p in parts)])
            flat = np.concatenate([p.column(3).flatten().to_numpy() for p in parts]).astype("<i8")
            own = posixpath.join(base, f"_{at:08d}.{os.getpid()}.{os.urandom(4).hex()}")
            with store.open_output_stream(own) as out:
                out.write(struct.pack("<4sIQQ8x", b"NNG1", data.shape[1], n, len(flat)))
                for x in (np.cumsum(sizes).astype("<i8"), flat, data):
                    out.write(x.tobytes())
            publish(store, own, posixpath.join(base, f"{at:08d}.nng"))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n], pa.int64())], names=["range", "n"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if parts and of[a] != at:
                    yield flush()
                    parts = []
                at = int(of[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield flush()

    dealt = rows.repartition(partitions(spark), "range").sortWithinPartitions("range", "node")
    stage(dealt.mapInArrow(run, "range long, n long"), f"{folder}-files")
    return root


class Graph:
    """A worker's view of the files of write_graph()."""

    def __init__(self, root: str, kind: str):
        from pyarrow import fs as pafs

        self.kind, self.held, self.size = np.dtype(kind), OrderedDict(), 0
        self.store, self.base = pafs.FileSystem.from_uri(root)
        self.mapped = isinstance(self.store, pafs.LocalFileSystem)

    def _range(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a range: where each node's links begin and end, all links, the vectors."""
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        path = posixpath.join(self.base, f"{k:08d}.nng")
        if self.mapped:
            data = pa.memory_map(path).read_buffer()
        else:
            with self.store.open_input_file(path) as f:
                data = f.read_buffer()
            self.size += data.size
        _, width, n, m = struct.unpack_from("<4sIQQ", data)
        starts = np.frombuffer(data, "<i8", n + 1, 32)
        links = np.frombuffer(data, "<i8", m, 32 + starts.nbytes)
        self.held[k] = starts, links, np.frombuffer(data, self.kind, n * width, 32 + starts.nbytes + links.nbytes).reshape(n, width)
        while self.size > HELD and len(self.held) > 1:
            self.size -= sum(x.nbytes for x in self.held.popitem(last=False)[1])
        return self.held[k]

    def _by_range(self, ids: np.ndarray):
        """Places of ascending ids by range, and the range's data."""
        of = ids // RANGE
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield a, b, ids[a:b] - of[a] * RANGE, self._range(int(of[a]))

    def links(self, ids: np.ndarray) -> list[np.ndarray]:
        """The links of each of ascending ids."""
        return [links[starts[i] : starts[i + 1]] for _, _, own, (starts, links, _) in self._by_range(ids) for i in own.tolist()]

    def products(self, n: np.ndarray, of: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Inner products of the vectors of nodes n and the rows `of` of y, in double precision."""
        out, order = np.empty(len(n)), np.argsort(n, kind="stable")
        step = max(1, (8 << 20) // (8 * y.shape[1]))
        for a, b, own, (_, _, x) in self._by_range(n[order]):
            for k in range(a, b, step):
                at = order[k : min(b, k + step)]
                out[at] = np.einsum("nd,nd->n", x[own[k - a : k - a + len(at)]].astype(np.float64), y[of[at]])
        return out


def walk(graph: Graph, y: np.ndarray, own: np.ndarray, entries: np.ndarray, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """The beam of each query, best first: nodes and inner products. y: the queries' vectors, own: their
    nodes, entries: a row of further nodes to begin at for each. Ends by itself: no node is met twice."""
    size = len(own)
    met = [np.unique(np.append(e, o)) for e, o in zip(entries, own.tolist(), strict=True)]
    n, score, seen = [np.zeros(0, np.int64)] * size, [np.zeros(0)] * size, [np.zeros(0, bool)] * size
    found: list[tuple[int, np.ndarray]] = list(enumerate(met))
    while found:
        of = np.repeat([i for i, _ in found], [len(c) for _, c in found])
        scores = graph.products(np.concatenate([c for _, c in found]), of, y)
        at, fronts = 0, []
        for i, c in found:
            both, marks = np.concatenate([n[i], c]), np.concatenate([seen[i], np.zeros(len(c), bool)])
            value = np.concatenate([score[i], scores[at : at + len(c)]])
            at += len(c)
            best = np.lexsort((both, -value))[: s.beam]
            n[i], score[i], seen[i] = both[best], value[best], marks[best]
            front = np.flatnonzero(~seen[i])[: s.expand]
            if len(front):
                seen[i][front] = True
                fronts.append((i, n[i][front]))
        found = []
        if fronts:
            nodes = np.unique(np.concatenate([f for _, f in fronts]))
            links = graph.links(nodes)
            for i, f in fronts:
                new = np.unique(np.concatenate([links[k] for k in np.searchsorted(nodes, f).tolist()]))
                place = np.searchsorted(met[i], new)
                new = new[met[i][np.minimum(place, len(met[i]) - 1)] != new]
                met[i] = np.sort(np.concatenate([met[i], new]), kind="stable")
                found.append((i, new))
    return list(zip(n, score, strict=True))


def greedy_search(asked: DataFrame, root: str, kind: str, count: int, s: Settings, best: int) -> DataFrame:
    """q, n, score: the `best` first of each query's beam. asked: q (a node), v (its vector)."""

    def run(batches):
        graph = Graph(root, kind)
        for batch in batches:
            for k in range(0, batch.num_rows, s.block):
                part = batch.slice(k, s.block)
                own = part.column(0).to_numpy()
                # a query begins at its own node and a few nodes anywhere
                entries = np.stack([np.random.default_rng(q).integers(0, count, 8) for q in own.tolist()])
                got = [(n[:best], x[:best]) for n, x in walk(graph, stack(part.column(1)), own, entries, s)]
                q = np.repeat(own, [len(n) for n, _ in got])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([n for n, _ in got])), pa.array(np.concatenate([x for _, x in got]))], names=["q", "n", "score"])

    return asked.select("q", "v").mapInArrow(run, "q long, n long, score double")


def search(df: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k found nearest to each query by inner product, the query's own
    row left out; ties go to the smaller vec_id. queries: the condition that makes a row a query.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids;
    nor, where vectors have different numbers of components, those that haven't the most common one (the
    greatest of equally common ones). With too few candidates all come; without any the result is empty.
    Rows with the same vec_id are candidates each by itself, and queries each by itself; such a query
    has no row of its vec_id among its results.
    """
    spark = df.sparkSession
    folder = work_dir(spark) + "/ann"
    kind = "<f4" if df.schema[vector].dataType.elementType == T.FloatType() else "<f8"
    rows = stage(usable(df, vec_id, vector), f"{folder}/all")
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == width.w)
    # equal vectors are one node
    nodes = stage(_numbered(rows.select("v").distinct(), folder), f"{folder}/nodes")
    count = nodes.count()
    s = (settings or Settings()).among(count)
    asked = stage(rows.where(queries).join(nodes, "v").select(F.col("vec_id").alias("query_id"), "node"), f"{folder}/asked")
    if count > 1:
        points = stage(points_of(nodes, longest_of(nodes)), f"{folder}/points")
        graph = neighbour_graph(points, count, folder, s)
    else:
        graph = spark.createDataFrame([], "u long, n long, d double")
    root = write_graph(graph, nodes, f"{folder}/files", s, kind)
    q = nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("q"), "v").repartition(2 * partitions(spark), "q")
    found = stage(greedy_search(q, root, kind, count, s, 3 * k), f"{folder}/found")
    return _rows(asked, found, rows, nodes, k)


def _numbered(vectors: DataFrame, folder: str) -> DataFrame:
    """node, v: numbers 0 .. n - 1 in some order; a partition's first number is the sum of those before."""
    spark = vectors.sparkSession
    parts = stage(vectors.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), f"{folder}/parts")
    total, starts = 0, []
    for part, n in sorted(tuple(r) for r in parts.groupBy("part").count().collect()):  # a row per partition
        starts.append((part, total))
        total += n
    at = spark.createDataFrame(starts, "part int, start long")
    return parts.join(F.broadcast(at), "part").select((F.col("start") + F.col("i")).alias("node"), "v")


def _rows(asked: DataFrame, found: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, from the nodes found."""
    # of a node's rows only the k + 1 smallest ids can be in a result: a partition sends no more
    few = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).join(nodes, "v").select("node", "vec_id")
    # and of what a vector finds, only the k + 1 best rows in that of its query rows
    order = [F.desc("score"), "vec_id"]
    best = found.join(first, F.col("n") == F.col("node")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    pairs = asked.withColumn("row", F.monotonically_increasing_id()).join(best, F.col("node") == F.col("q")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by 20, the 20 nearest found among all rows."""
    vectors = keyed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec_id="vec_id", embedding="embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)
