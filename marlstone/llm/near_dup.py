"""Near duplicates: b-bit MinHash signatures, joined by their Hamming distance, confirmed on full sets.

A document is the set of its word shingles. Equal sets become one class first. A class has a
signature of `indexed` symbols of 16 bits. Of two sets with similarity s a symbol differs with
probability 1 - s at most; at the similarity asked for, more than `distance` of the symbols differ with
probability below 1e-6. The symbols are cut into chunks, so that of two signatures within the distance
some chunk has few errors (pigeonhole); for each chunk every choice of that many symbols is left out in
turn and the rest is a key. So all pairs within the distance meet in a key, without exception.

What is asked for are the links' components, so not all pairs of a key's members are compared. First,
each class is compared with the smallest class of each of its keys, and joined to the likest if they
are confirmed. Where a key's members are in several components then, those outside the largest one are
compared with one of its members in the same way. Last, in keys that are still in several components,
every member outside the largest one is compared with every member of another component, in blocks; a
pair comes from the first key that it shares. So every pair within the distance is looked at, or is in
one component already. What is within the distance is confirmed on the full sets, unless the sizes of
the sets rule it out, or how many elements each has in each of BUCKETS parts of the hashes' range: no
more elements are common to two sets than the smaller numbers of the parts add up to.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, documents, keyed, merged, partitions, release, stage, work_dir
from .components import components
from .segments import cut, slices

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MIX[1]
    x = (x ^ x >> np.uint64(29)) * MIX[2]
    return x ^ x >> np.uint64(32)


@dataclass(frozen=True)
class Rule:
    """Links sets with percent * union <= 100 * intersection, of shingles of `words` words."""

    words: int = 5
    percent: int = 80
    indexed: int = 64
    distance: int = 31
    chunks: int = 16

    @property
    def errors(self) -> int:
        """Errors that some chunk is within, if the signatures are within the distance."""
        return self.distance // self.chunks

    def missed(self) -> float:
        """A bound for the chance that a pair of just the similarity asked for is beyond the distance."""
        p, n = 1 - self.percent / 100, self.indexed
        return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(self.distance + 1, n + 1))

    def sizes(self, x, y):
        """Whether sets of x and y elements can be similar enough."""
        return (100 * x >= self.percent * y) & (100 * y >= self.percent * x)

    def keys(self) -> list[tuple[int, ...]]:
        """The symbols of each key."""
        cuts = [round(i * self.indexed / self.chunks) for i in range(self.chunks + 1)]
        return [kept for a, b in zip(cuts, cuts[1:], strict=False) for kept in combinations(range(a, b), max(1, b - a - self.errors))]


#: The rule of the contract's query. Some chunk of 13 has 1 error at most, up to distance 25.
CONTRACT = Rule(words=3, percent=85, distance=25, chunks=13)


def shingle_sets(texts: pa.Array, words: int):
    """For each text its set of shingles as sorted distinct 64-bit hashes.

    A-Z are lower-cased; words are what ASCII white space separates. A text of fewer words than a
    shingle has is one shingle; one without words has none.
    """
    import xxhash

    for part in slices(texts, 4 << 20):
        codes, kinds, n = cut(pc.ascii_split_whitespace(pc.ascii_lower(part)))
        h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) if w else 0 for w in kinds), np.uint64, len(kinds))[codes]
        full = np.fromiter((w != "" for w in kinds), bool, len(kinds))[codes]
        of = np.repeat(np.arange(len(part)), n)
        h, n = h[full], np.bincount(of[full], minlength=len(part))
        # windows over everything; those that begin near a text's end are not used
        grams = h.copy()
        for k in range(1, words):
            grams[: len(h) - k] = mix(grams[: len(h) - k] * MIX[0] + h[k:])
        end = 0
        for m in n.tolist():
            start, end = end, end + m
            if m >= words:
                yield np.unique(grams[start : end - words + 1])
            elif m:
                x = np.uint64([m])
                for v in h[start:end]:
                    x = mix(x * MIX[0] + v)
                yield x
            else:
                yield h[:0]


def salts(hashes: int) -> np.ndarray:
    return mix(np.arange(1, hashes // 2 + 1, dtype=np.uint64) * MIX[0])


#: A symbol's type; the parts of the hashes' range whose elements are counted, up to MANY.
SYMBOL, BUCKETS, MANY = "<u2", 512, 255


def bucket_counts(s: np.ndarray) -> bytes:
    """How many elements of a set are in each part, MANY where they are as many or more."""
    return np.minimum(np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=BUCKETS), MANY).astype(np.uint8).tobytes()


def may_share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of bucket counts, an upper bound for the elements that the sets have in common."""
    bound = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    # where both have MANY or more, the counts tell no bound
    return np.where(((x == MANY) & (y == MANY)).any(axis=1), np.iinfo(np.int64).max >> 8, bound)


def signature(s: np.ndarray, salt: np.ndarray) -> bytes:
    """A symbol for each hash function, of the element that it puts first. The halves of a 64-bit hash
    are two functions."""
    least = np.full(2 * len(salt), np.uint32(2**32 - 1))
    for k in range(0, len(s), 512):
        np.minimum(least, ((s[k : k + 512, None] ^ salt) * MIX[1]).view(np.uint32).min(axis=0), out=least)
    return (mix(least.astype(np.uint64) * MIX[0]) >> np.uint64(48)).astype(SYMBOL).tobytes()


def symbols(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of symbols."""
    return np.frombuffer(b"".join(signatures), SYMBOL).reshape(len(signatures), -1)


def fingerprints(df: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash (128 bits of the set; null if empty), signature."""

    def run(batches):
        import xxhash

        release()
        salt = salts(rule.indexed)
        for batch in batches:
            n, h, sig = [], [], []
            for s in shingle_sets(batch.column(2), rule.words):
                n.append(len(s))
                h.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s, salt) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_hash", "signature"])

    return keyed(df, doc_id=doc_id, text_hash=F.xxhash64(text), text=text).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash binary, signature binary")


def full_sets(df: DataFrame, classes: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """id, elements (the sorted shingle hashes) and counts (of the buckets) of the classes, from the text that each has first."""

    def run(batches):
        release()
        for batch in batches:
            sets = [(s.tobytes(), bucket_counts(s)) for s in shingle_sets(batch.column(1), rule.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in sets], pa.binary()) for k in (0, 1))], names=["id", "elements", "counts"])

    wanted = classes.select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    # a repeated row is one text
    texts = keyed(df, doc_id=doc_id, text_hash=F.xxhash64(text), text=text).join(merged(wanted), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return texts.select("id", "text").mapInArrow(run, "id long, elements binary, counts binary")


def key_hashes(sig: np.ndarray, kept: list[np.ndarray]) -> np.ndarray:
    """Hashes of all keys: (keys, signatures)."""
    out = np.empty((len(kept), len(sig)), np.uint64)
    for t, places in enumerate(kept):
        key = np.full(len(sig), np.uint64(t + 1))
        for p in places:
            key = mix(key * MIX[0] + sig[:, p])
        out[t] = key
    return out


def chunk_keys(classes: DataFrame, rule: Rule) -> DataFrame:
    """key, id for every key of every class."""
    kept = [np.array(k) for k in rule.keys()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = symbols(part.column(1).to_pylist()).astype(np.uint64)
                ids = part.column(0)
                for key in key_hashes(sig, kept):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def within(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """a, b, apart (differing symbols) of the pairs within the distance whose sizes don't rule them out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (symbols(batch.column(k).to_pylist()) for k in (2, 3))
                apart = (x != y).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart, pa.int64())], names=["a", "b", "apart"]).filter(pa.array(apart <= rule.distance))

    one, other = (classes.select(F.col("id").alias(i), F.col("signature").alias(x), F.col("n_shingles").alias(n)) for i, x, n in (("a", "x", "m"), ("b", "y", "n")))
    both = pairs.join(merged(one), "a").join(merged(other), "b").where(rule.sizes(F.col("m"), F.col("n"))).select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long, apart long")


def likest(pairs: DataFrame) -> DataFrame:
    """a, b: of each b the a that is least apart."""
    return pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b")


def confirm(pairs: DataFrame, sets: DataFrame, rule: Rule, spread: int = 64) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. sets: id, elements.

    A pair goes to a place by a and a salt from b, with b's set; a's set goes once to each place that it
    has pairs in. So a class with very many pairs is spread, and a task holds one set of a class and one
    more at a time.
    """
    placed = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(spread)).alias("salt"))
    anchors = placed.select("a", F.lit(None).cast("long").alias("b"), "salt").distinct()
    sides = placed.select("a", "b", "salt", F.col("b").alias("id")).union(anchors.select("a", "b", "salt", F.col("a").alias("id")))
    sent = sides.join(merged(sets.select("id", "elements")), "id").select("a", "salt", "b", "elements").repartition(partitions(sets.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches):
        release()
        anchor = own = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, salt, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(data, np.uint64)
                if b is None:
                    anchor, own = (a, salt), s
                    continue
                if anchor != (a, salt):
                    raise RuntimeError("a pair came without its first set")
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both and 100 * both >= rule.percent * (len(own) + len(s) - both):
                    out[0].append(a)
                    out[1].append(b)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def mixed_keys(shared: DataFrame, label: DataFrame) -> DataFrame:
    """key, id, component, center (the key's largest component), n (members), outside (those not in it), of
    the keys whose members are in several components. label: id, component."""
    found = shared.select("key", "id").join(merged(label), "id")
    per = found.groupBy("key", "component").agg(F.count("*").alias("m"))
    keys = per.groupBy("key").agg(F.max(F.struct("m", "component")).alias("x"), F.sum("m").alias("n"), F.count("*").alias("k")).where("k > 1")
    return found.join(merged(keys.select("key", F.col("x.component").alias("center"), "n", (F.col("n") - F.col("x.m")).alias("outside"))), "key")


def near_center(members: DataFrame, few: int = 1) -> DataFrame:
    """a, b: members of a key's largest component, a few of them by a hash, and its members outside."""
    by = Window.partitionBy("key").orderBy(F.xxhash64("a"), "a")
    some = members.where("component = center").select("key", F.col("id").alias("a")).withColumn("place", F.row_number().over(by)).where(F.col("place") <= few).select("key", "a")
    return members.where("component <> center").select("key", F.col("id").alias("b")).join(merged(some), "key").select("a", "b").distinct()


def across(members: DataFrame, rule: Rule, block: int = 1024) -> DataFrame:
    """Pairs (a, b) of members of one key but of different components, within the distance and of fitting sizes.

    members: key, id, component, center, n, outside, signature, size, counts. One of a pair is outside the key's
    largest component. So a key's members, and those outside, are dealt into blocks, and every two blocks
    of the one and the other meet in a place of their own, with 2 * block rows or a few more.
    """
    rows, columns = (F.ceil(F.col(c) / block).cast("long") for c in ("n", "outside"))
    row, column, out = F.pmod(F.xxhash64("id"), rows), F.pmod(F.xxhash64("id", F.lit(1)), columns), F.col("component") != F.col("center")
    place = lambda i, j, inside, outside: F.struct(i.alias("i"), j.alias("j"), inside.alias("inside"), outside.alias("outside"))
    zero, yes, no = F.lit(0).cast("long"), F.lit(True), F.lit(False)
    as_member = F.transform(F.sequence(zero, F.col("columns") - 1), lambda j: place(F.col("row"), j, yes, F.col("out") & (j == F.col("column"))))
    as_outer = F.transform(F.filter(F.sequence(zero, F.col("rows") - 1), lambda i: F.col("out") & (i != F.col("row"))), lambda i: place(i, F.col("column"), no, yes))
    dealt = members.select("key", "id", "component", "signature", "counts", "size", rows.alias("rows"), columns.alias("columns"), row.alias("row"), column.alias("column"), out.alias("out"))
    dealt = dealt.withColumn("at", F.explode(F.concat(as_member, as_outer))).select("key", "at.i", "at.j", "at.inside", "at.outside", "id", "component", "size", "signature", "counts")
    dealt = dealt.repartition(partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    kept = [np.array(k) for k in rule.keys()]
    longest = max(map(len, kept))
    places = np.array([[*k, *[k[-1]] * (longest - len(k))] for k in rule.keys()])

    def settle(part: pa.RecordBatch) -> pa.RecordBatch:
        """The pairs of whole places."""
        key, i, j, inside, outside, ids, comp, size = (part.column(k).to_numpy(zero_copy_only=False) for k in range(8))
        sig = symbols(part.column(8).to_pylist())
        counts = np.frombuffer(b"".join(part.column(9).to_pylist()), np.uint8).reshape(len(sig), -1)
        change = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(key)]
        turns = (key_hashes(sig[cuts[:-1]].astype(np.uint64), kept).view(np.int64) == key[cuts[:-1]]).argmax(axis=0)
        out: tuple[list, list] = ([], [])
        xs, ys, ts, waiting = [], [], [], 0

        def judge() -> None:
            nonlocal xs, ys, ts, waiting
            if not xs:
                return
            x, y, turn = np.concatenate(xs), np.concatenate(ys), np.concatenate(ts)
            xs, ys, ts, waiting = [], [], [], 0
            for k in range(0, len(x), 8192):
                p, q, t = x[k : k + 8192], y[k : k + 8192], turn[k : k + 8192]
                same = sig[p] == sig[q]
                ok = same.sum(axis=1) >= rule.indexed - rule.distance
                p, q, t, same = p[ok], q[ok], t[ok], same[ok]
                ok = same[:, places].all(axis=2).argmax(axis=1) == t  # the first key that they share
                p, q = p[ok], q[ok]
                common = may_share(counts[p], counts[q])
                ok = 100 * common >= rule.percent * (size[p] + size[q] - common)
                p, q = ids[p[ok]], ids[q[ok]]
                out[0].append(np.minimum(p, q))
                out[1].append(np.maximum(p, q))

        for turn, a, b in zip(turns.tolist(), cuts, cuts[1:], strict=False):
            outer, inner = a + np.flatnonzero(outside[a:b]), a + np.flatnonzero(inside[a:b])
            for k in range(0, len(outer), 128):
                x, y = (m.ravel() for m in np.meshgrid(outer[k : k + 128], inner, indexing="ij"))
                # of two members outside the largest component, each is in the other's place too
                ok = (comp[x] != comp[y]) & rule.sizes(size[x], size[y])
                xs.append(x[ok])
                ys.append(y[ok])
                ts.append(np.full(len(xs[-1]), turn))
                waiting += len(xs[-1])
                if waiting > 50_000:
                    judge()
        judge()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            key, i, j = (whole.column(k).to_numpy() for k in range(3))
            other = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last place may go on
            if cut:
                yield settle(whole.slice(0, cut))
            held = [whole.slice(cut)]
        if held:
            yield settle(held[0])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def nearest_links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, rule: Rule, folder: str) -> DataFrame:
    """Of each b in the pairs (a, b) the likest a within the distance, if their full sets are similar enough.

    Each step is a table: one plan of all of them would keep the figures of all their tasks in the driver.
    """
    spark = pairs.sparkSession
    pairs = stage(pairs, f"{folder}/pairs")
    best = stage(likest(within(pairs, classes, rule)), f"{folder}/best")
    links = stage(confirm(best, sets, rule), f"{folder}/links")
    for name in ("pairs", "best"):
        delete(spark, f"{folder}/{name}")
    return links


def joined(label: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """label (id, component) after the components of the pairs (a, b) have been joined."""
    of = lambda c: merged(label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")))
    edges = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    onto = components(edges, folder).select(F.col("id").alias("component"), F.col("component").alias("onto"))
    return stage(label.join(merged(onto), "component", "left").select("id", F.coalesce("onto", "component").alias("component")), f"{folder}/label")


def near_duplicates(df: DataFrame, rule: Rule | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to), kept (it is that).

    Null and empty texts, and those without words, have no shingles and are linked with nothing. Every
    row is a document: rows of one doc_id with different texts are linked by their texts alone, each with
    a result of its own, and repeated rows come back repeated. A row without a doc_id takes no part, has
    no component_id and is kept. Of an empty table nothing comes.
    """
    rule = rule or Rule()
    spark = df.sparkSession
    folder = work_dir(spark) + "/near"
    prints = stage(fingerprints(df, rule, doc_id, text), f"{folder}/prints")
    some = prints.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    # a class has a number of its own, which the written table fixes
    grouped = some.groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = stage(grouped.withColumn("id", F.monotonically_increasing_id()), f"{folder}/classes")
    keys = stage(chunk_keys(classes, rule), f"{folder}/keys")
    sizes = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    shared = stage(keys.join(merged(sizes), "key").select("key", "id", "lead"), f"{folder}/shared")
    delete(spark, f"{folder}/keys")
    label = stage(shared.select("id").distinct().withColumn("component", F.col("id")), f"{folder}/label-0")
    sets = stage(full_sets(df, classes.join(merged(label.select("id")), "id", "left_semi"), rule, doc_id, text), f"{folder}/sets")
    leads = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    stars = nearest_links(leads, classes, sets, rule, f"{folder}/stars")
    label = joined(label, stars, f"{folder}/round-1")
    members = mixed_keys(shared, label)
    more = nearest_links(near_center(members), classes, sets, rule, f"{folder}/more")
    label = joined(label, more, f"{folder}/round-2")
    members = mixed_keys(shared, label).join(merged(classes.select("id", "signature", F.col("n_shingles").alias("size"))), "id").join(merged(sets.select("id", "counts")), "id")
    rest = stage(across(members, rule), f"{folder}/rest")
    label = joined(label, stage(confirm(rest, sets, rule), f"{folder}/last"), f"{folder}/round-3")
    member = classes.join(merged(label), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"), "first.doc_id")
    least = member.groupBy("component").agg(F.min("doc_id").alias("least"))
    found = stage(member.join(merged(least), "component").select("set_hash", "least"), f"{folder}/least")
    for name in ("shared", "sets", "stars", "more", "rest", "last", "label-0", "classes", "round-1", "round-2", "round-3"):
        delete(spark, f"{folder}/{name}")
    out = prints.join(merged(found), "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_duplicates(df: DataFrame, rule: Rule | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's rows without those that near_duplicates() doesn't keep; columns stay.

    Rows of one doc_id go together if all of them are linked to a smaller one, and stay together otherwise.
    """
    judged = near_duplicates(df, rule, doc_id, text)
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("stays")).where("NOT stays").select(F.col("doc_id").alias("__gone"))
    return df.join(merged(gone), df[doc_id] == gone["__gone"], "left_anti")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_shingles, component_id and kept of every document, by the rule CONTRACT."""
    return near_duplicates(documents(spark, sf_dir), CONTRACT)


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id, sizes.n
"""
