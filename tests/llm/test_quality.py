import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from marlstone.llm import quality_crf as q
from marlstone.llm.segments import slices

from .helpers import ODD, fuzz, odd_documents


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen3, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen3[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


TEXTS = [*ODD, *fuzz(800, 7), "a b c a b c a", "x\nx\n\nx\n", "a b\nc a b\nc d"]


def test_base_measures():
    got = []
    for part in slices(pa.array(TEXTS, pa.string()), 2000):
        m = q.measure(part)
        got += list(zip(*(m.base[k].tolist() for k in q.BASE), strict=True))
    assert got == [brute(t) for t in TEXTS]


def test_windows_beyond_64_bits():
    rng = np.random.default_rng(3)
    codes, of = rng.integers(0, 6, 400), np.sort(rng.integers(0, 9, 400))
    assert (q.repeats(codes, of, 6) == q.repeats(codes, of, 1 << 40)).all()


def test_viterbi_is_the_best_labelling():
    rng = random.Random(1)
    for _ in range(50):
        n = [rng.randint(1, 6) for _ in range(4)]
        f = q.Field(np.random.default_rng(rng.randint(0, 999)).normal(size=len(q.FEATURES)), np.random.default_rng(rng.randint(0, 999)).normal(size=(2, 2)))
        x = np.random.default_rng(rng.randint(0, 999)).normal(size=(sum(n), len(q.FEATURES)))
        labels, at = f.viterbi(x, np.array(n)), 0
        for k in n:
            s = x[at : at + k] @ f.weights
            total = lambda y: sum(s[i] * y[i] for i in range(k)) + sum(f.pairs[y[i], y[i + 1]] for i in range(k - 1))  # noqa: B023, E731
            assert abs(max(map(total, itertools.product((0, 1), repeat=k))) - total(labels[at : at + k])) < 1e-9
            at += k


def test_fit_raises_the_likelihood_to_separate():
    rng = np.random.default_rng(5)
    y = np.repeat([0, 1, 0, 1, 1, 0], 50)
    x = np.stack([np.ones(300), y + rng.normal(0, 0.3, 300)] + [np.zeros(300)] * (len(q.FEATURES) - 2), axis=1)
    f = q.Field.fit(x, np.array([100, 50, 150]), y)
    assert (f.viterbi(x, np.array([100, 50, 150])) == y).mean() > 0.97 and f.pairs[0, 0] > f.pairs[0, 1]


def test_judgement(spark):
    clean = " ".join(f"word{i} another{i}," for i in range(60)) + "."
    junk = " ".join(f"word{i}%%% sale{i}###" for i in range(60))
    field = q.train([clean + "\n" + clean.replace("word", "w") for _ in range(30)], [junk for _ in range(30)])
    docs = odd_documents(spark, [clean, junk, clean + "\n" + junk, "one two three " * 40])
    got = {r.text: r for r in q.judge(docs, field).collect()}
    assert got[clean].kept and not got[junk].kept and not got[junk].base_failed
    assert got["one two three " * 40].base_failed and not got[None].kept and got[None].n_words == 0
    kept = q.judge(docs, field, only_kept=True)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {t for t, r in got.items() if r.kept}
    assert q.judge(docs.limit(0), field).count() == 0


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = q.op3_quality_rules(spark, d).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.4 * len(bad)
