import numpy as np

from marlstone.llm import langid

from .helpers import odd_documents


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    layer = langid.Direction(rng.normal(0, 0.5, (256, 12)), rng.normal(0, 0.5, (4, 12)))
    layer.w, layer.u = layer.w.astype(np.float64), layer.u.astype(np.float64)
    x, weight = rng.integers(0, 4, (5, 3)), rng.normal(size=(5, 3, 4))
    loss = lambda: float((layer.forward(x).astype(np.float64) * weight).sum())
    tape: list = []
    layer.forward(x, tape)
    dw, du = layer.backward(x, tape, weight)
    for p, g in ((layer.w, dw), (layer.u, du)):
        for i in ((0, 1), (1, 5), (3, 10)):
            old, eps = p[i], 1e-2
            p[i] = old + eps
            up = loss()
            p[i] = old - eps
            down = loss()
            p[i] = old
            assert abs((up - down) / (2 * eps) - g[i]) < 2e-2 * max(1, abs(g[i]))


def test_words_pool_all_positions():
    rng = np.random.default_rng(1)
    d = lambda: langid.Direction(rng.normal(size=(256, 12)).astype(np.float32), rng.normal(size=(4, 12)).astype(np.float32))
    m = langid.Model(["a", "b"], d(), d(), rng.normal(size=(8, 2)).astype(np.float32), np.zeros(2, np.float32))
    words = ["ab", "", "é", "long" * 20, "ab"]
    out = m.words(words, block=2)
    assert out[:, -1].tolist() == [len(w.encode()) + 1 for w in words]
    assert np.allclose(out[:, :-1].sum(axis=1), out[:, -1], atol=1e-3) and np.allclose(out[0], out[4])


def test_windows_cover_whole_words():
    """Every byte counts once, in a window cut between characters with what stands around it."""
    for word in ["", "a", "x" * 95, "x" * 96, "y" * 1000, "日本語の長い文章です" * 40, "🙂" * 77, "é" * 200]:
        b, at = word.encode() + b" ", 0
        for piece, lo, hi in langid.windows(word):
            assert len(piece) <= langid.WINDOW and 0 <= lo < hi <= len(piece)
            assert b[at - lo : at - lo + len(piece)] == piece
            assert lo >= min(at, langid.MARGIN - 3) and len(piece) - hi >= min(len(b) - at - hi + lo, langid.MARGIN - 3)
            piece[lo:hi].decode() and piece.decode()
            at += hi - lo
        assert at == len(b)


def test_long_words_and_scripts_without_spaces(spark):
    """What tells languages apart lies beyond the first 100 bytes of 200-byte words, or in spaceless text."""
    rng = np.random.default_rng(3)
    common = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    rows = []
    for i in range(300):
        tail = "zyz" if i % 2 else "wvw"
        rows.append((i, " ".join(common(110) + tail * 30 for _ in range(6)), "xa" if i % 2 else "xb"))
        rows.append((1000 + i, "".join(rng.choice(list("あいうえおかきくけこ" if i % 2 else "人日本中国大小山川口"), 300)), "ja" if i % 2 else "zh"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_on(docs, docs_per_language=60, windows_per_language=400)
    got = langid.identify(docs, model).where(langid.fold(langid.F.col("doc_id")) == 0).collect()
    assert len(got) > 60 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_rows_of_one_id_and_many_languages(spark):
    docs = spark.createDataFrame([(7, f"word{i} again", "l%d" % (i % 40)) for i in range(400)] + [(None, "x y", "l1")], "doc_id long, text string, lang string")
    model = langid.train_on(docs, docs_per_language=3, windows_per_language=5)
    assert len(model.languages) == 40


def test_smallest_hashes_of_each_language(spark):
    rows = spark.sql("SELECT CASE WHEN id % 9 = 0 THEN 'b' WHEN id < 5 THEN 'c' ELSE 'a' END AS lang, CASE WHEN id % 7 > 0 THEN id DIV 2 END AS doc_id FROM range(30000)")
    for n in (1, 40, 50_000):
        found = langid.smallest(rows, n).collect()
        wanted = []
        for lang in "abc":
            of = rows.where(f"lang = '{lang}'").selectExpr("lang", "doc_id", "xxhash64(doc_id, 7) AS h").collect()
            wanted += [(r.lang, r.doc_id) for r in sorted(of, key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0))[:n]]
        assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert langid.smallest(rows.limit(0), 3).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = langid.op5_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 250
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    docs = odd_documents(spark)
    model = langid.train([(w.encode() + b" ", 0, len(w) + 1) for w in ["the", "and", "which"] * 40 + ["der", "und", "nicht"] * 40], np.repeat([0, 1], 120), ["de_wrong", "en"], epochs=1)
    for r in langid.identify(docs, model).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    kept = langid.identify(docs, model, reject_below=0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.train_on(docs.where("lang = 'xx'")) is None
    assert langid.identify(docs.limit(0), model).count() == 0
