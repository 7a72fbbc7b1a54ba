"""Language identification by a small bidirectional gated recurrent network over bytes.

The network reads a word's bytes and the space after it in both directions and gives a distribution
over languages at every position; a document's probabilities are the mean over all its positions.
Its state begins anew with each word, so a word has the same labels wherever it stands, and each
distinct word of a batch is read once. Words of more than WINDOW bytes, as in scripts without spaces,
are read in windows that overlap: each of their positions is labelled in the one window that has it
and MARGIN bytes around it. Windows begin and end between characters. It is trained in numpy by
backpropagation through time, on all windows of words of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, documents, extend, keyed, release, stage, work_dir
from .segments import Memo, cut, slices

UNKNOWN = "und"
#: Bytes that the network reads at once, and those on each side of a cut that only give context.
WINDOW, MARGIN = 96, 16


def border(b: bytes, at: int) -> int:
    """The last place up to `at` where a character of UTF-8 text begins or the text ends."""
    while 0 < at < len(b) and b[at] & 0xC0 == 0x80:
        at -= 1
    return at


def windows(word: str) -> Iterator[tuple[bytes, int, int]]:
    """What is read of a word and the space after it: windows, and of each the positions that count.
    Every byte counts in one window."""
    b = word.encode() + b" "
    if len(b) <= WINDOW:
        yield b, 0, len(b)
        return
    at = 0
    while at < len(b):
        end = border(b, min(len(b), at + WINDOW - 2 * MARGIN))
        first, last = border(b, max(0, at - MARGIN)), border(b, min(len(b), end + MARGIN))
        yield b[first:last], at - first, end - first
        at = end


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """One gated recurrent layer. w: byte -> update, reset, candidate inputs; u: state -> the same."""

    def __init__(self, w: np.ndarray, u: np.ndarray):
        self.w, self.u, self.h = w, u, u.shape[0]

    def forward(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States after each byte; x is (length, words)."""
        h, k = np.zeros((x.shape[1], self.h), np.float32), self.h
        out = np.empty((*x.shape, k), np.float32)
        u, v = self.u[:, : 2 * k], self.u[:, 2 * k :]
        for t in range(len(x)):
            a = self.w[x[t]]
            g = sigmoid(a[:, : 2 * k] + h @ u)
            z, r = g[:, :k], g[:, k:]
            s = r * h
            c = np.tanh(a[:, 2 * k :] + s @ v)
            new = h + z * (c - h)
            if tape is not None:
                tape.append((h, z, r, s, c))
            out[t] = h = new
        return out

    def backward(self, x: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u; grad is that of the states. Back through time."""
        k = self.h
        dw, du, inputs = np.zeros_like(self.w), np.zeros_like(self.u), np.empty((*x.shape, 3 * k), self.w.dtype)
        u, v = self.u[:, : 2 * k], self.u[:, 2 * k :]
        dh = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, s, c = tape[t]
            dh = dh + grad[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            ds = dc @ v.T
            dr = ds * h * r * (1 - r)
            g = np.concatenate([dz, dr], axis=1)
            du[:, : 2 * k] += h.T @ g
            du[:, 2 * k :] += s.T @ dc
            inputs[t, :, : 2 * k], inputs[t, :, 2 * k :] = g, dc
            dh = dh * (1 - z) + ds * r + g @ u.T
        # sums over all positions of a byte
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        seen, starts = np.unique(flat[order], return_index=True)
        dw[seen] = np.add.reduceat(inputs.reshape(-1, 3 * k)[order], starts)
        return dw, du


@dataclass
class Model:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities at each position of words of one length: (length, words, languages)."""
        h = np.concatenate([self.ahead.forward(x), self.back.forward(x[::-1])[::-1]], axis=2)
        y = h @ self.out + self.bias
        y -= y.max(axis=2, keepdims=True)
        np.exp(y, out=y)
        return y / y.sum(axis=2, keepdims=True)

    def words(self, words: list[str], block: int = 1024) -> np.ndarray:
        """For each word the sums of its positions' probabilities and, last, their number."""
        out = np.zeros((len(words), len(self.languages) + 1))
        pieces, of, spans = [], [], []
        for i, w in enumerate(words):
            for b, lo, hi in windows(w):
                pieces.append(b)
                of.append(i)
                spans.append((lo, hi))
        if not pieces:
            return out
        size, of, spans = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(of, np.int64), np.array(spans, np.int64)
        found = np.zeros((len(pieces), out.shape[1]))
        for rows in alike(size, block):
            x, counts = stacked(pieces, spans, rows)
            found[rows, :-1] = np.einsum("twl,tw->wl", self.positions(x), counts)
            found[rows, -1] = counts.sum(axis=0)
        if len(pieces) == len(words):
            return found
        np.add.at(out, of, found)
        return out


def alike(size: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Places of windows of one size, up to `block` of them at a time."""
    order = np.argsort(size, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(size[order])) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for k in range(a, b, block):
            yield order[k : min(b, k + block)]


def stacked(pieces: list[bytes], spans: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of windows of one size, (size, windows), and which positions count."""
    x = np.frombuffer(b"".join([pieces[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), -1).T
    t = np.arange(len(x))[:, None]
    return x, ((t >= spans[rows, 0]) & (t < spans[rows, 1])).astype(np.float32)


def train(sample: list[tuple[bytes, int, int]], labels: np.ndarray, languages: list[str], hidden: int = 16, epochs: int = 5, batch: int = 256, seed: int = 1) -> Model:
    """Fits the network to windows of known language: cross-entropy at every position that counts."""
    rng = np.random.default_rng(seed)
    k, n = hidden, len(languages)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0] if s[0] < 256 else 16)).astype(np.float32)
    model = Model(languages, Direction(init(256, 3 * k), init(k, 3 * k)), Direction(init(256, 3 * k), init(k, 3 * k)), init(2 * k, n), np.zeros(n, np.float32))
    params = [model.ahead.w, model.ahead.u, model.back.w, model.back.u, model.out, model.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pieces, spans = [b for b, _, _ in sample], np.array([(lo, hi) for _, lo, hi in sample], np.int64).reshape(-1, 2)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    step = 0
    for epoch in range(epochs):
        mixed = rng.permutation(len(pieces))
        batches = [mixed[rows] for rows in alike(size[mixed], batch)]
        for j in rng.permutation(len(batches)).tolist():
            rows = batches[j]
            x, counts = stacked(pieces, spans, rows)
            tapes: tuple[list, list] = ([], [])
            h = np.concatenate([model.ahead.forward(x, tapes[0]), model.back.forward(x[::-1], tapes[1])[::-1]], axis=2)
            y = h @ model.out + model.bias
            y = np.exp(y - y.max(axis=2, keepdims=True))
            y /= y.sum(axis=2, keepdims=True)
            y[:, np.arange(len(rows)), labels[rows]] -= 1
            y *= (counts / counts.sum())[:, :, None]
            dh = y @ model.out.T
            grads = [*model.ahead.backward(x, tapes[0], dh[:, :, :k]), *model.back.backward(x[::-1], tapes[1], dh[::-1, :, k:]), np.einsum("twh,twl->hl", h, y), y.sum(axis=(0, 1))]
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5 (a null doc_id as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def smallest(rows: DataFrame, n: int) -> DataFrame:
    """The n rows (lang, doc_id) of each language whose doc_id has the smallest hash.

    A language's rows are counted by 4096 ranges of the hash, of which the first that hold n rows are
    looked at. So what meets in one task is 4096 counts and about a 4096th of a language's rows.
    """
    placed = rows.withColumn("h", F.xxhash64("doc_id", F.lit(7))).withColumn("range", F.shiftright("h", 52))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = placed.groupBy("lang", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    # a row per language
    last = ranges.where(F.col("before") < n).groupBy("lang").agg(F.max("range").alias("last"))
    near = placed.join(F.broadcast(last), "lang").where(F.col("range") <= F.col("last"))
    # a partition's own best rows are found before any of them is sent
    return near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("place") <= n).select("lang", "doc_id")


def train_on(docs: DataFrame, docs_per_language: int = 300, windows_per_language: int = 25_000, bytes_per_language: int = 400_000) -> Model | None:
    """Fits the network to documents outside fold 0 with a language and a text.

    Of each language, the documents of docs_per_language rows are used (chosen by a hash of doc_id), and
    of all windows of their words those with the smallest hashes, windows_per_language and
    bytes_per_language at most. Rows of one doc_id count as one text after another. What comes to the
    driver are these windows. None if there is no such document.
    """
    known = keyed(docs, doc_id="doc_id", text="text", lang="lang").where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    folder = work_dir(docs.sparkSession) + "/langid"
    rows = smallest(stage(known.select("lang", "doc_id"), folder), docs_per_language)
    few = rows.select("lang", "doc_id").distinct()
    # docs_per_language rows of a language at most
    sample = known.join(F.broadcast(few), (known.lang == few.lang) & known.doc_id.eqNullSafe(few.doc_id), "left_semi")

    def read(batches):
        import xxhash

        for batch in batches:
            found: dict[str, list[tuple[int, bytes, int, int]]] = {}
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seed = xxhash.xxh3_64_intdigest(str(doc).encode())
                own = found.setdefault(lang, [])
                for w in text.split():
                    for b, lo, hi in windows(w):
                        own.append((xxhash.xxh3_64_intdigest(b, seed=seed ^ len(own)) >> 1, b, lo, hi))
                    if len(own) > 4 * windows_per_language:
                        own[:] = nsmallest(windows_per_language, own)
            for lang, own in found.items():
                own = nsmallest(windows_per_language, own) if len(own) > windows_per_language else own
                h, b, lo, hi = (list(c) for c in zip(*own, strict=True)) if own else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h, pa.int64()), pa.array(b, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["lang", "h", "piece", "lo", "hi"])

    pieces = sample.select("doc_id", "text", "lang").mapInArrow(read, "lang string, h long, piece binary, lo int, hi int")
    least = Window.partitionBy("lang").orderBy("h", "piece", "lo", "hi")
    upto = least.rowsBetween(Window.unboundedPreceding, 0)
    chosen = pieces.withColumn("place", F.row_number().over(least)).withColumn("bytes", F.sum(F.length("piece")).over(upto))
    rows = chosen.where((F.col("place") <= windows_per_language) & ((F.col("bytes") <= bytes_per_language) | (F.col("place") == 1))).select("lang", "place", "piece", "lo", "hi").toArrow()
    delete(docs.sparkSession, folder)
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("lang", "ascending"), ("place", "ascending")])
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    data = list(zip(*(rows.column(c).to_pylist() for c in ("piece", "lo", "hi")), strict=True))
    return train(data, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist())


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, reject_below: float | None = None) -> DataFrame:
    """df with lang_pred and score, the best language's mean probability over all positions.

    A null text, and one without a letter, has lang_pred "und" and score 0; so has every text without
    a model. reject_below: rows with "und" or a lower score go, and no columns are added.
    """

    def make():
        release()
        memo = Memo(lambda ws: [row.tobytes() for row in model.words(ws).astype(np.float32)], 400_000) if model else None

        def step(batch):
            column = batch.column(batch.schema.get_field_index(text))
            pred: list[str] = []
            scores: list[float] = []
            for part in slices(column, 6 << 20):
                lettered = pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
                if memo is None:
                    pred += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                codes, words, per_text = cut(pc.ascii_split_whitespace(part))
                values = np.frombuffer(b"".join(memo(words)), np.float32).reshape(len(words), -1)
                start = np.cumsum(per_text) - per_text
                sums = np.zeros((len(part), values.shape[1]))
                full = np.flatnonzero(per_text)
                for k in range(values.shape[1] if len(full) else 0):
                    sums[full, k] = np.add.reduceat(values[:, k][codes].astype(np.float64), start[full])
                mean = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
                best = mean.argmax(axis=1)
                pred += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += np.where(lettered, mean.max(axis=1).clip(0, 1), 0.0).tolist()
            if reject_below is not None:
                return {"__rows__": [p != UNKNOWN and s >= reject_below for p, s in zip(pred, scores, strict=True)]}
            return {"lang_pred": pred, "score": scores}

        return step

    return extend(df, {} if reject_below is not None else {"lang_pred": "string", "score": "double"}, make, [text], keep=keep)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; null and letterless texts are "und", score 0.

    Rows with one doc_id are judged each by its own text; a null doc_id has the fold of the empty text.
    """
    docs = keyed(documents(spark, sf_dir), doc_id="doc_id", text="text", lang="lang")
    found = identify(docs.select("doc_id", "text"), train_on(docs), keep=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
