"""Quality rules: a linear-chain conditional random field over a document's lines.

Every line is content or boilerplate. The field has weights for a line's features and for pairs of
neighbouring labels; Viterbi decoding gives the best labelling, and the share of a document's
characters that lie in content lines decides whether it stays. Plain rules on repeated and too few
words come first. The field is fitted to a bounded sample of labelled documents: lines of good
documents are content; a line of a bad document is boilerplate if one of its features is beyond what
nearly all lines of good documents have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extend, keyed, release
from .segments import slices

CONTENT, BOILER = 0, 1
#: Classes of bytes: ASCII white space, code points (all but UTF-8's continuation bytes), [#*$%&|<>],
#: capitals, digits, exclamation and question marks, ends of sentences, commas.
CLASSES = {
    "space": b" \t\n\r\x0b\x0c", "point": bytes(b for b in range(256) if b & 0xC0 != 0x80), "symbol": b"#*$%&|<>",
    "capital": bytes(range(65, 91)), "digit": b"0123456789", "shout": b"!?", "stop": b".", "comma": b",;:",
}
FEATURES = ["bias", "symbols", "capitals", "digits", "shouts", "commas", "no_stop", "short", "long_words", "repeats_line", "repeats_words", "first"]


def summed(table: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of table[byte] over each [start, end) of data; the ranges are in order and don't overlap."""
    out = np.zeros(len(starts), np.int64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        edges = np.stack([starts[full], ends[full]], axis=1).ravel()
        v = np.append(table[data], table.dtype.type(0))
        out[full] = np.add.reduceat(v, edges, dtype=np.int64)[::2]
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings and its offsets in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Measured:
    """Of a slice of texts: base measures per text, lines per text, features of all lines, and the
    characters in each line's words."""

    base: dict[str, np.ndarray]
    per_text: np.ndarray
    features: np.ndarray
    weight: np.ndarray


def repeats(codes: np.ndarray, of: np.ndarray, kinds: int, size: int = 3) -> np.ndarray:
    """Which words lie in a window of `size` words that its text has twice or more. of: each word's text."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n < size:
        return covered
    key = codes[: n - size + 1].astype(np.uint64)
    for k in range(1, size):
        nxt = codes[k : n - size + 1 + k].astype(np.uint64)
        if kinds ** 2 >= 1 << 63 or kinds ** (k + 1) >= 1 << 64:
            # too many kinds to number windows outright: number the shorter windows first
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            pair = np.unique(np.stack([key, nxt]), axis=1, return_inverse=True)[1]
            key = pair.ravel().astype(np.uint64)
        else:
            key = key * np.uint64(kinds) + nxt
    inside = of[: n - size + 1] == of[size - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    same = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    for k in range(size):
        covered[order[twice] + k] = True
    return covered


def measure(texts: pa.Array) -> Measured:
    texts = pa.concat_arrays([texts])  # no offset
    data, offsets = text_bytes(texts)
    tables = {}
    for name, members in CLASSES.items():
        tables[name] = np.zeros(256, np.uint8)
        tables[name][list(members)] = 1
    # lines: between the newlines of the joined texts
    lists = pc.split_pattern(texts, "\n")
    per_text = np.diff(lists.offsets.to_numpy())
    lines = lists.flatten()
    length = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line_of = np.repeat(np.arange(len(per_text)), per_text)
    first = np.cumsum(per_text) - per_text
    # a line begins after the lines before it in its text and their newlines
    gone = np.cumsum(length + 1) - (length + 1)
    start = offsets[line_of] + gone - gone[first[line_of]]
    count = {name: summed(t, data, start, start + length) for name, t in tables.items()}
    # words: where white space, a text's start or a line's start goes before
    is_space = np.append(tables["space"][data], np.uint8(1)).astype(bool)
    begins = ~is_space[:-1]
    begins[1:] &= is_space[:-2]
    texts_at = offsets[:-1][np.diff(offsets) > 0]
    begins[texts_at] = ~is_space[texts_at]
    words_per_line = summed(np.array([0, 1], np.uint8), begins.view(np.uint8), start, start + length)
    words = pc.ascii_split_whitespace(lines)
    flat = words.flatten()
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    word_line = np.repeat(np.arange(len(lines)), words_per_line)
    again = repeats(codes, line_of[word_line], max(1, len(flat.dictionary)))
    repeated = np.bincount(word_line[again], minlength=len(lines))
    # lines equal to an earlier line of their text
    kinds = lines.dictionary_encode()
    key = line_of * max(1, len(kinds.dictionary)) + kinds.indices.to_numpy(zero_copy_only=False)
    earlier = np.ones(len(key), bool)
    earlier[np.unique(key, return_index=True)[1]] = False
    earlier &= words_per_line > 0
    total = lambda x: np.add.reduceat(x, first) if len(first) else x
    chars = count["point"] - summed(tables["space"], data, start, start + length)
    base = {"n_words": total(words_per_line), "word_chars": total(chars), "n_symbols": total(count["symbol"]), "n_dup_lines": total(earlier.astype(np.int64)), "n_repeat_words": total(repeated)}
    part = lambda x, n: x / np.maximum(n, 1)
    f = np.stack([
        np.ones(len(lines)), part(count["symbol"], words_per_line), part(count["capital"], chars), part(count["digit"], chars), part(count["shout"], words_per_line), part(count["comma"], words_per_line),
        (count["stop"] == 0).astype(float), (words_per_line < 4).astype(float), np.maximum(0, part(chars, words_per_line) - 12) / 12, earlier.astype(float), part(repeated, words_per_line), np.arange(len(lines)) == first[line_of],
    ], axis=1).clip(0, 1)
    return Measured(base, per_text, f, chars)


@dataclass
class Field:
    """Weights of label BOILER's features (CONTENT's are 0) and of pairs of neighbouring labels."""

    weights: np.ndarray
    pairs: np.ndarray

    def viterbi(self, features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The best labels of all lines, text by text; texts of like place are worked on together."""
        score = features @ self.weights
        first = np.cumsum(per_text) - per_text
        labels = np.zeros(len(score), np.int64)
        order = np.argsort(-per_text, kind="stable")
        longest = int(per_text.max()) if len(per_text) else 0
        best = np.zeros((len(per_text), 2))
        back = np.zeros((len(score), 2), np.int8)
        live = len(order)
        for t in range(longest):
            while live and per_text[order[live - 1]] <= t:
                live -= 1
            rows = order[:live]
            at = first[rows] + t
            emit = np.stack([np.zeros(live), score[at]], axis=1)
            if t:
                through = best[rows][:, :, None] + self.pairs[None]
                back[at] = through.argmax(axis=1)
                best[rows] = through.max(axis=1) + emit
            else:
                best[rows] = emit
        state = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            rows = order[: np.searchsorted(-per_text[order], -t, side="left")]
            at = first[rows] + t
            labels[at] = state[rows]
            state[rows] = back[at, state[rows]]
        return labels

    @classmethod
    def fit(cls, features: np.ndarray, per_text: np.ndarray, labels: np.ndarray, rounds: int = 200, decay: float = 1e-5) -> Field:
        """Greatest likelihood with a small penalty, by gradient steps (Adam) on forward-backward."""
        n = features.shape[1]
        x, m, v = np.zeros(n + 4), np.zeros(n + 4), np.zeros(n + 4)
        first = np.cumsum(per_text) - per_text
        last = np.zeros(len(labels), bool)
        last[np.cumsum(per_text)[per_text > 0] - 1] = True
        seen_pairs = np.zeros((2, 2))
        np.add.at(seen_pairs, (labels[:-1][~last[:-1]], labels[1:][~last[:-1]]), 1)
        seen = features.T @ (labels == BOILER)
        order = np.argsort(-per_text, kind="stable")
        steps = []
        for t in range(int(per_text.max())):
            rows = order[: np.searchsorted(-per_text[order], -t, side="left")]
            steps.append((rows, first[rows] + t))
        for k in range(1, rounds + 1):
            w, pairs = x[:n], x[n:].reshape(2, 2)
            emit = np.stack([np.zeros(len(labels)), features @ w], axis=1)
            fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
            for t, (_, at) in enumerate(steps):
                fwd[at] = emit[at] if t == 0 else emit[at] + np.logaddexp(*(fwd[at - 1][:, i, None] + pairs[i][None] for i in (0, 1)))
            for t in range(len(steps) - 1, 0, -1):
                at = steps[t][1]
                then = emit[at] + bwd[at]
                bwd[at - 1] = np.logaddexp(pairs[None, :, 0] + then[:, None, 0], pairs[None, :, 1] + then[:, None, 1])
            both = fwd + bwd
            z = np.logaddexp(both[:, 0], both[:, 1])
            p = np.exp(both[:, 1] - z)
            at = np.flatnonzero(~last[:-1])
            joint = np.exp(fwd[at][:, :, None] + pairs[None] + (emit + bwd)[at + 1][:, None, :] - z[at][:, None, None]).sum(axis=0)
            g = np.concatenate([(seen - features.T @ p), (seen_pairs - joint).ravel()]) / len(labels) - decay * x
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls(x[:n], x[n:].reshape(2, 2))


#: The features by which a line of a bad document may stand out from those of good ones.
TELLING = [FEATURES.index(f) for f in ("symbols", "capitals", "digits", "shouts", "long_words", "repeats_line", "repeats_words")]


def train(good: list[str], bad: list[str], beyond: float = 0.995) -> Field:
    """Fits the field. Without documents of both kinds, every line is content."""
    if not good or not bad:
        return Field(np.array([-1.0] + [0.0] * (len(FEATURES) - 1)), np.zeros((2, 2)))
    a, b = measure(pa.array(good)), measure(pa.array(bad))
    usual = np.quantile(a.features[:, TELLING], beyond, axis=0)
    odd = (b.features[:, TELLING] > np.minimum(usual + 0.05, 0.95)).any(axis=1)
    labels = np.concatenate([np.zeros(len(a.features), np.int64), np.where(odd, BOILER, CONTENT)])
    return Field.fit(np.concatenate([a.features, b.features]), np.concatenate([a.per_text, b.per_text]), labels)


def train_on(docs: DataFrame, labels: DataFrame, most: int = 1500, longest: int = 200_000) -> Field:
    """Fits the field to labelled documents: `most` of either kind at most, chosen by a hash of doc_id,
    with texts of `longest` code points at most.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad; null rows don't count). Where rows share
    a doc_id, those with the smallest hashes of their texts are used, 2 * most rows in all.
    """
    rows = []
    known = keyed(labels, doc_id="doc_id", quality="quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    for q in (0, 1):
        rows += known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if not rows:
        return train([], [])
    # 2 * most rows at most
    few = docs.sparkSession.createDataFrame(rows, "doc_id long, quality long")
    texts = keyed(docs, doc_id="doc_id", text="text").where(F.length("text") <= longest).join(F.broadcast(few), "doc_id").select("quality", "doc_id", "text")
    texts = texts.orderBy(F.xxhash64("text"), "doc_id", "quality").limit(2 * most).collect()
    texts.sort()
    return train([r.text for r in texts if r.quality == 1], [r.text for r in texts if r.quality == 0])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, field: Field, text: str = "text", min_share: float = 0.5, min_words: int = 50, keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """df with the base measures, base_failed, content_share and kept.

    A text without words (null and empty ones too) has all measures 0 and fails. content_share is the
    share of the word characters in lines marked content, 0 without words. A document stays if it
    passes the base rules and its content share is min_share at least. only_kept: other rows go, and
    no columns are added.
    """
    added = {**dict.fromkeys(BASE, "long"), "base_failed": "boolean", "content_share": "double", "kept": "boolean"}

    def make():
        release()

        def step(batch):
            out = {k: [] for k in added}
            for part in slices(batch.column(batch.schema.get_field_index(text)), 4 << 20):
                m = measure(part)
                labels = field.viterbi(m.features, m.per_text)
                first = np.cumsum(m.per_text) - m.per_text
                content = np.add.reduceat(m.weight * (labels == CONTENT), first)
                share = content / np.maximum(m.base["word_chars"], 1)
                failed = (m.base["n_words"] < min_words) | (100 * m.base["n_repeat_words"] > 50 * m.base["n_words"])
                for k in BASE:
                    out[k].append(m.base[k])
                out["base_failed"].append(failed)
                out["content_share"].append(share)
                out["kept"].append(~failed & (share >= min_share))
            got = {k: pa.array(np.concatenate(v)) for k, v in out.items()}
            return {"__rows__": got["kept"].to_pylist()} if only_kept else got

        return step

    return extend(df, {} if only_kept else added, make, [text], keep=keep)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures, base_failed and kept of every document; texts without words have 0 and fail."""
    docs = keyed(documents(spark, sf_dir), doc_id="doc_id", text="text")
    field = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, field, keep=["doc_id"]).select("doc_id", *BASE, "base_failed", "kept", "content_share")
