"""Token counts without tokens: a BPE model compiled, as far as it is used, to a finite-state transducer.

A merge tokenizer has the property that the tokens of a text's prefix are those of a shorter prefix
and one token more, and that which token that is depends on the last token of the shorter prefix
alone: two tokens may stand side by side just if merging their joined text gives these two again.
So it is enough to know, at each place that a token might begin which is still open, the token
that ends there. These places lie within the longest suffix of the text that begins some piece.
That, with the counts relative to the present one, is a state; there are finitely many.

Each transition bears the difference that its character makes to the count. A text's count is the
sum along its path. White space after other characters leads to one state, whatever was before;
from there on a chunk's path is known without what precedes it, so that the map (state before ->
state after, count) of a chunk is the characters up to there, a constant and an end state. Such
maps compose associatively; the count of a long text is a prefix scan over its chunks' maps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import documents, extend, held, keyed
from .segments import cut, slices

SPACE = "▁"
#: States kept, words remembered by a worker, code points of a chunk.
STATES, WORDS, CHUNK = 300_000, 700_000, 1 << 15


class CountTransducer:
    """Counts tokens of a sentencepiece BPE model with byte fallback, identity normalisation and a
    dummy prefix, whose white space stands at a piece's start only."""

    def __init__(self, pieces: list[tuple[str, float]]):
        # pieces of white space alone have one score, the lowest: runs merge last, from the left
        self.score = {p: s for p, s in pieces if p.strip(SPACE) or p == SPACE}
        runs = {len(p) for p, _ in pieces if p and not p.strip(SPACE)}
        if any(SPACE in p.lstrip(SPACE) or p[:2] == SPACE * 2 for p in self.score):
            raise ValueError("a piece holds white space elsewhere than at its start")
        if any(c not in self.score for p in self.score for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.period = max(runs)
        spaces = self.score
        self.score = {SPACE * k: 0.0 for k in runs}
        self.of_run = [len(self.merge(SPACE * k)) for k in range(3 * self.period + 1)]
        self.score = spaces
        if any(self.of_run[k + self.period] != self.of_run[k] + 1 for k in range(2 * self.period + 1)):
            raise ValueError("runs of white space don't repeat")
        self.score = {p: s for p, s in self.score.items() if len(p) == 1 or self.merge(p) == [p]}
        self.starts = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.words: dict[str, int] = {}
        self.one: dict[tuple, tuple] = {}
        self.begin = self.state((None, 1))

    def state(self, key: tuple) -> int:
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return at

    def merge(self, text: str) -> list[str]:
        """The tokens of a short text by the definition: best pair first, the left one of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        """Whether b may follow a: their joined text has these two tokens."""
        got = self.fits.get((a, b))
        if got is None:
            got = self.fits[a, b] = self.merge(a + b) == [a, b]
        return got

    def step(self, at: int, c: str) -> tuple[int, int]:
        """The transition of state `at` by c, made when it is first needed: (next state, tokens more)."""
        key = self.keys[at]
        if c == SPACE:
            if key[0] is None:
                k = key[1]
                out = (self.state((None, k % self.period + 1)), self.of_run[k + 1] - self.of_run[k])
            else:
                out = (self.begin, 1)
        else:
            if key[0] is None:
                # the run's last space may belong to a token of the word; the others can't
                short = self.of_run[key[1] - 1] + 1 - self.of_run[key[1]]
                key = (SPACE, (("", -1, False), (SPACE, 0, True)), short)
            suffix, ends, short = key
            if c not in self.score:
                bare = ends[-1][2]
                ends, suffix, more = (("", 0, bare),), "", len(c.encode("utf-8", "surrogatepass"))
            else:
                grown = suffix + c
                cut = 0
                while grown[cut:] not in self.starts:
                    cut += 1
                ends, suffix = ends[cut:], grown[cut:]
                for k in range(len(suffix)):
                    token = suffix[k:]
                    if token in self.score and (ends[k][0] == "" or self.fit(ends[k][0], token)):
                        break
                else:
                    raise AssertionError("no token can end here")
                before, count, bare = ends[k]
                bare = bare or (before == "" and token == SPACE)
                more = count + 1
                # counts are relative to this place, the last; places where no piece can be open go
                starts, one = self.starts, self.one
                grown = [one.setdefault(x := (e[0], e[1] - more, e[2]), x) if e and suffix[i:] in starts else None for i, e in enumerate(ends)]
                grown.append(one.setdefault(x := (token, 0, bare), x))
                ends = tuple(grown)
            was = short * key[1][-1][2]
            out = (self.state((suffix, ends, short)), more - short * bare + was)
        self.next[at][c] = out
        return out

    def run(self, at: int, text: str) -> tuple[int, int]:
        """The state after text and the tokens that it adds."""
        total, nxt = 0, self.next
        for c in text:
            got = nxt[at].get(c)
            if got is None:
                got = self.step(at, c)
            at = got[0]
            total += got[1]
        return at, total

    def word(self, w: str) -> int:
        """Tokens of a space and w; w has no space. 0 for the empty word is wrong after a space, so
        runs of spaces are not asked here."""
        got = self.words.get(w)
        if got is None:
            if len(self.words) > WORDS:
                self.words.clear()
            if len(self.keys) > STATES:
                self.reset()
            got = 1 + self.run(self.begin, w)[1]
            if len(w) <= 64:
                self.words[w] = got
        return got

    def chunk_map(self, text: str) -> tuple[str, int, int | None]:
        """(head, tokens of the rest, end state): the head's path depends on the state before. An
        end state of None: there is nothing but head."""
        at = next((i for i in range(1, len(text)) if text[i] == SPACE and text[i - 1] != SPACE), None)
        if at is None:
            return text, 0, None
        end, total = self.run(self.begin, text[at + 1 :])
        return text[: at + 1], total, end

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a's text and then b's; associative."""
        if a[2] is None:
            return (a[0] + b[0], b[1], b[2])
        end, more = self.run(a[2], b[0])
        return (a[0], a[1] + more + b[1], end if b[2] is None else b[2])

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix scan by doubling."""
        step = 1
        while step < len(maps):
            maps = [m if i < step else self.compose(maps[i - step], m) for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str) -> int:
        """Tokens of the whole text (0 if it is empty)."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if len(text) > CHUNK:
            if len(self.keys) > STATES:
                self.reset()
            maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
            head, total, _ = self.scan(maps)[-1]
            return 1 + self.run(self.begin, head)[1] + total
        words = text.split(SPACE)
        return 1 + self.run(self.begin, text)[1] if "" in words else sum(map(self.word, words))

    def counts(self, texts: pa.Array) -> list[int]:
        """Tokens of each text; null and empty texts have none."""
        out: list[int] = []
        for part in slices(texts):
            # runs of spaces, the model's own space and long texts go one by one
            odd = pc.or_(pc.match_substring_regex(part, f"  |^ | $|^$|{SPACE}"), pc.greater(pc.binary_length(part), CHUNK)).to_numpy(zero_copy_only=False)
            codes, words, per_text = cut(pc.split_pattern(pc.if_else(pa.array(odd), "", part), " "))
            n = np.array([self.word(w) if w else 0 for w in words], np.int64)
            got = np.add.reduceat(n[codes], np.cumsum(per_text) - per_text)
            for i in np.flatnonzero(odd).tolist():
                got[i] = self.count(part[i].as_py())
            out += got.tolist()
        return out


def read_pieces(model: str) -> list[tuple[str, float]]:
    """The normal pieces of a sentencepiece model file, with their scores."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=model)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


def machine_of(model: str) -> CountTransducer:
    """A worker process's transducer: later tasks find the states that earlier ones have made."""
    return held(("counts", model), lambda: CountTransducer(read_pieces(model)))


def count_tokens(df: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit for its column of texts.

    Null and empty texts have no bytes and no tokens. Rows stay as they are otherwise, repeated ones
    too; a column that has one of the new names is replaced. model: a path that executors can read.
    """

    def make():
        machine = machine_of(model)

        def step(batch):
            texts = batch.column(batch.schema.get_field_index(text))
            n = machine.counts(texts)
            return {"n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}

        return step

    return extend(df, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, make, [text])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = keyed(documents(spark, sf_dir), doc_id="doc_id", text="text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")

