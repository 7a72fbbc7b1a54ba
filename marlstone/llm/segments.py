"""Working on whole texts by their distinct words.

A text is cut at its spaces (U+0020); Arrow does the cutting and finds the distinct words of a slice
of texts, Python sees only these, and numpy puts the words' values together again for each text.

A byte-level BPE of the family used here splits a text by a pattern before it merges within each
match. A space that follows or precedes a character that is no white space always begins a match (or
is one), and the pattern's only look-around, "not before a non-space", sees the same within a word as
within the text. So the ids of a text are those of its words, each with the space before it. Only a
space between white space on both sides (or the end) may be inside a match; texts with such a space
are cut at the borders of white-space runs instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters of the Unicode property White_Space (fixed values); Python's own \s has four more.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")

#: Distinct words that a worker remembers (each about 200 bytes), the longest worth it, and the bytes
#: of text that are worked on at once.
REMEMBERED, LONGEST, SLICE = 600_000, 64, 12 << 20
#: The same characters for Arrow's patterns, and the spaces that may lie inside a match.
WHITE_SPACE_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INNER_SPACE = f"[{WHITE_SPACE_RE2}] (?:[{WHITE_SPACE_RE2}]|$)"


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """texts in order, as slices of about `size` bytes (one text at least); nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def cut(lists: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of a list of words for each text: all words as codes, the distinct words, words per text."""
    flat = lists.flatten().dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist(), np.diff(lists.offsets.to_numpy())


def gather(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """pool[starts[c] : starts[c] + sizes[c]] of every code c, joined."""
    n = sizes[codes]
    ends = np.cumsum(n)
    if not len(ends):
        return pool[:0]
    return pool.take(np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1]))


class Memo:
    """Values of strings, each found once while it is remembered."""

    def __init__(self, find: Callable[[list[str]], list], remembered: int = REMEMBERED):
        self.find, self.remembered, self.seen = find, remembered, {}

    def __call__(self, keys: list[str]) -> list:
        seen = self.seen
        if len(seen) > self.remembered:
            seen.clear()
        out = list(map(seen.get, keys))
        new = [i for i, v in enumerate(out) if v is None]
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            for i, v in zip(part, self.find([keys[i] for i in part]), strict=True):
                out[i] = v
                if len(keys[i]) <= LONGEST:
                    seen[keys[i]] = v
        return out


class TextEncoder:
    """Ids of whole texts; `encode` gives the ids of distinct segments as little-endian uint32 bytes.

    `whole(text)`, if there is one, tells of texts that only `encode` on all the text gets right.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], special: list[str] = (), remembered: int = REMEMBERED):
        self.encode, self.special, self.memo = encode, list(special), Memo(self._find, remembered)
        self.ends = dict(zip(",.", encode([",", "."]), strict=True))

    def _find(self, keys: list[str]) -> list[bytes]:
        """Ids of words. A comma or full stop after a letter, at a word's end, is a match of its own."""
        seen = self.memo.seen
        stems = [k[:-1] if k[-1:] in self.ends and "@" < k[-2:-1] < "\u0250" and k[-2].isalpha() else k for k in keys]
        need = [s for s in dict.fromkeys(stems) if s not in seen]
        got = dict(zip(need, self.encode(need), strict=True)) if need else {}
        seen.update((s, v) for s, v in got.items() if len(s) <= LONGEST)
        return [v if s is k else v + self.ends[k[-1]] for k, s, v in ((k, s, got.get(s) or seen.get(s, b"")) for k, s in zip(keys, stems, strict=True))]

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts (null: empty): all ids, ids per text."""
        for part in slices(texts):
            yield self.slice(part)

    def slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, INNER_SPACE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        codes, words, per_text = cut(pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " "))
        # a text's first word has no space before it; odd texts come in its place
        codes, starts = codes.copy(), np.cumsum(per_text) - per_text
        first = [words[c] for c in codes[starts]]
        for i in np.flatnonzero(odd).tolist():
            first[i] = texts[i].as_py()
        codes[starts] = len(words) + np.arange(len(first))
        values = self.memo([" " + w for w in words]) + [self.text(t) if o else b"" for t, o in zip(first, odd, strict=True)]
        plain = [i for i in range(len(first)) if first[i] and not odd[i]]
        for i, v in zip(plain, self.memo([first[i] for i in plain]), strict=True):
            values[len(words) + i] = v
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = gather(codes, np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(values), "<u4"))
        return ids, np.add.reduceat(sizes[codes], starts) if len(starts) else starts

    def text(self, t: str) -> bytes:
        """Ids of one odd text."""
        if any(s in t for s in self.special):
            return self.encode([t])[0]
        return b"".join(self.memo(SEGMENT.findall(t)))
