"""Exact token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

A BPE encoding is valid exactly if each of its tokens encodes to itself and each adjacent pair of tokens stays as it
is when the pair is encoded alone. So the last token of every prefix of a word can be found from the last tokens of
shorter prefixes, and ``count[i] = count[i - len(last)] + 1``. The counts of a word's prefixes are stored once per
distinct word; a text's counts are its words' counts added up, so "how many tokens has this prefix" and "what is the
longest prefix within this budget" need no second encoding.

Results by case: null and empty texts have no bytes and no tokens; very long texts are counted whole; repeated rows
and null ids stay rows of their own; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, slices
from .tokenizer import Bpe, Words, byte_letters, load, merge_word, vocabulary

VOCABULARY = "byte_bpe_50k.json"
CACHE_PAIRS = 1_000_000
#: Words of more characters are counted once for each text.
LONG = 64
CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Prefix counts by word, kept for words met again."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        own = {c: b for b, c in enumerate(byte_letters())}
        self.letters = byte_letters()
        every = {bytes(own[c] for c in t) for t in bpe.vocab if all(c in own for c in t)}
        self.tokens = {t for t in every if len(self._merged(t)) == 1}  # those that their own bytes encode to
        self.longest = [1] * 256  # of the tokens that end in a byte
        for t in self.tokens:
            self.longest[t[-1]] = max(self.longest[t[-1]], len(t))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words = Words(self.word)

    def _merged(self, token: bytes) -> list[str]:
        return merge_word([self.letters[b] for b in token], self.bpe.ranks)

    def _stays(self, a: bytes, b: bytes) -> bool:
        """Whether the pair's bytes encode to just these two tokens; kept for the next time."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        parts = self._merged(a + b)
        found = self.pairs[a, b] = len(parts) == 2 and len(parts[0]) == len(a)
        return found

    def word(self, word: str) -> np.ndarray | bytes:
        """Token counts of the word's byte prefixes of length 1, 2, ..."""
        data, tokens, pairs, longest = word.encode(), self.tokens, self.pairs, self.longest
        last: list[bytes] = [b""]
        count = [0]
        for i in range(1, len(data) + 1):
            reach = longest[data[i - 1]]
            for j in range(i - reach if i > reach else 0, i):  # the longest token first
                token = data[j:i]
                if token in tokens:
                    if j:
                        stays = pairs.get((last[j], token))
                        if not (self._stays(last[j], token) if stays is None else stays):
                            continue
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[i - 1]}")
        return bytes(count[1:]) if len(data) < 256 else np.array(count[1:], np.int64)

    def by_character(self, word: str) -> np.ndarray:
        """Token counts of the word's prefixes of 1, 2, ... characters."""
        counts = self.words[word]
        ends = np.cumsum([len(c.encode()) for c in word]) - 1
        return (np.frombuffer(counts, np.uint8) if isinstance(counts, bytes) else counts)[ends]

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, text) in order; special strings are one token each."""
        if self.bpe.special_split is None or "<|" not in text:
            return [(False, text)] if text else []
        return [(p in self.bpe.specials, p) for p in self.bpe.special_split.split(text) if p]

    def total(self, text: str) -> int:
        words = self.words
        n = 0
        for special, part in self.segments(text):
            n += 1 if special else sum([words[w][-1] for w in self.bpe.pattern.findall(part)])
        return int(n)

    def total_and_fit(self, text: str, limit: int) -> tuple[int, int]:
        """The text's tokens, and the longest prefix, in characters, of at most ``limit`` of them."""
        if self.bpe.special_split is not None and "<|" in text:
            counts = self.of(text)
            return counts.sums[-1], counts.fit(limit)
        words = self.words
        parts = self.bpe.pattern.findall(text)
        each = [words[w][-1] for w in parts]
        n = sum(each)
        if n <= limit:
            return int(n), len(text)
        k = spent = 0
        while spent + each[k] <= limit:
            spent += each[k]
            k += 1
        # the cut falls near word k; two words before it suffice, for a run of white space is two words at most
        low = max(0, k - 2)
        begin = sum(map(len, parts[:low]))
        near = text[begin : begin + sum(map(len, parts[low : k + 3]))]
        return int(n), begin + self.of(near).fit(int(limit - sum(each[:low])))

    def of(self, text: str) -> PrefixCounts:
        return PrefixCounts(self, text)


class PrefixCounts:
    """The counts of one text's prefixes; positions are characters."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.parts: list[tuple[bool, str]] = []  # special tokens and words
        self.special_from: list[int] = []  # where the plain stretch of each part begins
        at = 0
        for special, part in counter.segments(text):
            words = [part] if special else counter.bpe.pattern.findall(part)
            self.parts += [(special, w) for w in words]
            self.special_from += [at] * len(words)
            at += len(part)
        self.ends = list(accumulate(len(w) for _, w in self.parts))
        self.long: dict[int, np.ndarray] = {}  # counts by character of words that are not kept by the counter
        self.sums = [0, *accumulate(1 if s else self._whole(i, w) for i, (s, w) in enumerate(self.parts))]
        self.run: tuple[int, int, int, np.ndarray] = (0, 0, 0, np.empty(0))  # begin, end, part and counts of the last long white space

    def _whole(self, part: int, word: str) -> int:
        if len(word) <= LONG:
            return int(self.counter.words[word][-1])
        self.long[part] = self.counter.by_character(word)
        return int(self.long[part][-1])

    def at(self, position: int) -> int:
        """Tokens of ``text[:position]``."""
        k = bisect_right(self.ends, position)
        start = self.ends[k - 1] if k else 0
        if position < len(self.text) and (position == start or self.text[position - 1].isspace()) and position and not (k and self.parts[k - 1][0] and position == start):
            return self._open(position, k)
        if position == start:
            return self.sums[k]
        special, word = self.parts[k]
        if special:
            return self._split(position, k)
        if k in self.long:
            return self.sums[k] + int(self.long[k][position - start - 1])
        head = word[: position - start]
        if word in CONTRACTIONS and len(head) == 2:  # "'r" is no contraction yet
            return self.sums[k] + sum(int(self.counter.words[c][-1]) for c in head)
        return self.sums[k] + int(self.counter.words[word][len(head.encode()) - 1])

    def _open(self, position: int, k: int) -> int:
        """A prefix that may end in white space, whose run is then one word."""
        if not self.text[position - 1].isspace():
            return self.sums[k]
        begin, end, j, counts = self.run
        if begin < position <= end:
            return self.sums[j] + int(counts[position - begin - 1])
        begin = position
        while begin and self.text[begin - 1].isspace() and begin > self.special_from[min(k, len(self.parts) - 1)]:
            begin -= 1
        j = bisect_right(self.ends, begin)
        if position - begin > LONG:  # its prefixes are one word each; no special string begins with white space
            end = position
            while end < len(self.text) and self.text[end].isspace():
                end += 1
            self.run = begin, end, j, self.counter.by_character(self.text[begin:end])
            return self.sums[j] + int(self.run[3][position - begin - 1])
        words = self.counter.bpe.pattern.findall(self.text[begin:position])
        return self.sums[j] + sum(int(self.counter.words[w][-1]) for w in words)

    def _split(self, position: int, k: int) -> int:
        """A prefix that ends inside a special token's string: that stretch is plain text then."""
        begin = self.special_from[k - 1] if k and not self.parts[k - 1][0] else (self.ends[k - 1] if k else 0)
        j = bisect_right(self.ends, begin) if begin else 0
        return self.sums[j] + self.counter.total(self.text[begin:position])

    def fit(self, budget: int) -> int:
        """The longest prefix, in characters, of at most ``budget`` tokens."""
        if self.sums[-1] <= budget:
            return len(self.text)
        k = bisect_right(self.sums, budget) - 1  # whole parts within the budget
        low = self.ends[k - 1] if k else 0
        for position in range(self.ends[min(k + 1, len(self.ends) - 1)], low, -1):
            if self.at(position) <= budget:
                return position
        while low and self.at(low) > budget:
            low -= 1
        return low


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(load(path))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_bytes", pa.int64())])


def count_tokens(df: DataFrame, limit: int = 512, vocabulary_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_bytes: the UTF-8 length of the longest prefix within the limit."""
    path = vocabulary_path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n, fit = counts.total_and_fit(text, limit)
                size = len(text.encode())
                rows.append((size, n, n > limit, size if n <= limit else len(text[:fit].encode())))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_OUT)

    rows = pick(df, doc_id=id_col, text=text_col)
    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")
