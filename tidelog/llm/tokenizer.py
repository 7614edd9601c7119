"""Byte-level BPE with public vocabularies: ids of whole texts, with a bounded cache of words.

The merge routine is the *contiguous rank array*: a word's part boundaries and the rank of every adjacent pair lie in
two short arrays; the lowest rank is found by a scan, its boundary is deleted and the two neighbouring ranks are
looked up again. A word occurs many times, so its result is kept in a dictionary of bounded size. The scan is for short
words; in a word of more than LONG_WORD parts a heap finds the same pair, so time does not grow with the square of its length.
"""

from __future__ import annotations

import json
import os
import re as plain
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex

CACHE_WORDS = 400_000
NEVER = 1 << 60
LONG_WORD = 256


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a vocabulary file: in ``folder``, in $TOKENIZER_DIR, or with the installed public files."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def merge_word(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Parts of one word after all merges, by the contiguous rank array."""
    if len(parts) > LONG_WORD:
        return _merge_long(parts, ranks)
    rank = [ranks.get(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
    while rank:
        best = min(rank)
        if best == NEVER:
            break
        i = rank.index(best)
        parts[i] += parts[i + 1]
        del parts[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get((parts[i], parts[i + 1]), NEVER)
        if i:
            rank[i - 1] = ranks.get((parts[i - 1], parts[i]), NEVER)
    return parts


def _merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same merges in the same order: lowest rank first, leftmost of equal ones."""
    n = len(parts)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]), NEVER)) < NEVER]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or ranks.get((parts[i], parts[j]), NEVER) != r:
            continue  # one of the two has been merged since
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]), NEVER)) < NEVER:
                heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]), NEVER)) < NEVER:
            heappush(heap, (r, h))
    return [p for p in parts if p is not None]


class Words(dict):
    """word -> what ``make`` gives for it, in two generations of CACHE_WORDS words at most: words met again outlive others."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
            if len(word) > 64:  # long junk is rarely met again
                return found
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class Bpe:
    """A byte-level BPE vocabulary file: ``ids`` and ``decode`` as the tokenizers library gives them by default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            if "<|" not in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"special token {t['content']!r} is of a kind that is not supported")
        self.special_split = plain.compile("(" + "|".join(map(plain.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.folds = spec["normalizer"] is not None
        first = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])[0]
        import public_tokenizers

        self.pattern = regex.compile(first["pattern"]["Regex"] if first["type"] == "Split" else public_tokenizers.PATTERN)
        self.by_id = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.words = Words(self._encode_word)
        self.special_ids = {t: array("I", [i]).tobytes() for t, i in self.specials.items()}

    def _encode_word(self, word: str) -> bytes:
        letters = byte_letters()
        parts = [letters[b] for b in word.encode()]
        if self.end:
            parts[-1] += self.end
        return array("I", [self.vocab[p] for p in merge_word(parts, self.ranks) if p in self.vocab]).tobytes()

    def fold(self, text: str) -> str:
        """The vocabulary's normalizer: NFC, white space to single spaces, lower case letter by letter."""
        if not self.folds:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return text.lower()  # white space only separates words, so runs of it need no replacement

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(self.fold(text))

    def id_bytes(self, text: str) -> bytes:
        """Ids of the whole text as little-endian uint32; special strings in the text give their ids."""
        words = self.words
        if self.special_split is None or "<|" not in text:
            return b"".join([words[w] for w in self.split(text)])
        return b"".join(self.special_ids[p] if p in self.special_ids else b"".join([words[w] for w in self.split(p)]) for p in self.special_split.split(text) if p)

    def ids(self, text: str) -> array:
        return array("I", self.id_bytes(text))

    def tokens(self, ids) -> list[str]:
        return [self.by_id[i] for i in ids]


@lru_cache(4)
def load(path: str) -> Bpe:
    """One vocabulary per Python worker."""
    return Bpe(path)
