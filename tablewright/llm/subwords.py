"""Subword ids of whole texts, by word.

The public tokenizer used here drops white space and never lets a token span it, so the
ids of a text are those of its words in a row.  A worker keeps the ids of the words it
has met, by the word's hash in sorted arrays, and encodes new words together.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

from tablewright.llm.words import U64, Words

#: New words are encoded so many in a row, with a mark between them that is an id of its own.
TOGETHER, MARK = 200, "\x01"
#: Words whose ids a worker keeps, at about 25 bytes each; beyond it the store starts anew.
KEPT = 2_500_000


#: What the tokenizer puts at the end of each piece of a word.
WORD_END = "</w>"
#: Words of these letters, digits and signs only (no apostrophe) fall into pieces that need no normal form but lower case.
PIECE = "[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+"
PLAIN, PIECES = re.compile(f"(?:{PIECE})+"), re.compile(PIECE)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*shown})) if b != 32}


class Subwords:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # pieces cut here and spelled in byte letters: only the merges are left to do
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for name, i in vocab.items() if name.endswith(WORD_END)]] = True
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.hash, self.first, self.size = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.store, self.used = np.zeros(1 << 20, np.uint16), 0

    def pieces(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of PLAIN words, flat, and how many each has."""
        cut = [PIECES.findall(s) for s in strings]
        rows = [" ".join(chain.from_iterable(cut[a : a + TOGETHER])).lower().encode().decode("latin-1").translate(self.letters) for a in range(0, len(cut), TOGETHER)]
        new = np.concatenate([np.array(e.ids, np.uint16) for e in self.merges.encode_batch_fast(rows, add_special_tokens=False)])
        last = np.flatnonzero(self.closes[new])[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))) - 1]
        return new, np.diff(last, prepend=-1).astype(np.int32)

    def learn(self, h: np.ndarray, strings: list[str]) -> None:
        plain = np.fromiter((PLAIN.fullmatch(s) is not None for s in strings), bool, len(strings))
        for part, encode in ((plain, self.pieces), (~plain, self.marked)):
            at = np.flatnonzero(part)
            if len(at):
                self.keep(h[at], *encode([strings[i] for i in at]))

    def marked(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, flat, and how many each has."""
        plain = not any(MARK in s for s in strings)
        step = TOGETHER if plain else 1
        rows = [f" {MARK} ".join([*strings[a : a + step], ""]) for a in range(0, len(strings), step)] if plain else strings
        lists = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
        new = np.concatenate(lists)
        if plain:
            ends = np.flatnonzero(new == self.mark)
            size = np.diff(ends, prepend=-1).astype(np.int32) - 1
            new = new[new != self.mark]
        else:
            size = np.fromiter(map(len, lists), np.int32, len(lists))
        return new, size

    def keep(self, h: np.ndarray, new: np.ndarray, size: np.ndarray) -> None:
        first = (self.used + np.cumsum(size) - size).astype(np.int32)
        if self.used + len(new) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros(len(self.store) + len(new), np.uint16)))
        self.store[self.used : self.used + len(new)] = new
        self.used += len(new)
        at = np.searchsorted(self.hash, h)
        self.hash, self.first, self.size = np.insert(self.hash, at, h), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def ids(self, words: Words, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the (chosen) words, flat, and how many each word has."""
        h, starts, ends = words.prefix_hash(), words.starts, words.ends
        if chosen is not None:
            h, starts, ends = h[chosen], starts[chosen], ends[chosen]
        raw = words.raw.tobytes()
        if b"<|" in raw:
            # names of special tokens are told apart by case, which the hash does not see
            lists = [self.tokenizer.encode(raw[s:e].decode(), add_special_tokens=False).ids for s, e in zip(starts, ends)]
            return np.fromiter((i for x in lists for i in x), np.uint16), np.fromiter(map(len, lists), np.int64, len(lists))
        if len(self.hash) > KEPT:
            self.clear()
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.hash, u)
        known = self.hash[np.minimum(slot, len(self.hash) - 1)] == u if len(self.hash) else np.zeros(len(u), bool)
        if not known.all():
            self.learn(u[~known], [raw[starts[i] : ends[i]].decode() for i in at[~known]])
            slot = np.searchsorted(self.hash, u)
        first, size = self.first[slot][back].astype(np.int64), self.size[slot][back].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        return self.store[np.arange(total[-1]) - np.repeat(total[:-1] - first, size)], size


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    """The worker's store for a tokenizer file."""
    return Subwords(path)
