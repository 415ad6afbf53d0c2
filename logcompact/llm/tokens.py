"""Token ids of whole texts, with each distinct word encoded once per task."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np

from logcompact.llm.wordkeys import WordKeys

#: Texts of code points below this go by words; others are encoded whole. Below it, no code point composes with another.
LATIN = 0x250
#: White space for Python's tables but not for the tokenizer; and the one letter here whose lower case is two.
WHOLE = (0x1C, 0x1D, 0x1E, 0x1F, 0x130)
SPACE, LETTER, DIGIT, OTHER = range(4)
BLOCK, MOST_WORDS = 1 << 21, 2_000_000
STEP = 0x9E3779B97F4A7C15


def _kind(c: int) -> int:
    if chr(c).isspace():
        return SPACE
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER)


class Words:
    """Ids of words by two hashes, in a table with open addresses; the first tells a word's place."""

    def __init__(self) -> None:
        self.pool = np.zeros(0, dtype=np.uint32)
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.slots = np.full(1 << 16, -1, dtype=np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(STEP)) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 for unknown ones."""
        out, todo, at = np.full(len(keys), -1), np.arange(len(keys)), self._home(keys)
        while len(todo):
            entry = self.slots[at]
            hit = entry >= 0
            if len(self.keys):
                hit &= (self.keys[entry] == keys[todo]) & (self.checks[entry] == checks[todo])
            out[todo[hit]] = entry[hit]
            more = (entry >= 0) & ~hit
            todo, at = todo[more], at[more] + 1 & len(self.slots) - 1
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New and distinct words with their ids one after another."""
        new = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])
        self.keys, self.checks = np.concatenate([self.keys, keys]), np.concatenate([self.checks, checks])
        self.lengths = np.concatenate([self.lengths, lengths])
        if 3 * len(self.keys) > len(self.slots):
            self.slots = np.full(1 << (4 * len(self.keys)).bit_length(), -1, dtype=np.int32)
            new = np.arange(len(self.keys), dtype=np.int32)
        at = self._home(self.keys[new])
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            left = self.slots[at] != new
            new, at = new[left], at[left] + 1 & len(self.slots) - 1

    def __len__(self) -> int:
        return len(self.keys)


class TokenIds:
    """Ids of texts under a tokenizer that lower-cases, drops white space and merges inside words only.

    Words are letter runs, single digits and runs of other marks; a chunk between white space that holds an apostrophe is
    taken as one, since contractions cut it otherwise. Words are told apart by two 64-bit keys within a task.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        points = range(LATIN)
        self.kind = np.array([_kind(c) for c in points], dtype=np.uint8)
        self.lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in points], dtype=np.uint32)
        same = np.unique(self.lower, return_inverse=True)[1]  # characters with one lower case are one symbol
        self.symbol, symbols = same.astype(np.int64), int(same.max()) + 1
        self.key, self.check = WordKeys(symbols, 1), WordKeys(symbols, 2)
        self.words = Words()

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            end, room = at, BLOCK - 1
            while end < len(texts) and room > len(texts[end]):
                room -= len(texts[end]) + 1
                end += 1
            if end == at:  # longer than a block
                yield self.whole(texts[at])
                end += 1
            else:
                yield from self._block(texts[at:end])
            at = end

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        chars = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(sizes) - sizes
        odd = (chars >= LATIN) | np.isin(chars, WHOLE)
        odd[:-1] |= (chars[:-1] == ord("<")) & (chars[1:] == ord("|"))
        slow = np.add.reduceat(odd, first, dtype=np.int64) > 0 if odd.any() else np.zeros(len(texts), dtype=bool)
        if slow.any():
            chars = np.where(np.repeat(slow, sizes), np.uint32(32), chars)
        ids, per_text = self._words(chars, first)
        ends = np.cumsum(per_text)
        out = [ids[e - n : e] for e, n in zip(ends, per_text, strict=True)]
        for k in np.flatnonzero(slow):
            out[k] = self.whole(texts[k])
        return out

    def _words(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = self.kind[chars]
        before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
        starts = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
        quoted = chars == ord("'")
        joined = None
        if quoted.any():  # chunks with an apostrophe stay whole
            chunk = np.cumsum((kind != SPACE) & (before == SPACE))
            marked = np.zeros(chunk[-1] + 1, dtype=bool)
            marked[chunk[quoted]] = True
            joined = marked[chunk] & (kind != SPACE)
            starts &= ~joined | (before == SPACE)
        at = np.flatnonzero(starts)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        closes = np.concatenate([starts[1:] | (kind[1:] == SPACE), [True]]) & (kind != SPACE)
        end = np.flatnonzero(closes) + 1
        symbols = self.symbol[chars]
        keys, checks = self.key(symbols, at, end), self.check(symbols, at, end)
        entry = self.words.find(keys, checks)
        if (entry < 0).any():
            if len(self.words) > MOST_WORDS:
                self.words = Words()
                entry[:] = -1
            self._learn(keys, checks, entry, chars, at, end, joined)
            new = entry < 0
            entry[new] = self.words.find(keys[new], checks[new])
        start, length = self.words.starts[entry], self.words.lengths[entry]
        stop = np.cumsum(length)
        ids = self.words.pool[np.repeat(start - (stop - length), length) + np.arange(stop[-1])]
        of = np.searchsorted(at, np.append(first, len(chars)))
        bounds = np.concatenate([[0], stop])[of]
        return ids, np.diff(bounds)

    def _learn(self, keys, checks, entry, chars, at, end, joined) -> None:
        unknown = np.flatnonzero(entry < 0)
        order = unknown[np.lexsort((checks[unknown], keys[unknown]))]
        first = (np.diff(keys[order], prepend=~keys[order[0]]) != 0) | (np.diff(checks[order], prepend=~checks[order[0]]) != 0)
        place = order[first]
        text = self.lower[chars].tobytes().decode("utf-32-le")
        words = [text[a:b] for a, b in zip(at[place], end[place], strict=True)]
        alone = joined[at[place]] if joined is not None else np.zeros(len(place), dtype=bool)
        if (~alone).any():  # one word each: the ids of a word run to the one that ends it
            flat = self.whole(" ".join(w for w, x in zip(words, alone, strict=True) if not x))
            ends = np.flatnonzero(self.is_end[flat]) + 1
            some = place[~alone]
            self.words.add(keys[some], checks[some], flat, np.diff(ends, prepend=0))
        if alone.any():
            found = [self.whole(w) for w, x in zip(words, alone, strict=True) if x]
            some = place[alone]
            self.words.add(keys[some], checks[some], np.concatenate(found), np.array([len(x) for x in found]))
