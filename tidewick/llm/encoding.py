"""Token ids of whole texts, by a public tokenizer's file, for tasks that encode many texts.

Byte-level BPE never joins over a space that stands alone before a word, nor over a line break. So the ids of a text
are those of its words, each with the space or line break before it, and words recur: a worker sends each to the
tokenizer once and keeps its bytes and ids in flat arrays. The words of a whole slice of texts are looked up at once by
their hashes, and their bytes compared, so equal hashes do no harm. Texts with other white space than single spaces and
line breaks between words go to the tokenizer as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import tokens

#: Words that a worker keeps; beyond that it starts afresh. Each takes about 50 bytes.
CACHE = 1_500_000
#: Words that are sent to the tokenizer as one text.
TOGETHER = 300
#: Bytes of texts to encode at once.
SLICE_BYTES = 500_000
_SLOT_BITS = 22


class _Flat:
    """Runs of numbers side by side in one array that grows."""

    def __init__(self, kind: np.dtype):
        self.data, self.ends, self.count = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0

    def add(self, data: np.ndarray, lengths: np.ndarray) -> None:
        used = self.ends[self.count]
        while used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.count + len(lengths) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.data[used : used + len(data)] = data
        self.ends[self.count + 1 : self.count + 1 + len(lengths)] = used + np.cumsum(lengths)
        self.count += len(lengths)

    def take(self, runs: np.ndarray, skip: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """`lengths` numbers of each run behind its first `skip`, one run after the other."""
        at = np.repeat(self.ends[runs] + skip - (np.cumsum(lengths) - lengths), lengths)
        return np.take(self.data, at + np.arange(len(at)), mode="clip")


class Encoder:
    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.keys, self.odd = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, bool)
        self.bytes, self.ids = _Flat(np.uint8), _Flat(self.type)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the words with these keys, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        slot, todo = (keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            word = self.slots[slot]
            there = word >= 0
            hit = there & (self.keys[word] == keys[todo])
            out[todo[hit]] = word[hit]
            on = there & ~hit
            todo, slot = todo[on], (slot[on] + 1) & ((1 << _SLOT_BITS) - 1)
        return out

    def _keep(self, keys: np.ndarray, words: list[bytes], ids: list[np.ndarray], odd: np.ndarray) -> None:
        """Adds words with new, distinct keys; odd: their texts go to the tokenizer whole."""
        base = self.bytes.count
        number = np.arange(base, base + len(keys), dtype=np.int32)
        self.bytes.add(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
        self.ids.add(np.concatenate(ids), np.array([len(x) for x in ids]))
        while base + len(keys) > len(self.keys):
            self.keys, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.odd))
        self.keys[number], self.odd[number] = keys, odd
        slot = (keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(number):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = number[free]
            on = self.slots[slot] != number
            number, slot = number[on], (slot[on] + 1) & ((1 << _SLOT_BITS) - 1)

    def _learn(self, keys: np.ndarray, words: list[bytes], breaks: np.ndarray) -> None:
        """Encodes new words, each behind a line break (`breaks`), whose id it then begins with, or behind a space."""
        texts = [w.decode() for w in words]
        odd = np.array([len(t.split()) != 1 or t[0].isspace() or t[-1].isspace() for t in texts])
        ids = [np.zeros(0, self.type)] * len(words)
        plain = np.flatnonzero(~odd).tolist()
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            text = "".join([("\n" if breaks[i] else "\n ") + texts[i] for i in some])
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            edges = [*np.flatnonzero(found == self.line_break).tolist(), len(found)]
            for i, a, b in zip(some, edges[:-1], edges[1:], strict=True):
                ids[i] = found[a if breaks[i] else a + 1 : b]
        self._keep(keys, words, ids, odd)

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and the n + 1 bounds of the texts."""
        words = tokens.Words(column, lower=False)
        data, starts, ends, bounds = words.data, words.starts, words.ends, words.bounds
        length = ends - starts
        first = np.zeros(len(starts), bool)
        full = bounds[:-1] < bounds[1:]
        first[bounds[:-1][full]] = True
        before = data[np.maximum(starts - 1, 0)]
        breaks = first | (before == 10)
        # a text is plain if one space or line break stands between its words and nothing around them
        gap = np.zeros(len(starts), bool)
        gap[1:] = (starts[1:] - ends[:-1] != 1) | ((before[1:] != 32) & (before[1:] != 10))
        gap[first] = starts[first] != words.offsets[:-1][full]
        plain = np.diff(words.offsets) == 0
        if full.any():
            plain[full] = (np.add.reduceat(gap, bounds[:-1][full]) == 0) & (ends[bounds[1:][full] - 1] == words.offsets[1:][full])
        keys = tokens.mix(words.hashes + breaks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        known = self._find(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            unknown, at = np.unique(keys[new], return_index=True)
            if self.bytes.count + len(unknown) > CACHE and self.bytes.count:
                self._forget()
                new = np.arange(len(keys))
                unknown, at = np.unique(keys, return_index=True)
            at = new[at]
            raw = data.tobytes()
            self._learn(unknown, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], breaks[at])
            known[new] = self._find(keys[new])
        other = self.odd[known] | (self.bytes.ends[known + 1] - self.bytes.ends[known] != length)
        differ = self.bytes.take(known, np.zeros(len(known), np.int64), length) != data[~tokens.SPACES[data]]
        if differ.any():
            other |= np.add.reduceat(differ, np.cumsum(length) - length) > 0
        if other.any():
            plain[np.searchsorted(bounds, np.flatnonzero(other), "right") - 1] = False
        count = np.maximum(self.ids.ends[known + 1] - self.ids.ends[known] - first, 0)
        ids = self.ids.take(known, first.astype(np.int64), count)
        edges = np.concatenate([[0], np.cumsum(count)])[bounds]
        if plain.all():
            return ids, edges
        whole = np.flatnonzero(~plain).tolist()
        found = self.tokenizer.encode_batch_fast([column[i].as_py() for i in whole], add_special_tokens=False)
        parts = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i, x in zip(whole, found, strict=True):
            parts[i] = np.array(x.ids, self.type)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column; a null is an empty text."""
        ids, bounds = self.column(column)
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def ended(self, column: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text and the id that ends it."""
        ids, bounds = self.column(column)
        ids = np.insert(ids, bounds[1:], self.type.type(end))
        bounds = bounds + np.arange(len(bounds))
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """The worker's encoder for a public tokenizer's file; it lasts until a task of another operator slices texts (tokens.KEPT)."""
    return Encoder(name)


def release() -> None:
    """Lets go of the worker's encoders: up to 100 MB of words each, and as much that allocations have left free."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        tokens.spare()


tokens.KEPT["encoder"] = release
