"""Exact word_bpe ids at the speed of a dictionary.

The vocabulary's normaliser (NFC, white space to one space, lower case) and its splitting
pattern never join anything over white space, so the ids of a text are the ids of its
white-space separated chunks, one after the other. Chunks are found and fingerprinted (64
bits) for many texts at once on arrays and looked up in a table. A new chunk falls into
pieces by the pattern; the tokenizers library encodes all new pieces as one text, in which
each ends with the first id whose token ends a word.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

#: Slots of a worker's table of words (18 bytes each, half of them used at most).
SLOTS = 1 << 22
#: Bytes of text taken up at a time (a long text is still taken whole).
AT_ONCE = 1 << 20
#: The splitting pattern of the vocabulary file, for characters below U+0250 in lower case.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u017f]*")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """ids(text) -> little-endian uint32 bytes, as Tokenizer.encode(text, add_special_tokens=False).
    Strings of special tokens inside a text are ordinary text."""

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = WordTable(slots)
        # The model alone, for pieces that are normal and in byte letters already.
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()} | {" ": " "})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of chunks that the table doesn't know."""
        out: list = [b""] * len(new)
        plain = list(range(len(new)))
        if not PLAIN.fullmatch("\n".join(new)):
            plain = []
            for i, c in enumerate(new):
                if PLAIN.fullmatch(c):
                    plain.append(i)
                else:
                    out[i] = self.whole(c)
        if not plain:
            return out
        split = []
        for c in "\n".join([new[i] for i in plain]).lower().split("\n"):
            if c.isalpha():
                split.append((c,))
            elif c[:-1].isalpha():
                split.append((c[:-1], c[-1]))
            else:
                split.append(PIECE.findall(c))
        known = dict.fromkeys([p for parts in split for p in parts])
        text = " ".join(known).encode().decode("latin-1").translate(self.letters)
        ids = np.asarray(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(known):
            raise ValueError("the vocabulary doesn't split as this module does")
        raw, at = ids.tobytes(), 0
        for p, end in zip(known, (4 * last).tolist(), strict=True):
            known[p] = raw[at:end]
            at = end
        for i, parts in zip(plain, split, strict=True):
            out[i] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
        return out

    def flat(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts' ids) for UTF-8 texts that
        stand end to end in data, text i at off[i] to off[i + 1]."""
        starts, ends = words(data, off)
        prints = word_prints(data, starts, ends)
        slot = self.table.find(prints)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            fresh, first = np.unique(prints[miss], return_index=True)
            if self.table.used + len(fresh) > self.table.most:
                self.table = WordTable(max(SLOTS, 1 << (4 * len(prints)).bit_length()))  # anew, with room
                return self.flat(data, off)
            raw, at = data.tobytes(), miss[first]
            new = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            got = [x for k in range(0, len(new), 12_000) for x in self.learn(new[k : k + 12_000])]
            self.table.add(fresh, got)
            slot[miss] = self.table.find(prints[miss])
        begin, count = self.table.begin[slot], self.table.count[slot].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.table.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, off)]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        raw = [(t or "").encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        ids, at = self.flat(np.frombuffer(b"".join(raw), np.uint8), off)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space; texts end runs."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    black = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = black.copy()
    starts[1:] &= ~black[:-1] | edge[1:-1]
    ends = black.copy()
    ends[:-1] &= ~black[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


_rng = np.random.default_rng(49)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
ODD = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, n of them at least."""
    for k, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
        while len(_powers[k]) < n:
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, len(_powers[k]), 1 << 64))])
    return _powers


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word, never 0: differences of one running sum."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    x = (total[ends] - total[starts]) * down[starts]
    x += (ends - starts).astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x | np.uint64(1)


class WordTable:
    """Fingerprint -> ids, by open addressing on arrays."""

    def __init__(self, slots: int):
        self.slots, self.most, self.used = slots, slots // 2, 0
        self.shift = np.uint64(64 - (slots - 1).bit_length())
        self.key, self.begin, self.count = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.uint32)
        self.ids, self.end = np.zeros(1 << 16, np.uint32), 0

    def find(self, prints: np.ndarray) -> np.ndarray:
        """The slot of each, or -1."""
        slot = (prints >> self.shift).astype(np.int64)
        got = self.key[slot]
        todo = np.flatnonzero(got != prints)
        while len(todo):
            gone = self.key[slot[todo]] == 0
            slot[todo[gone]] = -1
            todo = todo[~gone]
            slot[todo] = (slot[todo] + 1) % self.slots
            todo = todo[self.key[slot[todo]] != prints[todo]]
        return slot

    def add(self, prints: np.ndarray, ids: list[bytes]) -> None:
        """Distinct new fingerprints."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        while len(self.ids) < self.end + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.end : self.end + len(flat)] = flat
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = self.end + np.cumsum(count) - count
        slot, todo = (prints >> self.shift).astype(np.int64), np.arange(len(prints))
        while len(todo):
            free = self.key[slot[todo]] == 0
            self.key[slot[todo[free]]] = prints[todo[free]]
            done = self.key[slot[todo]] == prints[todo]
            at = slot[todo[done]]
            self.begin[at], self.count[at] = begin[todo[done]], count[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) % self.slots
        self.end += len(flat)
        self.used += len(prints)


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each worker process and vocabulary."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


def forget() -> None:
    """Drop the tables of this process: for stages that need the room and no ids."""
    _made.clear()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc_ids(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
