"""Token ids of many texts at once for a byte-level BPE vocabulary.

Texts are cut into words by class runs over the bytes of a whole batch; a word's ids come from a table keyed by the
word's hash, and only words not in the table are encoded one by one. The ids equal those of the tokenizer file.
"""

from __future__ import annotations

import base64

import numpy as np
import tiktoken
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from earshot.llm import rolling

SLOT_BITS = 21
#: The table of known words is emptied when it holds so many ids.
POOL_IDS = 1 << 24
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
#: Endings that stay with their apostrophe (fixed value of the vocabulary's split rule).
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class Encoder:
    """``ranks_path``: the vocabulary as ranks; ``pattern``: its split rule, used for nothing but loading."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._piece = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self._tests = [(k, Split(Regex(r), "removed")) for k, r in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
        self._learn(np.arange(128))
        self._clear()

    def _learn(self, points: np.ndarray) -> None:
        for p in points.tolist():
            self._kind[p] = next((k for k, test in self._tests if not test.pre_tokenize_str(chr(p))), OTHER)

    def _clear(self) -> None:
        self._tag = np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self._at = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self._len = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self._pool = np.zeros(1 << 16, dtype=np.uint16)
        self._used = 0

    def _classes(self, data: np.ndarray) -> np.ndarray:
        kinds = self._kind[np.minimum(data, 127)]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
            for k in range(1, 4):
                more = size > k
                point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
            new = np.unique(point[self._kind[point] == UNKNOWN])
            self._learn(new)
            for k in range(4):
                kinds[lead[size > k] + k] = self._kind[point[size > k]]
        return kinds

    def word_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of all words; every row's first byte is one."""
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.int64)
        kinds = self._classes(data)
        row_start = np.zeros(n, dtype=bool)
        row_start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = row_start.copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        runs = np.flatnonzero(start)
        after_space = runs[(runs > 0) & ~row_start[runs] & (kinds[runs - 1] == SPACE)]
        last = after_space - 1
        for _ in range(3):
            last -= (data[last] & 0xC0) == 0x80
        start[last] = True
        joined = data[last] == 0x20
        start[after_space[joined]] = False
        # contractions: a lone apostrophe that begins a word, and letters
        mark = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & (kinds[1:] == LETTER) & start[1:] & ~row_start[1:])
        for i in mark.tolist():
            tail = data[i + 1 : i + 3].tobytes()
            size = next((len(c) for c in CONTRACTIONS if tail.startswith(c) and not row_start[i + 1 : i + 1 + len(c)].any()), 0)
            if size:
                start[i + 1] = False
                if i + 1 + size < n:
                    start[i + 1 + size] = True
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the number of every row."""
        starts = self.word_starts(data, offsets)
        rows = len(offsets) - 1
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(rows, np.int64)
        if self._used > POOL_IDS:
            self._clear()
        ends = np.append(starts[1:], len(data))
        names = rolling.substring_hashes(rolling.prefix_hashes(data), starts, ends) | np.uint64(1)
        slot = (names >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = self._tag[slot] == names
        at, size = self._at[slot], self._len[slot].astype(np.int64)
        missing = np.flatnonzero(~hit)
        if len(missing):
            _, first, back = np.unique(names[missing], return_index=True, return_inverse=True)
            where = missing[first]
            raw = data.tobytes()
            pieces = [self._piece(raw[a:b]) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            lengths = np.array([len(p) for p in pieces])
            total = int(lengths.sum())
            if self._used + total > len(self._pool):
                self._pool = np.concatenate((self._pool, np.zeros(max(total, len(self._pool)), np.uint16)))
            self._pool[self._used : self._used + total] = [i for p in pieces for i in p]
            begin = self._used + np.cumsum(lengths) - lengths
            self._used += total
            at[missing], size[missing] = begin[back], lengths[back]
            self._tag[slot[where]], self._at[slot[where]], self._len[slot[where]] = names[where], begin, lengths
            # two new words of one slot: the tag must belong to the entry
            clash = self._tag[slot[where]] != names[where]
            if clash.any():
                again = np.unique(slot[where[clash]])
                self._tag[again] = 0
        ids = self._pool[np.repeat(at, size) + rolling.ragged_arange(size)]
        per_word = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(per_word[np.searchsorted(starts, offsets)])


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """The encoder of this worker process."""
    if (ranks_path, pattern) not in _loaded:
        _loaded[ranks_path, pattern] = Encoder(ranks_path, pattern)
    return _loaded[ranks_path, pattern]
