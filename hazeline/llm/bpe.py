"""Byte-level BPE by monoid tree reduction.

``encode`` cuts a piece into halves, encodes them recursively and joins them:
the tokens on both sides of the seam are re-encoded in a growing window until
the tokens just outside it provably stay. A sequence is the encoding of its
bytes exactly if every adjacent pair re-encodes to itself, so a window is done
once the pairs across both of its edges do. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import heapq
import os
from itertools import chain

import numpy as np

from hazeline.llm.arrays import ranges, same_words, word_hashes

#: Entries kept per memo before it is emptied; bounds a worker's memory.
MEMO = 200_000
#: Longest piece, in bytes, whose encoding is kept: halves of words recur far more than words.
HALF = 8
#: Pieces from which encodings are kept again, as halves of long runs recur, and the bytes of these that are kept together.
LONG, LONG_KEPT = 256, 32 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MonoidBpe:
    """Encoder and decoder for one rank table; associative ``join`` makes any tree shape give the same ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._pieces: dict[bytes, tuple[int, ...]] = {}
        self._windows: dict[bytes, tuple[int, ...]] = {}
        self._seams: dict[tuple[int, int], tuple[int, ...]] = {}
        self._kept = 0

    def _window(self, data: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked adjacent pair, the leftmost first, until none is left (only seams' windows come here)."""
        found = self._windows.get(data)
        if found is None:
            found = self._merged(data)
            if len(data) <= 64:
                if len(self._windows) >= MEMO:
                    self._windows.clear()
                self._windows[data] = found
        return found

    def _merged(self, data: bytes) -> tuple[int, ...]:
        get, n = self.ranks.get, len(data)
        stop = list(range(1, n + 1))  # end of the part that starts here; 0 once it is merged into another
        before = list(range(-1, n - 1))
        pairs = [(r, i) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            r, i = heapq.heappop(pairs)
            j = stop[i]
            if not j or j == n or get(data[i : (k := stop[j])]) != r:
                continue  # one of the two parts has changed since
            stop[i], stop[j] = k, 0
            if k < n:
                before[k] = i
                if (r := get(data[i : stop[k]])) is not None:
                    heapq.heappush(pairs, (r, i))
            h = before[i]
            if h >= 0 and (r := get(data[h:k])) is not None:
                heapq.heappush(pairs, (r, h))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : stop[i]]])
            i = stop[i]
        return tuple(out)

    def seam(self, a: int, b: int) -> tuple[int, ...]:
        """What the adjacent pair (a, b) re-encodes to; the pair stays if that is (a, b)."""
        found = self._seams.get((a, b))
        if found is None:
            if len(self._seams) >= MEMO:
                self._seams.clear()
            found = self._seams[a, b] = self._window(self.bytes_of[a] + self.bytes_of[b])
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        mid = self.seam(left[-1], right[0])
        if mid == (left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            firm_left = i == len(left) or self.seam(left[-i - 1], mid[0]) == (left[-i - 1], mid[0])
            firm_right = j == len(right) or self.seam(mid[-1], right[j]) == (mid[-1], right[j])
            if firm_left and firm_right:
                return left[: len(left) - i] + mid + right[j:]
            i = i if firm_left else min(len(left), 2 * i)
            j = j if firm_right else min(len(right), 2 * j)
            mid = self._window(self.decode(left[len(left) - i :] + right[:j]))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) < 2:
            return (self.ranks[piece],) if piece else ()
        found = self._pieces.get(piece)
        if found is None:
            # a power of two, so that long runs of one sign or of a short pattern fall into equal pieces and stable seams
            half = 1 << (len(piece) - 1).bit_length() - 1
            found = self.join(self.encode(piece[:half]), self.encode(piece[half:]))
            if len(piece) <= HALF:
                if len(self._pieces) >= MEMO:
                    self._pieces.clear()
                self._pieces[piece] = found
            elif len(piece) >= LONG:
                self._kept += len(piece)
                if self._kept > LONG_KEPT:
                    self._pieces.clear()
                    self._kept = len(piece)
                self._pieces[piece] = found
        return found

    def decode(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


# The White_Space code points of Unicode.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        import regex

        table = np.zeros(0x110000, np.uint8)
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        table[WHITE] = _SPACE
        _classes.append(table)
    return _classes[0]


def pretoken_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches over documents laid end to end; no match crosses a document.

    Letters, numbers and other signs form runs that take one space before them;
    a run of white space gives its last character up if text follows; a lone
    apostrophe takes the ending s, t, re, ve, m, ll or d.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _class_table()[codes]
    fresh = np.zeros(n + 1, bool)
    fresh[doc_starts] = True
    fresh[n] = True
    edge = fresh.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    # a space run's last character belongs to what follows
    after = np.flatnonzero(edge[1:n] & ~fresh[1:n] & (kind[:-1] == _SPACE)) + 1
    edge[after - 1] = True
    edge[after[codes[after - 1] == 0x20]] = False
    # contractions
    quote = np.flatnonzero(edge[:n] & (codes == 0x27))
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1]]
    if len(quote):
        one = codes[quote + 1]
        two = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
        two[fresh[np.minimum(quote + 2, n)]] = 0
        c = {x: ord(x) for x in "stmdrevl"}
        single = np.isin(one, [c["s"], c["t"], c["m"], c["d"]])
        double = ((one == c["r"]) | (one == c["v"])) & (two == c["e"]) | (one == c["l"]) & (two == c["l"])
        edge[quote[single | double] + 1] = False
        edge[quote[single] + 2] = True
        at = quote[double]
        edge[at + 2] = False
        edge[at + 3] = True
    return np.flatnonzero(edge[:n])


class BatchEncoder:
    """Ids of many whole texts at once: numpy cuts the words and finds equal ones, each new word goes to ``encode_word``."""

    def __init__(self, encode_word, memo: int = MEMO):
        self.encode_word, self.memo, self.known = encode_word, memo, {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offsets of each text's ids (one more than texts)."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        starts = pretoken_starts(codes, first[sizes > 0])
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(codes))
        where, inverse = self._distinct(codes, starts, ends)
        known, entries = self.known, []
        if len(known) > self.memo:
            known.clear()
        for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True):
            word = joined[a:b]
            e = known.get(word)
            if e is None:
                e = self.encode_word(word)
                if b - a <= 24:
                    known[word] = e
            entries.append(e)
        lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        flat = np.fromiter(chain.from_iterable(entries), np.uint32, int(lengths.sum()))
        each = lengths[inverse]
        ids = flat[ranges((np.cumsum(lengths) - lengths)[inverse], each)]
        done = np.append(0, np.cumsum(each))
        offsets = done[np.searchsorted(starts, np.append(first, len(codes)))]
        return ids, offsets

    @staticmethod
    def _distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First places of the distinct words, and each word's number among them; hashes propose, the words themselves decide."""
        wide = next(k for k in (np.uint8, np.uint16, np.uint32) if codes.max() <= np.iinfo(k).max)
        data, size = codes.astype(wide).view(np.uint8), np.dtype(wide).itemsize
        _, where, inverse = np.unique(word_hashes(data, starts * size, ends * size), return_index=True, return_inverse=True)
        odd = np.flatnonzero(~same_words(data, starts * size, ends * size, where[inverse]))
        inverse[odd] = len(where) + np.arange(len(odd))
        return np.append(where, odd), inverse


_encoders: dict[tuple[str, int], MonoidBpe] = {}


def encoder(path: str) -> MonoidBpe:
    """One encoder per rank file in each worker; the file is reread if it changes."""
    key = path, os.stat(path).st_mtime_ns
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = MonoidBpe(load_ranks(path))
    return _encoders[key]
