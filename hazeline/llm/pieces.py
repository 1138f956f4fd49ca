"""SentencePiece BPE by a table of last tokens.

A token sequence is the encoding of its text exactly if each adjacent pair is
the encoding of its own text: the merges inside a pair come in the order in
which they come in the whole, so the first merge across a seam would come in the
pair, too. Hence each prefix has one last token, the only one among the tokens
that end there whose pair with the last token of the prefix before it holds.
An automaton finds the tokens that end at each place, a memo of pairs tells
which hold, and the ids are recovered from the end.
"""

from __future__ import annotations

import heapq
import os
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np

from hazeline.llm.arrays import ranges, same_words, word_hashes

#: Segments kept before the older half goes, and pairs of tokens kept before they are emptied; these bound a worker's memory.
MEMO, PAIRS_KEPT = 250_000, 1_000_000
#: Longest segment, in characters, whose ids are kept.
KEPT = 24
#: How SentencePiece writes a space.
SPACE = "▁"
#: Slots of the filter of character pairs that occur within a piece.
PAIRS = 1 << 21

# Kinds of pieces and field numbers of a SentencePiece model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_TEXT, _SCORE, _KIND = 1, 2, 3
_MODEL_TYPE, _BYTE_FALLBACK, _UNK_ID, _EOS_ID, _UNK_SURFACE = 3, 35, 40, 42, 44
_CHARSMAP, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE = 2, 3, 4, 5
_BPE = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Encoder and decoder for a BPE model file with byte fallback and no rewriting of characters."""

    def __init__(self, data: bytes):
        texts, scores, kinds = [], [], []
        trainer: dict = {}
        norm: dict = {}
        for number, value in _fields(data):
            if number == _PIECE:
                piece = dict(_fields(value))
                texts.append(piece[_TEXT].decode())
                scores.append(struct.unpack("<f", piece[_SCORE])[0] if _SCORE in piece else 0.0)
                kinds.append(piece.get(_KIND, _NORMAL))
            elif number == _TRAINER:
                trainer = dict(_fields(value))
            elif number == _NORMALIZER:
                norm = dict(_fields(value))
        if trainer.get(_MODEL_TYPE) != _BPE or not trainer.get(_BYTE_FALLBACK):
            raise ValueError("only BPE models with byte fallback are read")
        if norm.get(_CHARSMAP) or norm.get(_EXTRA_SPACES, 1) or not norm.get(_DUMMY_PREFIX, 1) or not norm.get(_ESCAPE, 1):
            raise ValueError("only models that keep their characters and put a space before a text are read")
        if set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("models with pieces of the user are not read")
        self.unknown = trainer.get(_UNK_ID, 0)
        self.end = trainer.get(_EOS_ID, 2)
        surface = trainer.get(_UNK_SURFACE, " ⁇ ".encode())
        self.ids = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k == _NORMAL}
        # pieces of equal score share a rank: the leftmost goes first
        order = {s: i for i, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {t: order[scores[i]] for t, i in self.ids.items()}
        self.byte_ids = [0] * 256
        #: What each id decodes to, and whether it is a single byte, or a piece that may lose the space before the text.
        self.shown = [t.replace(SPACE, " ").encode() for t in texts]
        self.is_byte, self.spaced = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        for i, (t, k) in enumerate(zip(texts, kinds, strict=True)):
            if k == _BYTE:
                b = int(t[3:5], 16)
                self.byte_ids[b], self.shown[i], self.is_byte[i] = i, bytes([b]), True
            elif k == _CONTROL:
                self.shown[i] = b""
            elif k == _UNKNOWN:
                self.shown[i] = surface
            else:
                self.spaced[i] = t.startswith(SPACE)
        self._size = len(texts)

        # a character that occurs in pieces without being one is a token of its own until bytes replace it
        alphabet = sorted(set(chain.from_iterable(self.ids)))
        self._token = dict(self.ids)
        self._bare: dict[int, tuple[int, ...]] = {}
        for c in alphabet:
            if c not in self._token:
                self._token[c] = self._size + len(self._bare)
                self._bare[self._token[c]] = self._bytes(c)
        self._text = {i: t for t, i in self._token.items()}
        self._lengths = [len(self._text.get(i, "")) for i in range(self._size + len(self._bare))]
        self._classes = np.zeros(0x110000, np.uint32)
        self._classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self._joined = np.zeros(PAIRS, bool)
        every = np.array(sorted({p for t in self.ids for p in zip(t, t[1:], strict=False)}))
        codes = [self._classes[[ord(c) for c in every[:, k]]] for k in (0, 1)] if len(every) else [np.zeros(0, np.uint32)] * 2
        self._joined[self._slot(*codes)] = True

        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for t, i in self._token.items():
            self._automaton.add_word(t, i)
        self._automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        #: Segments of late, and those of a while before.
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - PAIRS.bit_length() + 1)

    def _bytes(self, text: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in text.encode())

    def _merged(self, text: str) -> list[str]:
        """Merge the adjacent pair of best score, the leftmost first, until none is left (only pairs of tokens come here)."""
        get, n = self.rank.get, len(text)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = stop[i]
            if not j or j == n or get(text[i : (k := stop[j])]) != r:
                continue  # a part has changed since
            stop[i], stop[j] = k, 0
            if k < n:
                before[k] = i
                if (r := get(text[i : stop[k]])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := get(text[h:k])) is not None:
                heapq.heappush(heap, (r, h))
        out, i = [], 0
        while i < n:
            out.append(text[i : stop[i]])
            i = stop[i]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether the pair of tokens encodes its own text; ``a`` is -1 for the start of a segment."""
        pair = [self._text[b]] if a < 0 else [self._text[a], self._text[b]]
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        found = self._pairs[a << 20 | b] = self._merged("".join(pair)) == pair
        return found

    def encode_segment(self, text: str) -> tuple[int, ...]:
        """Ids of a segment: the table of last tokens forward, the ids backward."""
        if len(text) == 1 and text not in self._token:
            return self._bytes(text)
        known, lengths = self._pairs.get, self._lengths
        last, done = [-1] * (len(text) + 1), -1  # the last token of each prefix
        for at, token in self._automaton.iter(text):
            if at != done:
                before = last[at + 1 - lengths[token]]
                holds = known(before << 20 | token)
                if holds or holds is None and self.fits(before, token):
                    last[at + 1], done = token, at
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        if self._bare and max(out) >= self._size:
            return tuple(chain.from_iterable(self._bare.get(i, (i,)) for i in out))
        return tuple(out)

    def segment_starts(self, codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Places where no piece can cross: between two characters that stand side by side in no piece."""
        kinds = self._classes[codes]
        edge = np.ones(len(codes), bool)
        edge[1:] = ~self._joined[self._slot(kinds[:-1], kinds[1:])] | (kinds[1:] == 0) | (kinds[:-1] == 0)
        edge[doc_starts] = True
        return np.flatnonzero(edge)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offsets of each text's ids (one more than texts); the end id is not among them."""
        joined = "".join(SPACE + t for t in texts if t).replace(" ", SPACE)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        starts = self.segment_starts(codes, first[sizes > 0])
        ends = np.append(starts[1:], len(codes))
        where, inverse = _distinct(codes, starts, ends)
        if len(self._known) > MEMO:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        entries = []
        for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True):
            segment = joined[a:b]
            e = known.get(segment)
            if e is None:
                e = older.get(segment) or self.encode_segment(segment)
                if b - a <= KEPT:
                    known[segment] = e
            entries.append(e)
        lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        flat = np.fromiter(chain.from_iterable(entries), np.int64, int(lengths.sum()))
        each = lengths[inverse]
        ids = flat[ranges((np.cumsum(lengths) - lengths)[inverse], each)]
        done = np.append(0, np.cumsum(each))
        return ids, done[np.searchsorted(starts, np.append(first, len(codes)))]

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: one space at its start goes, and each byte that is part of no character becomes U+FFFD."""
        shown = [self.shown[i] for i in ids]
        for k, i in enumerate(ids):  # up to the first id that shows anything
            if self.spaced[i] and not self.is_byte[i]:
                shown[k] = shown[k][1:]
                break
            if shown[k]:
                break
        try:
            if b"" not in shown[:-1]:  # what shows nothing parts the bytes around it
                return b"".join(shown).decode()
        except UnicodeDecodeError:
            pass
        return self._mended(ids, shown)

    def _mended(self, ids: list[int], shown: list[bytes]) -> str:
        out, run = [], b""
        for i, part in zip([*ids, -1], [*shown, b""], strict=True):
            if i >= 0 and self.is_byte[i]:
                run += part
                continue
            while run:
                size = next((n for n in range(1, 5) if _is_character(run[:n])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[size or 1 :]
            out.append(part.decode())
        return "".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct segments and each segment's number among them; hashes propose, the characters decide."""
    wide = np.dtype(np.uint16 if codes.max() < 1 << 16 else np.uint32)
    data, size = codes.astype(wide).view(np.uint8), wide.itemsize
    a, b = starts * size, ends * size
    _, where, inverse = np.unique(word_hashes(data, a, b), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_words(data, a, b, where[inverse]))
    inverse[odd] = len(where) + np.arange(len(odd))
    return np.append(where, odd), inverse


_models: dict[tuple[str, int], PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per file in each worker; the file is reread if it changes."""
    key = path, os.stat(path).st_mtime_ns
    if key not in _models:
        with open(path, "rb") as f:
            found = PieceModel(f.read())
        _models.clear()
        _models[key] = found
    return _models[key]
