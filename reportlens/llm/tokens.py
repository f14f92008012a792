"""Token ids of whole texts with a public tokenizer, each distinct word encoded once per worker."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .arrays import SPACE, hash_runs, text_buffer, text_slices

MOST_KEPT = 500_000       # words a worker remembers; then it starts anew
STOPS = np.zeros(256, bool)
STOPS[list(b"!#$%&*,.:;?")] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _cuts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Borders at which both tokenizers always split.

    A border lies before ASCII white space that follows something else, before one of STOPS that follows
    an ASCII letter or one of U+00C0 to U+00FF, and before an ASCII letter that follows a single line
    feed. Characters that may be white space beyond ASCII are kept with what follows, since the
    tokenizers take runs of white space as a whole.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    before = [data[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    wide = (before[2] >= 0xE1) & (before[2] <= 0xE3) & np.isin(before[1], (0x80, 0x81, 0x9A))
    odd = wide | ((before[1] == 0xC2) & np.isin(before[0], (0x85, 0xA0))) | ((before[0] >= 0x1C) & (before[0] <= 0x1F))
    cut[at[odd]] = False
    letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    ends = letter.copy()                    # last bytes of letters
    ends[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut[1:] |= (STOPS[data[1:]] & ends[:-1]) | (letter[1:] & (data[:-1] == 0x0A) & cut[:-1])
    cut[borders[:-1][np.diff(borders) > 0]] = True
    return np.flatnonzero(cut)


LATIN_WORD = re.compile("( ?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes batches of texts; remembers the ids of the pieces it has seen.

    Plain words go straight to the tokenizer's model, all other pieces through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.folds = getattr(self.model, "end_of_word_suffix", None) == "</w>"     # lower case, white space dropped
        self._forget()

    def _word_ids(self, piece: str) -> list[int] | None:
        word = piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalpha():
            word = word.lower() if self.folds else word if word == piece else self.letters[0x20] + word
            return [x.id for x in self.model.tokenize(word)]
        plain = LATIN_WORD.fullmatch(piece)
        if not plain:
            return None
        word = plain[2].lower() if self.folds else piece
        return [x.id for x in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def _forget(self) -> None:
        self.words, self.hashes, self.row = pa.array([], pa.large_string()), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.begin = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        ids = [self._word_ids(x) for x in pieces]
        odd = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([pieces[i] for i in odd], add_special_tokens=False)):
            ids[i] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _learn(self, pieces: pa.Array, hashes: np.ndarray) -> None:
        ids, sizes = self._ids(pieces.to_pylist())
        used, more = int(self.begin[-1]), len(ids)
        if used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(max(used, more) + more, np.uint32)])
        self.flat[used:used + more] = ids
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.row = np.insert(self.hashes, at, hashes[order]), np.insert(self.row, at, len(self.words) + order)
        self.words = pa.concat_arrays([self.words, pieces])
        self.begin = np.concatenate([self.begin, used + np.cumsum(sizes)])

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where those of each distinct piece begin in them, and how many it has.

        Pieces are found by a hash and then compared, so two with one hash do no harm.
        """
        data, borders = text_buffer(pieces)
        hashes = hash_runs(data, borders[:-1], borders[1:])
        new = np.arange(len(hashes))
        if len(self.hashes):
            new = np.flatnonzero(self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] != hashes)
        if len(self.words) + len(new) > MOST_KEPT:
            self._forget()
            new = np.arange(len(hashes))
        if len(new):
            self._learn(pieces.take(pa.array(new)), hashes[new])
        row = self.row[np.searchsorted(self.hashes, hashes)]
        if self.words.take(pa.array(row)).equals(pieces):
            return self.flat, self.begin[row], self.begin[row + 1] - self.begin[row]
        ids, sizes = self._ids(pieces.to_pylist())
        return ids, np.cumsum(sizes) - sizes, sizes

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their n + 1 borders; null is an empty text."""
        done = [self._encode(column.slice(a, b - a)) for a, b in text_slices(column)]
        ids, ends = [np.zeros(0, np.uint32), *(d[0] for d in done)], np.cumsum([0, *(len(d[0]) for d in done)])
        borders = [np.zeros(1, np.int64), *(d[1][1:] + e for d, e in zip(done, ends))]
        return np.concatenate(ids), np.concatenate(borders)

    def _encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        data, borders = text_buffer(column)
        cuts = _cuts(data, borders)
        if not len(cuts):
            return np.zeros(0, np.uint32), np.zeros(len(borders), np.int64)
        ends = np.append(cuts, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
        seen = pieces.dictionary_encode()
        flat, begin, sizes = self._known(seen.dictionary)
        at = seen.indices.to_numpy()
        begin, sizes = begin[at], sizes[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(begin - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(cuts, borders)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
