"""Token ids of whole texts with a public tokenizer, remembering the words it has seen.

A text is cut where the tokenizer cuts in any case: before ASCII white space that
follows another character, and between an ASCII letter or digit and a full stop or
comma. The ids of such a piece are looked up by its hash; only pieces not met before
by this Python worker go through the tokenizer. Texts with other white space are
encoded whole, so the ids are always those of the whole text. Strings of special
tokens in a text are plain text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from mergelens.llm.words import span_hashes, text_buffers, text_runs

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x1C, 0x1D, 0x1E, 0x1F]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MOST_PIECES = 2_000_000  # then the memory starts afresh
_RUN_BYTES = 4_000_000
_PART_BYTES = 2_000_000  # of a run encoded at a time, as arrays take many times the text
_BATCH = 5_000  # pieces tokenized at a time, as the tokenizer returns much more than ids
_LOADED: dict[str, Encoder] = {}


def _odd_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space beyond ASCII in UTF-8, and of ASCII separators that some count as such."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.r_[data, 0, 0]
    one, two, three = data[at], padded[at + 1], padded[at + 2]
    odd = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
    odd |= (one == 0xE1) & (two == 0x9A) & (three == 0x80)
    odd |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | np.isin(three, (0xA8, 0xA9, 0xAF)))
    odd |= (one == 0xE2) & (two == 0x81) & (three == 0x9F)
    odd |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
    return np.sort(np.r_[at[odd], np.flatnonzero(_SEPARATOR[data])])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)  # sorted
        self._start = np.zeros(0, np.int64)
        self._length = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first in range(0, len(texts), _BATCH):
            found = self._tokenizer.encode_batch_fast(texts[first : first + _BATCH], add_special_tokens=False)
            found = [x.ids for x in found]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(parts), np.concatenate(lengths)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self._hashes)
        known[inside] = self._hashes[at[inside]] == hashes[inside]
        return at, known

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that ``offsets`` (from 0) cut ``data`` into, one after another, and the number of each."""
        space = _SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | (_STOP[data[1:]] & _ALNUM[data[:-1]])
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(begins)
        end = np.r_[start[1:], len(data)][: len(start)]
        hashes, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self._hashes) > _MOST_PIECES:
            self._forget()
        at, known = self._places(hashes)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            ids, lengths = self._encode([raw[a:b].decode() for a, b in spans])
            starts = len(self._ids) + np.cumsum(lengths) - lengths
            self._ids = np.concatenate([self._ids, ids])
            self._start = np.insert(self._start, at[new], starts)
            self._length = np.insert(self._length, at[new], lengths)
            self._hashes = np.insert(self._hashes, at[new], hashes[new])
            at, _ = self._places(hashes)
        place = at[inverse]
        lengths = self._length[place]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._ids[np.repeat(self._start[place] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.r_[0, ends][np.searchsorted(start, offsets)]
        odd = _odd_space(data)
        if len(odd):
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for row in np.unique(np.searchsorted(offsets, odd, side="right") - 1).tolist():
                text = data[offsets[row] : offsets[row + 1]].tobytes().decode()
                parts[row] = self._encode([text])[0]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(bounds)

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Per run of rows ``first`` to ``stop`` their ids, one text after another, and each text's number; null is empty."""
        offsets, data = text_buffers(column)
        for first, stop in text_runs(offsets, _RUN_BYTES):
            ids, counts = [], []
            for a, b in text_runs(offsets[first : stop + 1], _PART_BYTES):
                cut = offsets[first + a : first + b + 1]
                part = self.encode(data[cut[0] : cut[-1]], cut - cut[0])
                ids.append(part[0])
                counts.append(part[1])
            yield first, stop, np.concatenate(ids), np.concatenate(counts)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file; made once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
