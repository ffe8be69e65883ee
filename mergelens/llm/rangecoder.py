"""Context-mixing range coder for token ids below 2^16, many blocks in lockstep.

``Orders`` holds what a run of ids says of the next one: for the id before (order 1)
and for a hash of the two before (order 2) the id that follows most often and its
share, and the share of every id (order 0). It is learned from all ids of the run in
sorts, and kept with the blocks as bytes. Blocks given no such model learn and hold
one of their own; in either case every block is read without the others.

Whether the next id is order 2's, and if not whether it is order 1's, are two choices
whose probabilities mix, in the logistic domain, what both orders say; the weights
adapt in each block, from the same start. What remains goes to order 0, and an id
that order 0 lacks is written as it is. Numbers are integers in doubles, or floats
that go through the same steps, so reading repeats exactly what writing did.

The blocks of a call are the lanes of numpy arrays: one step codes the next id of
every block, and longer blocks come first, so the lanes at work are a prefix. Apart
from its code a lane holds a few numbers; the tables are shared and stay in cache.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_U, _I, _F = np.uint32, np.int64, np.float32
_SIXTEEN = _U(16)
_IDS = 1 << 16
_LAST, _BEFORE = _U(2_654_435_761), _U(2_246_822_519)
_MOST, _ESCAPE = 32_768, 64  # ids that order 0 knows at most, and the least share of all others
_UNSEEN = -64  # the share of a context without a prediction
_WORTH = 5  # times a prediction must have held to be kept, as it takes some bytes
_ALL, _LOW, _WORD = np.int32(_IDS), 2.0**32, 2.0**16
_TABLES = struct.Struct("<IIII")  # entries of order 1, 2 and 0, bytes
_HEADER = struct.Struct("<4sIIIII")  # magic, ids, crc32 of the ids, bytes of an own model and of code, crc32 of both
_MAGIC = b"IDR2"

# Shares are logits times 16 in a byte, their mix is a logit times 256. No choice is certain.
_SQUASH = 1 / (1 + np.exp((2048 - np.arange(4096)) / 256))
_SQUASH = np.clip(np.rint(_SQUASH * 65_536), 32, 65_376).astype(np.int32)
_RATE, _BIAS_RATE = _F(1e-9), _F(0.001)


def _slot(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The order-2 context: a hash of the two ids before, as uint32 below 2^16."""
    return last * _LAST + before * _BEFORE >> _SIXTEEN


def _pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of context * 2^16 + id, sorted, and how often each occurs; sorts ``keys``."""
    keys.sort()
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    edge = np.r_[np.zeros(min(1, len(keys)), _I), edge]
    return keys[edge], np.diff(edge, append=len(keys))


def _followers(pair: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per context the id seen most often (the largest of equals) and, above it, its share."""
    table = np.full(_IDS, _UNSEEN << 16, np.int32)
    if not len(pair):
        return table
    context = pair >> _SIXTEEN
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    top = np.maximum.reduceat(count << 16 | (pair & _U(0xFFFF)), first)
    most, total = top >> 16, np.add.reduceat(count, first)
    odds = (most + 0.02) / (total - most + 0.48)
    share = np.clip(np.rint(16 * np.log(odds)), -127, 127).astype(np.int32)
    often = most >= _WORTH
    table[context[first][often]] = (share << 16 | (top & 0xFFFF).astype(np.int32))[often]
    return table


class Orders:
    """What a run of ids says of the next id, in orders 0 to 2."""

    def __init__(self, one: np.ndarray, two: np.ndarray, size: np.ndarray):
        self._one, self._two, self._size = one, two, size
        # As they are used: a logit times 256 above the id; of order 0 where an id's share of 2^16 begins and its size.
        self.one, self.two = (((x >> 16) << 4 + 16) + (x & 0xFFFF) for x in (one, two))
        self.known = int(size.sum())
        self.symbol = np.repeat(np.arange(_IDS, dtype=np.uint16), size)
        start = np.cumsum(size) - size
        self.others = self.known << 16 | min(_IDS - self.known, 0xFFFF)
        self.place = np.where(size > 0, start << 16 | size, self.others).astype(_U)

    @classmethod
    def learn(cls, ids: np.ndarray) -> Orders:
        ids = ids.astype(_U)
        keys, more = ids.copy(), np.zeros_like(ids)
        keys[1:] |= ids[:-1] << _SIXTEEN
        pair, count = _pairs(keys)
        one = _followers(pair, count)
        seen = np.bincount(pair & _U(0xFFFF), count, _IDS).astype(_I)
        more[1:] = ids[:-1]
        more[1:] *= _LAST
        keys[2:] = ids[:-2]
        keys[2:] *= _BEFORE
        more[2:] += keys[2:]
        more >>= _SIXTEEN
        more <<= _SIXTEEN
        more |= ids
        two = _followers(*_pairs(more))
        if np.count_nonzero(seen) > _MOST:
            seen[np.argsort(-seen, kind="stable")[_MOST:]] = 0
        room = _IDS - _ESCAPE - np.count_nonzero(seen)
        size = (seen > 0) + seen * room // max(1, int(seen.sum()))
        return cls(one, two, size)

    def to_bytes(self) -> bytes:
        parts, entries = [], []
        for table in (self._one, self._two):
            at = np.flatnonzero(table != _UNSEEN << 16)
            entries.append(len(at))
            parts += [np.diff(at, prepend=0).astype("<u2"), (table[at] & 0xFFFF).astype("<u2"), (table[at] >> 16).astype("i1")]
        at = np.flatnonzero(self._size)
        parts += [np.diff(at, prepend=0).astype("<u2"), self._size[at].astype("<u2")]
        packed = zlib.compress(b"".join(x.tobytes() for x in parts))
        return _TABLES.pack(*entries, len(at), len(packed)) + packed

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> tuple[Orders, int]:
        """The model at the start of ``data``, and how many bytes it takes."""
        *entries, length = _TABLES.unpack_from(data)
        raw, at = zlib.decompress(data[_TABLES.size : _TABLES.size + length]), 0

        def values(kind: str, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(raw, kind, n, at - n * np.dtype(kind).itemsize).astype(_I)

        tables = []
        for n in entries[:2]:
            table = np.full(_IDS, _UNSEEN << 16, np.int32)
            where, ids = np.cumsum(values("<u2", n)), values("<u2", n)
            table[where] = values("i1", n) << 16 | ids
            tables.append(table)
        size = np.zeros(_IDS, _I)
        where = np.cumsum(values("<u2", entries[2]))
        size[where] = values("<u2", entries[2])
        return cls(*tables, size), _TABLES.size + length


class _Mixer:
    """Probabilities of the two choices and the weights the blocks have learned; the same when writing and when reading."""

    def __init__(self, lanes: int, orders: Orders):
        self.orders = orders
        self.last, self.before = np.zeros(lanes, _U), np.zeros(lanes, _U)
        # Of order 2, of order 1 and alone, first for order 2's id, then for order 1's; 2,048 is even odds.
        self.weights = [np.full(lanes, x, _F) for x in (0.9, 0.2, 2048, 0.8, 0.1, 1900)]

    def predict(self, n: int) -> None:
        """The orders' ids, and where their shares of 2^16 end, for the first ``n`` lanes."""
        last = self.last[:n]
        two = self.orders.two.take(_slot(last, self.before[:n]), mode="clip")
        one = self.orders.one.take(last, mode="clip")
        self.id2, self.id1 = two & 0xFFFF, one & 0xFFFF
        self.other = self.id1 != self.id2
        self.says2, self.says1 = (two >> 16).astype(_F), (one >> 16).astype(_F)
        # Order 1 speaks for order 2's id if it is its own, else against it.
        self.agrees = self.says1 * (1 - 2 * self.other.view(np.int8))
        w = [x[:n] for x in self.weights]
        mixed = w[0] * self.says2 + w[1] * self.agrees + w[2]
        self.p2 = _SQUASH.take(mixed.astype(_I), mode="clip")
        mixed = w[3] * self.says1 + w[4] * self.says2 + w[5]
        self.p1 = _SQUASH.take(mixed.astype(_I), mode="clip")
        # No share is ever empty, but order 1's when it is order 2's id.
        self.end2 = self.p2
        self.end1 = self.p2 + (((65_472 - self.p2) * (self.p1 >> 1) >> 15) + 16) * self.other

    def learn(self, n: int, ids: np.ndarray, is2: np.ndarray, is1: np.ndarray) -> None:
        w = [x[:n] for x in self.weights]
        wrong = (is2 * _F(65_536) - self.p2.astype(_F))
        w[2] += wrong * _BIAS_RATE
        wrong *= _RATE
        w[0] += wrong * self.says2
        w[1] += wrong * self.agrees
        wrong = (is1 * _F(65_536) - self.p1.astype(_F)) * (self.other & ~is2)
        w[5] += wrong * _BIAS_RATE
        wrong *= _RATE
        w[3] += wrong * self.says1
        w[4] += wrong * self.says2
        self.before[:n], self.last[:n] = self.last[:n], ids


def _lanes(sizes: list[int]) -> tuple[list[int], list[int]]:
    """Longest first: the order of the blocks, and per step how many are at work."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    steps = np.arange(max(sizes, default=0))
    return order, np.searchsorted(-np.array([sizes[i] for i in order], _I), -steps, side="left").tolist()


def encode(blocks: list[np.ndarray], orders: Orders | None = None) -> list[bytes]:
    """Each block of ids as bytes that can be read without the others, with ``orders`` or a model of its own."""
    if any(len(b) and int(b.max()) >= _IDS for b in blocks):
        raise ValueError("ids must be below 65,536")
    if orders is not None:
        return _encode(blocks, orders, b"")
    own = [Orders.learn(b) for b in blocks]
    return [_encode([b], x, x.to_bytes())[0] for b, x in zip(blocks, own, strict=True)]


def _encode(blocks: list[np.ndarray], orders: Orders, own: bytes) -> list[bytes]:
    order, working = _lanes([len(b) for b in blocks])
    ids = np.zeros((len(working), len(order)), np.uint16)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
    mixer = _Mixer(len(order), orders)
    low, width = np.zeros(len(order)), np.full(len(order), _LOW * _WORD)
    who, what = [], []  # lanes that gave a word, and the words, which may carry

    def shift(lanes: np.ndarray) -> None:
        now = low[lanes]
        word = np.floor(now * (1 / _LOW))
        who.append(lanes.astype(np.uint16 if len(order) <= _IDS else _U))
        what.append(word.astype(_U))
        low[lanes] = (now - word * _LOW) * _WORD

    def settle(lanes: np.ndarray) -> None:
        while len(lanes):
            shift(lanes)
            width[lanes] = wide = width[lanes] * _WORD
            lanes = lanes[wide < _LOW]

    for step, n in enumerate(working):
        now = ids[step, :n]
        mixer.predict(n)
        is2 = mixer.id2 == now
        is1 = (mixer.id1 == now) & ~is2
        rest = ~(is2 | is1)
        start = mixer.end2 * is1 + mixer.end1 * rest
        end = mixer.end2 * is2 + mixer.end1 * is1 + _ALL * rest
        part = np.floor(width[:n] * (1 / _WORD))
        low[:n] += part * start
        np.multiply(part, end - start, out=width[:n])
        rest = np.flatnonzero(rest)
        if len(rest):
            place = orders.place.take(now[rest], mode="clip")
            start = place >> _SIXTEEN
            part = np.floor(width[rest] * (1 / _WORD))
            low[rest] += part * start
            width[rest] = part * (place & _U(0xFFFF))
            plain = rest[start == orders.known]
            if len(plain):
                settle(plain[width[plain] < _LOW])
                part = np.floor(width[plain] * (1 / _WORD))
                low[plain] += part * now[plain]
                width[plain] = part
        settle(np.flatnonzero(width[:n] < _LOW))  # at most two words, as no share is empty
        mixer.learn(n, now, is2, is1)
    for _ in range(3):
        shift(np.arange(len(order)))
    lanes = np.concatenate(who)
    words = np.concatenate(what)[np.argsort(lanes, kind="stable")]
    ends = np.cumsum(np.bincount(lanes, minlength=len(order))).tolist()
    while len(over := np.flatnonzero(words > 0xFFFF)):  # never the first of a lane
        words[over] &= _U(0xFFFF)
        words[over - 1] += _U(1)
    words = words.astype("<u2")
    coded: list[bytes] = [b""] * len(order)
    for first, end, i in zip([0, *ends], ends, order, strict=False):
        code = words[first:end].tobytes()
        crc = zlib.crc32(blocks[i].astype("<u4").tobytes())
        check = zlib.crc32(code, zlib.crc32(own))
        coded[i] = _HEADER.pack(_MAGIC, len(blocks[i]), crc, len(own), len(code), check) + own + code
    return coded


def split(data: bytes | memoryview, count: int) -> tuple[list[tuple], int]:
    """Headers, own models and codes of ``count`` blocks at the start of ``data``, and how many bytes they take."""
    found, at = [], 0
    for _ in range(count):
        magic, n, crc, own, length, check = _HEADER.unpack_from(data, at)
        at += _HEADER.size
        both = bytes(data[at : at + own + length])
        if magic != _MAGIC or len(both) != own + length or zlib.crc32(both) != check:
            raise ValueError("damaged block")
        found.append((n, crc, both[:own], both[own:]))
        at += own + length
    return found, at


def decode(blocks: list[tuple], orders: Orders | None = None) -> list[np.ndarray]:
    """Ids of the blocks that ``split`` found; a wrong checksum is an error."""
    if orders is not None:
        return _decode(blocks, orders)
    return [_decode([b], Orders.from_bytes(b[2])[0])[0] for b in blocks]


def _decode(blocks: list[tuple], orders: Orders) -> list[np.ndarray]:
    order, working = _lanes([b[0] for b in blocks])
    room = max([len(b[3]) for b in blocks], default=0) // 2 + 8
    words = np.zeros((len(order), room), np.uint16)
    for lane, i in enumerate(order):
        words[lane, : len(blocks[i][3]) // 2] = np.frombuffer(blocks[i][3], "<u2")
    code = (words[:, 0] * _WORD + words[:, 1]) * _WORD + words[:, 2]
    words, used = words.ravel(), np.arange(len(order), dtype=_I) * room + 3
    width = np.full(len(order), _LOW * _WORD)
    mixer, ids = _Mixer(len(order), orders), np.zeros((len(working), len(order)), np.uint16)

    def settle(lanes: np.ndarray) -> None:
        while len(lanes):
            at = used[lanes]
            code[lanes] = code[lanes] * _WORD + words.take(at, mode="clip")
            used[lanes] = at + 1
            width[lanes] = wide = width[lanes] * _WORD
            lanes = lanes[wide < _LOW]

    for step, n in enumerate(working):
        mixer.predict(n)
        part = np.floor(width[:n] * (1 / _WORD))
        at = code[:n] / part
        is2, rest = at < mixer.end2, at >= mixer.end1
        is1 = ~(is2 | rest)
        start = mixer.end2 * is1 + mixer.end1 * rest
        end = mixer.end2 * is2 + mixer.end1 * is1 + _ALL * rest
        code[:n] -= part * start
        np.multiply(part, end - start, out=width[:n])
        now = ids[step, :n]
        now[:] = np.where(is2, mixer.id2, mixer.id1)
        rest = np.flatnonzero(rest)
        if len(rest):
            part = np.floor(width[rest] * (1 / _WORD))
            at = (code[rest] / part).astype(_I)
            symbol = orders.symbol.take(at, mode="clip") if orders.known else np.zeros(len(rest), np.uint16)
            place = orders.place.take(symbol, mode="clip")
            odd = np.flatnonzero(at >= orders.known)
            place[odd] = orders.others
            code[rest] -= part * (place >> _SIXTEEN)
            width[rest] = part * (place & _U(0xFFFF))
            if len(odd):
                plain = rest[odd]
                settle(plain[width[plain] < _LOW])
                part = np.floor(width[plain] * (1 / _WORD))
                at = np.minimum(code[plain] / part, 65_535).astype(np.uint16)
                code[plain] -= part * at
                width[plain] = part
                symbol[odd] = at
            now[rest] = symbol
        settle(np.flatnonzero(width[:n] < _LOW))  # at most two words, as no share is empty
        mixer.learn(n, now, is2, is1)
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(order)
    for lane, i in enumerate(order):
        found[i] = ids[: blocks[i][0], lane].astype("<u4")
        if zlib.crc32(found[i].tobytes()) != blocks[i][1]:
            raise ValueError("ids differ from those written")
    return found
