"""Content-defined blocks of fixed-length windows, computed with numpy inside a task.

Every window of ``width`` symbols picks the smallest hashed ``k``-gram in it
(leftmost of equals). Neighbouring windows that pick the same occurrence form
one *block*. What a window picks depends on its own content alone, so equal
windows always lie in blocks with the same anchor hash, wherever they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_POSITION_BITS = 22
POSITIONS = _U((1 << _POSITION_BITS) - 1)
SLICE = 1 << 19  # symbols per numpy pass; well below 2 ** _POSITION_BITS
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_STEPS = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                          0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]

BYTE_CODES = np.random.default_rng(20_240_115).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _STEPS[0]
    x ^= x >> _U(27)
    x *= _STEPS[1]
    x ^= x >> _U(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the span-hash base, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    up, _ = POWERS.upto(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, _U)
    np.cumsum(symbols * up[:len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``symbols[start:end]``, the same wherever the span lies."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(_U) * _STEPS[2])


def gram_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` symbols (``k`` a power of two)."""
    h, size, step = symbols, 1, 3
    while size < k:
        h = h[:-size] * _STEPS[step] + h[size:]
        size, step = size * 2, step + 1
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def blocks(symbols: np.ndarray, ends: np.ndarray, k: int, width: int) -> tuple[np.ndarray, ...]:
    """Blocks of one slice: anchor hash, body hash, first window, number of windows.

    ``ends[i]`` is the end of the document that symbol ``i`` belongs to; a
    window may not reach beyond it.
    """
    n = len(symbols) - width + 1
    if n <= 0:
        return (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = gram_hash(symbols, k)
    keyed = (grams & ~POSITIONS) | np.arange(len(grams), dtype=_U)
    at = (sliding_min(keyed, width - k + 1) & POSITIONS).astype(np.int64)
    valid = np.arange(n) + width <= ends[:n]
    label = np.where(valid, at, -1)
    first = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    count = np.diff(np.append(first, n))
    keep = label[first] >= 0
    first, count = first[keep], count[keep]
    anchor = label[first]
    body = span_hash(prefix_hash(symbols), first, first + count + width - 1)
    body = mix(body + (anchor - first).astype(_U) * _STEPS[5])
    return grams[anchor], body, first, count


def cover(starts: np.ndarray, counts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over ``n`` symbols: covered by one of ``counts`` windows from ``starts`` on."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + width - 1, -1)
    return np.cumsum(edge[:n]) > 0


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ``gaps`` (white space); none crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gaps[data]
    begins, stops = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~inside[:-1]
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:]
    cuts = np.unique(offsets)
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    begins[cuts] = True
    stops[cuts] = True
    return np.flatnonzero(begins), np.flatnonzero(stops)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole word. Sums of letter codes would not do: they agree for some swapped letters."""
    out = np.empty(len(starts), _U)
    hashed = xxhash.xxh3_64_intdigest
    at = 0
    while at < len(starts):
        to = min(len(starts), max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right"))), at + SLICE)
        low = int(starts[at])
        part = data[low:int(ends[to - 1])].tobytes()
        places = zip((starts[at:to] - low).tolist(), (ends[at:to] - low).tolist())
        out[at:to] = np.fromiter((hashed(part[a:z]) for a, z in places), _U, to - at)
        at = to
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; a null is an empty text."""
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null(b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def packs(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Cut texts into runs of at most ``limit`` bytes together; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to
        at = to


class Symbols:
    """The texts of one pack as symbols: bytes, or codes of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, by_word: bool) -> None:
        if by_word:
            starts, ends = words(data, offsets)
            self.codes = word_codes(data, starts, ends)
            self.offsets = np.searchsorted(starts, offsets)
        else:
            self.codes, self.offsets = BYTE_CODES[data], offsets
        sizes = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def blocks(self, k: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Anchor, body, text number, first window (in its text), windows; slice by slice."""
        n = len(self.codes)
        for low in range(0, max(n - width + 1, 0), SLICE):
            high = min(n, low + SLICE + width - 1)
            anchor, body, first, count = blocks(
                self.codes[low:high], self.offsets[self.owner[low:high] + 1] - low, k, width)
            owner = self.owner[low + first]
            yield anchor, body, owner, low + first - self.offsets[owner], count
