"""Hashes of words, windows and shingles of many texts at once, in numpy.

Words are the runs of bytes other than ASCII white space, so a text's words in UTF-8 are
those of the pattern [^\\x20\\x09-\\x0D]+. A word's hash is a polynomial in its bytes
modulo 2**64, taken from prefix sums over a whole block of texts, and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1

#: Texts are taken so many bytes at a time; a longer run without white space is taken whole.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values fall far apart."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_BASE2)


def sliding(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Sum of values[j] * base**(j - start) over start <= j < end, for each pair of start and end."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def _block(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of the bytes; words end at the cuts as well."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = sliding(data.astype(np.uint64) + np.uint64(1), starts, ends, _BYTES)
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))), starts, ends


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column side by side, and the offsets of its texts; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and offsets[-1] > 0 else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the offsets of each text's words among them, and the words' first and last bytes.

    offsets: where the texts begin in the bytes, and the end of the last.
    """
    hashes, firsts, lasts = [], [], []
    at, size = 0, len(data)
    while at < size:
        end = min(size, at + BLOCK)
        if end < size:
            # a block ends before white space or at a text's end, so that no word is cut
            text_end = offsets[np.searchsorted(offsets, end, "right") - 1]
            spaces = np.flatnonzero(_SPACE[data[max(at, end - 4096) : end]])
            if len(spaces):
                end = max(at, end - 4096) + int(spaces[-1]) + 1
            elif text_end > at:
                end = int(text_end)
            else:
                stop = int(offsets[np.searchsorted(offsets, end, "left")])
                while end < stop and not _SPACE[data[end]]:
                    span = np.flatnonzero(_SPACE[data[end : min(stop, end + BLOCK)]])
                    end = end + int(span[0]) if len(span) else min(stop, end + BLOCK)
        part = data[at:end]
        lo, hi = np.searchsorted(offsets, [at, end])
        h, a, b = _block(lower_ascii(part) if lower else part, offsets[lo:hi] - at)
        hashes.append(h)
        firsts.append(a + at)
        lasts.append(b + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    h, a, b = np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)
    return h, np.searchsorted(a, offsets), a, b


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``size`` words within one text, their first words and their texts."""
    counts = np.diff(offsets)
    n = np.maximum(counts - size + 1, 0)
    texts = np.repeat(np.arange(len(counts)), n)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][texts]
    return mix(sliding(hashes, starts, starts + size, _WORDS)), starts, texts


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of a text with fewer words the whole sequence is one."""
    starts_of, ends_of = offsets[:-1], offsets[1:]
    if len(hashes) >= size:
        n = len(hashes) - size + 1
        at = np.arange(n)
        every = mix(sliding(hashes, at, at + size, _WORDS))
    else:
        every = np.zeros(0, np.uint64)
    for a, b in zip(starts_of.tolist(), ends_of.tolist(), strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            one = np.array([a]), np.array([b])
            yield mix(sliding(hashes[a:b], one[0] - a, one[1] - a, _WORDS) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``size`` bytes together; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def together(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text each, small batches joined."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0
    for part in pieces(batches, column, size):
        n = len(text_bytes(part.column(column))[0])
        if held and bytes_held + n > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, bytes_held = [], 0
        held.append(part)
        bytes_held += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values, byte plane by byte plane, compressed: sorted values lose their leading bytes."""
    import zstandard

    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    """The columns of a packed blob."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    planes = data.reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.uint64).reshape(-1) for p in planes]


def fine_parts(count: int) -> int:
    """Into how many ranges each partition's share of the hashes is cut, so that one is held at a time; fewer where partitions are many."""
    return max(1, min(32, 4096 // count))


def by_part(batches: Iterator[pa.RecordBatch], part: str = "part") -> Iterator[tuple[int, pa.Table]]:
    """(part, its rows) of batches sorted by part, one part at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        parts = np.asarray(batch.column(part))
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and parts[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(parts[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


#: What a worker keeps between the tasks of one operator: models and memos by file.
HELD: list[dict] = []


def start_afresh() -> None:
    """Drops what another operator's tasks left in this worker, and returns its memory."""
    if any(HELD):
        for held in HELD:
            held.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives the stage that it worked for."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
