"""64-bit hashes of all words of many texts at once, on byte arrays.

A word is read eight bytes at a time; each step mixes them in with a 64-bit
finalizer, which begins with the word's length. Equal words have equal hashes
wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes of texts that are put in one buffer; words beyond LONG bytes are hashed one by one; rows that are Python objects at a time
BUFFER, LONG, AT_ONCE = 1 << 20, 1 << 10, 500
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: bytes that end a word: the six ASCII blanks, and what str.split takes besides in ASCII
BLANKS = np.zeros(256, bool)
BLANKS[list(b" \t\n\x0b\x0c\r")] = True
WHITE = BLANKS.copy()
WHITE[0x1C:0x20] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (public murmur3 constants)."""
    x = x.astype(np.uint64) + np.uint64(salt)
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(times)
    x ^= x >> np.uint64(33)
    return x


_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def wide_white(buf: np.ndarray) -> np.ndarray:
    """Places of bytes of white space beyond ASCII: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F and 3000."""
    two = np.flatnonzero(buf[:-1] == 0xC2)
    two = two[(buf[two + 1] == 0x85) | (buf[two + 1] == 0xA0)]
    three = np.flatnonzero(buf[:-2] - np.uint8(0xE1) <= 2)
    a, b, c = buf[three], buf[three + 1], buf[three + 2]
    wide = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    wide |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    wide |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    three = three[wide]
    return np.concatenate([two, two + 1, three, three + 1, three + 2])


def words_in(buf: np.ndarray, blanks: np.ndarray = BLANKS, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place of its first byte, place after its last) of every word of a buffer of bytes."""
    cut = np.flatnonzero(buf <= 32)
    cut = cut[blanks[buf[cut]]]
    if wide and len(more := wide_white(buf)):
        cut = np.sort(np.concatenate([cut, more]))
    cut = np.concatenate([[-1], cut, [len(buf)]])
    some = np.diff(cut) > 1
    return cut[:-1][some] + 1, cut[1:][some]


def hashed_words(buf: np.ndarray, blanks: np.ndarray = BLANKS, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place of its first byte, hash) of every word of a buffer of bytes."""
    first, last = words_in(buf, blanks, wide)
    return first, hashes(buf, first, last)


def hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes from first to before last."""
    eights = np.zeros(len(buf) // 8 + 2, np.uint64)
    eights.view(np.uint8)[: len(buf)] = buf

    def at(place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The next most bytes from each place, eight at most."""
        i, bits = place >> 3, ((place & 7) << 3).astype(np.uint64)
        eight = (eights[i] >> bits) | ((eights[i + 1] << np.uint64(1)) << (np.uint64(63) - bits))
        return eight & _FIRST[np.minimum(most, 8)]

    length = last - first
    with np.errstate(over="ignore"):
        h = mixed(at(first, length) + length.astype(np.uint64) * np.uint64(STEP))
        open_, done = np.flatnonzero(length > 8), 8
        while len(open_) and done < LONG:
            h[open_] = mixed(h[open_] * np.uint64(BASE) + at(first[open_] + done, length[open_] - done))
            done += 8
            open_ = open_[length[open_] > done]
    if len(open_):
        import xxhash

        h[open_] = [xxhash.xxh3_64_intdigest(buf[first[i] : last[i]].tobytes()) for i in open_]
    return h


def give_back() -> None:
    """Memory that is free goes back to the system: a worker process lives on, beside others, for tasks of other kinds."""
    import ctypes
    import sys

    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
    if pa := sys.modules.get("pyarrow"):
        pa.default_memory_pool().release_unused()


def lowered(text: bytes) -> bytes:
    """UTF-8 text in lower case by Python's rules; bytes that are no UTF-8 stay."""
    return text.lower() if text.isascii() else text.decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape")


def buffers(batches, fold, at_most: int = 1 << 30) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, buffer, ends) of Arrow batches (id, text): about BUFFER bytes of folded texts, each followed by a line end, at most at_most texts in one; ends are the places after these. Nulls count as empty."""
    ids, held, size = [], [], 0

    def made():
        data = np.frombuffer(b"\n".join([*held, b""]), np.uint8)
        return ids, data, np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)

    for key, text in pairs_of(batches):
        ids.append(key)
        held.append(fold(text) if text else b"")
        size += len(held[-1]) + 1
        if size >= BUFFER or len(held) >= at_most:
            yield made()
            ids, held, size = [], [], 0
    if held:
        yield made()
    del ids, held
    give_back()


def pairs_of(batches) -> Iterator[tuple]:
    """(id, text in UTF-8 or None) of Arrow batches, a few rows of a batch at a time as Python objects."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            yield from zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)


def runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all, joined."""
    return values[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]


class Tally:
    """Counts of small numbers in a table of fixed size."""

    def __init__(self, size: int) -> None:
        self.total = np.zeros(size, np.int32)

    def add(self, numbers: np.ndarray) -> None:
        np.add.at(self.total, numbers, np.int32(1))

    def counts(self) -> np.ndarray:
        return self.total
