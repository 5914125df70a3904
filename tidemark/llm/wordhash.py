"""Word hashes of many texts at once, by NumPy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts hashed together, which takes some forty times as much memory; a longer text is hashed alone.
BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def byte_values(separators: bytes) -> np.ndarray:
    """A number for every byte: 0 for separators, the same for A-Z and a-z."""
    folded = np.arange(256, dtype=np.uint64)
    folded[ord("A") : ord("Z") + 1] += np.uint64(32)
    values = mixed(folded + np.uint64(0x51_7C_C1))
    values[list(separators)] = 0
    return values


#: Words are what stands between ASCII white space.
BLANK_SEPARATED = byte_values(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters, digits and all other characters beyond ASCII.
LETTERS = byte_values(bytes(b for b in range(128) if not chr(b).isalnum()))


class Words:
    """Words of a run of texts: their hashes, first bytes, and the text each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, values: np.ndarray):
        self.texts = len(offsets) - 1
        self.offsets = offsets
        number = values[data]
        inside = number != 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        start[first] = inside[first]
        self.starts = np.flatnonzero(start)
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        if not len(self.starts):
            self.hashes = np.zeros(0, dtype=np.uint64)
            return
        # sum of value * BASE ** (place in the word), by powers of the place in the run
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(data) - 1), BASE)]))
        sums = np.add.reduceat(number * powers, self.starts)
        backwards = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(data) - 1), INVERSE)]))
        self.hashes = mixed(sums * backwards[self.starts])

    def bounds(self) -> np.ndarray:
        """Where each text's words begin and end."""
        return np.searchsorted(self.text, np.arange(self.texts + 1))


def texts_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = texts.buffers()[2]
    content = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return content[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_runs(texts: pa.Array, values: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, Words]]:
    """``(number of the first text, its run's words)`` for runs of up to ``size`` bytes."""
    if not len(texts):
        return
    data, offsets = texts_bytes(texts)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield low, Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], values)
        low = high
