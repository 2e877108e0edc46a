"""Words of many texts at once, as numpy arrays: places, hashes, hashes of windows."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text that go into one set of arrays; longer words than LONG bytes are hashed one by one.
BLOCK, LONG = 1_000_000, 1024

#: Odd multipliers of independent word hashes, and of the parts of a window.
WORD_A, WORD_B, LEFT, RIGHT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def blocks(sizes: list[int], most: int = BLOCK) -> list[slice]:
    """Slices of texts with about `most` bytes each."""
    out, begin, held = [], 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            out.append(slice(begin, k))
            begin, held = k, 0
        held += n
    return [*out, slice(begin, len(sizes))] if len(sizes) > begin else out


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which each bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: first and end byte in `raw`, and the text they belong to."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        self.raw = np.frombuffer(self.data, np.uint8)
        white = np.zeros(256, bool)
        white[[32, 9, 10, 11, 12, 13]] = True
        inside = np.append(False, ~white[self.raw])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        first = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.text = np.searchsorted(first, self.starts, "right") - 1
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))  # first word of each text

    def __len__(self) -> int:
        return len(self.starts)


class WordHash:
    """Polynomial hashes of words, mixed; equal words have equal hashes wherever they stand."""

    def __init__(self, odd: int):
        self.odd, self.powers, self.inverse = odd, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, w: Words) -> np.ndarray:
        n = len(w.raw)
        if len(self.powers) < n:
            full = lambda x: np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, x, np.uint64))))
            self.powers, self.inverse = full(self.odd), full(pow(self.odd, -1, 1 << 64))
        sums = np.append(np.uint64(0), np.cumsum((w.raw.astype(np.uint64) + np.uint64(1)) * self.powers[:n]))
        h = (sums[w.ends] - sums[w.starts]) * self.inverse[w.starts]
        for k in np.flatnonzero(w.ends - w.starts > LONG):
            h[k] = int.from_bytes(hashlib.blake2b(w.data[w.starts[k] : w.ends[k]], digest_size=8, salt=self.odd.to_bytes(8, "little")).digest(), "little")
        return mix(h)


def doubled(h: np.ndarray, by: int) -> np.ndarray:
    """Hashes of windows of 2 * by words from those of by words (one for each place where the window fits)."""
    return mix(h[: max(0, len(h) - by)] * np.uint64(LEFT) + h[by:] * np.uint64(RIGHT))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words."""
    n = max(0, len(words) - size + 1)
    out, factor = np.zeros(n, np.uint64), 1
    for k in range(size):
        factor = factor * LEFT % (1 << 64)
        out += words[k : k + n] * np.uint64(factor)
    return mix(out)
