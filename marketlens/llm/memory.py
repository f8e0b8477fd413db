"""What a task remembers of distinct strings, so that repeated ones are worked out once."""

import numpy as np

from marketlens.llm import tokens as T


class Memory:
    """Number lists of distinct strings, by their 64-bit hashes; all are forgotten beyond `limit` bytes."""

    def __init__(self, channels, limit=16 << 20):
        self.channels, self.limit = channels, limit
        self.clear()

    def clear(self):
        self.names = np.zeros(0, T.U)
        self.flat = [np.zeros(0, np.int32) for _ in range(self.channels)]
        self.at = [np.zeros(0, np.int32) for _ in range(self.channels)]
        self.size = [np.zeros(0, np.int32) for _ in range(self.channels)]

    def held(self):
        return self.names.nbytes + sum(x.nbytes for kind in (self.flat, self.at, self.size) for x in kind)

    def find(self, names, make):
        """Rows of sorted distinct hashes; make(which) gives (flat numbers, sizes) a channel for the unknown ones."""
        if self.held() > self.limit:
            self.clear()
        at = np.searchsorted(self.names, names)
        new = np.ones(len(names), bool)
        inside = at < len(self.names)
        new[inside] = self.names[at[inside]] != names[inside]
        if not new.any():
            return at
        place = at[new]
        for c, (flat, size) in enumerate(make(np.flatnonzero(new))):
            begin = len(self.flat[c]) + np.cumsum(size) - size
            self.flat[c] = np.concatenate([self.flat[c], np.asarray(flat, np.int32)])
            self.at[c], self.size[c] = np.insert(self.at[c], place, begin), np.insert(self.size[c], place, size)
        self.names = np.insert(self.names, place, names[new])
        return np.searchsorted(self.names, names)

    def take(self, channel, rows):
        """The lists of the rows, one after the other, and their sizes."""
        size = self.size[channel][rows].astype(np.int64)
        at, _ = T.flat_positions(self.at[channel][rows], size)
        return self.flat[channel][at], size


def byte_level():
    """The printable character that byte-level vocabularies write for each byte, and the way back."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return chars, {c: b for b, c in chars.items()}


class Written:
    """Byte strings by number, written one after the other without a loop."""

    def __init__(self, strings):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def write(self, numbers):
        at, _ = T.flat_positions(self.begin[numbers], self.size[numbers])
        return self.data[at], np.cumsum(self.size[numbers])


class Decimals:
    """Numbers below `most` in decimal digits, each followed by a byte of its own."""

    def __init__(self, most):
        width = len(str(max(most - 1, 0)))
        n = np.arange(most)[:, None]
        power = 10 ** np.arange(width - 1, -1, -1)
        self.digits = np.zeros((most, width + 1), np.uint8)
        self.digits[:, :width] = n // power % 10 + 48
        self.shown = np.ones((most, width + 1), bool)
        self.shown[:, :width] = (n >= power) | (power == 1)

    def write(self, numbers, after):
        """The bytes, and where each number's run ends; after: one byte or an array of them."""
        out, shown = self.digits[numbers], self.shown[numbers]
        out[:, -1] = after
        return out[shown], np.cumsum(shown.sum(axis=1))
