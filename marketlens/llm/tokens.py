"""Vectorised word splitting and hashing over Arrow string columns.

Words are runs of bytes of a class. All classes used by the operators put every byte of a
multi-byte UTF-8 character inside words, so splitting bytes equals splitting characters.
Hashes are 64 bit: a random value per byte times a power of an odd base, summed over the word
and mixed. They depend on the bytes alone, so every executor finds the same ones.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21  # bytes hashed at once; bounds the temporary arrays
U = np.uint64
BREAKS = np.array([*b".,;:!?", *range(0x0A, 0x0E)])  # bytes that phrases don't run over


def mix(x):
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(lower=False):
    """A fixed pseudo-random value for each byte; with lower, A-Z share those of a-z."""
    v = mix((np.arange(1, 257, dtype=U)) * U(0x9E3779B97F4A7C15))
    if lower:
        v[65:91] = v[97:123]
    return v


def byte_class(kind):
    """Which bytes are in words: 'space' (all but ASCII white space), 'phrase' (nor BREAKS) or 'alnum'."""
    c = np.ones(256, dtype=bool)
    if kind in ("space", "phrase"):
        c[[0x20, *range(0x09, 0x0E)]] = False
        if kind == "phrase":
            c[BREAKS] = False
    else:
        c[:0x80] = False
        c[0x30:0x3A] = True
        c[0x41:0x5B] = True
        c[0x61:0x7B] = True
    return c


def utf8(column):
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(table, column, limit=CHUNK):
    """Cut a batch or table into runs of rows of about `limit` bytes of text each."""
    if not table.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    run = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), table.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield table.slice(a, b - a)


def word_spans(data, offsets, kind):
    """Starts and ends of all words in bytes, and each text's first word (n+1 entries)."""
    inside = byte_class(kind)[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data, starts, ends, lower=False):
    """A 64-bit hash of each byte span; spans must not overlap and must be in order."""
    out = np.empty(len(starts), U)
    values, base = byte_values(lower), U(0x9E3779B97F4A7C15 | 1)
    size = ends - starts
    total = np.cumsum(size)
    a = 0
    while a < len(starts):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + CHUNK, "right")))
        s = size[a:b]
        first = np.cumsum(s) - s
        rel = np.arange(int(s.sum()), dtype=np.int64) - np.repeat(first, s)
        powers = np.cumprod(np.full(int(s.max()), base, U))
        v = values[data[rel + np.repeat(starts[a:b], s)]] * powers[rel]
        out[a:b] = np.add.reduceat(v, first)
        a = b
    return mix(out)


def words(column, kind, lower=False):
    """Hashes of all words of a string column, first word per text, bytes, starts, ends."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets, kind)
    return span_hashes(data, starts, ends, lower), first, data, starts, ends


def windows(hashes, size):
    """A hash of each run of `size` consecutive words (len - size + 1 of them; none if shorter)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for k in range(size):
        out += hashes[k : k + n] * U((2 * k + 3) * 0x9E3779B97F4A7C15 % 2**64 | 1)
    return mix(out)


def window_docs(first, size):
    """Of each text: where its windows start in the flat word array, and how many it has."""
    return first[:-1], np.maximum(np.diff(first) - size + 1, 0)


def flat_positions(begin, count):
    """Concatenated ranges begin[i] .. begin[i] + count[i], and the range each belongs to."""
    owner = np.repeat(np.arange(len(begin)), count)
    at = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(begin, count) + at, owner
