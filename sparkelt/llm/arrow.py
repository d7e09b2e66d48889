"""Arrow columns as numpy arrays, and words found in them without Python loops."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, so that index arrays stay small.
SLICE_BYTES = 4 << 20


def filled(column):
    """A text column as one large_string array, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat(column):
    """Bytes and offsets of a ``filled`` column; the first offset may be above 0."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), ends


def slices(offsets, most=SLICE_BYTES):
    """Row ranges of at most ``most`` bytes each; a longer text has a range of its own."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def text_slices(batches, most=SLICE_BYTES):
    """(record batch, bytes from 0, offsets from 0) per slice; the text column is called ``text``."""
    for batch in batches:
        column = filled(batch.column("text"))
        data, offsets = flat(column)
        for start, stop in slices(offsets, most):
            part = offsets[start:stop + 1]
            yield batch.slice(start, stop - start), data[part[0]:part[-1]], part - part[0]


def byte_set(pattern):
    """A table of 256 flags from a predicate over byte values."""
    return np.array([bool(pattern(b)) for b in range(256)])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that are digits, a-z after lower-casing, or not ASCII.
ALNUM = byte_set(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Bytes of words that are cut at ASCII white space.
NOT_SPACE = byte_set(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def words(data, offsets, inside):
    """Lower-cased bytes, word starts and ends in them, and the first word of each text.

    ``offsets`` start at 0. A word never reaches into the next text. The last
    array has one entry more than there are texts.
    """
    low = LOWER[data]
    flags = inside[low]
    n = len(low)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, stops = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1] | first[1:n]
    stops[:-1] &= ~flags[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    return low, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n):
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(low, starts, ends):
    """64-bit hashes of byte ranges: equal ranges have equal hashes; the caller rules out the rest."""
    forward, back = _power_tables(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * forward[:len(low)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * back[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def spread(starts, lengths):
    """start, start + 1, ... for every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def totals(values, bounds):
    """Sums of ``values[bounds[i]:bounds[i + 1]]``, empty ranges included."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]
