"""Benchmark passages in training documents, by suffix arrays over shards of the documents.

Words that no benchmark item has cannot be part of a match. So each shard keeps
only runs of benchmark words that are long enough, sorts their suffixes, and
every benchmark suffix is looked up there by binary search: that gives the
longest verbatim match and all its places.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .arrow import ALNUM, filled, flat, slices, spread, totals, word_hashes, words

#: Words of a window; bytes of benchmark text that are sent to the tasks at a time; bytes of text of a shard.
WINDOW, BLOCK_BYTES, SHARD_BYTES = 10, 8 << 20, 16 << 20
_FILTER_BITS = 22


class Benchmark:
    """One block of benchmark items, ready to be looked up.

    ``vocabulary``: hashes, lengths and bytes of the distinct words; ``ids``:
    the items as word numbers from 1, with a 0 after each; ``starts`` and
    ``sizes``: the different windows in ``ids``; ``items`` of a window:
    ``names[owner[owner_ends[w]:owner_ends[w + 1]]]``.
    """

    def __init__(self, rows, window=WINDOW):
        names = sorted({name or "" for name, _ in rows})
        data, offsets = flat(filled(pa.array([text or "" for _, text in rows], pa.large_string())))
        low, starts, ends, bounds = words(data, offsets, ALNUM)
        raw = low.tobytes()
        spelled = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        number = {w: i + 1 for i, w in enumerate(dict.fromkeys(spelled))}
        self.names = names
        self.ids = np.zeros(len(spelled) + len(rows) + window, np.int64)
        place, found = {}, {}
        index = {name: i for i, name in enumerate(names)}
        at = 0
        for row, (name, _) in enumerate(rows):
            item = [number[w] for w in spelled[bounds[row]:bounds[row + 1]]]
            self.ids[at:at + len(item)] = item
            size = min(window, len(item))
            for i in range(len(item) - size + 1 if size else 0):
                key = tuple(item[i:i + size])
                place.setdefault(key, (at + i, size))
                found.setdefault(key, set()).add(index[name or ""])
            at += len(item) + 1
        self.longest = int(max(np.diff(bounds), default=0))
        self.starts = np.array([p for p, _ in place.values()], np.int64)
        self.sizes = np.array([n for _, n in place.values()], np.int64)
        self.least = int(self.sizes.min()) if len(self.sizes) else 0
        owners = [sorted(found[key]) for key in place]
        self.owner = np.array([i for some in owners for i in some], np.int64)
        self.owner_ends = np.concatenate([[0], np.cumsum([len(some) for some in owners])]).astype(np.int64)
        spelling = list(number)
        joined = np.frombuffer(b"".join(spelling), np.uint8)
        self.word_ends = np.concatenate([[0], np.cumsum([len(w) for w in spelling])]).astype(np.int64)
        self.bytes = joined
        hashes = word_hashes(joined, self.word_ends[:-1], self.word_ends[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        # the next word of the same hash, 0 behind the last one
        self.after = np.zeros(len(spelling) + 1, np.int64)
        same = np.flatnonzero(np.diff(self.hashes) == 0)
        self.after[self.order[same] + 1] = self.order[same + 1] + 1
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def numbers(self, hashes):
        """Word numbers by hash, 0 for others; of several words with one hash the first, ``after`` leads to the rest."""
        out = np.zeros(len(hashes), np.int64)
        likely = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[likely]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[likely]
        out[likely[same]] = self.order[at[same]] + 1
        return out

    def really(self, numbers, low, starts, ends):
        """Whether the words of these byte ranges are spelled as their numbers say."""
        sizes = ends - starts
        begins = self.word_ends[numbers - 1]
        fine = sizes == self.word_ends[numbers] - begins
        at = np.flatnonzero(fine)
        differ = low[spread(starts[at], sizes[at])] != self.bytes[spread(begins[at], sizes[at])]
        wrong = totals(differ, np.concatenate([[0], np.cumsum(sizes[at])]))
        fine[at[wrong > 0]] = False
        return fine


def _runs(numbers, first):
    """Starts and lengths of runs of words with a number inside one text; ``first``: the word opens a text."""
    known = numbers != 0
    begins, stops = known.copy(), known.copy()
    begins[1:] &= ~known[:-1] | first[1:]
    stops[:-1] &= ~known[1:] | first[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1 - starts


def suffix_array(sequence, positions, depth):
    """``positions`` in the order of the suffixes there, compared over ``depth`` entries, by prefix doubling."""
    rank = sequence.astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        step *= 2
    return positions[np.argsort(rank[positions], kind="stable")]


def _bound(sequence, order, patterns, starts, sizes, upper):
    """Binary search of all patterns at once: the first suffix not below (or above) each."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        below = np.full(len(open_), upper)
        left, at, want, size = np.arange(len(open_)), order[middle], starts[open_], sizes[open_]
        for k in range(int(size.max())):
            left = left[size[left] > k]
            have, ask = sequence[at[left] + k], patterns[want[left] + k]
            below[left[have != ask]] = (have < ask)[have != ask]
            left = left[have == ask]
            if not left.size:
                break
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
    return low


def look_up(bench, low, starts, ends, bounds, hashes):
    """All matches of one block in one shard: hit words, (text, item) pairs, longest match per text."""
    n_texts = len(bounds) - 1
    nothing = np.empty(0, np.int64), np.empty((0, 2), np.int64), np.zeros(n_texts, np.int64)
    if not len(bench.starts) or not len(starts):
        return nothing
    numbers = bench.numbers(hashes)
    first = np.zeros(len(starts) + 1, bool)
    first[bounds] = True
    first = first[:-1]
    begin, size = _runs(numbers, first)
    keep = size >= bench.least
    candidates = spread(begin[keep], size[keep])
    changed = False
    while candidates.size:
        wrong = candidates[~bench.really(numbers[candidates], low, starts[candidates], ends[candidates])]
        numbers[wrong] = bench.after[numbers[wrong]]
        candidates, changed = wrong[numbers[wrong] != 0], changed or wrong.size > 0
    if changed:
        begin, size = _runs(numbers, first)
        keep = size >= bench.least
    begin, size = begin[keep], size[keep]
    if not begin.size:
        return nothing
    # the kept runs, one after the other with a 0 behind each and room for reading on
    place = np.cumsum(size + 1) - (size + 1)
    length = int((size + 1).sum())
    sequence, word = np.zeros(length + bench.longest + 1, np.int64), np.full(length, -1, np.int64)
    inside = spread(place, size)
    word[inside] = spread(begin, size)
    sequence[inside] = numbers[word[inside]]
    order = suffix_array(sequence[:length], spread(place, size - bench.least + 1), bench.longest)
    lower = _bound(sequence, order, bench.ids, bench.starts, bench.sizes, False)
    upper = _bound(sequence, order, bench.ids, bench.starts, bench.sizes, True)
    count = upper - lower
    at = order[spread(lower, count)]
    window = np.repeat(np.arange(len(count)), count)
    if not at.size:
        return nothing
    match = bench.sizes[window].copy()
    going = np.arange(len(at))
    while going.size:
        have, ask = sequence[at[going] + match[going]], bench.ids[bench.starts[window[going]] + match[going]]
        going = going[(have == ask) & (have != 0)]
        match[going] += 1
    text = np.searchsorted(bounds, word[at], side="right") - 1
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, text, match)
    covered = np.zeros(length + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + bench.sizes[window], -1)
    hit = word[np.flatnonzero(np.cumsum(covered)[:length] > 0)]
    pair = np.unique(text * len(bench.starts) + window)
    text, window = pair // len(bench.starts), pair % len(bench.starts)
    owners = np.diff(bench.owner_ends)[window]
    pairs = np.stack([np.repeat(text, owners), bench.owner[spread(bench.owner_ends[window], owners)]], axis=1)
    return hit, pairs, longest


def _shard(data, offsets):
    """Words of a shard, found slice by slice: bytes, starts, ends, first word per text, hashes."""
    parts, at, n = [], [], 0
    for start, stop in slices(offsets):
        cut = offsets[start:stop + 1]
        low, s, e, b = words(data[cut[0]:cut[-1]], cut - cut[0], ALNUM)
        parts.append((low, s + cut[0] - offsets[0], e + cut[0] - offsets[0], word_hashes(low, s, e)))
        at.append(b[:-1] + n)
        n += len(s)
    low, s, e, h = (np.concatenate(x) for x in zip(*parts))
    return low, s, e, np.append(np.concatenate(at), n), h


def _scan(texts, blocks):
    """Per text of an Arrow column: n_words, n_hit, items, longest match, spans of hit words."""
    data, offsets = flat(filled(texts))
    for start, stop in slices(offsets, SHARD_BYTES):
        low, s, e, bounds, hashes = _shard(data, offsets[start:stop + 1])
        hits, items, longest = np.empty(0, np.int64), [set() for _ in range(stop - start)], np.zeros(stop - start, np.int64)
        for block in blocks:
            bench = block.value
            hit, pairs, most = look_up(bench, low, s, e, bounds, hashes)
            hits = np.union1d(hits, hit)
            longest = np.maximum(longest, most)
            for text, item in pairs.tolist():
                items[text].add(bench.names[item])
            if len(blocks) > 1:
                block.unpersist()
        text = np.searchsorted(bounds, hits, side="right") - 1
        inside = hits - bounds[text]
        n_hit = np.bincount(text, minlength=stop - start)
        opens = np.flatnonzero(np.diff(hits, prepend=-9) != 1) if hits.size else hits
        opens = np.union1d(opens, np.flatnonzero(np.diff(text, prepend=-1) != 0)) if hits.size else opens
        closes = np.append(opens[1:], len(hits)) - 1 if hits.size else opens
        spans = [[] for _ in range(stop - start)]
        for t, a, b in zip(text[opens].tolist(), inside[opens].tolist(), inside[closes].tolist()):
            spans[t].append((a, b + 1))
        yield start, stop, np.diff(bounds), n_hit, items, longest, spans


class _Block:
    """A broadcast block that is read again when several blocks take turns."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self):
        return self.broadcast.value

    def unpersist(self):
        if hasattr(self.broadcast, "_value"):
            del self.broadcast._value


def benchmark_blocks(benchmark, id_col="item_id", text_col="text", window=WINDOW, block_bytes=BLOCK_BYTES):
    """The items as broadcast blocks of about ``block_bytes`` of text each.

    The size is measured first; a larger benchmark takes more blocks, which the
    driver holds one at a time and each task reads one after the other.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-size // block_bytes))
    blocks = []
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        blocks.append(_Block(spark.sparkContext.broadcast(Benchmark([(r["item"], r["text"]) for r in part.collect()], window))))
    return blocks


def benchmark_matches(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                      window=WINDOW, block_bytes=BLOCK_BYTES):
    """What each document shares with the benchmark: one row per row of ``docs``.

    Words are runs of digits, letters a-z in either case and characters beyond
    ASCII. A window is ``window`` words of an item in a row, or the whole item
    if it is shorter. Returns the id, n_words, n_hit (words inside an occurring
    window), items (their ids as sorted strings), longest (words of the longest
    verbatim match), spans (start and end of hit words, in words).

    Null and empty texts and items have no words. Repeated rows are each
    answered; repeated items count once, items without id are named by the
    empty string. An empty benchmark hits nothing. Nothing is shuffled.
    """
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([
        StructField(id_col, narrow.schema["id"].dataType), StructField("n_words", LongType()), StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())), StructField("longest", LongType()), StructField("spans", ArrayType(span)),
    ])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def match(batches):
        for batch in batches:
            for start, stop, n_words, n_hit, items, longest, spans in _scan(batch.column("text"), blocks):
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(start, stop - start), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span_type),
                ], names=schema.names)

    return narrow.mapInArrow(match, schema)


def remove_contaminated(docs, benchmark, text_col="text", item_col="item_id", item_text_col="text", window=WINDOW,
                        block_bytes=BLOCK_BYTES):
    """The rows of ``docs`` that share no window with the benchmark, all columns as they are."""
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    at = docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            for start, stop, _, n_hit, *_ in _scan(batch.column(at), blocks):
                yield batch.slice(start, stop - start).filter(pa.array(n_hit == 0))

    return docs.mapInArrow(clean, docs.schema)
