"""Near copies by SimHash: an inverted index over byte positions of the fingerprints, with count filtering.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 3 of
their 8 bytes, so they share at least 5 bytes at the same position. Of any 5
positions, 3 lie in the same half of the fingerprint; so the index has one list
per triple of positions within a half and value of those bytes. Within a list
the shared positional bytes of each pair are tallied; pairs that reach 5 are
verified bit by bit.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrow import NOT_SPACE, text_slices, words
from .links import connected_components, cut_lineage, merge, written

BYTES, BITS, SEED = 8, 3, 42
LEAST_SHARED = BYTES - BITS
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: A list longer than this is split by two more shared positions, which every pair in it must have.
LONG_LIST = 16_384
#: A split list longer than this is searched by flipping bits, which is linear in its length.
DENSE_LIST = 65_536
#: Shingles whose bits are counted at a time.
_SHINGLES = 1 << 17


def fingerprints(data, offsets, size=3):
    """SimHash of each text, as numpy uint64: XXH64 of word shingles, a bit is set if over half have it."""
    low, starts, ends, bounds = words(data, offsets, NOT_SPACE)
    out = np.zeros(len(offsets) - 1, np.uint64)
    counts = np.diff(bounds)
    shingles = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    total = int(shingles.sum())
    if not total:
        return out
    # one space between the words of a text, whatever stood there
    text = low.copy()
    text[~NOT_SPACE[low]] = 32
    keep = NOT_SPACE[low]
    keep[ends[ends < len(low)]] = True
    place = np.cumsum(keep) - 1
    packed = text[keep].tobytes()
    begin, stop = place[starts], place[ends - 1] + 1
    span = np.minimum(size, counts)
    row = np.repeat(np.arange(len(counts)), shingles)
    first = np.arange(total) - np.repeat(np.cumsum(shingles) - shingles, shingles) + bounds[row]
    left, right = begin[first], stop[first + span[row] - 1]
    ones = np.zeros((len(counts), 64), np.int64)
    for at in range(0, total, _SHINGLES):
        part = slice(at, min(at + _SHINGLES, total))
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(packed[a:b], SEED) for a, b in zip(left[part].tolist(), right[part].tolist())),
            np.uint64, part.stop - at)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row[part]
        edges = np.flatnonzero(np.diff(rows, prepend=-1))
        ones[rows[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    set_ = (ones * 2 > shingles[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprint_table(df, id_col="doc_id", text_col="text", keyed=False):
    """(id, fp) per row of ``df``; fp: the fingerprint as a signed long. ``keyed`` adds ``row_key``."""
    text = F.col(f"`{text_col}`").cast("string")
    key = [row_key(id_col, text_col).alias("row_key")] if keyed else []
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), *key, text.alias("text"))
    schema = StructType([*(f for f in narrow.schema if f.name != "text"), StructField("fp", LongType())])

    def make(batches):
        for batch, data, offsets in text_slices(batches):
            kept = [batch.column(c) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fingerprints(data, offsets).view(np.int64), pa.int64())], names=schema.names)

    return narrow.mapInArrow(make, schema)


def row_key(id_col, text_col):
    """What tells documents apart: a digest of id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("none")), F.col(f"`{text_col}`").cast("string")).cast("binary"))


def _differing_bytes(x):
    """Number of bytes that are not 0 in each uint64."""
    for shift in (4, 2, 1):
        x = x | (x >> np.uint64(shift))
    return np.bitwise_count(x & np.uint64(0x0101010101010101))


def _near(a, b):
    """Tally the shared positional bytes of each pair, keep those with enough, verify the bits."""
    x = a ^ b
    enough = np.flatnonzero(BYTES - _differing_bytes(x) >= LEAST_SHARED)
    return enough[np.bitwise_count(x[enough]) <= BITS]


def _flips(free):
    """All masks of up to 3 set bits out of ``free``."""
    return [np.uint64(sum(1 << b for b in some)) for n in range(1, BITS + 1) for some in combinations(free, n)]


def link_lists(keys, prints, dense=DENSE_LIST):
    """Links within lists, as a forest: two arrays of fingerprints. ``keys``: the list of each fingerprint."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    distinct, node = np.unique(prints, return_inverse=True)
    labels = np.arange(len(distinct))
    edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(edges, len(keys)))
    small = np.repeat(sizes <= dense, sizes)
    left, right, held = [], [], 0

    def add(i, j):
        nonlocal held
        left.append(node[i])
        right.append(node[j])
        held += len(i)
        if held > 1 << 20:
            close()

    def close():
        nonlocal held
        if left:
            merge(labels, np.concatenate(left), np.concatenate(right))
        left.clear()
        right.clear()
        held = 0

    at, step = np.flatnonzero(small), 1
    while at.size:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        linked = at[_near(prints[at], prints[at + step])]
        add(linked, linked + step)
        step += 1
    for start, size in zip(edges[sizes > dense].tolist(), sizes[sizes > dense].tolist()):
        own = prints[start:start + size]
        differ = np.bitwise_or.reduce(own ^ own[0])
        free = [b for b in range(64) if int(differ) >> b & 1]
        for mask in _flips(free):
            asked = own ^ mask
            found = np.minimum(np.searchsorted(own, asked), size - 1)
            hit = np.flatnonzero(own[found] == asked)
            add(start + hit, start + found[hit])
    close()
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return distinct[moved], distinct[labels[moved]]


def _list_key(positions, tag):
    """Value of the bytes at these positions, with a tag in front so that lists of different positions differ."""
    key = F.lit(tag).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)))
    return key


def fingerprint_links(prints, long_list=LONG_LIST):
    """Links (a, b) that connect all fingerprints of ``prints`` (column fp, distinct) at 3 or fewer bits, as a forest.

    Lists are dealt out by key. A list over ``long_list`` is replaced by one per
    two further shared positions, so members differ in 3 bytes at most and no
    list grows with a group of near copies beyond that.
    """
    lists = F.array(*[_list_key(t, k + 1) for k, t in enumerate(TRIPLES)])
    posted = prints.select("fp", F.posexplode(lists).alias("triple", "list"))
    long_ = posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > long_list).select("list", F.lit(True).alias("long"))
    marked = posted.join(long_, "list", "left")
    finer = F.lit(None).cast("array<bigint>")
    for k, triple in enumerate(TRIPLES):
        rest = [p for p in range(BYTES) if p not in triple]
        split = F.array(*[_list_key((*triple, *pair), 16 + 10 * k + i) for i, pair in enumerate(combinations(rest, 2))])
        finer = F.when(F.col("triple") == k, split).otherwise(finer)
    dealt = marked.select("fp", F.explode(F.when(F.col("long"), finer).otherwise(F.array("list"))).alias("list"))
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def link(batches):
        parts = [(b.column("list").to_numpy(), b.column("fp").to_numpy()) for b in batches if b.num_rows]
        if parts:
            keys, own = (np.concatenate(x) for x in zip(*parts))
            a, b = link_lists(keys, own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=schema.names)

    return dealt.repartition("list").mapInArrow(link, schema)


def _components(prints):
    """(fp, component, component_id) for every fingerprint of ``prints`` (id, fp)."""
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("first")))
    members = connected_components(fingerprint_links(classes.select("fp")))
    named = classes.join(members, classes["fp"] == members["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    return named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").drop("first")


def near_copies(df, id_col="doc_id", text_col="text"):
    """One row per row of ``df``: the id, fingerprint (16 hex digits) and component_id.

    Words are cut at ASCII white space and lower-cased in A-Z; shingles have 3
    words. Fingerprints link at 3 or fewer bits; component_id is the smallest id
    that can be reached by links. A null or empty text has the fingerprint zero
    and links like any other; rows without id get a component but never name
    one, so a group of them alone has a null. Repeated rows each get their row.
    Other columns are not looked at; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprint_table(df, id_col, text_col))
    return prints.join(_components(prints), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df, id_col="doc_id", text_col="text"):
    """The rows of ``df`` with one document of each group of near copies: the one with the smallest id.

    Where rows of a group repeat that id, or no row of it has one, the text
    with the lowest digest stays; equal texts of one id stay once. All columns
    stay as they are.
    """
    prints = cut_lineage(fingerprint_table(df, id_col, text_col, keyed=True))
    named = prints.join(_components(prints), "fp").select("id", "row_key", "component", "component_id")
    kept = named.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row_key").alias("key"))
    named = cut_lineage(named.select("row_key", "component").join(kept, "component").select("row_key", (F.col("row_key") == F.col("key")).alias("stays")))
    # few rows leave and fewer repeat, so these keys are the smaller tables
    leave = written(named.where("NOT stays").select("row_key").distinct())
    again = written(named.where("stays").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"))
    # columns in a struct, so that no name of the caller's meets those used here
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), row_key(id_col, text_col).alias("row_key"))
    # by merge at every size, as these keys grow with the rows
    rows = rows.join(leave.hint("merge"), "row_key", "left_anti")
    if not again.isEmpty():
        first = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
        once = rows.join(again, "row_key", "left_semi").withColumn("rank", first).where("rank = 1").drop("rank")
        rows = rows.join(again, "row_key", "left_anti").union(once)
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns])
