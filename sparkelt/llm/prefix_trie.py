"""The prefix trie of conversations, built in sorted shards below a skeleton that all of them know.

A conversation is a path of turns, one unit of ``UNIT`` characters each: 128 bits
of the digest of role and text, and the bytes of the text. Sorted by path, the
conversations that share a node stand side by side. Spark's range partitions cut
this order; the nodes that a cut runs through are prefixes of the path it cuts
at. Their trie, the skeleton, is broadcast. Each shard finishes all its other
nodes in one pass, and gives partial sums of skeleton nodes, which are added up.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .links import cut_lineage
from .twins import CRC_TABLE, crc32_sql

DIGEST, SIZE = 32, 8
UNIT = DIGEST + SIZE
#: A conversation takes fewer turns than this from another one; ids in a row that share theirs.
HEADS, SIBLINGS = 9, 5
#: Ids that a piece of a list holds, and rows that a batch holds.
PIECE, BATCH = 8192, 4096


def turn_unit(role, text):
    """A turn as ``UNIT`` hex digits: equal turns, and only they, have equal units."""
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(framed, 256), 1, DIGEST), F.lower(F.lpad(F.hex(F.octet_length(text).cast("long")), SIZE, "0")))


def rebuilt(turns):
    """(conv_id, path) of every conversation with its first turns taken from another one.

    Conversation c starts with the first h turns of conversation c - c % 5 (all
    of them if it has fewer, none if there is no such conversation) and goes on
    with its own turns after its first h, where h is the unsigned CRC-32 of c as
    text, modulo 9. ``%`` is that of SQL: -1 % 5 is -1. A path takes 40
    characters per turn and is one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = turns.where("conv_id IS NOT NULL").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % SIBLINGS).alias("base"), F.struct(F.col("turn").alias("turn"), turn_unit(role, text).alias("unit")).alias("t"))
    # an array is sorted with nulls first; equal turn numbers are ordered by unit
    whole = own.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.withColumn("units", F.transform("ts", lambda t: t["unit"]))
    family = Window.partitionBy("base")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("units", 1, HEADS))).over(family)
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    whole = whole.withColumns({"head": F.coalesce(head, F.array().cast("array<string>")), "h": h})
    # slice() has no open end
    rest = F.filter("units", lambda unit, i: i >= F.col("h"))
    return whole.select("conv_id", F.array_join(F.concat(F.slice("head", F.lit(1), F.col("h")), rest), "").alias("path"))


def shared_units(a, b):
    """How many first units two paths have in common."""
    low, high = 0, min(len(a), len(b)) // UNIT
    # paths that differ early are the rule, so the step doubles from the front
    step = 1
    while low < high:
        probe = min(low + step, high)
        if a[low * UNIT:probe * UNIT] == b[low * UNIT:probe * UNIT]:
            low, step = probe, step * 2
        elif step == 1:
            break
        else:
            high, step = probe - 1, 1
    return low


class Skeleton:
    """The trie of the paths at which ranges are cut, in preorder: node 0 is the root."""

    def __init__(self, cuts):
        self.steps, self.parents, self.depths = {}, [-1], [0]
        for cut in sorted(cuts):
            node = 0
            for at in range(0, len(cut), UNIT):
                key = (node, cut[at:at + UNIT])
                if key not in self.steps:
                    self.steps[key] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                node = self.steps[key]

    def walk(self, path):
        """The skeleton nodes on a path, from the root."""
        nodes, at = [0], 0
        while (node := self.steps.get((nodes[-1], path[at:at + UNIT]))) is not None:
            nodes.append(node)
            at += UNIT
        return nodes


def find_cuts(ordered):
    """What the paths on both sides of each cut between partitions have in common."""
    schema = "part int, first string, last string"

    def ends(batches):
        from pyspark import TaskContext

        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() if first is None else first
                last = batch.column(0)[-1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([last])], names=["part", "first", "last"])

    found = ordered.select("path").mapInArrow(ends, schema).orderBy("part").collect()
    return [b["first"][:shared_units(a["last"], b["first"]) * UNIT] for a, b in zip(found, found[1:])]


class _Open:
    """A node whose subtree is being read."""

    __slots__ = ("skeleton", "least", "members", "children", "leaves", "saved", "size", "ids", "ends", "closed")

    def __init__(self, skeleton, size):
        self.skeleton, self.size = skeleton, size
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ids, self.ends, self.closed = [], None, []

    def end(self, conv):
        self.members += 1
        self.least = conv if self.least is None else min(self.least, conv)
        self.ids.append(conv)


LOCAL, UNDER, PARTIAL, PIECES = range(4)
_FOUND = StructType([
    StructField("kind", IntegerType()), StructField("node", LongType()), StructField("conv_id", LongType()), StructField("depth", LongType()),
    StructField("parent_conv_id", LongType()), *(StructField(c, LongType()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), StructField("ends", StringType())])
_NOTHING = hashlib.sha256().hexdigest()


def _shard(skeleton):
    """A function from sorted (path, conv_id) batches to rows of ``_FOUND``."""
    types = [pa.int32(), *[pa.int64()] * 8, pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_FOUND.names)

    def grown(batches):
        trie = skeleton.value
        stack, before, out = [], None, []

        def hashed(node):
            """Closes a part of the list of ids that end at a node."""
            if not node.ids:
                return
            text = ",".join(map(str, node.ids))
            if node.skeleton is not None:
                out.append((PIECES, node.skeleton, node.ids[0], None, None, None, None, None, None, text))
            elif node.ends is None:
                node.ends = hashlib.sha256(text.encode())
            else:
                node.ends.update(f",{text}".encode())
            node.ids = []

        def close():
            node, depth = stack.pop(), len(stack)
            hashed(node)
            # children of a local node have waited for its smallest member
            out.extend((*row[:4], node.least, *row[5:]) for row in node.closed)
            parent = stack[-1] if stack else None
            if node.skeleton is not None:
                out.append((PARTIAL, node.skeleton, node.least, depth, None, node.members, node.children, node.leaves, node.saved, None))
            else:
                leaves, saved = node.leaves or 1, node.saved + (node.members - 1) * node.size
                row = [LOCAL, None, node.least, depth, None, node.members, node.children, leaves, saved, node.ends.hexdigest() if node.ends else _NOTHING]
                if parent.skeleton is None:
                    parent.closed.append(row)
                else:
                    row[:2] = UNDER, parent.skeleton
                    out.append(tuple(row))
                parent.children += 1
                parent.leaves += leaves
                parent.saved += saved
            if parent is not None:
                parent.members += node.members
                parent.least = node.least if parent.least is None else min(parent.least, node.least)

        for batch in batches:
            for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
                if path != before:
                    common = shared_units(before, path) if before is not None else -1
                    while len(stack) > common + 1:
                        close()
                    known = trie.walk(path)
                    for depth in range(len(stack), len(path) // UNIT + 1):
                        size = int(path[depth * UNIT - SIZE:depth * UNIT], 16) if depth else 0
                        stack.append(_Open(known[depth] if depth < len(known) else None, size))
                    before = path
                stack[-1].end(conv)
                if len(stack[-1].ids) == PIECE:
                    hashed(stack[-1])
                while len(out) >= BATCH:
                    yield batch_of(out[:BATCH])
                    del out[:BATCH]
        while stack:
            close()
            while len(out) >= BATCH:
                yield batch_of(out[:BATCH])
                del out[:BATCH]
        if out:
            yield batch_of(out)

    return grown


def _joined_digests(pieces):
    """(node, ends_sha256): pieces of lists in order as one digest per node; a task holds one piece at a time."""
    schema = "node long, ends_sha256 string"

    def chain(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if node != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    return pieces.select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(chain, schema)


def _finished(skeleton, sums, sizes):
    """Rows (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of skeleton nodes from their sums.

    In preorder a subtree is a run of nodes, so its sums are differences of running totals.
    """
    count = len(skeleton.parents)
    parents, depths = np.array(skeleton.parents), np.array(skeleton.depths)
    least, members, children, leaves, saved = (np.zeros(count, np.int64) for _ in range(5))
    for r in sums:
        k = r["node"]
        least[k], members[k], children[k], leaves[k], saved[k] = r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]
    np.add.at(children, parents[1:], 1)
    leaves += children == 0
    saved += (members - 1) * sizes
    after = np.arange(1, count + 1)
    for k in range(count - 1, 0, -1):
        after[parents[k]] = max(after[parents[k]], after[k])
    whole = [np.concatenate([[0], np.cumsum(v)]) for v in (leaves, saved)]
    sums_of = [w[after] - w[np.arange(count)] for w in whole]
    return [(k, int(least[k]), int(depths[k]), int(least[parents[k]]) if k else None, int(members[k]), int(children[k]), int(sums_of[0][k]), int(sums_of[1][k]))
            for k in range(count)]


def prefix_trie(paths):
    """One row per node of the trie of ``paths`` (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node stands for all conversations that start with its turns: n_convs of
    them, the smallest id is conv_id; parent_conv_id is that of the node one
    turn shorter, null for the root. n_leaves and saved_tokens (bytes of a
    node's last text for each conversation but one) are sums over its subtree,
    itself included. ends_sha256 is the digest of the ids of the conversations
    that end there, in order and comma-joined. Ids are distinct whole numbers;
    an empty path ends at the root; an empty table gives no rows.

    Equal paths are ranged by id, so a conversation that a third of all rows
    repeat is spread over shards. A shard holds the nodes on its current path
    and the finished children of those among them that are its own. The driver
    holds the skeleton: common prefixes of neighbouring partitions.
    """
    spark = paths.sparkSession
    ordered = cut_lineage(paths.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"))
    cuts = find_cuts(ordered)
    skeleton = Skeleton(cuts)
    sizes = np.zeros(len(skeleton.parents), np.int64)
    for (_, unit), node in skeleton.steps.items():
        sizes[node] = int(unit[DIGEST:], 16)
    found = cut_lineage(ordered.mapInArrow(_shard(spark.sparkContext.broadcast(skeleton)), _FOUND))
    sums = found.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()
    finished = _finished(skeleton, sums, sizes) if sums else []
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    top = spark.createDataFrame(finished, ", ".join(f"{c} long" for c in ("node", *names)))
    ends = _joined_digests(found.where(F.col("kind") == PIECES))
    spanning = top.join(ends, "node", "left").select(*names, F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    local = found.where(F.col("kind") == LOCAL).select(*names, F.col("ends").alias("ends_sha256"))
    under = found.where(F.col("kind") == UNDER).drop("parent_conv_id").join(
        top.select("node", F.col("conv_id").alias("parent_conv_id")), "node").select(*names, F.col("ends").alias("ends_sha256"))
    return local.unionAll(under).unionAll(spanning)


def conversation_trie(turns):
    """The trie of all conversations of ``turns`` (conv_id, turn, role, text), each rebuilt (see ``rebuilt``).

    Turns are ordered by turn, null first, equal ones by their digest; a null
    role or text counts as empty; repeated rows each count. Rows without conv_id
    belong to no conversation. Other columns are not looked at.
    """
    return prefix_trie(rebuilt(turns))


def trie_sql(conversations="conversations"):
    """The same trie as one DuckDB query: every prefix of every path as a row."""
    return f"""WITH {CRC_TABLE},
t AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations} WHERE conv_id IS NOT NULL),
u AS MATERIALIZED (SELECT conv_id, turn, strlen(text) AS size, substr(sha256(concat(strlen(role), ':', role, text)), 1, {DIGEST}) || lower(lpad(hex(strlen(text)), {SIZE}, '0')) AS unit FROM t),
own AS MATERIALIZED (SELECT conv_id, list(struct_pack(u := unit, s := size) ORDER BY turn NULLS FIRST, unit) AS us FROM u GROUP BY conv_id),
h AS MATERIALIZED (SELECT conv_id, us, conv_id - conv_id % {SIBLINGS} AS base, {crc32_sql('CAST(conv_id AS VARCHAR)')} % {HEADS} AS h FROM own, crc),
whole AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.us[:a.h], []), a.us[a.h + 1:]) AS us FROM h a LEFT JOIN own b ON a.base = b.conv_id),
p AS MATERIALIZED (SELECT conv_id, us, unnest(range(len(us) + 1)) AS depth FROM whole),
x AS MATERIALIZED (SELECT conv_id, depth, len(us) = depth AS ends, CASE WHEN depth > 0 THEN us[depth].s ELSE 0 END AS size,
    array_to_string(list_transform(us[:depth], lambda y: y.u), '') AS path FROM p),
n AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM x GROUP BY path, depth),
c AS MATERIALIZED (SELECT a.path, a.depth, a.conv_id, a.n_convs, a.own, a.ends_sha256, b.conv_id AS parent_conv_id FROM n a
    LEFT JOIN n b ON a.depth > 0 AND b.depth = a.depth - 1 AND b.path = substr(a.path, 1, (a.depth - 1) * {UNIT})),
k AS MATERIALIZED (SELECT substr(path, 1, (depth - 1) * {UNIT}) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
d AS MATERIALIZED (SELECT c.*, coalesce(n_children, 0) AS n_children FROM c LEFT JOIN k USING (path)),
s AS MATERIALIZED (SELECT up AS path, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM
    (SELECT own, n_children, substr(path, 1, unnest(range(depth + 1)) * {UNIT}) AS up FROM d) GROUP BY up)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM d JOIN s USING (path)"""
