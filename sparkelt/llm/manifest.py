"""A Merkle manifest of a table: one digest per row, group and table, with proofs that are folded from kept hash states.

Leaves of a group stand in the order of their ids; every run of ``BRANCH`` of
them becomes a node, and so on. A node keeps a copy of its SHA-256 state before
each child's slot, so a changed child is folded in by resuming that state with
the replacement and the siblings on its right; what is on its left is not read again.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .links import written
from .ordered import numbered
from .twins import CRC_TABLE, crc32_sql

BRANCH = 8
#: Levels that one task builds at once: blocks of 512 nodes.
LEVELS = 3
BLOCK = BRANCH ** LEVELS


class Node:
    """A node over digests of its children (hex, as bytes), with the hash state before each of them."""

    def __init__(self, children):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()
        self._others = {}

    def fold(self, slot, child):
        """This node's digest with another child in one slot."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(b"".join(self.children[slot + 1:]))
        return state.hexdigest().encode()

    def others(self, slot):
        """The siblings of one slot, left to right."""
        if slot not in self._others:
            self._others[slot] = b"".join(self.children[:slot] + self.children[slot + 1:])
        return self._others[slot]


def grow(digests, levels=None):
    """The levels of nodes above some digests: ``levels`` of them, or until one node remains."""
    grown = []
    while len(digests) > 1 if levels is None else len(grown) < levels:
        grown.append([Node(digests[i:i + BRANCH]) for i in range(0, len(digests), BRANCH)])
        digests = [node.digest for node in grown[-1]]
    return grown


def leaf_digest(values):
    """SHA-256 of columns, one after the other: byte count, colon and text of each, or ``-`` for a null."""
    framed = []
    for value in values:
        text = value.cast("string")
        framed.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*framed), 256)


def _blocks(batches):
    """((group, block), rows) of sorted batches whose first columns are group and block; a block has at most 513 rows."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def _local_levels(n):
    """How many levels a block of a group with ``n`` nodes grows: all of them, if it is the only one."""
    return LEVELS if n > BLOCK else None


def _block():
    return F.floor(F.col("place") / BLOCK).cast("long").alias("block")


def _tops(nodes):
    """(g, place, n, digest) of the top of each block of ``nodes``."""
    schema = StructType([StructField("g", StringType()), StructField("place", LongType()), StructField("n", LongType()), StructField("digest", StringType())])

    def build(batches):
        for (group, block), rows in _blocks(batches):
            n = rows[0][1]
            digests = [row[2].encode() for row in rows]
            grown = grow(digests, _local_levels(n))
            top = grown[-1][0].digest if grown else digests[0]
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([block]), pa.array([-(-n // BLOCK)]), pa.array([top.decode()])], names=schema.names)

    return nodes.select("g", _block(), "place", "n", "digest").repartition("g", "block").sortWithinPartitions("g", "block", "place").mapInArrow(build, schema)


_PATH = ArrayType(StructType([StructField("slot", IntegerType()), StructField("nodes", StringType())]))


def _with_paths(nodes, paths):
    """Nodes by block, each block led by a row (place -1) with the path from its top to its group's."""
    led = paths.select("g", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "path") if paths is not None else None
    rows = nodes.select("*", _block())
    rows = rows.unionByName(led, allowMissingColumns=True) if led is not None else rows.withColumn("path", F.lit(None).cast(_PATH))
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "place")


def _opened(rows):
    """Upper path as (slot, node) and the nodes of a block, from its rows (place, path, ...)."""
    upper = []
    if rows[0][0] < 0:
        for step in rows[0][1]:
            text = step["nodes"].encode()
            upper.append((step["slot"], Node([text[i:i + 64] for i in range(0, len(text), 64)])))
        rows = rows[1:]
    return upper, rows


def _paths(nodes, paths):
    """(g, place, path): for each node the run it is in and its slot there, level by level up to its group's top."""
    schema = StructType([StructField("g", StringType()), StructField("place", LongType()), StructField("path", _PATH)])
    step_type = pa.list_(pa.struct([("slot", pa.int32()), ("nodes", pa.string())]))

    def build(batches):
        for (group, _), rows in _blocks(batches):
            upper, rows = _opened(rows)
            grown = grow([row[3].encode() for row in rows], _local_levels(rows[0][2]))
            above = [{"slot": slot, "nodes": b"".join(node.children).decode()} for slot, node in upper]
            runs = [[b"".join(node.children).decode() for node in level] for level in grown]
            out = [[{"slot": i // BRANCH ** k % BRANCH, "nodes": level[i // BRANCH ** (k + 1)]} for k, level in enumerate(runs)] + above for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(rows)), pa.array([row[0] for row in rows]), pa.array(out, step_type)], names=schema.names)

    return _with_paths(nodes, paths).select("g", "block", "place", "path", "n", "digest").mapInArrow(build, schema)


def _proved(leaves, paths, subroots):
    """One row per leaf with its proof, and the root that its given digest folds to."""
    slot_of = {g: k for k, (g, _) in enumerate(subroots)}
    schema = StructType([leaves.schema["id"], *(StructField(c, StringType()) for c in ("leaf", "subroot", "root", "proof", "folded_root")), StructField("verified", BooleanType())])

    def build(batches):
        # hash states cannot be sent to tasks
        top = Node([digest.encode() for _, digest in subroots])
        root = top.digest.decode()
        for batch in batches:
            id_type = batch.schema.field("id").type
            break
        else:
            return

        def rest():
            yield batch
            yield from batches

        for (group, _), rows in _blocks(rest()):
            upper, rows = _opened(rows)
            own = slot_of[group]
            grown = grow([row[3].encode() for row in rows], _local_levels(rows[0][2]))
            above = [*upper, (own, top)]
            shared = b"".join(node.others(slot) for slot, node in above)
            proofs, folded = [], []
            for i, row in enumerate(rows):
                digest, siblings, at = (row[4] or row[3]).encode(), [], i
                for level in grown:
                    at, slot = divmod(at, BRANCH)
                    siblings.append(level[at].others(slot))
                    digest = level[at].fold(slot, digest)
                for slot, node in above:
                    digest = node.fold(slot, digest)
                proofs.append((b"".join(siblings) + shared).decode())
                folded.append(digest.decode())
            n = len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array([row[5] for row in rows], id_type), pa.array([row[3] for row in rows]), pa.array([subroots[own][1]] * n), pa.array([root] * n),
                pa.array(proofs, pa.string()), pa.array(folded), pa.array([f == root for f in folded])], names=schema.names)

    return _with_paths(leaves, paths).select("g", "block", "place", "path", "n", "digest", "given", "id").mapInArrow(build, schema)


def manifest(df, columns, id_col="doc_id", group_col="lang", replaced=None):
    """One row per row of ``df``: the id, leaf, subroot, root, proof, folded_root, verified.

    ``leaf`` is the digest of ``columns`` (see ``leaf_digest``); ``subroot``
    that of its group's tree, a lone leaf itself; ``root`` that of all subroots
    in the order of groups, null first, then by their bytes. ``proof`` holds the
    siblings, 64 hex digits each: those in the leaf's run, in that of its parent
    and so on, then the other subroots, left to right within each level.
    ``replaced`` maps columns to what was found in their place; ``folded_root``
    is the root that the row's digest with these values leads to by its proof,
    and ``verified`` says whether it is the root. Without ``replaced`` every row is verified.

    Rows without id come first in their group, rows with one id are ordered by
    leaf; repeated rows each have a leaf. Columns that are not named are not
    looked at. An empty table gives no rows. Values are compared as text, so 1
    and "1" have one digest, a null and ``-`` have not.

    Texts are read once. A task holds a block of 512 nodes, whatever the size
    of a group; the tops of blocks are nodes of the next round. The driver holds
    one digest per group, as every proof holds them too.
    """
    values = [F.col(f"`{c}`") for c in columns]
    leaf = leaf_digest(values)
    given = F.lit(None).cast("string")
    if replaced:
        given = leaf_digest([replaced.get(c, v) for c, v in zip(columns, values)])
    leaves = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("g"), F.col(f"`{id_col}`").alias("id"),
        leaf.alias("digest"), given.alias("given"), F.rand(BRANCH).alias("apart"))
    rounds = [written(numbered(written(leaves), "g", "id", "digest", "apart").drop("apart"))]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(written(_tops(rounds[-1])))
        most = -(-most // BLOCK)
    tops = rounds[-1].select("g", "digest").collect()
    subroots = sorted(((r["g"], r["digest"]) for r in tops), key=lambda r: r[0].encode())
    paths = None
    for nodes in reversed(rounds[1:-1]):
        paths = _paths(nodes, paths)
    return _proved(rounds[0], paths, subroots).withColumnRenamed("id", id_col)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def manifest_sql(documents="documents", levels=12):
    """The manifest of documents as one DuckDB query, up to 8 ** ``levels`` rows a language; texts in lower case where 3 divides the id's CRC-32."""
    def leaf(text):
        framed = ", ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256(concat({framed}))"

    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    steps = [f"""WITH {CRC_TABLE},
found AS MATERIALIZED (SELECT *, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {lower} ELSE text END AS given FROM {documents}, crc),
leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, leaf, given,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
    FROM (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf('given')} AS given FROM found)),
l0 AS MATERIALIZED (SELECT g, place, n, leaf AS digest FROM leaves),
f0 AS MATERIALIZED (SELECT doc_id, g, place, place AS seat, leaf, given AS folded, '' AS proof FROM leaves)"""]
    for k in range(levels):
        steps.append(f"""r{k} AS MATERIALIZED (SELECT g, place // {BRANCH} AS run, n, list(digest ORDER BY place) AS digests FROM l{k} GROUP BY ALL),
l{k + 1} AS MATERIALIZED (SELECT g, run AS place, CAST(ceil(n / {BRANCH}) AS BIGINT) AS n, CASE WHEN n > 1 THEN sha256(array_to_string(digests, '')) ELSE digests[1] END AS digest FROM r{k}),
f{k + 1} AS MATERIALIZED (SELECT doc_id, g, place, seat // {BRANCH} AS seat, leaf,
    CASE WHEN n > 1 THEN sha256(concat(array_to_string(digests[:seat % {BRANCH}], ''), folded, array_to_string(digests[seat % {BRANCH} + 2:], ''))) ELSE folded END AS folded,
    CASE WHEN n > 1 THEN concat(proof, array_to_string(digests[:seat % {BRANCH}], ''), array_to_string(digests[seat % {BRANCH} + 2:], '')) ELSE proof END AS proof
    FROM f{k} JOIN r{k} USING (g) WHERE seat // {BRANCH} = run)""")
    steps.append(f"""tops AS MATERIALIZED (SELECT list(digest ORDER BY g) AS digests, list(g ORDER BY g) AS groups FROM l{levels}),
placed AS MATERIALIZED (SELECT *, list_position(groups, g) AS at_ FROM f{levels}, tops),
done AS MATERIALIZED (SELECT doc_id, leaf, digests[at_] AS subroot, sha256(array_to_string(digests, '')) AS root,
    concat(proof, array_to_string(digests[:at_ - 1], ''), array_to_string(digests[at_ + 1:], '')) AS proof,
    sha256(concat(array_to_string(digests[:at_ - 1], ''), folded, array_to_string(digests[at_ + 1:], ''))) AS folded_root FROM placed)""")
    return ",\n".join(steps) + """
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM done"""
