"""Documents moved from old shards to new ones with the fewest bytes on the way.

The sizes of the old shards and the capacities of the new ones make a transport
problem, small however many documents there are; a minimum-cost flow says how
many bytes go from each old shard to each new one. Each old shard is one line of
documents, large ones first, and every flow takes the next piece of that line.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .links import cut_lineage

#: Rows that are put in order at a time, on average.
BUCKET_ROWS = 50_000
#: Shards that a plan may name on either side; its size is bounded by their product.
MOST_SHARDS = 4096


def even_capacities(total, shards):
    """``total`` bytes over ``shards``, at most one apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def min_cost_flow(supply, capacity, cost):
    """Flows (supply x capacity) of least total cost that place all supply, as whole numbers.

    Successive shortest paths: each path may also take back an earlier flow.
    """
    supply, capacity = np.array(supply, dtype=object), np.array(capacity, dtype=object)
    m, n = len(supply), len(capacity)
    if supply.sum() > capacity.sum():
        raise ValueError("the shards are larger than the capacities")
    flow = np.zeros((m, n), dtype=object)
    cost = np.asarray(cost, float)
    while (supply > 0).any():
        left = np.where(supply > 0, 0.0, np.inf)
        right, via, back = np.full(n, np.inf), np.full(n, -1), np.full(m, -1)
        while True:
            reach = left[:, None] + cost
            best = reach.argmin(axis=0)
            better = reach[best, np.arange(n)] < right - 1e-12
            right[better], via[better] = reach[best, np.arange(n)][better], best[better]
            undo = np.where(flow > 0, right[None, :] - cost, np.inf)
            best = undo.argmin(axis=1)
            closer = undo[np.arange(m), best] < left - 1e-12
            left[closer], back[closer] = undo[np.arange(m), best][closer], best[closer]
            if not closer.any():
                break
        open_ = np.where(capacity > 0, right, np.inf)
        j = int(open_.argmin())
        path, end = [], j
        while True:
            i = int(via[j])
            path.append((i, j, 1))
            if back[i] < 0:
                break
            path.append((i, int(back[i]), -1))
            j = int(back[i])
        amount = min([supply[i], capacity[end], *(flow[a, b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a, b] += sign * amount
        supply[i] -= amount
        capacity[end] -= amount
    return flow


def transfers(old_sizes, capacities):
    """(old, new, from byte, to byte) along the line of each old shard; what stays comes first."""
    if max(len(old_sizes), len(capacities)) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards")
    old = sorted(old_sizes)
    cost = [[0 if i == j else 1 for j in range(len(capacities))] for i in old]
    flow = min_cost_flow([old_sizes[i] for i in old], capacities, cost)
    plan = []
    for row, i in enumerate(old):
        at = 0
        for j in sorted(range(len(capacities)), key=lambda j: (j != i, j)):
            if flow[row, j]:
                plan.append((i, j, int(at), int(at + flow[row, j])))
                at += flow[row, j]
    return plan


def _measured(docs, id_col, text_col, old):
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    return {
        "id": F.col(f"`{id_col}`"), "size": size, "crc": F.crc32(text.cast("binary")), "old": old.cast("int"),
        "grade": F.floor(F.log2(size.cast("double")) * 4).cast("int"),
    }


def _buckets(rows, sub_buckets):
    """Rows with the bucket of their old shard's line: a grade of size, and a part of it by digest."""
    parts = F.lit(1)
    for grade, n in sub_buckets.items():
        parts = F.when(F.col("grade") == grade, n).otherwise(parts)
    return rows.withColumn("sub", F.pmod(F.xxhash64("id", "crc"), parts).cast("int"))


def _in_line(rows):
    """Rows with their rank and running size within the bucket."""
    order = Window.partitionBy("old", "grade", "sub").orderBy(F.col("size").desc(), "id", "crc")
    return rows.withColumns({
        "rank": F.row_number().over(order), "through": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})


class Placement:
    """Where documents go; ``plan`` are the transfers, ``affected`` the shards whose files change."""

    def __init__(self, docs, old, shards=16, capacities=None, id_col="doc_id", text_col="text"):
        self.columns = _measured(docs, id_col, text_col, old)
        self.narrow = cut_lineage(docs.select(*[c.alias(n) for n, c in self.columns.items()]))
        counts = {r["grade"]: r["n"] for r in self.narrow.groupBy("grade").agg(F.count("*").alias("n")).collect()}
        self.sub_buckets = {g: -(-n // BUCKET_ROWS) for g, n in counts.items() if n > BUCKET_ROWS}
        sums = cut_lineage(_buckets(self.narrow, self.sub_buckets).groupBy("old", "grade", "sub").agg(F.sum("size").alias("bytes")))
        old_sizes = {r["old"]: r["n"] for r in sums.groupBy("old").agg(F.sum("bytes").alias("n")).limit(MOST_SHARDS + 1).collect()}
        self.capacities = capacities or even_capacities(sum(old_sizes.values()), shards)
        self.plan = transfers(old_sizes, self.capacities)
        self.affected = sorted({s for i, j, *_ in self.plan if i != j for s in (i, j)})
        line = Window.partitionBy("old").orderBy(F.col("grade").desc(), "sub")
        before = F.sum("bytes").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
        self.begins = cut_lineage(sums.select("old", "grade", "sub", before.alias("begin")))
        self.pieces = docs.sparkSession.createDataFrame(self.plan, "old int, shard int, lo long, hi long")
        self.moved = cut_lineage(self._assigned(self.narrow))
        parts = self.moved.groupBy("shard", "old", "grade", "sub").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
        spot = Window.partitionBy("shard").orderBy("old", F.col("grade").desc(), "sub").rowsBetween(Window.unboundedPreceding, 0)
        self.slots = cut_lineage(parts.select("shard", "old", "grade", "sub", (F.sum("n").over(spot) - F.col("n") - F.col("first")).alias("shift")))

    def _assigned(self, rows):
        """Rows with their new shard: the piece of the line that holds the middle of the document."""
        rows = _in_line(_buckets(rows, self.sub_buckets)).join(self.begins, ["old", "grade", "sub"])
        twice = 2 * (F.col("begin") + F.col("through")) - F.col("size")
        pieces = F.broadcast(self.pieces)  # at most MOST_SHARDS times MOST_SHARDS rows, in fact few more than there are shards
        here = (rows["old"] == pieces["old"]) & (twice >= 2 * pieces["lo"]) & (twice < 2 * pieces["hi"])
        return rows.join(pieces, here).drop(pieces["old"]).drop("begin", "through", "lo", "hi")

    def _slotted(self, moved):
        return moved.join(self.slots, ["shard", "old", "grade", "sub"]).withColumn("slot", (F.col("rank") + F.col("shift")).cast("long"))

    def rows(self):
        """id, size, crc, old, shard, slot per document."""
        return self._slotted(self.moved).select("id", "size", "crc", "old", "shard", "slot")

    def documents(self, docs):
        """The documents themselves, all columns, with shard and slot (replacing columns of that name)."""
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in self.columns.items()])
        kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
        placed = self._slotted(self._assigned(whole))
        return placed.select(*[F.col("row")[c].alias(c) for c in kept], "shard", "slot")

    def rewrite(self, docs, path):
        """Write the shards whose documents change to ``path`` (shard=K folders there are replaced); returns them.

        ``path`` must not be where ``docs`` are read from.
        """
        changed = self.documents(docs).where(F.col("shard").isin(self.affected))
        changed.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        return self.affected


def old_shards(id_col="doc_id", shards=12):
    """The layout that documents come from: a digest of the id over ``shards``."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def reshard(docs, shards=16, old=None, capacities=None, id_col="doc_id", text_col="text"):
    """A ``Placement`` of all rows of ``docs`` from their old shards into ``shards`` new ones, sizes near equal.

    The size of a document is the UTF-8 bytes of its text plus 1, so empty and
    null texts count too. ``old``: a column with the number of the old shard.
    Slots count from 0 in every shard. Rows that repeat id and text lie next to
    each other; rows without id are placed like any other; an empty table gives
    no rows; other columns are not looked at.
    """
    return Placement(docs, old_shards(id_col) if old is None else old, shards, capacities, id_col, text_col)
