"""Tables kept by ranges of row digests, under a Merkle tree: two of them are compared from the top."""

from pyspark.sql import functions as F

from ..functions.hashing import content_digest, content_hash, row_digest
from ..sources.files import keep_schema, read_kept

RANGE, DIGEST = "_range", "_digest"
TREE = "_tree"
#: A range is the digests that start with these many hex digits: 256 ranges.
DIGITS = 2
#: The longest such start, for 65,536 ranges.
DEEPEST = 4


def _range_of(digest, digits):
    # a letter in front, or Spark would read some folder names as numbers
    return F.concat(F.lit("r"), F.left(digest, F.lit(digits)))


def write_by_digest(df, path, digits=DIGITS):
    """Write ``df`` with the digest of each row, in folders by ranges of digests, and the tree over them.

    Digests spread evenly, whatever the keys. The rows of a range are rebalanced,
    so that adaptive execution cuts a range with one row in very many copies.
    """
    if not 1 <= digits <= DEEPEST:
        raise ValueError(f"between 1 and {DEEPEST} digits: {digits}")
    taken = {RANGE, DIGEST} & set(df.columns)
    if taken:
        raise ValueError(f"names of the table's own columns: {sorted(taken)}")
    digested = df.withColumn(DIGEST, row_digest(df, df.columns))
    ranged = digested.withColumn(RANGE, _range_of(F.col(DIGEST), digits)).hint("rebalance", F.col(RANGE))
    ranged.write.mode("overwrite").partitionBy(RANGE).parquet(path)
    keep_schema(ranged, path)
    digest_tree(read_kept(df.sparkSession, path), digits).coalesce(1).write.parquet(f"{path}/{TREE}")


def digest_tree(digested, digits=DIGITS):
    """Nodes (node, row_count, digest, digits) over rows with ``_digest``: a leaf per range, 16 children to a node.

    A leaf is the content hash of its rows, in any order; a node is the hash of
    its children's names and digests. The top is named ``r``.
    """
    leaves = digested.groupBy(_range_of(F.col(DIGEST), digits).alias("node")).agg(*content_digest(F.col(DIGEST)))
    level = leaves.select("node", "row_count", content_hash().alias("digest"))
    nodes = level
    for length in range(digits, 0, -1):
        children = F.array_sort(F.collect_list(F.concat("node", F.lit(":"), "digest")))
        level = level.groupBy(F.left("node", F.lit(length)).alias("parent")).agg(
            F.sum("row_count").alias("row_count"), F.sha2(F.concat_ws(",", children), 256).alias("digest")
        ).withColumnRenamed("parent", "node")
        nodes = nodes.unionByName(level)
    return nodes.withColumn("digits", F.lit(digits))


def changed_ranges(spark, old, new):
    """Names of the ranges whose rows differ between two tables, found from the top of their trees.

    Equal tables cost one row of each tree. Below the top only the children of
    nodes that differ are looked at; the names of ranges come to the driver, 16 to the power of the digits at most.
    """
    a, b = (spark.read.parquet(f"{path}/{TREE}").select("node", "digits", F.col("digest").alias(name))
            for path, name in ((old, "a"), (new, "b")))
    suspects = [""]
    for length in range(1, DEEPEST + 2):
        level = [side.where((F.length("node") == length) & F.left("node", F.lit(length - 1)).isin(suspects)) for side in (a, b)]
        differing = level[0].join(level[1], ["node", "digits"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
        found = differing.select("node", "digits").collect()
        if len({r["digits"] for r in found}) > 1:
            raise ValueError("the tables are kept in ranges of different length")
        suspects = sorted(r["node"] for r in found)
        if not found or found[0]["digits"] == length - 1:
            return suspects
    return suspects


def changed_rows(spark, old, new):
    """Rows that one table has more often than the other: (range, change, copies and the columns).

    ``change`` is ``added`` or ``removed``, ``copies`` by how many rows. Only
    the folders of ranges that differ are read. Copies are counted in every task
    before the shuffle. The tables must have the same columns.
    """
    ranges = changed_ranges(spark, old, new)
    before, after = (read_kept(spark, path) for path in (old, new))
    columns = [c for c in before.columns if c not in (RANGE, DIGEST)]
    if columns != [c for c in after.columns if c not in (RANGE, DIGEST)]:
        raise ValueError("the tables have different columns")
    both = before.withColumn("_sign", F.lit(-1)).unionByName(after.withColumn("_sign", F.lit(1)))
    net = both.where(F.col(RANGE).isin(ranges)).groupBy(RANGE, DIGEST).agg(
        F.sum("_sign").alias("_net"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row"))
    return net.where("_net <> 0").select(
        F.col(RANGE).alias("range"), F.when(F.col("_net") > 0, "added").otherwise("removed").alias("change"),
        F.abs("_net").alias("copies"), "_row.*")
