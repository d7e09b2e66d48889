"""Connected components of a table of links, in arrays and across a cluster."""

import numpy as np
from pyspark.sql import functions as F

from sparkelt.sources.paths import shared_dir


def merge(labels, a, b):
    """Labels after joining a[i] and b[i]: the smallest member of each component. Changes ``labels``."""
    while a.size:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = labels[labels]
            if np.array_equal(higher, labels):
                break
            labels[:] = higher
    return labels


def cut_lineage(df):
    """The rows of ``df`` from files in the folder that the cluster names, so that lost tasks start there.

    Only a local session without ``spark.checkpoint.dir`` gets a folder here.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint()


def written(df):
    """The rows of ``df`` as a table in the shared folder: its size is known when a join with it is planned.

    For small tables that large ones are joined with: Spark then broadcasts
    them if they are below its threshold, before it shuffles the large side.
    """
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(links):
    """(node, component) for every node of ``links`` (columns a, b): the smallest node it is connected with.

    Alternates two steps until nothing changes: every larger neighbour of a
    node, then every smaller one, is linked to the smallest of them. Each step
    is a grouped minimum and a join, and every round is written to files. Links
    of a node with itself and repeated links do no harm; links with a null are left out.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut_lineage(pairs)
    before = None
    while True:
        # the same number of rows and the same sum of hashes: the same links
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == now or not now["n"]:
            break
        before = now
        both = pairs.union(pairs.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(small.union(lowest).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
