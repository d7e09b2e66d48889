"""Files laid out along a space-filling curve, so that a filter on any of its columns prunes them."""

from functools import reduce

from pyspark.sql import functions as F, types as T

from ..sources.files import keep_schema, read_kept

CELL = "_cell"
#: Beside the data, and hidden from a reader of it by its underscore.
BOUNDS = "_bounds"
#: Each column is cut into 2 ** BITS parts of about equal size.
BITS = 8
ACCURACY = 10_000
#: Bytes of a text that count for its order.
TEXT_BYTES = 7


def _number(name, kind):
    """A number in the order of the column."""
    value = F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        start = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
        return F.conv(start, 16, 10).cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    raise TypeError(f"no order to lay out {name!r} by: {kind.simpleString()}")


def _search_tree(cuts):
    """Sorted cuts as a binary search tree in an array: node i has its children at 2i + 1 and 2i + 2."""
    tree, waiting = [0.0] * len(cuts), iter(cuts)

    def fill(node):
        if node < len(tree):
            fill(2 * node + 1)
            tree[node] = next(waiting)
            fill(2 * node + 2)

    fill(0)
    return tree


def _part(number, cuts):
    """Which part of the column a number is in, by BITS comparisons; a null is in the first."""
    tree = F.lit(_search_tree(cuts))
    leaf = F.aggregate(
        F.lit(list(range(BITS))), F.lit(0),
        lambda node, _: node * 2 + 1 + F.coalesce((number >= tree[node]).cast("int"), F.lit(0)))
    return leaf - (2 ** BITS - 1)


def curve_position(df, by):
    """Place of each row on a Z-order curve over the columns ``by``, at most seven.

    Columns are cut at approximate quantiles, so a column whose values crowd
    together is cut as evenly as any other. They are found by one mergeable
    aggregate when this is called; 255 numbers per column come to the driver.
    """
    if not 1 <= len(by) <= 63 // BITS:
        raise ValueError(f"between 1 and {63 // BITS} columns: {by}")
    numbers = [_number(c, df.schema[c].dataType) for c in by]
    wanted = [i / 2 ** BITS for i in range(1, 2 ** BITS)]
    found = df.agg(*[F.percentile_approx(n, wanted, ACCURACY).alias(f"c{i}") for i, n in enumerate(numbers)]).first()
    # a column of nothing but nulls has no cuts
    parts = F.array(*[_part(n, cuts).cast("long") if cuts else F.lit(0).cast("long") for n, cuts in zip(numbers, found)])
    weights = F.lit([2 ** i for i in range(len(by))])

    def spread(part):
        """The bits of a part with room for those of the other columns between them."""
        bits = [F.shiftleft(F.shiftright(part, b).bitwiseAND(F.lit(1)), b * len(by)) for b in range(BITS)]
        return reduce(lambda x, y: x + y, bits)

    # inside the lambda a part is worked out once, however many bits are taken from it
    woven = F.transform(parts, lambda part, i: spread(part) * weights[i])
    return F.aggregate(woven, F.lit(0).cast("long"), lambda total, bits: total + bits)


def write_clustered(df, path, by, cells=256, compression=None):
    """Write ``df`` as Parquet in ``cells`` pieces of the curve over ``by``, with their bounds beside them.

    Rows are dealt by ranges of the curve, and within one place of it by a hash
    of the row, so a place that holds a third of all rows fills several cells.
    Only rows that are equal in every column stay together. An earlier table at ``path`` is replaced.
    """
    if CELL in df.columns:
        raise ValueError(f"{CELL!r} is the name of the layout's own column")
    hashable = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    placed = df.select("*", curve_position(df, by).alias("_place"), F.xxhash64(*hashable).alias("_within"))
    dealt = placed.repartitionByRange(cells, "_place", "_within").drop("_place", "_within")
    celled = dealt.withColumn(CELL, F.spark_partition_id())
    writer = celled.write.mode("overwrite").partitionBy(CELL)
    (writer.option("compression", compression) if compression else writer).parquet(path)
    keep_schema(celled, path)
    ends = [end(f"`{c}`").alias(f"{end.__name__}_{i}") for i, c in enumerate(by) for end in (F.min, F.max)]
    bounds = read_kept(df.sparkSession, path).groupBy(CELL).agg(*ends)
    bounds.withColumn("by", F.lit(list(by))).coalesce(1).write.parquet(f"{path}/{BOUNDS}")


def cells_within(spark, path, ranges):
    """``(cells that may hold a row within all ranges, number of all cells)``.

    ``ranges`` gives lowest and highest value by column, None where open. The
    bounds are one row per cell.
    """
    bounds = spark.read.parquet(f"{path}/{BOUNDS}")
    first = bounds.first()
    by = list(first["by"]) if first else []
    fits = F.lit(True)
    for name, (low, high) in ranges.items():
        if name in by:  # other columns cannot leave out a cell
            i = by.index(name)
            fits &= F.lit(True) if low is None else F.col(f"max_{i}") >= F.lit(low)
            fits &= F.lit(True) if high is None else F.col(f"min_{i}") <= F.lit(high)
    return sorted(r[CELL] for r in bounds.where(fits).select(CELL).collect()), bounds.count()


def read_clustered(spark, path, ranges):
    """Rows within all ``ranges``, as for ``cells_within``; files of other cells are not listed for the scan."""
    cells, _ = cells_within(spark, path, ranges)
    rows = read_kept(spark, path).where(F.col(CELL).isin(cells))
    for name, (low, high) in ranges.items():
        if low is not None:
            rows = rows.where(F.col(f"`{name}`") >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(f"`{name}`") <= F.lit(high))
    return rows.drop(CELL)
