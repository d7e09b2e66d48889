"""Column profiles, chart series, histograms and distribution summaries."""

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from .relational import top_k

BANDS = 1024  # per doubling of a value
REACH = 39.0  # bandwidths beyond which a normal kernel is zero in doubles
# Bits of a double below those that name its band: sign, exponent and 12 bits are kept.
FINE_BITS = 40
PENDING = 1 << 18  # counts of a column that a task holds before it adds up equal ones


def is_numeric(df, column):
    """Whether a column exists and holds numbers; booleans do not count."""
    return column in df.columns and isinstance(df.schema[column].dataType, T.NumericType)


def numeric_columns(df):
    return [c for c in df.columns if is_numeric(df, c)]


def _known(df, column):
    """The column with NaN as null, and whole numbers as DECIMAL so that sums cannot overflow."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value.cast("decimal(20,0)") if isinstance(kind, T.IntegralType) else value


def _is_known(df, column):
    """Neither null nor NaN; written so that the null test reaches the scan."""
    value = F.col(f"`{column}`")
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return value.isNotNull() & ~F.isnan(value) if floating else value.isNotNull()


def _mean(value):
    # for DECIMAL this divides the exact sum, where avg() would round to four more digits
    return F.sum(value) / F.count(value)


def _rounded(value):
    return F.round(value, 2).cast("double")


def summary_stats(df, column):
    """One row: count, sum, mean, min, max and sample deviation, rounded to 2.

    Nulls and NaN are left out. One value has deviation 0; no values give
    zeros; a missing or non-numeric column gives the row count and zeros.
    """
    names = ("sum", "mean", "min", "max", "std")
    if not is_numeric(df, column):
        return df.agg(F.count("*").alias("count"), *[F.lit(0.0).alias(n) for n in names])
    v = _known(df, column)
    values = (F.sum(v), _mean(v), F.min(v), F.max(v), F.stddev_samp(v))
    return df.agg(
        F.count(v).alias("count"),
        *[F.coalesce(_rounded(value), F.lit(0.0)).alias(n) for n, value in zip(names, values)],
    )


def aggregate_series(df, x, y, measure="SUM", k=15, order=None):
    """Chart series (label, value): ``y`` measured per ``x``, the k highest values first.

    Rows with a null in x or y are dropped. Text in y is counted whatever the
    measure; an unknown measure means SUM. ``NONE`` gives the first k raw
    points by the columns in ``order``.
    """
    label = F.col(f"`{x}`").cast("string").alias("label")
    numeric = is_numeric(df, y)
    known = _known(df, y) if numeric else F.col(f"`{y}`")
    clean = df.where(_is_known(df, x) & _is_known(df, y))
    measure = measure.upper()
    if measure == "NONE":
        if not order:
            raise ValueError("raw points need an order: rows of a table have none")
        point = known.cast("double") if numeric else F.lit(1.0)
        return clean.orderBy(*order).limit(k).select(label, point.alias("value"))
    if not numeric:
        measure = "COUNT"
    value = {"AVG": _mean(known), "COUNT": F.count(known), "MIN": F.min(known),
             "MAX": F.max(known)}.get(measure, F.sum(known))
    grouped = clean.groupBy(F.col(f"`{x}`").alias("_x")).agg(value.alias("_value"))
    labelled = grouped.select(F.col("_x").cast("string").alias("label"), "_value")
    return top_k(labelled, "_value", "label", k).select("label", _rounded(F.col("_value")).alias("value"))


def histogram(df, column, bins=8):
    """Equal-width bins (bin, lower, upper, n); the last bin is closed, empty bins are kept.

    Equal values give a single bin, no values and text columns give none.
    """
    v = F.col("_v")
    if not is_numeric(df, column):
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    values = df.where(_is_known(df, column)).select(F.col(f"`{column}`").cast("double").alias("_v"))
    span = values.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    lo, hi = span.scalar()["lo"], span.scalar()["hi"]
    width = (hi - lo) / bins
    index = F.when(lo == hi, 0).otherwise(F.least(F.floor((v - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counts = values.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    lower = lo + F.col("bin") * width
    # counts has one row per bin
    return (
        grid.join(F.broadcast(counts), "bin", "left")
        .where(lo.isNotNull() & ((lo < hi) | (F.col("bin") == 0)))
        .select("bin", lower.alias("lower"), (lower + width).alias("upper"),
                F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def value_counts(df, column):
    """Distinct values with their counts."""
    known = df.where(_is_known(df, column))
    return known.groupBy(F.col(f"`{column}`").cast("double").alias("_v")).agg(F.count("*").alias("_c"))


def _band(value):
    """A coarse rank of a number: bands of 0.07 % relative width, in the order of the values."""
    # the smallest double is 2 ** -1074, so the added constant keeps the size positive
    size = (F.least(F.log2(F.abs(value)), F.lit(1100.0)) + 1100) * BANDS
    return F.when(value == 0, F.lit(0)).otherwise((F.signum(value) * F.floor(size)).cast("long"))


def _grouped_values(df, group, column):
    """The values without nulls, in ``_v``, by groups without nulls, in ``_g0`` and on."""
    known = df.where(_is_known(df, column)).select(
        *[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)], F.col(f"`{column}`").cast("double").alias("_v"))
    return known.dropna(subset=[f"_g{i}" for i in range(len(group))])


def exact_quantiles(df, group, column, probabilities):
    """Exact interpolated quantiles per group: (group…, n, q0, q1, …).

    ``percentile`` holds all distinct values of a group in one task. Here a
    first pass counts the rows per band of values, and running totals over the
    bands tell which band holds each wanted rank. A second pass cuts those
    bands into finer ones, and a third reads and sorts only the finer bands that
    hold a rank. All of it is one lazy plan: adaptive execution broadcasts the
    bands where they are few and splits a hot band where they are not. A group
    column named like a result keeps its name, and the result gets a trailing underscore.
    """
    names = [group] if isinstance(group, str) else list(group)
    group = [f"_g{i}" for i in range(len(names))]
    values = _grouped_values(df, names, column).withColumn("_band", _band(F.col("_v")))
    total = F.col("_total")
    at = [(total - 1) * F.lit(float(p)) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))

    counted = values.groupBy(*group, "_band").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    bands = _holding_ranks(
        counted.withColumns({"_total": F.sum("_c").over(Window.partitionBy(*group)), "_before": F.lit(0)})
        .withColumn("_ranks", ranks), group, "_band")
    bands = _finer(values, bands, group)

    state = [*group, "_band", "_lo", "_hi", "_total", "_before", "_ranks"]
    ordered = _in_bands(values, bands.select(*state), group).groupBy(*state, "_v").agg(F.count("*").alias("_c"))
    # at most two ranks per probability are collected
    found = (
        _holding_ranks(ordered, [*group, "_band", "_lo"], "_v")
        .select(*group, "_total", "_v", F.explode("_ranks").alias("_rank"))
        .groupBy(*group).agg(
            F.first("_total").alias("_total"),  # one value per group
            F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    )
    quantiles = []
    for i, a in enumerate(at):
        low, high = [F.col("_at")[f(a).cast("long")] for f in (F.floor, F.ceil)]
        quantiles.append((low + (high - low) * (a - F.floor(a))).alias(_apart(f"q{i}", names)))
    return found.select(*_named(group, names), total.alias(_apart("n", names)), *quantiles)


def _named(group, names):
    return [F.col(g).alias(n) for g, n in zip(group, names)]


def _apart(name, taken):
    return f"{name}_" if name in taken else name


def _holding_ranks(counted, within, order):
    """The rows of ``counted`` that hold a wanted rank, by running totals of ``_c`` after ``_before``.

    Leaves in ``_ranks`` the ranks a row holds and in ``_before`` the rows ahead of it.
    """
    upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("_before") + F.sum("_c").over(upto)
    return (
        counted.withColumn("_before", after - F.col("_c"))
        .withColumn("_ranks", F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))))
        .where(F.size("_ranks") > 0)
    )


def _in_bands(values, bands, group):
    return values.join(bands, [*group, "_band"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _finer(values, bands, group, parts=1024):
    """The same bands cut into equal widths, as far as they hold a wanted rank."""
    state = [*group, "_band", "_lo", "_total", "_before", "_ranks"]
    place = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * parts
    part = F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(parts - 1)).alias("_part")
    cut = _in_bands(values, bands.drop("_c"), group).groupBy(*state, part).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_hi"))
    kept = _holding_ranks(cut, [*group, "_band", "_lo"], "_part")
    return kept.drop("_lo", "_part").withColumnRenamed("_from", "_lo").select(*bands.columns)


def _band_codes(values):
    """Whole numbers in the order of the doubles, cut to bands of 1 / 4096 of a doubling."""
    bits = (values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> FINE_BITS


def _counted_in_tasks(wide, keys_of, kind):
    """(c, key, n): rows per column number and key; a task adds up its own before anything is shuffled.

    ``keys_of(c, values)`` gives the keys of an array of doubles without nulls.
    """
    def count(batches):
        held = {}

        def merged(c):
            keys, at = np.unique(np.concatenate([k for k, _ in held[c]]), return_inverse=True)
            held[c] = [(keys, np.bincount(at, weights=np.concatenate([n for _, n in held[c]]), minlength=len(keys)))]
            return held[c][0]

        for batch in batches:
            for c, column in enumerate(batch.columns):
                values = keys_of(c, column.drop_null().to_numpy(zero_copy_only=False))
                if len(values):
                    held.setdefault(c, []).append(np.unique(values, return_counts=True))
                    if sum(len(k) for k, _ in held[c]) > PENDING and len(held[c]) > 1:
                        merged(c)
        for c in held:
            keys, n = merged(c)
            for start in range(0, len(keys), 1 << 16):
                part = slice(start, start + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), c, np.int32)), pa.array(keys[part]), pa.array(n[part].astype(np.int64))], names=["c", "key", "n"])

    return wide.mapInArrow(count, f"c int, key {kind}, n long").groupBy("c", "key").agg(F.sum("n").alias("_c"))


def column_quantiles(wide, probabilities):
    """Exact interpolated quantiles of all columns of doubles of ``wide`` (no NaN): (c, q0, q1, ...), c the column's number.

    Two scans however many columns there are, and no row per value: the first
    counts rows per column and band of values, the second only the values of
    bands that hold a wanted rank. Those bands, two per column and
    probability at most, come to the driver between the two.
    """
    total = F.col("_total")
    at = [(total - 1) * F.lit(float(p)) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    bands = _counted_in_tasks(wide, lambda c, values: _band_codes(values), "long")
    bands = bands.withColumns({"_total": F.sum("_c").over(Window.partitionBy("c")), "_before": F.lit(0)}).withColumn("_ranks", ranks)
    bands = _holding_ranks(bands, ["c"], "key").select("c", F.col("key").alias("band"), "_total", "_before", "_ranks").toArrow()
    chosen = {}
    for c, band in zip(bands.column("c").to_pylist(), bands.column("band").to_pylist()):
        chosen.setdefault(c, []).append(band)

    def within(c, values):
        return values[np.isin(_band_codes(values), chosen.get(c, []))] + 0.0

    # which value holds a rank follows from what is ahead of its band; a band is named by where it begins
    wanted = [(r["c"], float(_band_start(r["band"])), r["_total"], r["_before"], r["_ranks"]) for r in bands.to_pylist()]
    wanted = wide.sparkSession.createDataFrame(wanted, "c int, low double, _total long, _before long, _ranks array<long>")
    by_column = wanted.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("low", "_total", "_before", "_ranks"))).alias("bands"))
    counts = _counted_in_tasks(wide, within, "double").join(F.broadcast(by_column), "c")  # one row per column
    own = F.element_at(F.filter("bands", lambda b: b["low"] <= F.col("key")), -1)
    placed = counts.withColumn("band", own).select("c", "key", "_c", *[F.col("band")[name].alias(name) for name in ("low", "_total", "_before", "_ranks")])
    found = _holding_ranks(placed, ["c", "low"], "key")
    found = found.select("c", "_total", "key", F.explode("_ranks").alias("_rank")).groupBy("c").agg(
        F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "key"))).alias("_at"))
    quantiles = []
    for i, a in enumerate(at):
        low, high = [F.col("_at")[f(a).cast("long")] for f in (F.floor, F.ceil)]
        quantiles.append(F.when(low == high, low).otherwise(low + (high - low) * (a - F.floor(a))).alias(f"q{i}"))
    return found.select("c", *quantiles)


def _band_start(band):
    """The smallest double of a band; below the finite ones there is only minus infinity."""
    code = np.array([band << FINE_BITS], np.int64)
    start = (code ^ ((code >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0]
    return -np.inf if np.isnan(start) else start


def box_stats(df, x, y):
    """Box plot per x: quartiles, whiskers at the last values within 1.5 IQR, outlier count.

    A statistic named like ``x`` gets a trailing underscore.
    """
    plain = df.select(F.col(f"`{x}`").alias("_x"), F.col(f"`{y}`").alias("_y"))
    quartiles = exact_quantiles(plain, "_x", "_y", (0.25, 0.5, 0.75))
    reach = (F.col("q2") - F.col("q0")) * 1.5
    fences = quartiles.withColumns({"_low": F.col("q0") - reach, "_high": F.col("q2") + reach})
    values = _grouped_values(plain, ["_x"], "_y").join(fences.withColumnRenamed("_x", "_g0"), "_g0")
    within = F.col("_v").between(F.col("_low"), F.col("_high"))
    named = {"n": "n", "q0": "q1", "q1": "median", "q2": "q3"}
    boxes = values.groupBy("_g0").agg(
        *[F.first(c).alias(_apart(name, [x])) for c, name in named.items()],
        F.min(F.when(within, F.col("_v"))).alias(_apart("whisker_low", [x])),
        F.max(F.when(within, F.col("_v"))).alias(_apart("whisker_high", [x])),
        F.count_if(~within).alias(_apart("outliers", [x])),
    )
    return boxes.withColumnRenamed("_g0", x)


def kde_grid(df, column, points=200):
    """Gaussian density at equal steps from the minimum to the maximum (point, x, density).

    Exact over all rows, with Scott's bandwidth: equal values are counted
    once and their kernel weighted with the count. A kernel is 0.0 in doubles
    beyond ``REACH`` bandwidths, so a point meets only the values within them:
    each task sorts its values a batch at a time and adds up one sum per point.
    Fewer than two different values have no density.
    """
    counted = value_counts(df, column)
    v, c = F.col("_v"), F.col("_c")
    first = counted.agg(F.sum("_c").alias("n"), (F.sum(v * c) / F.sum("_c")).alias("mean"),
                        F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    around = F.struct("n", "mean", "lo", "hi")
    base = lambda: first.select(around).scalar()
    spread = counted.agg(F.sum(c * F.pow(v - base()["mean"], F.lit(2))).alias("ss"))
    n, lo, hi = base()["n"], base()["lo"], base()["hi"]
    width = F.sqrt(spread.scalar() / F.nullif(n - 1, F.lit(0))) * F.pow(n.cast("double"), F.lit(-0.2))
    step = (hi - lo) / max(points - 1, 1)
    scale = n * width * F.sqrt(F.lit(2) * F.pi())
    # the scalars become columns once, not once per point
    spots = counted.where(width > 0).select(
        "_v", "_c", lo.alias("_lo"), step.alias("_step"), width.alias("_width"), scale.alias("_scale"))

    def kernels(batches):
        sums, grid = np.zeros(points), None
        for batch in batches:
            if not batch.num_rows:
                continue
            values, counts = (batch.column(name).to_numpy() for name in ("_v", "_c"))
            low, between, width_, scale_ = (batch.column(name)[0].as_py() for name in ("_lo", "_step", "_width", "_scale"))
            grid = low + np.arange(points) * between
            order = np.argsort(values)
            values, counts = values[order], counts[order].astype(np.float64)
            begins = np.searchsorted(values, grid - REACH * width_)
            ends = np.searchsorted(values, grid + REACH * width_, side="right")
            for k, (begin, end) in enumerate(zip(begins, ends)):
                away = (grid[k] - values[begin:end]) / width_
                sums[k] += counts[begin:end] @ np.exp(away * away * -0.5)
        if grid is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(grid), pa.array(sums), pa.array(np.full(points, scale_))], names=["point", "x", "_sum", "_scale"])

    sums = spots.mapInArrow(kernels, "point int, x double, _sum double, _scale double").groupBy("point").agg(
        F.max("x").alias("x"), (F.sum("_sum") / F.max("_scale")).alias("density"))
    return sums.where("density IS NOT NULL")


def scatter_points(df, x, y):
    """All points (x, y) without a null."""
    known = df.where(_is_known(df, x) & _is_known(df, y))
    return known.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"))


def describe_numeric(df):
    """One row per numeric column: count, mean, std, min, quartiles, max (all exact).

    A column without a value has the count 0 and nulls. The moments of all
    columns are one aggregate over the wide table, their quartiles two scans of it (see ``column_quantiles``).
    """
    columns = numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, count long, mean double, std double, min double, max double, "
                                               "q25 double, median double, q75 double")
    wide = df.select(*[_known(df, c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    moments = wide.agg(*[
        F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                 F.min(v).alias("min"), F.max(v).alias("max")).alias(v)
        for v, c in zip(wide.columns, columns)])
    stats = moments.select(F.inline(F.array(*moments.columns)))
    quartiles = column_quantiles(wide, (0.25, 0.5, 0.75))
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    # both sides have one row per column of the table
    quartiles = quartiles.select(named.alias("column"), F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75"))
    return stats.join(quartiles, "column", "left")


def describe_text(df):
    """One row per column that is not numeric: count, unique, top (the first by name of the most frequent) and freq."""
    parts = []
    for c in (c for c in df.columns if not is_numeric(df, c)):
        values = df.select(F.col(f"`{c}`").cast("string").alias("v")).where("v IS NOT NULL")
        counts = values.groupBy("v").agg(F.count("*").alias("n"))
        parts.append(counts.agg(
            F.lit(c).alias("column"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count("*").alias("unique"),
            F.min(F.struct((-F.col("n")).alias("down"), "v")).alias("best")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, count long, unique long, top string, freq long")
    best = F.col("best")
    return reduce(lambda a, b: a.union(b), parts).select(
        "column", "count", "unique", best["v"].alias("top"), (-best["down"]).alias("freq"))


def correlation_matrix(df, columns):
    """Pearson correlation of every pair of columns, in one pass; fewer than two columns have no pair."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, corr double")
    both = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                     F.corr(_known(df, a).cast("double"), _known(df, b).cast("double")).alias("corr"))
            for a, b in combinations(columns, 2)]
    return df.agg(F.array(*both).alias("pairs")).select(F.inline("pairs"))


def regression_trend(df, x, y):
    """Least-squares line y = slope * x + intercept, with r squared and the number of points."""
    a, b = _known(df, y).cast("double"), _known(df, x).cast("double")
    return df.agg(F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"),
                  F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))


# Chart colours.
LINE_STYLE = {"borderColor": "#3fb950", "backgroundColor": "rgba(35, 134, 54, 0.2)"}
BAR_STYLE = {"borderColor": "#007acc", "backgroundColor": "rgba(0, 122, 204, 0.7)"}


def chart_payload(series, chart_type, title="ANALYTICS CHART"):
    """A series (label, value) of at most a few rows as one Chart.js JSON text."""
    # sorting by the negative value puts the highest first
    rows = F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("down"), "label", "value")))
    style = LINE_STYLE if chart_type.lower() == "line" else BAR_STYLE
    dataset = F.struct(
        F.lit(title).alias("label"),
        F.transform("rows", lambda r: r["value"].cast("decimal(38,2)")).alias("data"),
        *[F.lit(colour).alias(name) for name, colour in style.items()],
        F.lit(2).alias("borderWidth"),
    )
    chart = F.struct(
        F.lit(chart_type.lower()).alias("type"),
        F.lit(title).alias("title"),
        F.struct(
            F.transform("rows", lambda r: r["label"]).alias("labels"),
            F.array(dataset).alias("datasets"),
        ).alias("data"),
    )
    return series.agg(rows.alias("rows")).select(F.to_json(chart).alias("payload"))


def chart_frame(df, chart_type, x, y, measure="SUM", bins=20):
    """The data behind a chart of the given type: bins, boxes, points, or the series of a bar or line."""
    kind = chart_type.upper()
    if kind == "HISTOGRAM":
        return histogram(df, y if is_numeric(df, y) else x, bins)
    if kind == "BOX":
        return box_stats(df, x, y)
    if kind == "SCATTER":
        return scatter_points(df, x, y)
    return aggregate_series(df, x, y, measure)


def chart_dataset(df, x, y, measure="SUM", k=15):
    """Profile of y (or x) and the series of a chart, as one table (kind, label, value)."""
    stats = summary_stats(df, y or x)
    names = ["count", "sum", "mean", "min", "max", "std"]
    profile = stats.select(*[F.col(n).cast("double") for n in names]).unpivot([], names, "label", "value")
    series = aggregate_series(df, x, y, measure, k)
    return profile.select(F.lit("stat").alias("kind"), "label", "value").unionByName(
        series.select(F.lit("series").alias("kind"), "label", "value"))


# -- gold roll-ups ----------------------------------------------------------

def _first_category(df):
    return next((c for c in df.columns if not is_numeric(df, c)), None)


def rollup_sums(df):
    """Sums of all numeric columns per value of the first other column.

    Without a category the description of the numeric columns, without a number that of the others.
    """
    category, numbers = _first_category(df), numeric_columns(df)
    if not numbers:
        return describe_text(df)
    if category is None:
        return describe_numeric(df)
    clean = df.where(F.col(f"`{category}`").isNotNull())
    return clean.groupBy(F.col(f"`{category}`").alias(category)).agg(
        *[F.coalesce(F.sum(_known(df, c)).cast("double"), F.lit(0.0)).alias(c) for c in numbers])


def rollup_first(df, order=None):
    """Count, mean and sum of the first numeric column per value of the first other column.

    Without a category or a number, the first ten rows by ``order``.
    """
    category, numbers = _first_category(df), numeric_columns(df)
    if category is None or not numbers:
        if not order:
            raise ValueError("the first rows need an order")
        return df.orderBy(*order).limit(10)
    v = _known(df, numbers[0])
    return df.where(F.col(f"`{category}`").isNotNull()).groupBy(F.col(f"`{category}`").alias(category)).agg(
        F.count(v).alias("count"), _mean(v).cast("double").alias("mean"), F.sum(v).cast("double").alias("sum"))
