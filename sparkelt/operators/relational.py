"""Projections, joins, unions, top-k and capped samples."""

from functools import reduce

from pyspark.sql import functions as F

JOIN_KINDS = {
    "inner": "inner",
    "left": "left", "left_outer": "left", "leftouter": "left",
    "right": "right", "right_outer": "right", "rightouter": "right",
    "outer": "outer", "full": "outer", "full_outer": "outer", "fullouter": "outer",
    "semi": "left_semi", "left_semi": "left_semi", "leftsemi": "left_semi",
    "anti": "left_anti", "left_anti": "left_anti", "leftanti": "left_anti",
}


def transform_columns(df, select=None, rename=None, drop=None):
    """Select, then rename, then drop; so ``drop`` uses the new names."""
    if select:
        missing = [c for c in select if c not in df.columns]
        if missing:
            raise ValueError(f"unknown columns: {missing}")
        df = df.select(*[F.col(f"`{c}`") for c in select])
    if rename:
        df = df.withColumnsRenamed(rename)
    return df.drop(*drop) if drop else df


# -- joins ------------------------------------------------------------------

#: Keys that the summary follows per wanted one. Its count of a key is too high by 2.625 / (TRACKED / share) of the
#: rows at most, i.e. by less than a sixth of ``share``, and never too low.
TRACKED, MOST_TRACKED = 16, 1_000_000
#: Summaries are merged in so many groups first, so that the last task gets few.
MERGES = 64
#: Key types that the summary follows as they are; others go by their digest.
FOLLOWED = {"tinyint", "smallint", "int", "bigint", "date", "string"}


def hot_keys(df, keys, share):
    """Every key that holds more than ``share`` of the rows without null keys, and none with less than 5/6 of it.

    One pass over the key columns, with a heavy-hitter summary per task; the
    summaries are merged and no key is shuffled. Keys of several columns, and
    those of other types, are followed by digest; a second pass then
    reads out the few keys that have such a digest. The keys only steer how a
    join is laid out, never its result.
    """
    if not TRACKED / MOST_TRACKED <= share < 1:
        raise ValueError(f"a share between {TRACKED / MOST_TRACKED} and 1 is needed, got {share}")
    tracked = int(-(-TRACKED // share))
    known = df.select(*keys).where(_all_set(keys))
    types = dict(known.dtypes)
    single = len(keys) == 1 and types[keys[0]] in FOLLOWED
    # zeros of both signs are one key
    equal = [F.col(k) + F.lit(0).cast(types[k]) if types[k] in ("float", "double") else F.col(k) for k in keys]
    followed = known.select(F.col(keys[0]) if single else F.xxhash64(*equal)).toDF("_item").withColumn(
        "_group", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    parts = followed.groupBy("_group").agg(
        F.expr(f"approx_top_k_accumulate(_item, {tracked})").alias("_seen"), F.count("*").alias("_n"))
    # summaries cannot be merged where there are none, so an empty table must give no group
    whole = parts.groupBy(F.lit(True)).agg(F.expr(f"approx_top_k_combine(_seen, {tracked})").alias("_seen"), F.sum("_n").alias("_n"))
    # at most 1 / (5/6 of the share) keys can be listed
    listed = whole.select(F.expr(f"inline(approx_top_k_estimate(_seen, {int(-(-1.25 // share))}))"), "_n")
    hot = listed.where(F.col("count") > F.lit(share) * F.col("_n"))
    if single:
        return hot.select(F.col("item").alias(keys[0]))
    digests = hot.select(F.col("item").alias("_digest"))
    return known.withColumn("_digest", F.xxhash64(*equal)).join(F.broadcast(digests), "_digest", "left_semi").select(*keys).distinct()


def _found_hot_keys(df, keys, share):
    """The hot keys as a local table, or None; both sides of a join must see the same ones."""
    hot = hot_keys(df, keys, share)
    found = hot.collect()
    return df.sparkSession.createDataFrame(found, hot.schema) if found else None


def _all_set(keys):
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def is_small(df):
    """Whether Catalyst would broadcast a table, by its own size estimate.

    Without access to the estimate, as on a remote session, the answer is no.
    """
    try:
        limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit
    except AttributeError:
        return False


# sides that Spark can broadcast for a kind of join
BROADCAST_SIDES = {"inner": {"left", "right"}, "left": {"right"}, "right": {"left"}, "outer": set(),
                   "left_semi": {"right"}, "left_anti": {"right"}}
# sides whose hot keys adaptive execution cannot split
UNSPLIT_SIDES = {"left": {"right"}, "right": {"left"}, "outer": {"left", "right"}}


def join_frames(left, right, on, how="inner", suffixes=("_x", "_y"), hot_share=0.02, hot_sides=None,
                hot_source=None, salts=32, always_salt=False):
    """Equi-join on shared key names.

    Non-key columns that both sides have get a suffix. Null keys never match.

    Adaptive execution splits hot keys of either side of an inner join, and of
    the left side of a left, semi or anti join. It cannot split the optional
    side of an outer join. There, keys that hold more than ``hot_share`` of a
    side's rows are cut into ``salts`` parts, unless a side is small enough to
    be broadcast. Finding them runs a query over the key columns of that side;
    a join without hot keys is left as it is. ``hot_share=None`` turns this off.

    ``hot_sides`` names the sides to look at instead. Adaptive execution also
    fails for a side that an aggregation or join on the same keys has left in
    place, so name the other side of such a join, whatever its kind.
    ``hot_source`` is a cheaper table to find the left side's hot keys in.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {how!r}; there are {sorted(JOIN_KINDS)}")
    how = JOIN_KINDS[how]
    if hot_source is not None and how in ("right", "outer"):
        raise ValueError("a right or outer join finds hot keys in its own left side")
    for side, df in (("left", left), ("right", right)):
        missing = [k for k in keys if k not in df.columns]
        if missing or not keys:
            raise ValueError(f"join keys {missing or keys} not on the {side} side")

    half = how in ("left_semi", "left_anti")
    if half:
        right = right.select(*keys)
    else:
        shared = (set(left.columns) & set(right.columns)) - set(keys)
        left, right = [
            df.withColumnsRenamed({c: c + suffix for c in shared})
            for df, suffix in ((left, suffixes[0]), (right, suffixes[1]))
        ]
        names = [c for c in left.columns + right.columns if c not in keys]
        if len(names) != len(set(names)):
            raise ValueError("the suffixes lead to duplicate column names")

    # a broadcast join shuffles nothing, and a small side has no key worth splitting
    small = set() if always_salt else {n for n, df in (("left", left), ("right", right)) if is_small(df)}
    if small & BROADCAST_SIDES[how]:
        return left.join(right, keys, how)
    hot_sides = set(UNSPLIT_SIDES.get(how, ()) if hot_sides is None else hot_sides) - small
    if half:
        # A key of the right side is needed once. A few copies are left of each,
        # so that the join still shuffles this side and can split the left one.
        part = F.pmod(F.spark_partition_id(), F.lit(8))
        right = right.withColumn("_part", part).distinct().drop("_part")
        hot_sides -= {"right"}
    if hot_share is None or not hot_sides:
        return left.join(right, keys, how)
    hot_left, hot_right = [
        _found_hot_keys(df, keys, hot_share) if side in hot_sides else None
        for side, df in (("left", left if hot_source is None else hot_source), ("right", right))
    ]
    if hot_left is None and hot_right is None:
        return left.join(right, keys, how)
    return _salted_join(left, right, keys, how, hot_left, hot_right, salts)


def _salted_join(left, right, keys, how, hot_left, hot_right, salts):
    columns = [c for c in left.columns + right.columns if c not in keys]
    half = how in ("left_semi", "left_anti")
    left = _salt(left, keys, hot_left, hot_right, salts, "l")
    right = _salt(right, keys, hot_right, hot_left, salts, "r")
    left = left.withColumnsRenamed({"_own": "_sl", "_copy": "_sr"})
    right = right.withColumnsRenamed({"_own": "_sr", "_copy": "_sl"})
    joined = left.join(right, [*keys, "_sl", "_sr"], how)
    if half:
        return joined.select(*keys, *columns)
    # A hot key of one side has partners there by definition, so a copy made
    # for it on the other side that met none is not an unmatched row.
    stray = F.lit(False)
    if how in ("left", "outer"):
        stray |= F.col("_side_r").isNull() & F.col("_copied_l")
    if how in ("right", "outer"):
        stray |= F.col("_side_l").isNull() & F.col("_copied_r")
    return joined.where(~stray).select(*keys, *columns)


def _salt(df, keys, hot, other_hot, salts, side):
    """Spread own hot rows over salts and copy the rows that face the other side's hot keys.

    The salt hashes the row and its input partition. Both are the same when a
    lost task runs again, so a row never changes its salt, and the partition
    keeps copies of a row apart. Rows with a null key match nothing and are
    spread as well.
    """
    hashable = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    spread = F.pmod(F.xxhash64(*hashable, F.spark_partition_id()), F.lit(salts)).cast("int")
    is_hot, copied = F.lit(False), F.lit(False)
    if hot is not None:
        # a local table of at most 1/share rows
        df = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
        is_hot = F.col("_hot").isNotNull()
    if other_hot is not None:
        df = df.join(F.broadcast(other_hot.withColumn("_faced", F.lit(True))), keys, "left")
        copied = F.col("_faced").isNotNull()
    zero = F.array(F.lit(0))
    copies = F.when(copied, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(zero)
    return (
        df.withColumns({
            "_own": F.when(is_hot | ~_all_set(keys), spread).otherwise(0),
            f"_copied_{side}": copied,
            f"_side_{side}": F.lit(True),
        })
        .withColumn("_copy", F.explode(copies))
        .drop("_hot", "_faced")
    )


def left_and_right(inputs):
    """The two inputs of a join, by port: ``left`` and ``right``, or whatever two ports there are, in order."""
    if len(inputs) != 2 and not inputs.keys() >= {"left", "right"}:
        raise ValueError(f"a join needs a left and a right input, got {len(inputs)}")
    first, second = (["left", "right"] if inputs.keys() >= {"left", "right"} else inputs)
    return inputs[first], inputs[second]


# -- unions, limits ---------------------------------------------------------

def union_frames(*frames, allow_missing=False):
    """All rows of two or more tables, matched by column name; duplicates stay."""
    if len(frames) < 2:
        raise ValueError("a union needs at least two inputs")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def top_k(df, value, label, k=15):
    """The k rows with the highest value; equal values are ordered by label."""
    return df.orderBy(F.col(value).desc(), F.col(label).asc()).limit(k)


def sample_with_total(df, order, n=100):
    """The first n rows by ``order``, each with the size of the whole table as ``row_count``."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).limit(n).withColumn("row_count", total)
