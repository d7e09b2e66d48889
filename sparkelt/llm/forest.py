"""Near copies among vectors, by a forest of random projection trees whose children overlap.

Equal vectors are one class. Every tree has one random direction per level; its
cuts are fitted on a bounded sample, beside dense clusters. Vectors near a cut
go to both sides. All pairs of a leaf are compared in double precision, by
blocks that are tasks of their own. A pair counts in the first leaf that both
vectors are in, and what leaves a task is a count per vector and a forest of links.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .links import connected_components, cut_lineage, merge, written

TREES, SEED = 4, 20
#: Vectors of a leaf, on average without overlap; vectors and bytes of the sample that the cuts of a dimension are fitted on.
LEAF, SAMPLE, SAMPLE_BYTES = 1024, 65_536, 32 << 20
#: Vectors and numbers of a block of a leaf; vectors that are compared at a time.
BLOCK, BLOCK_NUMBERS, STEP = 4096, 8 << 20, 1024
#: Half width of the overlap, in standard deviations of the projected difference of two vectors at the threshold.
OVERLAP = 0.6
#: A cut that leaves more than this share of the vectors on one side is none.
NO_GAIN = 0.9


def overlap(dimension, threshold):
    """Half width of the overlap around a cut, for unit vectors and unit directions."""
    return OVERLAP * np.sqrt(max(0.0, 2 - 2 * threshold) / dimension)


def directions(tree, levels, dimension):
    drawn = np.random.default_rng([SEED, tree, dimension]).standard_normal((levels, dimension))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True) if levels else drawn


def units(vectors):
    """Rows scaled to length 1 without overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def descend(rows, tree, cuts, threshold):
    """(row, leaf) of all unit vectors in the upper levels; a row near a cut has several leaves."""
    margin = overlap(rows.shape[1], threshold)
    at, leaf = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for level, direction in enumerate(directions(tree, len(cuts), rows.shape[1])):
        side = (rows @ direction)[at] - cuts[level][leaf]
        left, right = side < margin, side >= -margin
        at, leaf = np.concatenate([at[left], at[right]]), np.concatenate([2 * leaf[left], 2 * leaf[right] + 1])
    return at, leaf


def _best_cut(side, margin):
    """The value of sorted ``side`` that leaves the fewest pairs on one side together; infinite if it gains nothing."""
    n = len(side)
    if n < 8:
        return np.inf
    candidates = side[np.linspace(n // 20, n - 1 - n // 20, 65).astype(int)]
    left, right = np.searchsorted(side, candidates + margin), n - np.searchsorted(side, candidates - margin)
    # among equals the one in the middle
    best = np.lexsort((np.abs(np.arange(65) - 32), left ** 2 + right ** 2))[0]
    return candidates[best] if max(left[best], right[best]) <= NO_GAIN * n else np.inf


def fit_cuts(sample, tree, levels, threshold):
    """The cut of every node: where it leaves the fewest pairs of the sample together; infinite (all go left) where no cut parts them."""
    margin, cuts = overlap(sample.shape[1], threshold), []
    at, leaf = np.arange(len(sample)), np.zeros(len(sample), np.int64)
    for level, direction in enumerate(directions(tree, levels, sample.shape[1])):
        side = (sample @ direction)[at]
        own = np.full(1 << level, np.inf)
        order = np.lexsort((side, leaf))
        edges = np.searchsorted(leaf[order], np.arange((1 << level) + 1))
        for node in np.flatnonzero(np.diff(edges)):
            own[node] = _best_cut(side[order[edges[node]:edges[node + 1]]], margin)
        cuts.append(own)
        # the sample is parted without overlap, so that it does not grow
        leaf = 2 * leaf + (side >= own[leaf])
    return cuts


def _matrix(column):
    """A list column of one dimension as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _earlier(homes, home):
    """Which leaves before ``home`` each row is in, as bits; ``homes``: a list column."""
    flat, rows = homes.flatten().to_numpy(), np.repeat(np.arange(len(homes)), homes.value_lengths().to_numpy())
    before = flat < home
    columns, at = np.unique(flat[before], return_inverse=True)
    bits = np.zeros((len(homes), -(-len(columns) // 64)), np.uint64)
    np.bitwise_or.at(bits, (rows[before], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return bits


def link_block(rows, first, second, earlier, weights, threshold):
    """Links between rows ``first`` and rows ``second`` (slices) of unit vectors that no earlier leaf has.

    Returns the weight of each row's partners, and a label per row: the
    smallest row that links reach. Equal slices are compared once per pair.
    """
    others, labels = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for a in range(first.start, first.stop, STEP):
        for b in range(a if first == second else second.start, second.stop, STEP):
            i, j = np.nonzero(rows[a:min(a + STEP, first.stop)] @ rows[b:min(b + STEP, second.stop)].T >= threshold)
            i, j = i + a, j + b
            new = ~(earlier[i] & earlier[j]).any(axis=1)
            if first == second:
                new &= i < j
            i, j = i[new], j[new]
            others += np.bincount(i, weights=weights[j], minlength=len(rows)).astype(np.int64) + np.bincount(j, weights=weights[i], minlength=len(rows)).astype(np.int64)
            merge(labels, i, j)
    return others, labels


def fit_forest(classes, threshold=0.9, trees=TREES, leaf=LEAF):
    """Cuts per dimension and tree, fitted on at most ``SAMPLE`` vectors and ``SAMPLE_BYTES`` of each dimension that has more than a leaf.

    A dimension without cuts is one leaf, compared in blocks like any other.
    """
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > leaf).orderBy(F.desc("n"), "dim").limit(1000).collect()}
    model = {}
    for dimension, n in counts.items():
        levels = int(np.ceil(np.log2(n / leaf)))
        most = max(16, min(SAMPLE, SAMPLE_BYTES // (4 * dimension)))
        drawn = classes.where(F.col("dim") == dimension).orderBy(F.xxhash64("cid"), "cid").limit(min(most, 64 << levels)).select("vector").toPandas()
        sample = units(np.stack([np.asarray(v, np.float64) for v in drawn["vector"]]))
        levels = min(levels, max(0, int(np.log2(len(sample) / 8))))
        model[dimension] = [fit_cuts(sample, t, levels, threshold) for t in range(trees)]
    return model


def _dealt(classes, model, threshold, trees):
    """(cid, n, dim, vector, homes): the leaves of each vector in all trees."""
    model = classes.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*classes.select("cid", "n", "dim", "vector").schema, StructField("homes", ArrayType(LongType()))])

    def deal(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dimension in np.unique(dims):
                rows = batch.filter(pa.array(dims == dimension))
                matrix, parts = units(_matrix(rows.column("vector"))), []
                for tree in range(trees):
                    at, leaf = descend(matrix, tree, model.value.get(int(dimension), [[]] * trees)[tree], threshold)
                    parts.append((at, (int(dimension) << 40) | (tree << 32) | leaf))
                at, home = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((home, at))
                ends = np.searchsorted(at[order], np.arange(len(rows) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(home[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=schema.names)

    return classes.select("cid", "n", "dim", "vector").mapInArrow(deal, schema)


def vector_links(classes, threshold=0.9, trees=TREES, leaf=LEAF, block=BLOCK):
    """(a, b, others) of ``classes`` (cid, n, dim, vector): row ``a`` has links of weight ``others`` in one block, and reaches ``b`` there.

    Summed over blocks, ``others`` is the weight ``n`` of all partners of a
    class, each counted once; the pairs (a, b) connect what links connect. A
    task holds two blocks of a leaf. Rows of a leaf with k blocks are sent to k tasks.
    """
    dealt = written(_dealt(classes, fit_forest(classes, threshold, trees, leaf), threshold, trees))
    most = F.greatest(F.lit(256), F.least(F.lit(block), F.floor(F.lit(BLOCK_NUMBERS) / F.shiftright("home", 40)))) if block == BLOCK else F.lit(block)
    sizes = dealt.select(F.explode("homes").alias("home")).groupBy("home").agg(F.count("*").alias("size"))
    blocks = written(sizes.withColumn("blocks", F.ceil(F.col("size") / most).cast("int")).where("blocks > 1").select("home", "blocks"))
    rows = dealt.select("cid", "n", "vector", "homes", F.explode("homes").alias("home")).join(blocks, "home", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("home", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "cid", "n", "vector", "homes")
    schema = StructType([StructField(c, LongType()) for c in ("a", "b", "others")])

    def link(batches):
        held, key = [], None

        def closed():
            home, low, high = key
            table = pa.Table.from_batches(held).combine_chunks()
            ids, own = table.column("cid").to_numpy(), table.column("own").to_numpy()
            split = int(np.searchsorted(own, low, side="right"))
            first = slice(0, split)
            second = first if low == high else slice(split, len(ids))
            vectors, homes = (table.column(c).combine_chunks() for c in ("vector", "homes"))
            others, labels = link_block(units(_matrix(vectors)), first, second, _earlier(homes, home), table.column("n").to_numpy(), threshold)
            some = np.flatnonzero(others)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[labels[some]]), pa.array(others[some])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("home", "low", "high")])
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *edges], [*edges, len(keys)]):
                now = tuple(int(x) for x in keys[start])
                if held and now != key:
                    yield closed()
                    held = []
                key = now
                held.append(batch.slice(start, stop - start))
        if held:
            yield closed()

    return rows.repartition("home", "low", "high").sortWithinPartitions("home", "low", "high", "own", "cid").mapInArrow(link, schema)


def near_vectors(df, id_col="vec_id", vector_col="embedding", threshold=0.9, trees=TREES, leaf=LEAF, block=BLOCK):
    """One row per row of ``df``: the id, n_links, component_id, kept.

    n_links counts the other rows at a cosine of at least ``threshold``;
    component_id is the smallest id that links reach, the row's own included;
    kept: the id is that one. A vector that is null, empty, zero, or holds a null
    or a number that is not finite links with nothing, and vectors of different
    length never link. Equal vectors are compared once and all counted; rows
    without id count and never name a component that has another id. No pair
    below the threshold is linked; a pair above it is found unless every tree
    parts it. Other columns are not looked at; an empty table gives no rows.
    """
    vector = F.col(f"`{vector_col}`")
    infinite = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"), F.coalesce(fine, F.lit(False)).alias("fine"))
    useful = rows.where("fine")
    classes = useful.groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("cid"), F.size("vector").alias("dim"), "vector", "first", "n"))
    links = cut_lineage(vector_links(classes, threshold, trees, leaf, block))
    sizes = classes.select("cid", "first", "n")
    degrees = links.groupBy("a").agg(F.sum("others").alias("others"))
    members = connected_components(links.select("a", "b"))
    named = (sizes.join(degrees, sizes["cid"] == degrees["a"], "left").join(members, sizes["cid"] == members["node"], "left")
             .select("cid", "first", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = classes.select("cid", "vector").join(named, "cid").join(smallest, "component").select(F.col("vector").alias("same"), "n_links", "component_id")
    linked = useful.join(known, F.col("vector") == F.col("same")).select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
