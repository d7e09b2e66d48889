"""Toxic passages: runs of words whose log-odds add up to more than chance explains.

A word's log-odds come from labelled documents. Its label counts have a
Dirichlet prior from the words that share a long beginning with it, those have
one from the words that share a shorter one, and so on up to all labelled documents. A linear scan finds the maximal segments of each text; how
likely a best segment of that score is by chance follows the extreme-value law,
with parameters measured over all documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .arrow import ALNUM, text_slices, totals, word_hashes, words
from .links import cut_lineage, written

#: Labelled documents that the model is fitted on at most, chosen by a digest of the id.
FIT_ROWS = 50_000
#: Beginnings of a word, in bytes, from general to special; the whole word comes last. Each kind has so many bins.
STEMS = (3, 4, 5, 6, 7, 8)
BINS = 1 << 19
#: Pseudo-counts that a word or beginning has from the next shorter one.
PRIOR = 4.0
#: What every word costs, so that segments end; scores below the floor are no passages.
DRIFT, FLOOR = 1.0, 2.0
#: Grid for the decay of chance scores.
DECAYS = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0, 3.0])
#: A passage is significant if fewer such are expected in a text by chance.
EXPECTED = 0.05
THRESHOLD = 0.3
#: -log(expected) beyond this counts as this.
HIGHEST = 50.0


def held_out(id_col):
    """Whether labels of this id may not be learnt from."""
    return _remainder(id_col) == 2


def _remainder(id_col):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4


def _bins(data, offsets):
    """Bins of each word's beginnings and of the word, and the first word of each text."""
    low, starts, ends, bounds = words(data, offsets, ALNUM)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    stops = [*(np.minimum(ends, starts + n) for n in STEMS), ends]
    return [(word_hashes(low, starts, stop) >> shift).astype(np.int32) for stop in stops], bounds


def _label_counts(docs, sample):
    """(bin, n, toxic): labelled documents that hold a word or beginning of the bin; kinds are numbered through."""
    schema = StructType([StructField("bin", LongType()), StructField("n", LongType()), StructField("toxic", LongType())])

    def count(batches):
        sums = np.zeros((2, (len(STEMS) + 1) * BINS), np.int32)
        for batch, data, offsets in text_slices(batches):
            label = np.asarray(batch.column("label").to_numpy(zero_copy_only=False), np.int64)
            codes, bounds = _bins(data, offsets)
            row = np.repeat(np.arange(len(label)), np.diff(bounds))
            for kind, code in enumerate(codes):
                once = np.unique(row * BINS + code)
                for toxic in (0, 1):
                    mine = once[label[once // BINS] == toxic] % BINS
                    sums[toxic, kind * BINS:(kind + 1) * BINS] += np.bincount(mine, minlength=BINS).astype(np.int32)
        held = np.flatnonzero(sums.sum(axis=0))
        for start in range(0, len(held), 1 << 16):
            at = held[start:start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([
                pa.array(at, pa.int64()), pa.array(sums[:, at].sum(axis=0), pa.int64()), pa.array(sums[1, at], pa.int64())], names=schema.names)

    # the sample has at most FIT_ROWS rows of two numbers
    known = docs.join(F.broadcast(sample), docs["id"] == sample["known"]).select("label", "text")
    counts = known.mapInArrow(count, schema).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    return counts.select(*[F.col(c).cast("int") for c in ("bin", "n", "toxic")])


class Odds:
    """Log-odds of words, from general beginnings to the word itself."""

    def __init__(self, counts, n, toxic):
        base = (toxic + 0.5) / (n + 1.0)
        self.base = np.float32(base)
        self.n, self.toxic = (np.zeros((len(STEMS) + 1) * BINS, np.float32) for _ in range(2))
        for part in (batch for kind in counts for batch in kind.to_batches()):
            bins, held, toxic_ = (part.column(c).to_numpy() for c in ("bin", "n", "toxic"))
            self.n[bins], self.toxic[bins] = held, toxic_

    def scores(self, codes):
        rate = np.full(len(codes[0]), self.base, np.float32)
        for kind, code in enumerate(codes):
            at = code + kind * BINS
            rate = (self.toxic[at] + np.float32(PRIOR) * rate) / (self.n[at] + np.float32(PRIOR))
        rate = np.clip(rate.astype(np.float64), 1e-6, 1 - 1e-6)
        odds = np.log(rate / (1 - rate)) - np.log(self.base / (1 - self.base))
        # a word that is repeated at once, or in turns with another, says nothing new
        for back in (1, 2):
            odds[back:][codes[-1][back:] == codes[-1][:-back]] = 0.0
        return odds - DRIFT


def best_segments(scores, bounds):
    """The highest sum over consecutive words of each text, 0 if none is positive."""
    n = len(bounds) - 1
    # sums before each word and after the last, text after text, each on a level far below the one before
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    step = float(np.abs(scores).sum()) + 1.0
    at = np.arange(bounds[0], bounds[-1] + n) - np.repeat(np.arange(n), np.diff(bounds) + 1)
    text = np.repeat(np.arange(n), np.diff(bounds) + 1)
    own = sums[at] - sums[bounds[:-1]][text]
    floor = np.minimum.accumulate(own - text * step) + text * step
    return np.maximum.reduceat(own - floor, bounds[:-1] + np.arange(n)) if n else np.empty(0)


def maximal_segments(scores):
    """All maximal scoring segments (start, end, score) of a list, in one pass.

    Each positive score opens a segment; it is joined with earlier ones as long
    as that makes a higher sum than either has.
    """
    left, right, starts, ends = [], [], [], []
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            a, b, start = total, total + s, i
            while True:
                j = len(left) - 1
                while j >= 0 and left[j] >= a:
                    j -= 1
                if j < 0 or right[j] >= b:
                    break
                a, start = left[j], starts[j]
                del left[j:], right[j:], starts[j:], ends[j:]
            left.append(a)
            right.append(b)
            starts.append(start)
            ends.append(i + 1)
        total += s
    return [(s, e, r - a) for s, e, a, r in zip(starts, ends, left, right)]


def _scan(docs, odds):
    """id, words, best segment, segments over the floor (in words and score), sums of exp(decay x score)."""
    segment = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    schema = StructType([
        StructField("id", docs.schema["id"].dataType), StructField("n_words", LongType()), StructField("best", DoubleType()),
        StructField("segments", ArrayType(segment)), StructField("decayed", ArrayType(DoubleType())),
    ])
    segment_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        for batch, data, offsets in text_slices(batches):
            codes, bounds = _bins(data, offsets)
            scores = odds.value.scores(codes)
            best = best_segments(scores, bounds)
            segments = [[] for _ in best]
            for i in np.flatnonzero(best >= FLOOR):
                found = maximal_segments(scores[bounds[i]:bounds[i + 1]].tolist())
                segments[i] = [{"start": a, "end": b, "score": s} for a, b, s in found if s >= FLOOR]
            decayed = np.empty((len(best), len(DECAYS)))
            values, kind = np.unique(scores, return_inverse=True)
            for k, decay in enumerate(DECAYS):
                sums = np.concatenate([[0.0], np.cumsum(np.exp(decay * np.minimum(values, FLOOR))[kind])])
                decayed[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(best, pa.float64()), pa.array(segments, segment_type),
                pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * len(DECAYS), pa.int32()), pa.array(decayed.ravel())),
            ], names=schema.names)

    return docs.select("id", "text").mapInArrow(scan, schema)


def chance_law(scanned):
    """Decay and factor of the extreme-value law, from all documents.

    The decay is where words drawn from the corpus have a mean of
    exp(decay x score) of 1; the factor puts the median best segment where the
    law has its median. Toxic words are cut at the floor, so that they don't bend
    the law, and the median is not moved by the few toxic documents.
    """
    sums = scanned.agg(F.sum("n_words").alias("n"), *[F.sum(F.col("decayed")[k]).alias(f"s{k}") for k in range(len(DECAYS))]).first()
    if not sums["n"]:
        return 1.0, 1.0
    means = np.array([sums[f"s{k}"] for k in range(len(DECAYS))]) / sums["n"] - 1.0
    above = np.flatnonzero(means > 0)
    if not above.size:
        decay = DECAYS[-1]
    elif above[0] == 0:
        decay = DECAYS[0]
    else:
        a, b = above[0] - 1, above[0]
        decay = DECAYS[a] + (DECAYS[b] - DECAYS[a]) * means[a] / (means[a] - means[b])
    height = F.lit(float(decay)) * F.col("best") - F.log(F.col("n_words").cast("double"))
    middle = scanned.where("n_words > 0").agg(F.percentile_approx(height, 0.5, 10_000).alias("m")).first()["m"]
    return float(decay), float(np.exp(middle + np.log(np.log(2))))


def _logistic(x, y, rounds=50, ridge=1e-2):
    """Weights (slope, intercept) of a logistic curve through labelled heights."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    weights = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + ridge * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def toxicity(df, labels, id_col="doc_id", text_col="text", label_col="toxic", fit_rows=FIT_ROWS):
    """One row per row of ``df``: id, held_out, score, predicted, n_words, best, expected, passages.

    The model learns from at most ``fit_rows`` labelled ids whose remainder
    allows it; a third of them, by remainder, only calibrate. ``best`` is the
    highest segment score, ``expected`` the number of such segments that chance
    puts into a text of that length, ``passages`` (start, end, score, in words)
    the segments of which fewer than ``EXPECTED`` are expected. ``score`` is a
    probability by a logistic curve over log(1 + 1 / expected), or over the sum
    of -log(expected) of all passages where that is more.

    Labels other than 0 and 1 or without id are not used; an id that is labelled
    twice counts as toxic if one says so. Null and empty texts have no words and
    a best segment of 0; rows without id and repeated rows get their score like any other. Without
    usable labels every score is 0.5 at most. Other columns are not looked at.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("known"), F.col(f"`{label_col}`").cast("long").alias("label"))
    known = known.where(F.col("known").isNotNull() & F.col("label").isin(0, 1) & ~held_out("known"))
    known = known.groupBy("known").agg(F.max("label").alias("label")).orderBy(F.xxhash64("known"), "known").limit(fit_rows)
    known = cut_lineage(known.withColumn("part", _remainder("known")))
    fitted = known.where("part <> 3").select("known", "label")
    size = fitted.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    # one kind of bins at a time: at most one row per bin, twelve bytes each
    counts = written(_label_counts(docs, fitted))
    kinds = (counts.where(F.col("bin").between(k * BINS, (k + 1) * BINS - 1)).toArrow() for k in range(len(STEMS) + 1))
    odds = df.sparkSession.sparkContext.broadcast(Odds(kinds, size["n"], size["toxic"]))
    scanned = cut_lineage(_scan(docs, odds))
    decay, factor = chance_law(scanned)
    def rarity(segment_score):
        """-log of the number of segments of that score that chance puts into the text."""
        return F.lit(decay) * segment_score - F.log(F.lit(factor) * F.greatest(F.col("n_words"), F.lit(1)))

    rare = rarity(F.col("best"))
    expected = F.exp(-rare)
    # log(1 + 1 / expected) of the best segment, without overflow, or the sum over all significant ones
    one = F.greatest(rare, F.lit(0.0)) + F.log1p(F.exp(-F.abs(rare)))
    least = float(-np.log(EXPECTED))
    rest = F.aggregate("segments", F.lit(0.0), lambda total, s: total + F.when(rarity(s["score"]) > least, rarity(s["score"])).otherwise(0.0))
    height = F.least(F.greatest(one, rest), F.lit(HIGHEST))
    measured = scanned.withColumns({"expected": expected, "height": height})
    judged = known.where("part = 3").select("known", "label")
    # at most as many rows as the sample has
    seen = measured.select("id", "height").join(F.broadcast(judged), F.col("id") == F.col("known")).groupBy("known", "label").agg(F.max("height").alias("height")).toPandas()
    slope, intercept = _logistic(seen["height"].to_numpy(float), seen["label"].to_numpy(float)) if len(seen) else (0.0, 0.0)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(max(slope, 0.0))) * F.col("height") + F.lit(float(intercept)))))
    passages = F.filter("segments", lambda s: F.exp(-rarity(s["score"])) < EXPECTED)
    return measured.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"),
        "n_words", "best", "expected", passages.alias("passages"))
