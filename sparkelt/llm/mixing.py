"""Documents sampled so that sources, languages and topics get the token shares asked for.

DataFrame functions only: token weights of the cells source x language x topic
are raked to the marginals in turn, and documents are drawn by a digest of
their id.
"""

from functools import reduce

from pyspark.sql import functions as F

from .links import cut_lineage, written

DIMENSIONS = ("source", "lang", "topic")
#: Share of a value: its part of all tokens to this power, so that rare ones gain.
ALPHA = 0.9
ROUNDS = 12
#: Raking with bounds: largest relative error of a marginal that ends it; rounds in which the error must fall by a tenth; rounds at most.
TOLERANCE, STALLED, MOST_ROUNDS = 0.005, 10, 200
#: Topics by words that a text holds, in lower case; the first that fits counts.
TOPICS = {
    "legal": ("license", "rights reserved"),
    "config": ("password", "token", "secret", "api_key"),
    "contact": ("@",),
}
OTHER, NONE = "prose", "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text, topics=TOPICS):
    """The topic of a text column by its words."""
    low = F.lower(text)
    out = F.lit(OTHER)
    for name, some in reversed(topics.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in some]), name).otherwise(out)
    return out


def _features(docs, text_col, topics):
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return {
        "source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "topic": topic_of(text, topics), "tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
    }


def _asked(cells, targets, alpha):
    """The cells with the tokens that each value of each dimension should get."""
    whole = cells.agg(F.sum("tokens").cast("double")).scalar()
    out = cells
    for name in DIMENSIONS:
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("n"))
        share = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
        if targets and name in targets:
            share = F.lit(0.0)
            for value, part in targets[name].items():
                share = F.when(F.col(name) == value, float(part)).otherwise(share)
            share = F.when(F.col("n") > 0, share).otherwise(0.0)
        shares = sums.select(name, share.alias("share"))
        total = F.nullif(shares.agg(F.sum("share")).scalar(), F.lit(0.0))
        part = F.coalesce(whole * F.col("share") / total, F.lit(0.0))
        out = out.join(shares.select(name, part.alias(f"want_{name}")).hint("merge"), name)
    return out


def _level(values, budget):
    """The factor that brings wanted tokens (``want``), held at what there is (``n``), to a sum of ``budget``."""
    level = budget / (values.agg(F.sum("want")).first()[0] or 1.0)
    while True:
        full = F.lit(level) * F.col("want") >= F.col("n")
        held, free = values.agg(F.sum(F.when(full, F.col("n")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("want")))).first()
        higher = (budget - held) / free if free else level
        # it only rises, and ends when no further value is full
        if higher <= level * (1 + 1e-12):
            return level
        level = higher


def _bounded(cells, least):
    """Weights of ``cells`` raked to ``least`` of all tokens in sum, none above the tokens of its cell.

    A value that should get more tokens than it has gets all of them, and the
    others share the rest as they are wanted. In each step full cells stay full
    while the others of their value grow. Ends when every marginal is within
    ``TOLERANCE``, or when the error no longer falls, as the marginals then
    contradict each other.
    """
    reach = cells.agg(F.sum("tokens").alias("all"), *[F.sum(F.when(F.col(f"want_{n}") > 0, F.col("tokens")).otherwise(0)).alias(n) for n in DIMENSIONS]).first()
    budget = float(min(least * reach["all"], *(reach[n] for n in DIMENSIONS)))
    for name in DIMENSIONS:
        values = cut_lineage(cells.groupBy(name).agg(F.max(f"want_{name}").alias("want"), F.sum("tokens").alias("n")))
        cap = F.least(F.lit(_level(values, budget)) * F.col("want"), F.col("n").cast("double"))
        cells = cells.join(values.select(name, cap.alias(f"cap_{name}")).hint("merge"), name)
    cells = cut_lineage(cells.withColumn("weight", F.col("tokens") * F.lit(budget / reach["all"])))
    errors = []
    while len(errors) < MOST_ROUNDS:
        for name in DIMENSIONS:
            full, cap, weight = F.col("weight") >= F.col("tokens"), F.col(f"cap_{name}"), F.col("weight")
            sums = cells.groupBy(name).agg(F.sum("weight").alias("sum"), F.sum(F.when(full, weight).otherwise(0.0)).alias("full"))
            scaled = F.when((F.col("sum") >= cap) & (F.col("sum") > 0), weight * cap / F.col("sum")).when(
                ~full & (F.col("sum") > F.col("full")), weight * (cap - F.col("full")) / (F.col("sum") - F.col("full"))).otherwise(weight)
            off = F.when(cap > 0, F.abs(F.col("sum") - cap) / cap).otherwise(0.0)
            cells = cells.join(sums.hint("merge"), name).withColumns(
                {"weight": F.least(scaled, F.col("tokens").cast("double")), f"off_{name}": off}).drop("sum", "full")
        cells = cut_lineage(cells)
        errors.append(max(cells.agg(*[F.max(f"off_{n}") for n in DIMENSIONS]).first()))
        if errors[-1] <= TOLERANCE or len(errors) > STALLED and errors[-1] > 0.9 * errors[-1 - STALLED]:
            break
    return cells


def raked_cells(features, targets=None, alpha=ALPHA, rounds=ROUNDS, least=None):
    """source, lang, topic, tokens, weight, factor and probability per cell of ``features``.

    Iterative proportional fitting: in each round the weights are scaled to the
    wanted tokens of every source, then of every language, then of every topic.
    ``factor`` is weight over tokens; the probability is factor over the largest
    factor, so expected tokens keep the raked shares. A cell without tokens has
    probability 1. Each round is written to files.

    The rarest cell alone then sets how much is kept. With ``least``, a share of
    all tokens that must be kept, the cells are raked with bounds to that share
    if the largest factor would leave less; factor and probability are then both
    weight over tokens. ``want_*`` are the tokens asked for.
    """
    cells = features.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    cells = _asked(cut_lineage(cells), targets, alpha)
    cells = cut_lineage(cells.withColumn("weight", F.col("tokens").cast("double")))
    for _ in range(rounds):
        for name in DIMENSIONS:
            sums = cells.groupBy(name).agg(F.sum("weight").alias("sum"))
            scaled = F.when(F.col("sum") > 0, F.col("weight") * F.col(f"want_{name}") / F.col("sum")).otherwise(F.col("weight"))
            # by merge: a broadcast per step and round would fill the driver with small tables
            cells = cells.join(sums.hint("merge"), name).withColumn("weight", scaled).drop("sum")
        cells = cut_lineage(cells)
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    cells = cells.withColumn("factor", factor)
    most = F.nullif(cells.agg(F.max("factor")).scalar(), F.lit(0.0))
    if least is not None:
        whole, kept, largest = cells.agg(F.sum("tokens"), F.sum("weight"), F.max("factor")).first()
        if largest and kept / largest < least * whole:
            cells, most = _bounded(cells.drop("factor"), least).withColumn("factor", factor), F.lit(1.0)
    wants = [f"want_{n}" for n in DIMENSIONS]
    return written(cells.select(*DIMENSIONS, "tokens", "weight", "factor", F.coalesce(F.col("factor") / most, F.lit(1.0)).alias("probability"), *wants))


def mixing_report(docs, text_col="text", targets=None, alpha=ALPHA, rounds=ROUNDS, topics=TOPICS, least=None):
    """dimension, value, tokens, kept (expected tokens), kept_share, error: how far the sample is from what is asked.

    ``error`` is the share of a value among the kept tokens over the share that
    is asked for, less 1; null if none is asked for. The row of dimension
    ``(all)`` has the largest absolute error of all.
    """
    cells = raked_cells(docs.select(*[c.alias(n) for n, c in _features(docs, text_col, topics).items()]), targets, alpha, rounds, least)
    cells = cells.withColumn("kept", F.col("tokens") * F.col("probability"))
    whole = cells.agg(F.sum("tokens").cast("double").alias("whole"), F.sum("kept").alias("whole_kept"))
    rows = None
    for name in DIMENSIONS:
        part = cells.groupBy(F.lit(name).alias("dimension"), F.col(name).alias("value")).agg(
            F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"), F.max(f"want_{name}").alias("want"))
        rows = part if rows is None else rows.unionByName(part)
    share, asked = F.col("kept") / F.nullif(F.col("whole_kept"), F.lit(0.0)), F.col("want") / F.nullif(F.col("whole"), F.lit(0.0))
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("error", share / F.nullif(asked, F.lit(0.0)) - 1)
    rows = cut_lineage(rows.select("dimension", "value", "tokens", "kept", (F.col("kept") / F.nullif(F.col("tokens"), F.lit(0))).alias("kept_share"), "error"))
    of_all = rows.where(F.col("dimension") == DIMENSIONS[0]).agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"))
    of_all = of_all.crossJoin(rows.agg(F.max(F.abs("error")).alias("error"))).select(
        F.lit("(all)").alias("dimension"), F.lit("(all)").alias("value"), "tokens", "kept", (F.col("kept") / F.nullif(F.col("tokens"), F.lit(0))).alias("kept_share"), "error")
    return rows.unionByName(of_all)


def uniform(id_col, seed):
    """A number from 0 to 1 that id and seed decide: 52 bits of a digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(NONE)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def mixing_decisions(docs, id_col="doc_id", text_col="text", targets=None, alpha=ALPHA, rounds=ROUNDS, topics=TOPICS, seed="mix", least=None):
    """One row per row of ``docs``: id, source, lang, topic, tokens, factor, probability, kept.

    ``docs`` has columns source and lang. ``targets`` may give shares by value
    for some dimensions ({"lang": {"en": 0.5, "fr": 0.5}}; a value that is not
    named gets none); elsewhere a value's share is its tokens to the power
    ``alpha``. Tokens are words cut at ASCII white space. Null sources and
    languages count as ``(none)``, null texts as empty: no tokens, always kept
    with cells that have none. Rows that repeat an id share their fate within a
    cell. ``least`` is the share of all tokens that is kept at least, in
    expectation (see ``raked_cells``). Without it a single rare cell can thin
    out all others; that is the rule that ``mixing_sql`` writes out. An empty
    table gives no rows.
    """
    features = cut_lineage(docs.select(F.col(f"`{id_col}`").alias("id"), *[c.alias(n) for n, c in _features(docs, text_col, topics).items()]))
    cells = raked_cells(features, targets, alpha, rounds, least).select(*DIMENSIONS, "factor", "probability")
    return features.join(cells, list(DIMENSIONS)).select(
        F.col("id").alias(id_col), *DIMENSIONS, "tokens", "factor", "probability", (uniform("id", seed) < F.col("probability")).alias("kept"))


def mix(docs, id_col="doc_id", text_col="text", targets=None, alpha=ALPHA, rounds=ROUNDS, topics=TOPICS, seed="mix", least=None):
    """The rows of ``docs`` that ``mixing_decisions`` keeps, all columns as they are."""
    features = _features(docs, text_col, topics)
    narrow = docs.select(*[c.alias(n) for n, c in features.items()])
    cells = raked_cells(narrow, targets, alpha, rounds, least).select(*DIMENSIONS, "probability")
    # columns in a struct, so that no name of the caller's meets those used here
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), uniform(id_col, seed).alias("drawn"), *[features[n].alias(n) for n in DIMENSIONS])
    rows = whole.join(cells, list(DIMENSIONS))
    return rows.where(F.col("drawn") < F.col("probability")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mixing_sql(documents="documents", alpha=ALPHA, rounds=ROUNDS, topics=TOPICS, seed="mix"):
    """The same decisions as one DuckDB query, the rounds written out."""
    cases = " ".join(
        f"WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in some)} THEN '{name}'" for name, some in topics.items())
    steps = [f"""WITH f AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    CASE {cases} ELSE '{OTHER}' END AS topic, CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS tokens
    FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM {documents})),
n AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM f GROUP BY ALL)"""]
    for name in DIMENSIONS:
        steps.append(f"""want_{name} AS MATERIALIZED (SELECT {name}, (SELECT sum(tokens) FROM n) * pow(t, {alpha}) / sum(pow(t, {alpha})) OVER () AS want
    FROM (SELECT {name}, sum(tokens) AS t FROM n GROUP BY {name}))""")
    last = "start"
    steps.append("start AS MATERIALIZED (SELECT *, tokens AS weight FROM n)")
    for k in range(rounds):
        for name in DIMENSIONS:
            steps.append(f"""r{k}_{name} AS MATERIALIZED (SELECT c.* EXCLUDE (weight), CASE WHEN s > 0 THEN c.weight * want / s ELSE c.weight END AS weight
    FROM {last} c JOIN (SELECT {name}, sum(weight) AS s FROM {last} GROUP BY {name}) USING ({name}) JOIN want_{name} USING ({name}))""")
            last = f"r{k}_{name}"
    steps.append(f"""c AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens END AS factor FROM {last}),
p AS MATERIALIZED (SELECT *, coalesce(factor / (SELECT max(factor) FROM c), 1.0) AS probability FROM c)""")
    return ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, tokens, round(factor, 6) AS factor, round(probability, 6) AS probability,
    CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '{NONE}')), 1, 13) AS BIGINT) AS DOUBLE) / {16 ** 13}.0 < probability AS kept
FROM f JOIN p USING (source, lang, topic)"""
