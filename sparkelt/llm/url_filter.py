"""Verdicts over URLs from a tree of path templates per host, and from rules.

Per host, the segments of paths grow a tree level by level. A segment that is
rare among its siblings becomes a wildcard of its kind. Frequent ones whose
branches are statistically alike, in the shapes of what follows and in their
labels, become one branch (``de|en|fr``). A template is rejected if the smoothed
share of good pages among its labelled ones is too low.
"""

from pyspark.sql import Window, functions as F

from .links import written
from .manifest import UPPER

#: Levels of the tree; what lies deeper is one last segment.
LEVELS = 6
#: A segment can stay as it is if so many pages of its host have it there, and at least this share.
LEAST, SHARE = 10, 0.05
#: Branches differ if chi-square exceeds its mean by so many deviations (labels: this value) and the effect is at least so large.
DEVIATIONS, LABEL_CHI, SHAPE_EFFECT, LABEL_EFFECT = 4.0, 10.83, 0.01, 0.05
#: Pseudo-counts of a host's purity in its templates, and of that of all pages in a host's; templates below the share are rejected.
PRIOR, PURITY = 5.0, 0.5

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What a segment ends in if it names a kind of file.
_KIND = r"(\.[A-Za-z][A-Za-z0-9]{0,4})\z"
_DIGITS, _CODE, _SOME_DIGIT = r"^[0-9]+\z", r"^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*\z", "[0-9]"
#: The number that names a page's document.
_DOCUMENT = r"/([0-9]{1,18})(?:\.[A-Za-z][A-Za-z0-9]{0,4})?/?\z"

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def url_parts(url):
    """(host, path) of a URL column: A-Z of the host in lower case; both empty for a null or where ``://`` is missing."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, UPPER.lower()), F.regexp_extract(url, _PARTS, 2)


def matching_rule(host, path, rules):
    """(rule, verdict) of the longest rule that fits, null if none does. ``rules``: (verdict, host and path) pairs."""
    found = verdict = None
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        found = F.when(fits, rule) if found is None else found.when(fits, rule)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if found is None else (found, verdict)


def kind(segment):
    """The wildcard of a segment: number, code, name with digits or word, and the kind of file. No path has a ``?`` of its own."""
    end = F.regexp_extract(segment, _KIND, 1)
    name = F.substring(segment, F.lit(1), F.length(segment) - F.length(end))
    of = (F.when(name == "", "").when(name.rlike(_DIGITS), "?n").when((F.length(name) >= 8) & name.rlike(_CODE), "?h")
          .when(name.rlike(_SOME_DIGIT), "?a").otherwise("?w"))
    return F.concat(of, end)


def segments(path):
    """Segments of a path, at most ``LEVELS``; the first slash opens the first one."""
    parts = F.split(F.when(path.startswith("/"), F.substring(path, F.lit(2), F.length(path))).otherwise(path), "/")
    tail = F.array_join(F.slice(parts, LEVELS, F.greatest(F.size(parts) - (LEVELS - 1), F.lit(0))), "/")
    return F.when(F.size(parts) > LEVELS, F.concat(F.slice(parts, 1, LEVELS - 1), F.array(tail))).otherwise(parts)


def _tokens(rows, level):
    """(host, template, segment, token) of the frequent segments at a level; ``rows``: see ``templates``.

    A node has at most ``1 / SHARE`` frequent segments. They are put in order by
    their most frequent shape and their labels; each is tested against the one
    before it, and a run without a significant difference is one branch.
    """
    node = ["host", "template"]
    here = rows.where(F.size("segments") >= level).select(
        *node, F.element_at("segments", level).alias("segment"),
        F.array_join(F.slice("kinds", F.lit(level + 1), F.greatest(F.size("kinds") - level, F.lit(0))), "/").alias("shape"), "bad")
    shapes = written(here.groupBy(*node, "segment", "shape").agg(F.count("*").alias("a"), F.count("bad").alias("m"), F.sum(F.coalesce("bad", F.lit(0))).alias("b")))
    nodes = shapes.groupBy(*node).agg(F.sum("a").alias("whole"))
    branches = shapes.groupBy(*node, "segment").agg(
        F.sum("a").alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b"), F.max(F.struct("a", "shape"))["shape"].alias("main")).where(F.col("n") >= LEAST)
    branches = branches.join(nodes, node).where(F.col("n") >= F.lit(SHARE) * F.col("whole")).withColumn("share", F.col("b") / F.nullif(F.col("m"), F.lit(0)))
    inside = Window.partitionBy(*node).orderBy("main", F.asc_nulls_last("share"), "segment")
    branches = written(branches.withColumns({f"last_{c}": F.lag(c).over(inside) for c in ("segment", "main", "n", "m", "b", "share")}))

    # shapes of a branch and of the one before it, as one table of two columns
    own = branches.select(*node, "segment", "n", "last_n", "last_segment").where("last_segment IS NOT NULL")
    keys = ["n", "last_n"]
    a = own.join(shapes, [*node, "segment"]).select(*node, "segment", *keys, "shape", "a", F.lit(0).cast("long").alias("z"))
    before = shapes.select(*node, F.col("segment").alias("last_segment"), "shape", F.lit(0).cast("long").alias("a"), F.col("a").alias("z"))
    both = a.union(own.join(before, [*node, "last_segment"]).select(*node, "segment", *keys, "shape", "a", "z"))
    both = both.groupBy(*node, "segment", *keys, "shape").agg(F.sum("a").alias("a"), F.sum("z").alias("z"))
    x, z, n, last = (F.col(c).cast("double") for c in ("a", "z", "n", "last_n"))
    tested = both.groupBy(*node, "segment").agg(F.sum(F.pow(x * last - z * n, F.lit(2)) / (n * last * (x + z))).alias("chi"), (F.count("*") - 1).alias("free"))

    m, b, last_m, last_b = (F.col(c).cast("double") for c in ("m", "b", "last_m", "last_b"))
    together, gap = (b + last_b) / (m + last_m), F.col("share") - F.col("last_share")
    unlike = (F.pow(gap, F.lit(2)) > LABEL_CHI * (together * (1 - together) * (1 / F.nullif(m, F.lit(0.0)) + 1 / F.nullif(last_m, F.lit(0.0))))) & (F.abs(gap) >= LABEL_EFFECT)
    other = (F.col("chi") > F.col("free") + DEVIATIONS * F.sqrt(2.0 * F.col("free"))) & (F.col("chi") / (n + last) >= SHAPE_EFFECT)
    cut = F.when(F.col("last_segment").isNull() | (F.col("main") != F.col("last_main")) | F.coalesce(unlike, F.lit(False)) | F.coalesce(other, F.lit(False)), 1).otherwise(0)
    runs = branches.join(tested, [*node, "segment"], "left").withColumn("cut", cut).select(
        *node, "segment", F.sum("cut").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("run"))
    members = F.array_sort(F.collect_list("segment").over(Window.partitionBy(*node, "run")))
    return written(runs.select(*node, "segment", F.array_join(members, "|").alias("token")))


def templates(rows):
    """``rows`` (host, segments, kinds, bad, ...) with ``template``: a whole path with wildcards."""
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    rows = rows.withColumn("template", F.lit(""))
    for level in range(1, deepest + 1):
        at = F.least(F.lit(level), F.size("segments"))
        rows = rows.withColumn("segment", F.when(F.size("segments") >= level, F.element_at("segments", at)))
        rows = rows.join(_tokens(rows, level), ["host", "template", "segment"], "left")
        token = F.coalesce("token", F.element_at("kinds", at))
        rows = rows.withColumn("template", F.when(F.col("segment").isNotNull(), F.concat("template", F.lit("/"), token)).otherwise(F.col("template"))).drop("token", "segment")
    return rows


def template_purity(rows):
    """host, template, pages, labelled, bad, purity: the smoothed share of good pages, from that of the host, from that of all."""
    counted = rows.groupBy("host", "template").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    counted = written(counted)
    hosts = counted.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    good = counted.agg((F.sum("labelled") - F.sum("bad")) / F.nullif(F.sum("labelled"), F.lit(0))).scalar()
    prior = (F.col("host_labelled") - F.col("host_bad") + PRIOR * F.coalesce(good, F.lit(1.0))) / (F.col("host_labelled") + PRIOR)
    purity = (F.col("labelled") - F.col("bad") + PRIOR * prior) / (F.col("labelled") + PRIOR)
    return counted.join(hosts, "host").select("host", "template", "pages", "labelled", "bad", purity.alias("purity"))


def _featured(df, id_col, url_col, bad, rules):
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), (bad if bad is not None else F.lit(None)).cast("int").alias("bad"))
    host, path = url_parts(F.col("url"))
    rows = rows.select("id", "bad", host.alias("host"), path.alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"), segments(F.col("path")).alias("segments"))
    return written(rows.withColumn("kinds", F.transform("segments", kind)))


def url_verdicts(df, id_col="page_id", url_col="url", bad=None, rules=RULES):
    """One row per row of ``df``: the id, host, path, rule, verdict, template.

    ``bad`` is a column: 1 for a page labelled bad, 0 for a good one, null
    without label. The longest of ``rules`` that fits host (or a domain above
    it) and start of the path decides; other pages are blocked if their template
    is rejected. A null URL, or one without ``://``, has an empty host and path
    and is judged like the others of that host. An empty path has one empty
    segment. Repeated rows, also of one id, are each counted and answered; other
    columns are not looked at; an empty table gives no rows.

    Per level, rows are counted by host, template so far, segment and shape of
    the rest, before anything is shuffled. Rows meet small tables only: the
    branches that stay as they are, at most ``1 / SHARE`` per node, and the rejected templates.
    """
    rows = templates(_featured(df, id_col, url_col, bad, rules))
    rejected = written(template_purity(rows).where(F.col("purity") < PURITY).select("host", "template", F.lit("block").alias("judged")))
    verdict = F.coalesce("said", "judged", F.lit("allow"))
    return rows.join(rejected, ["host", "template"], "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template")


def labelled_pages(pages, labels):
    """``pages`` (page_id, url) with ``bad``, by the label of the document whose number a URL ends in: low quality or toxic."""
    worst = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0))
    known = labels.where("doc_id >= 0").groupBy("doc_id").agg(worst.alias("bad"))
    number = F.regexp_extract(url_parts(F.col("url"))[1], _DOCUMENT, 1)
    # pages without a number get keys that no document has, all different, so that they don't meet in one task
    key = F.coalesce(F.nullif(number, F.lit("")).cast("long"), -1 - F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)))
    return pages.select("page_id", "url", key.alias("doc_id")).join(known, "doc_id", "left").select("page_id", "url", "bad")


def url_sql(pages="pages", labels="labels", rules=RULES):
    """The same verdicts as one DuckDB query, the levels written out."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for said, rule in ordered:
        domain, slash, start = rule.partition("/")
        fits.append((f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{start}')", rule, said))
    cases = [" ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) for k in (1, 2)]
    end = f"regexp_extract(x, '{_KIND}', 1)"
    name = f"substr(x, 1, length(x) - length({end}))"
    wild = (f"CASE WHEN {name} = '' THEN '' WHEN regexp_matches({name}, '{_DIGITS}') THEN '?n' WHEN length({name}) >= 8 AND regexp_matches({name}, '{_CODE}') THEN '?h' "
            f"WHEN regexp_matches({name}, '{_SOME_DIGIT}') THEN '?a' ELSE '?w' END || {end}")
    steps = [rf"""WITH known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM {labels} WHERE doc_id >= 0 GROUP BY doc_id),
p AS MATERIALIZED (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path FROM {pages}),
q AS MATERIALIZED (SELECT p.*, bad, CASE {cases[0]} END AS rule, CASE {cases[1]} END AS said,
    string_split(CASE WHEN starts_with(path, '/') THEN substr(path, 2) ELSE path END, '/') AS parts
    FROM p LEFT JOIN known ON TRY_CAST(nullif(regexp_extract(path, '{_DOCUMENT}', 1), '') AS BIGINT) = doc_id),
s AS MATERIALIZED (SELECT * EXCLUDE (parts), CASE WHEN len(parts) > {LEVELS} THEN list_append(parts[:{LEVELS - 1}], array_to_string(parts[{LEVELS}:], '/')) ELSE parts END AS segments FROM q),
t0 AS MATERIALIZED (SELECT *, list_transform(segments, lambda x: {wild}) AS kinds, '' AS template FROM s)"""]
    for k in range(1, LEVELS + 1):
        order = "PARTITION BY host, template ORDER BY main, share NULLS LAST, segment"
        lags = ", ".join(f"lag({c}) OVER ({order}) AS last_{c}" for c in ("segment", "main", "n", "m", "b", "share"))
        steps.append(f"""a{k} AS MATERIALIZED (SELECT host, template, segments[{k}] AS segment, array_to_string(kinds[{k + 1}:], '/') AS shape, count(*) AS a, count(bad) AS m, sum(coalesce(bad, 0)) AS b
    FROM t{k - 1} WHERE len(segments) >= {k} GROUP BY ALL),
b{k} AS MATERIALIZED (SELECT *, {lags} FROM (SELECT *, CAST(b AS DOUBLE) / nullif(m, 0) AS share FROM
    (SELECT host, template, segment, sum(a) AS n, sum(m) AS m, sum(b) AS b, max(struct_pack(a := a, s := shape)).s AS main FROM a{k} GROUP BY ALL)
    JOIN (SELECT host, template, sum(a) AS whole FROM a{k} GROUP BY ALL) USING (host, template) WHERE n >= {LEAST} AND n >= {SHARE} * whole)),
c{k} AS MATERIALIZED (SELECT host, template, segment, sum(pow(CAST(a AS DOUBLE) * last_n - CAST(z AS DOUBLE) * n, 2) / (CAST(n AS DOUBLE) * last_n * (a + z))) AS chi, count(*) - 1 AS free FROM
    (SELECT host, template, segment, n, last_n, shape, sum(a) AS a, sum(z) AS z FROM
        (SELECT b.host, b.template, b.segment, n, last_n, shape, a.a AS a, 0 AS z FROM b{k} b JOIN a{k} a ON b.host = a.host AND b.template = a.template AND b.segment = a.segment WHERE last_segment IS NOT NULL
         UNION ALL SELECT b.host, b.template, b.segment, n, last_n, shape, 0, a.a FROM b{k} b JOIN a{k} a ON b.host = a.host AND b.template = a.template AND last_segment = a.segment) GROUP BY ALL) GROUP BY ALL),
d{k} AS MATERIALIZED (SELECT host, template, segment, sum(cut) OVER ({order} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN last_segment IS NULL OR main <> last_main
        OR coalesce(pow(share - last_share, 2) > {LABEL_CHI} * ((CAST(b AS DOUBLE) + last_b) / (m + last_m) * (1 - (CAST(b AS DOUBLE) + last_b) / (m + last_m)) * (1.0 / nullif(m, 0) + 1.0 / nullif(last_m, 0)))
            AND abs(share - last_share) >= {LABEL_EFFECT}, false)
        OR coalesce(chi > free + {DEVIATIONS} * sqrt(2.0 * free) AND chi / (n + last_n) >= {SHAPE_EFFECT}, false) THEN 1 ELSE 0 END AS cut
    FROM b{k} LEFT JOIN c{k} USING (host, template, segment))),
k{k} AS MATERIALIZED (SELECT host, template, segment, string_agg(segment, '|') OVER (PARTITION BY host, template, run ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS token FROM d{k}),
t{k} AS MATERIALIZED (SELECT t.* EXCLUDE (template), CASE WHEN len(segments) >= {k} THEN t.template || '/' || coalesce(token, kinds[{k}]) ELSE t.template END AS template
    FROM t{k - 1} t LEFT JOIN k{k} k ON t.host = k.host AND t.template = k.template AND k.segment = segments[{k}])""")
    steps.append(f"""u AS MATERIALIZED (SELECT host, template, CAST(count(bad) AS DOUBLE) AS m, CAST(sum(coalesce(bad, 0)) AS DOUBLE) AS b FROM t{LEVELS} GROUP BY ALL),
v AS MATERIALIZED (SELECT host, sum(m) AS hm, sum(b) AS hb FROM u GROUP BY host),
w AS (SELECT host, template FROM u JOIN v USING (host) WHERE (m - b + {PRIOR} * (hm - hb + {PRIOR} * coalesce((SELECT (sum(m) - sum(b)) / nullif(sum(m), 0) FROM u), 1.0)) / (hm + {PRIOR})) / (m + {PRIOR}) < {PURITY})""")
    return ",\n".join(steps) + f"""
SELECT page_id, t.host, path, rule, coalesce(said, CASE WHEN w.host IS NOT NULL THEN 'block' END, 'allow') AS verdict, t.template
FROM t{LEVELS} t LEFT JOIN w ON t.host = w.host AND t.template = w.template"""
