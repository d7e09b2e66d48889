"""The language of documents and pages: evidence from text, markup, address and host, fused by Bayes' rule.

Likelihoods of byte trigrams are learnt from all rows that declare a language.
What a row's markup declares and what its address ends in have likelihoods per
language from grouped counts; the prior is that of its host, smoothed by that of
the domain, smoothed by that of all rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .arrow import LOWER, NOT_SPACE, spread, text_slices, totals, word_hashes, words
from .links import cut_lineage, written

#: Bins of trigrams; trigrams that a language is taken to have beside its own, in no bin, so that little evidence counts little.
BINS, UNSEEN = 1 << 16, 300.0
#: Languages whose counts the driver and a task hold at a time; all are learnt, block by block.
BLOCK, HELD = 32, 128
#: Bytes of text that a task works on at a time: several arrays of numbers per byte are held beside the models.
TEXT_BYTES = 1 << 20
#: Numbers that are worked on at a time when evidence is fused.
FUSED = 1 << 20
#: How much a trigram counts, as neighbours overlap; weight of all text in a language's trigrams.
TEMPER, MIXED = 0.3, 0.01
#: Words of a shingle and marks per text, by which a language's different texts are counted; other texts that count as half a language.
SHINGLE, MARKS, HALF = 5, 8, 2.0
#: A language has a script of its own if so much of its text is in bins of which it has so large a part.
OWN_SCRIPT, OWN_BIN = 0.5, 0.9
#: Pseudo-counts of host and domain priors and of declared values.
PRIOR, VALUES = 5.0, 1.0
#: Below this probability a language is not settled.
SETTLED = 0.5
UNKNOWN = "und"

_LETTER = LOWER.copy()
_LETTER[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 32


def trigrams(data, offsets):
    """Bin of each byte trigram with at most one gap in it, and the first of each text.

    Letters are lower-cased, all other ASCII is a gap; trigrams don't reach into the next text.
    """
    text = _LETTER[data]
    if len(text) < 3:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    wide = text.astype(np.uint32)
    code = ((wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    gap = (text == 32).astype(np.int8)
    good = gap[:-2] + gap[1:-1] + gap[2:] <= 1
    for back in (1, 2):
        good[np.maximum(offsets[1:-1] - back, 0)[offsets[1:-1] - back < len(good)]] = False
    at = np.flatnonzero(good)
    return code[at].astype(np.int64), np.searchsorted(at, offsets)


_FACTORS = np.random.default_rng(MARKS).integers(1 << 62, 1 << 63, MARKS, np.uint64) * np.uint64(2) + np.uint64(1)


def marks(data, offsets):
    """The texts that have a word, and ``MARKS`` numbers of each: the smallest of its shingles in as many orders.

    Near copies share most of their marks, different texts none.
    """
    low, starts, ends, bounds = words(data, offsets, NOT_SPACE)
    n = np.maximum(np.diff(bounds) - (SHINGLE - 1), np.minimum(np.diff(bounds), 1))
    some = np.flatnonzero(n)
    if not len(some):
        return some, np.empty((0, MARKS), np.int64)
    first = spread(bounds[:-1], n)
    last = np.minimum(first + SHINGLE - 1, np.repeat(bounds[1:] - 1, n))
    h, at = word_hashes(low, starts[first], ends[last]), np.cumsum(n[some]) - n[some]
    return some, np.column_stack([np.minimum.reduceat(h * f >> np.uint64(2), at).astype(np.int64) for f in _FACTORS])


def trust_of(different):
    """How far a language is believed that has so many different texts: not at all with one, fully with many."""
    others = np.where(different > 1 + 1e-6, different - 1, 0.0)
    return others / (others + HALF)


class Model:
    """Log-likelihoods of trigram bins per language, as differences to those of bins that it does not hold.

    Six bytes per language and held bin. ``overall`` is trigrams per bin of all
    languages, if ``counts`` has only some of them. A language has a share of its
    likelihood as large as its ``trust``, in the rest every bin is alike; one
    with a script of its own has full trust.
    """

    def __init__(self, languages, counts, overall=None, trust=None):
        self.languages = list(languages)
        language, bins, n = (counts.column(c).to_numpy() for c in ("language", "bin", "n"))
        if overall is None:
            overall = np.bincount(bins, weights=n, minlength=BINS)
        self.both = (overall + 0.5) / (overall.sum() + 0.5 * BINS)
        order = np.argsort(language, kind="stable")
        language, bins, n = language[order], bins[order], n[order]
        size = len(self.languages)
        self.totals = np.bincount(language, weights=n, minlength=size)
        alone = np.bincount(language, weights=np.where(n >= OWN_BIN * overall[bins], n, 0), minlength=size)
        self.own_script = alone > OWN_SCRIPT * self.totals
        self.trust = np.where(self.own_script, 1.0, np.ones(size) if trust is None else trust)
        self.bins, self.n = bins.astype(np.uint16), n.astype(np.float32)
        self.bounds = np.searchsorted(language, np.arange(size + 1))

    def sums(self, code, bounds, declared=()):
        """(texts x languages) log-likelihoods of trigrams; one language is spread over all bins at a time.

        A text that declares a language is not held against its own trigrams
        there, unless nobody else could confirm them: in a script of its own.
        """
        out = np.empty((len(bounds) - 1, len(self.languages)))
        of = {}
        for row, name in enumerate(declared):
            of.setdefault(name, []).append(row)
        for k, name in enumerate(self.languages):
            held = slice(self.bounds[k], self.bounds[k + 1])
            bins, n = self.bins[held], self.n[held].astype(np.float64)
            rest = self.trust[k] * MIXED * self.both + (1 - self.trust[k]) / BINS
            logs = np.log(rest)
            logs[bins] = np.log(rest[bins] + self.trust[k] * (1 - MIXED) * n / (self.totals[k] + UNSEEN))
            sums = np.concatenate([[0.0], np.cumsum(logs[code])])
            out[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
            if name in of and not self.own_script[k]:
                dense = np.zeros(BINS)
                dense[bins] = n
                self._without_own(out, k, dense, rest, code, bounds, np.array(of[name]))
        return out

    def _without_own(self, out, k, n, rest, code, bounds, rows):
        sizes = (bounds[1:] - bounds[:-1])[rows]
        key, own = np.unique(np.repeat(np.arange(len(rows)) << 16, sizes) | code[spread(bounds[rows], sizes)], return_counts=True)
        row, bins = key >> 16, key & 0xFFFF
        others = np.maximum(n[bins] - own, 0) / (np.maximum(self.totals[k] - sizes, 0) + UNSEEN)[row]
        logs = np.log(rest[bins] + self.trust[k] * (1 - MIXED) * others)
        out[rows, k] = np.bincount(row, weights=own * logs, minlength=len(rows))

    def likelihoods(self, data, offsets, declared=()):
        return likelihoods([self], data, offsets, declared)


def likelihoods(models, data, offsets, declared=()):
    """(texts x languages of all models and unknown) log-likelihoods, trigrams and letter bytes per text.

    A text in none of the languages has every bin alike. ``declared`` names what each text declares.
    """
    code, bounds = trigrams(data, offsets)
    n = np.diff(bounds)
    out = np.column_stack([*(m.sums(code, bounds, declared) for m in models), n * -np.log(BINS)])
    return TEMPER * out + 0.0, n, totals(_LETTER[data] != 32, offsets)


def primary(declared):
    """The primary part of a declared language, in lower case: ``fr`` of ``fr-CA``."""
    return F.nullif(F.lower(F.regexp_extract(declared.cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit(""))


def parent(host):
    """The domain of a host: its last two parts; of a name without dots, what stands before trailing digits."""
    two = F.substring_index(host, ".", -2)
    return F.when(F.contains(host, F.lit(".")), two).otherwise(F.regexp_replace(host, r"[0-9]+$", ""))


def _evidence(df, text_col, declared, suffix, host):
    nothing = F.lit(None).cast("string")
    where = F.coalesce(host.cast("string"), F.lit("")) if host is not None else F.lit("")
    return {
        "text": F.col(f"`{text_col}`").cast("string") if isinstance(text_col, str) else text_col.cast("string"),
        "declared": primary(declared) if declared is not None else nothing,
        "suffix": F.lower(suffix.cast("string")) if suffix is not None else nothing, "host": where, "domain": parent(where),
    }


def _bins(batches):
    """(language, bin, n) of declared texts; a task holds counts of ``HELD`` languages and passes them on when there are more.

    The marks of texts are counted like bins, beyond ``BINS``.
    """
    held = {}

    def passed_on():
        for name, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], names=["language", "bin", "n"])

    for batch, data, offsets in text_slices(batches, TEXT_BYTES):
        code, bounds = trigrams(data, offsets)
        names = batch.column("declared").dictionary_encode()
        of = np.repeat(names.indices.to_numpy(), np.diff(bounds))
        order = np.argsort(of, kind="stable")
        code, ends = code[order], np.searchsorted(of[order], np.arange(len(names.dictionary) + 1))
        some, found = marks(data, offsets)
        if len(some):
            by_mark = names.dictionary.take(names.indices.take(pa.array(np.repeat(some, MARKS)))).cast(pa.string())
            yield pa.RecordBatch.from_arrays([by_mark, pa.array(BINS + found.ravel()), pa.array(np.ones(found.size, np.int64))], names=["language", "bin", "n"])
        for k, name in enumerate(names.dictionary.to_pylist()):
            if name not in held:
                if len(held) == HELD:
                    yield from passed_on()
                    held.clear()
                held[name] = np.zeros(BINS, np.int64)
            held[name] += np.bincount(code[ends[k]:ends[k + 1]], minlength=BINS)
    yield from passed_on()


def learn(rows, languages=None):
    """Names of languages and broadcast models of ``BLOCK`` languages each, from all ``rows`` (text, declared) that declare one.

    Without ``languages``, every declared language that has a trigram is learnt,
    however rare. It is trusted by the number of its different texts, of which a
    group of copies counts as one; a code of one text alone is left out, unless
    it has a script of its own. Those of ``languages`` are all believed. The counts are a table in files; the driver
    reads a block of languages at a time.
    """
    spark = rows.sparkSession
    known = rows.select("declared", "text").where("declared IS NOT NULL" if languages is None else F.col("declared").isin(list(languages)))
    counts = written(known.mapInArrow(_bins, "language string, bin long, n long").groupBy("language", "bin").agg(F.sum("n").alias("n")))
    bins, found = counts.where(F.col("bin") < BINS), counts.where(F.col("bin") >= BINS)
    # as many texts as marks would be shared by, if all texts were alike in that; one for a group of copies
    different = (F.pow(F.sum("n").cast("double"), F.lit(2)) / (MARKS * F.sum(F.col("n").cast("double") * F.col("n")))).alias("different")
    texts = {r["language"]: r["different"] for r in found.groupBy("language").agg(different).collect()}
    given = languages is not None
    if not given:
        languages = sorted(r["language"] for r in bins.select("language").distinct().collect())
    sums = bins.groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    overall = np.zeros(BINS)
    overall[sums.column("bin").to_numpy()] = sums.column("n").to_numpy()
    names, models = [], []
    for start in range(0, len(languages), BLOCK):
        some = list(languages[start:start + BLOCK])
        part = bins.where(F.col("language").isin(some)).toArrow()

        def model(some):
            number = pc.index_in(part.column("language"), pa.array(some, pa.string()))
            known = part.set_column(0, "language", number.cast(pa.int64())).filter(pc.is_valid(number))
            return Model(some, known, overall, None if given else trust_of(np.array([texts.get(name, 0.0) for name in some])))

        made = model(some)
        believed = [name for name, trust in zip(some, made.trust) if trust > 0]
        if believed:
            names += believed
            models.append(spark.sparkContext.broadcast(made if len(believed) == len(some) else model(believed)))
    return names, models


def _scored(rows, models):
    """``rows`` with ``logs`` (log-likelihood per language and unknown) in place of the text."""
    kept = [c for c in rows.columns if c != "text"]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("logs", ArrayType(DoubleType())), StructField("trigrams", LongType()), StructField("letters", LongType())])

    def score(batches):
        for batch, data, offsets in text_slices(batches, TEXT_BYTES):
            logs, *sizes = likelihoods([m.value for m in models], data, offsets, batch.column("declared").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1) * logs.shape[1], pa.int32()), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, *(pa.array(n, pa.int64()) for n in sizes)], names=schema.names)

    return rows.select(*kept, "text").mapInArrow(score, schema)


def _with_best(scored):
    """Adds ``best``: where the text alone points; without letters to the last place, unknown; null if too short to tell."""
    likeliest = F.when(F.col("trigrams") > 0, F.array_position("logs", F.array_max("logs")).cast("int") - 1)
    return scored.withColumn("best", F.when(F.col("letters") == 0, F.size("logs") - 1).otherwise(likeliest))


def _counted(scored, key):
    """Per value of ``key`` its rows by best language, as a list of those that occur."""
    counts = scored.where(F.col(key).isNotNull()).groupBy(key, "best").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "n"))).alias(f"n_{key}"))


def _dense(lists, width):
    """(rows x languages) counts of lists of (best, n); a null list has none."""
    out = np.zeros((len(lists), width))
    flat = pc.list_flatten(lists)
    out[pc.list_parent_indices(lists).to_numpy(), flat.field("best").to_numpy()] = flat.field("n").to_numpy()
    return out


class Evidence:
    """What all rows together say: host, domain and overall priors, likelihoods of declared values and suffixes."""

    KEYS = ("host", "domain", "declared", "suffix")

    def __init__(self, scored, languages):
        self.names = [*languages, UNKNOWN]
        self.width = len(self.names)
        scored = cut_lineage(_with_best(scored).select("declared", "suffix", "host", "domain", "best"))
        held = {name: np.zeros(self.width) for name in ("all", "declared", "suffix")}
        for r in scored.where("best IS NOT NULL").groupBy("best").agg(F.count("*"), F.count("declared"), F.count("suffix")).collect():
            for sums, n in zip(held.values(), r[1:]):
                sums[r["best"]] = n
        self.overall = (held["all"] + 1.0) / (held["all"].sum() + self.width)
        self.rows = {key: held[key] for key in ("declared", "suffix")}
        self.values = {key: written(_counted(scored, key)) for key in self.rows}
        domains = _counted(scored, "domain").withColumnRenamed("domain", "of")
        self.hosts = written(_counted(scored, "host").withColumn("of", parent(F.col("host"))).join(domains, "of").drop("of"))

    def joined(self, rows):
        """``rows`` with the counts of their host, domain, declared value and suffix."""
        for key, table in self.values.items():
            rows = rows.join(table.withColumnRenamed(key, "value"), F.col(key) == F.col("value"), "left").drop("value")
        return rows.join(self.hosts.withColumnRenamed("host", "value"), F.col("host") == F.col("value")).drop("value")

    def judge(self):
        """A function from a batch of joined rows, log-likelihoods, trigrams and letters to language, probability, text_language, kept."""
        # without self, which holds tables that tasks can't take
        names, width, overall, totals_of = np.array(self.names, object), self.width, self.overall, self.rows

        def judged(batch, logs, trigrams_, letters):
            bare = letters == 0
            best = np.where(bare, width - 1, np.where(trigrams_ > 0, logs.argmax(axis=1), -1))
            at = np.flatnonzero(best >= 0)
            host, domain = _dense(batch.column("n_host"), width), _dense(batch.column("n_domain"), width)
            # the row itself does not count for its host
            host[at, best[at]] -= 1.0
            prior = (domain + PRIOR * overall) / (domain.sum(axis=1, keepdims=True) + PRIOR)
            prior = (host + PRIOR * prior) / (host.sum(axis=1, keepdims=True) + PRIOR)
            fused = logs + np.log(prior)
            for key, rows in totals_of.items():
                n = _dense(batch.column(f"n_{key}"), width)
                share = n.sum(axis=1, keepdims=True) / max(rows.sum(), 1.0)
                some = np.flatnonzero(share[:, 0])
                fused[some] += np.log((n[some] + VALUES * share[some]) / (rows + VALUES))
            posterior = np.exp(fused - fused.max(axis=1, keepdims=True))
            posterior /= posterior.sum(axis=1, keepdims=True)
            top, most = posterior.argmax(axis=1), posterior.max(axis=1)
            return [pa.array(names[np.where(bare, width - 1, top)], pa.string()), pa.array(most), pa.array(names[best], pa.string()),
                    pa.array(~bare & (top < width - 1) & (most >= SETTLED))]

        return judged, max(FUSED // width, 1)

    def fuse(self, scored):
        """``scored`` with the names and probability of the best language; kept: it is a known one, has letters to show for it and is settled."""
        judged, step = self.judge()
        carried = [c for c in scored.columns if c not in ("logs", "trigrams", "letters")]
        schema = StructType([*(scored.schema[c] for c in carried), *_VERDICT])

        def fused(batches):
            for whole in batches:
                for start in range(0, len(whole), step):
                    batch = whole.slice(start, step)
                    logs = batch.column("logs").flatten().to_numpy().reshape(len(batch), -1)
                    found = judged(batch, logs, *(batch.column(c).to_numpy() for c in ("trigrams", "letters")))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *found], names=schema.names)

        return self.joined(scored).mapInArrow(fused, schema)

    def keep(self, rows, models):
        """Column ``row`` of those ``rows`` (row, text and evidence) whose language is settled."""
        judged, step = self.judge()
        schema = StructType([rows.schema["row"]])

        def kept(batches):
            for whole, data, offsets in text_slices(batches, TEXT_BYTES):
                for start in range(0, len(whole), step):
                    batch, ends = whole.slice(start, step), offsets[start:start + step + 1]
                    found = judged(batch, *likelihoods([m.value for m in models], data[ends[0]:ends[-1]], ends - ends[0], batch.column("declared").to_pylist()))
                    yield pa.RecordBatch.from_arrays([batch.column("row").filter(found[-1])], names=schema.names)

        return self.joined(rows).select("row", "text", "declared", *[f"n_{key}" for key in self.KEYS]).mapInArrow(kept, schema)


_VERDICT = [StructField("language", StringType()), StructField("probability", DoubleType()), StructField("text_language", StringType()), StructField("kept", BooleanType())]


def identify(df, id_col="doc_id", text_col="text", declared=None, suffix=None, host=None, languages=None):
    """One row per row of ``df``: the id, language, probability, text_language, declared, kept.

    ``declared``, ``suffix`` and ``host`` are columns with the language that the
    markup declares, the language part of the address, and the host; each may be
    None, and a null says nothing (rows without host share one). ``text_language``
    is what the text alone points to. Every language that a row declares is
    learnt, or those of ``languages``. A row is kept if its language is one of
    those learnt and has a probability of at least ``SETTLED``. A null or empty
    text, or one without letters, is ``und`` and not kept. Ties go to the first
    language in order; rows without id and repeated rows are each answered; an
    empty table gives no rows. ``text_col`` may be a column expression. Other
    columns are not looked at.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), *[c.alias(n) for n, c in _evidence(df, text_col, declared, suffix, host).items()])
    names, models = learn(rows, languages)
    scored = cut_lineage(_scored(rows, models))
    return Evidence(scored, names).fuse(scored).select(
        F.col("id").alias(id_col), "language", "probability", "text_language", "declared", "kept")


def keep_identified(df, text_col="text", declared=None, suffix=None, host=None, languages=None):
    """The rows of ``df`` whose language is settled, all columns as they are; texts are not shuffled."""
    found = _evidence(df, text_col, declared, suffix, host)
    rows = df.select(*[c.alias(n) for n, c in found.items()])
    names, models = learn(rows, languages)
    evidence = Evidence(_scored(rows, models), names)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in found.items()])
    return evidence.keep(whole, models).select(*[F.col("row")[c].alias(c) for c in df.columns])


def page_evidence(pages, url_col="url", html_col="html"):
    """Text, declared language, address suffix and host of web pages, as columns.

    The suffix is a first part of the path with two letters, else a top-level domain with two.
    """
    html, url = F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return {
        "text_col": text, "declared": F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1),
        "suffix": F.coalesce(F.nullif(path, F.lit("")), F.nullif(top, F.lit(""))), "host": host,
    }
