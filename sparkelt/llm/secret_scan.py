"""Secrets in texts: three fixed forms, and strings whose characters look random."""

import re
from math import log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .arrow import filled

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: The same forms for a fast test of whole texts; they may let more through.
_MAY_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_MAY_RANDOM = r"[A-Za-z0-9+/_=-]{20}"

BASE_KINDS = ("assign", "access", "hex")
#: Per character class: kind, characters, window, bits per character from which a window looks random.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]+"), 24, 3.0),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.8),
)
KINDS = (*BASE_KINDS, *(c[0] for c in CLASSES))
#: Candidates, and runs of one class in them, that match one of these as a whole are no secrets. They run in linear time.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9+/_=-]+",  # numbers, dates, rules
    r"[A-Za-z+/_=-]+",  # words
    r"[A-Z]?[a-z]+(?:[/_-](?:[A-Za-z][a-z]*)?[0-9]{0,4})*",  # names and paths; each part can be read in one way only
    r"AKIA[A-Z0-9]*EXAMPLE",  # placeholder of the published documentation
)


def entropy_spans(text, window, bits):
    """Ranges covered by windows of ``window`` characters with at least ``bits`` of Shannon entropy.

    The sum of n log n over the counts is kept up to date as one character
    leaves the window and one enters, so the scan is linear.
    """
    part = [0.0] + [n * log2(n) for n in range(1, window + 1)]
    most = window * (log2(window) - bits) + 1e-9
    counts, total, spans = {}, 0.0, []
    for end, char in enumerate(text, 1):
        n = counts.get(char, 0)
        total += part[n + 1] - part[n]
        counts[char] = n + 1
        if end > window:
            gone = text[end - window - 1]
            n = counts[gone]
            total += part[n - 1] - part[n]
            counts[gone] = n - 1
        if end >= window and total <= most:
            if spans and spans[-1][1] >= end - window:
                spans[-1][1] = end
            else:
                spans.append([end - window, end])
    return spans


def find_secrets(text, allowed, classes=CLASSES, assign=True, access=True, random=True):
    """(start, kind number, end) of everything found in one text, in order."""
    found = []
    if assign:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if random:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        for m in _CANDIDATE.finditer(text):
            if allowed and allowed.fullmatch(m[0]):
                continue
            for k, (_, characters, window, bits) in enumerate(classes, len(BASE_KINDS)):
                for run in characters.finditer(m[0]):
                    if len(run[0]) >= window and not (allowed and allowed.fullmatch(run[0])):
                        at = m.start() + run.start()
                        found += [(at + a, k, at + b) for a, b in entropy_spans(run[0], window, bits)]
                # a string of one class alone is not held against wider ones
                if characters.fullmatch(m[0]):
                    break
    return sorted(found)


def scan_secrets(df, id_col="doc_id", text_col="text", allowed=ALLOWED, classes=CLASSES):
    """One row per row of ``df``: the id and ``secrets``, an array of (kind, start, end).

    Places are code points, end exclusive, ordered by start and kind. Kinds
    ``assign``, ``access`` and ``hex`` are fixed forms; further kinds are windows
    of high entropy in every run of a character class of ``classes``, unless the
    run or the whole string around it matches a pattern of ``allowed``. Patterns
    of a caller run in Python's ``re``, so a part of a string must not be readable
    in two ways: ``(a*b?)*`` takes exponential time. A null or empty text has none.
    Null ids and repeated rows stay; other columns are not looked at. Whole texts
    are read, one at a time; nothing is shuffled.
    """
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    entry = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([StructField(id_col, narrow.schema["id"].dataType), StructField("secrets", ArrayType(entry))])
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    pattern = "|".join(f"(?:{a})" for a in allowed)
    kinds = (*BASE_KINDS, *(c[0] for c in classes))

    def scan(batches):
        suppressed = re.compile(pattern) if pattern else None
        for batch in batches:
            texts = filled(batch.column("text"))
            flags = [pc.match_substring_regex(texts, _MAY_ASSIGN), pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, _MAY_RANDOM)]
            found = [[] for _ in range(len(texts))]
            some = pc.or_(pc.or_(flags[0], flags[1]), flags[2])
            for i in pc.indices_nonzero(some).to_pylist():
                got = find_secrets(texts[i].as_py(), suppressed, classes, *(f[i].as_py() for f in flags))
                found[i] = [{"kind": kinds[k], "start": a, "end": b} for a, k, b in got]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind_type)], names=schema.names)

    return narrow.mapInArrow(scan, schema)


def secret_report(found, id_col="doc_id"):
    """Counts per fixed kind, a digest of their places, and all places as text."""
    def text(entries):
        return F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(*kinds):
        return F.filter("secrets", lambda x: x["kind"].isin(*kinds))

    base = of(*BASE_KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(f"`{id_col}`", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
