"""Token counts of whole texts, by an installed tokenizer."""

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .arrow import filled, flat, slices, totals

#: Bytes of one batch for the tokenizer, and the length from which a text is cut.
BATCH_BYTES, LONG_TEXT = 8 << 20, 1 << 20
#: Distinct words whose counts a worker keeps between batches.
KNOWN_WORDS = 400_000
#: What the short way and its cuts hold for; fixed values.
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Behind white space, beside a digit, behind a full-width mark before an ideograph: no token reaches over these, nor
#: does a special string. A pattern matches up to the cut.
_WORD_CUT = re.compile(rb"[\x09-\x0d\x20]|[A-Za-z0-9](?=[0-9])|[0-9](?=[A-Za-z])|(?:\xe3\x80\x82|\xef\xbc\x8c)(?=[\xe4-\xe9])")
#: A byte-level vocabulary takes a space with the word behind it, so a cut lies between a word and the space.
_BYTE_CUT = re.compile(rb"[A-Za-z0-9](?= [A-Za-z])")


def _way(described):
    """How a tokenizer may be taken apart, by its own description: ``words``, ``bytes``, or None for whole texts only."""
    normalizer, pre = described.get("normalizer") or {}, described.get("pre_tokenizer") or {}
    steps, parts = normalizer.get("normalizers", []), pre.get("pretokenizers", [])
    # added tokens are found before all else, so one that holds a cut would be lost
    added = [a["content"].encode() for a in described.get("added_tokens", [])]
    if ([s["type"] for s in steps] == WORD_NORMALIZERS and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"] == {"Regex": WORD_PATTERN} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
            and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] and described["model"]["type"] == "BPE"
            and all(a.startswith(b"<|") and not _WORD_CUT.search(a) for a in added)):
        return "words"
    if (not normalizer and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
            and not any(_BYTE_CUT.search(a) or a.startswith(b" ") for a in added)
            and not any(a["lstrip"] or a["rstrip"] for a in described.get("added_tokens", []))):
        return "bytes"
    return None


@lru_cache(maxsize=2)
def _tokenizer(path):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        return tokenizer, _way(json.load(file)), {}


def _cut(data, offsets, long_text, boundary):
    """Offsets with cuts behind matches of ``boundary`` in long texts, and the first piece of each row."""
    added = []
    for row in np.flatnonzero(np.diff(offsets) > long_text):
        at, end = int(offsets[row]), int(offsets[row + 1])
        while end - at > long_text:
            found = boundary.search(data, at + long_text, end)
            if not found or found.end() >= end:
                break
            at = found.end()
            added.append(at)
    cuts = np.sort(np.concatenate([offsets, np.array(added, np.int64)]), kind="stable") if added else offsets
    return cuts, np.searchsorted(cuts, offsets, side="left") if added else np.arange(len(offsets))


def _lengths(texts, tokenizer):
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return [len(e) for e in encode(texts, add_special_tokens=False)]


def _word_counts(texts, tokenizer, known):
    """Tokens per text: each distinct word of the batch is encoded once.

    The vocabulary never joins characters across white space, nor a letter or
    digit with sentence marks that end a word, and it ignores case; so the
    lengths of those parts add up. Texts that may hold a special string keep
    their case, as special strings have one.
    """
    marked = pc.match_substring(texts, "<|")
    plain = pc.if_else(marked, texts, pc.ascii_lower(texts))
    plain = pc.replace_substring_regex(plain, r"([A-Za-z0-9])([.,;:!?]+)(\s|$)", r"\1 \2\3")
    parts = pc.ascii_split_whitespace(plain)
    coded = parts.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    lengths = np.fromiter((known.get(w, -1) for w in distinct), np.int64, len(distinct))
    new = np.flatnonzero(lengths < 0)
    fresh = [distinct[i] for i in new]
    for at in range(0, len(fresh), 20_000):
        some = _lengths(fresh[at:at + 20_000], tokenizer)
        lengths[new[at:at + len(some)]] = some
    if len(known) + len(fresh) > KNOWN_WORDS:
        known.clear()
    known.update(zip(fresh[:KNOWN_WORDS], lengths[new[:KNOWN_WORDS]].tolist()))
    bounds = parts.offsets.to_numpy()
    return totals(lengths[coded.indices.to_numpy(zero_copy_only=False)], bounds - bounds[0])


def count_tokens(texts, path, batch_bytes=BATCH_BYTES, long_text=LONG_TEXT):
    """Tokens per text of an Arrow array, as numpy."""
    tokenizer, way, known = _tokenizer(path)
    column = filled(texts)
    data, offsets = flat(column)
    cuts, bounds = offsets, np.arange(len(offsets))
    if way:
        cuts, bounds = _cut(data, offsets, long_text, _WORD_CUT if way == "words" else _BYTE_CUT)
    counts = np.zeros(len(cuts) - 1, np.int64)
    for start, stop in slices(cuts, batch_bytes):
        part = cuts[start:stop + 1] - cuts[start]
        piece = pa.LargeStringArray.from_buffers(
            stop - start, pa.py_buffer(part.astype(np.int64)), pa.py_buffer(data[cuts[start]:cuts[stop]]))
        counts[start:stop] = _word_counts(piece, tokenizer, known) if way == "words" else _lengths(piece.to_pylist(), tokenizer)
    return totals(counts, bounds)


def token_counts(df, path, id_col="doc_id", text_col="text", limit=2048, batch_bytes=BATCH_BYTES, long_text=LONG_TEXT):
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit.

    ``path`` names the file of a tokenizer; it must be readable on every
    executor. Where the file says that words end at white space and case is
    ignored, each distinct word of a batch is encoded once; other tokenizers
    are given whole pieces. No special tokens are added; special strings inside a text count as the library takes them. A
    null text counts as empty (0 and 0); null ids and repeated rows are kept as
    they are; an empty table gives no rows; other columns are not looked at.
    Texts are encoded in batches of about ``batch_bytes``; a text over
    ``long_text`` bytes is cut where no token can reach over, or stays whole if
    the tokenizer is of a kind for which no such place is known. Nothing is shuffled.
    """
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([
        StructField(id_col, narrow.schema["id"].dataType), StructField("n_bytes", LongType()),
        StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()),
    ])

    def count(batches):
        for batch in batches:
            n_tokens = count_tokens(batch.column("text"), path, batch_bytes, long_text)
            n_bytes = np.diff(flat(filled(batch.column("text")))[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)],
                names=schema.names)

    return narrow.mapInArrow(count, schema)
