"""Chat transcripts as marked text with a loss mask, assembled column by column.

A turn becomes ``<s>[INST]role[/INST]text</s>``. Inside roles and texts every
control string gets a backslash after its first character, one more than it may
have already, so that no text can forge a turn and every text can be read back.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .arrow import filled, flat, spread

OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = re.compile(rb"([<\[])\\(\\*/?(?:s>|INST\]))")
_TURN = re.compile(re.escape(OPEN) + rb"(.*?)" + re.escape(MIDDLE) + rb"(.*?)" + re.escape(CLOSE), re.S)
#: Turns of one conversation that are formatted together, and bytes after which a row ends.
BLOCK_TURNS, PART_BYTES = 4096, 16 << 20


def escape(column):
    """Control strings of a text column made harmless."""
    return pc.replace_substring_regex(column, _CONTROL, r"\1\\\2")


def unescape(text):
    """The bytes that ``escape`` was given."""
    return _ESCAPED.sub(rb"\1\2", text)


def read_turns(formatted):
    """(role, text) of each turn, as bytes, in order."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def assemble(roles, texts):
    """Formatted bytes of all turns in one buffer, turn ends, and where texts start and how long they are.

    All segment lengths are known first; their running sum says where each
    byte goes, and every column is copied by one scatter.
    """
    role_data, role_ends = flat(escape(filled(roles)))
    text_data, text_ends = flat(escape(filled(texts)))
    n = len(role_ends) - 1
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(OPEN), len(MIDDLE), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = np.diff(role_ends), np.diff(text_ends)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[begins[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, data, bounds in ((1, role_data, role_ends), (3, text_data, text_ends)):
        out[spread(begins[:, k], lengths[:, k])] = data[bounds[0]:bounds[-1]]
    return out, ends[:, 4], begins[:, 3], lengths[:, 3]


def _rows(table, firsts, part):
    """One output row per group of turns; ``firsts``: the first turn of each group."""
    out, ends, starts, lengths = assemble(table.column("role"), table.column("text"))
    firsts = np.asarray(firsts, np.int64)
    after = np.append(firsts[1:], len(ends))
    byte_ends = np.concatenate([[0], ends[after - 1]])
    learned = np.asarray(pc.fill_null(pc.equal(table.column("role"), "assistant"), False).combine_chunks().to_numpy(zero_copy_only=False), bool)
    chosen = np.flatnonzero(learned)
    group = np.searchsorted(firsts, chosen, side="right") - 1
    list_ends = pa.array(np.searchsorted(chosen, np.append(firsts, len(ends))), pa.int32())
    text = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(byte_ends.astype(np.int32)), pa.py_buffer(out))
    return [
        table.column("conv_id").take(pa.array(firsts)).combine_chunks(), table.column("block").take(pa.array(firsts)).combine_chunks(),
        pa.array(np.full(len(firsts), part, np.int32)), pa.array(after - firsts, pa.int64()), text,
        pa.ListArray.from_arrays(list_ends, pa.array(starts[chosen] - byte_ends[group], pa.int64())),
        pa.ListArray.from_arrays(list_ends, pa.array(lengths[chosen], pa.int64())),
    ]


def format_conversations(df, block_turns=BLOCK_TURNS, part_bytes=PART_BYTES):
    """Conversations (conv_id, turn, role, text) as formatted text with a loss mask.

    Returns conv_id, block, part, n_turns, formatted, loss_start, loss_len: one
    row per conversation, or per block of ``block_turns`` turn numbers where it
    is longer, so that a hot conversation is spread over tasks; a block beyond
    ``part_bytes`` is written in parts. Rows in the order of block and part,
    joined, are the conversation. The mask gives bytes of ``formatted``: the
    text of every assistant turn, escaped.

    Turns are ordered by turn, role, text, so repeated turns stay and have a
    defined place. A null role or text counts as empty, a null turn comes
    first, rows without conv_id form one conversation. Other columns are not
    looked at. An empty table gives no rows.
    """
    turns = df.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.floor(F.col("turn") / block_turns).cast("long").alias("block"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = StructType([
        StructField("conv_id", df.schema["conv_id"].dataType), StructField("block", LongType()), StructField("part", IntegerType()),
        StructField("n_turns", LongType()), StructField("formatted", StringType()),
        StructField("loss_start", ArrayType(LongType())), StructField("loss_len", ArrayType(LongType())),
    ])

    def build(batches):
        held, key, part = None, None, 0

        def made(table, firsts):
            return pa.RecordBatch.from_arrays(_rows(table, firsts, part), names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist()))
            firsts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
            table = pa.Table.from_batches([batch])
            if held is not None and keys[0] == key:
                stop = firsts[1] if len(firsts) > 1 else len(keys)
                held, table = pa.concat_tables([held, table.slice(0, stop)]), table.slice(stop)
                firsts = [i - stop for i in firsts[1:]]
            if firsts:
                if held is not None:
                    yield made(held, [0])
                part = 0
                if len(firsts) > 1:
                    yield made(table.slice(0, firsts[-1]), firsts[:-1])
                held, key = table.slice(firsts[-1]), keys[-1]
            if held.get_total_buffer_size() > part_bytes and held.num_rows > 1 and held.nbytes > part_bytes:
                yield made(held, [0])
                held, part = held.slice(0, 0), part + 1
        if held is not None and held.num_rows:
            yield made(held, [0])

    return (turns.repartition("conv_id", "block")
            .sortWithinPartitions("conv_id", "block", "turn", "role", "text").mapInArrow(build, schema))


def conversation_digests(formatted):
    """What the formatted rows say, read back: one row per conversation.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn),
    loss_chars and loss_sha256 (all text under the mask, unescaped, in order),
    formatted_chars. A digest over a whole conversation is one chain, so its
    rows pass one task in order; the task holds one row at a time.
    """
    schema = StructType([
        StructField("conv_id", formatted.schema["conv_id"].dataType), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
        StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType()),
    ])

    def digest(batches):
        key, state = None, None
        done = []

        def closed():
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_len")]
            for conv, text, starts, sizes in zip(*columns):
                if state is None or conv != key:
                    if state is not None:
                        closed()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = text.encode()
                for role, body in read_turns(raw):
                    state[0] += 1
                    state[1].update(role + b"\n" + body + b"\n")
                for start, size in zip(starts, sizes):
                    body = unescape(raw[start:start + size])
                    state[2] += len(body.decode())
                    state[3].update(body)
                state[4] += len(text)
            yield _batch(done, schema)
            done = []
        if state is not None:
            closed()
            yield _batch(done, schema)

    ordered = formatted.select("conv_id", "block", "part", "formatted", "loss_start", "loss_len")
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(digest, schema)


def _batch(rows, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=to_arrow_schema(schema))
