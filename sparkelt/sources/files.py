"""File datasets: the format follows the extension of the path."""

import csv
import re
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import functions as F, types as T

FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "json": "json"}


def format_of(path):
    """Format named by the extension, or None for the session's default source."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return FORMATS.get(name.rsplit(".", 1)[-1]) if "." in name else None


def endpoint_options(endpoint, path_style=True):
    """Reader and writer options for an S3-compatible store at its own address."""
    return {"fs.s3a.endpoint": endpoint, "fs.s3a.path.style.access": str(path_style).lower()}


#: CSV with doubled quotes and with the blanks that a value has.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Times as text, to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_dataset(spark, path, fmt=None, schema=None, multiline=False, options=None):
    """Scan a dataset.

    Pass ``schema`` for CSV and JSON on large inputs: without it Spark reads
    the data once more to infer one. ``multiline`` reads CSV values with line
    breaks and JSON documents over several lines; one task then reads a whole file.
    """
    fmt = fmt or format_of(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if fmt in ("csv", "json"):
        reader = reader.option("multiLine", multiline)
    reader = reader.options(**(options or {}))
    return reader.load(path, format=fmt) if fmt else reader.load(path)


def write_dataset(df, path, fmt=None, mode="overwrite", partition_by=(), compression=None,
                  replace_partitions=False, multiline=False, options=None):
    """Write a dataset; ``replace_partitions`` overwrites only partitions present in ``df``.

    A CSV value with a line break fails the write unless ``multiline`` says
    that the file will be read so: other readers would cut the row in two.
    """
    fmt = fmt or format_of(path)
    if fmt == "csv" and not multiline:
        df = _on_one_line(df)
    writer = df.write.mode(mode)
    if fmt:
        writer = writer.format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV)
    if fmt in ("csv", "json"):
        writer = writer.options(**TIMES)
    writer = writer.options(**(options or {}))
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def _on_one_line(df):
    """``df`` with a check on its text columns; the check runs as the rows are written."""
    def checked(name):
        text = F.col(f"`{name}`")
        error = F.raise_error(F.lit(f"a line break in column {name!r}: write CSV with multiline=True"))
        return F.when(text.rlike("[\r\n]"), error.cast("string")).otherwise(text)

    texts = {c: checked(c) for c, kind in df.dtypes if kind == "string"}
    return df.withColumns(texts) if texts else df


def write_through(df, path, fmt=None, multiline=False, **options):
    """Write ``df`` and hand back the written table, so later steps do not recompute it."""
    write_dataset(df, path, fmt, multiline=multiline, **options)
    # the writer leaves a null blank and quotes an empty text; a stand-in for blanks keeps them apart
    apart = {"nullValue": "\0null"} if (fmt or format_of(path)) == "csv" else {}
    return read_dataset(df.sparkSession, path, fmt, schema=df.schema, multiline=multiline, options=apart)


def keep_schema(df, path):
    """Store the schema of a partitioned table beside it, hidden from its readers: an empty one has no file to show it."""
    df.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")


def read_kept(spark, path):
    """A table whose schema ``keep_schema`` has stored."""
    return spark.read.schema(spark.read.parquet(f"{path}/_schema").schema).parquet(path)


# -- landed uploads ---------------------------------------------------------

CORRUPT = "_corrupt_record"


#: Bytes of a file that are read first; twice as many each time until its first line is whole.
HEAD_BYTES = 1 << 16
#: Schemes of Hadoop's connectors, and what Arrow calls the same store.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "s3": "s3"}


def sniff_formats(spark, landing, heads_only=None):
    """One row (file, format, head) per landed file, from its first line that is not blank.

    A leading ``[`` means one JSON array document, the ending ``.json`` alone
    JSON lines (which Spark can split), anything else CSV, whose ``head`` is that
    line. A file without such a line has no row.

    Spark lists the files; tasks open each of them with Arrow and stop behind the
    first line, so the bytes read grow with the number of files, not with their
    size. A store that Arrow cannot open is scanned by Spark instead, every byte
    once. ``heads_only`` chooses the way; by default the driver tries the folder.
    """
    heads_only = _arrow_opens(landing) if heads_only is None else heads_only
    first = _read_heads(spark, landing) if heads_only else _scan_heads(spark, landing)
    kind = F.when(F.col("line").startswith("["), "json").when(
        F.col("file").endswith(".json"), "json_lines").otherwise("csv")
    return first.select("file", kind.alias("format"), "line").select(
        "file", "format", F.when(F.col("format") == "csv", F.col("line")).alias("head"))


def _arrow_opens(path):
    try:
        files, place = _arrow_place(path)
        return files.get_file_info(place).type != fs.FileType.NotFound
    except (OSError, ValueError, ImportError):
        return False


def _arrow_place(path):
    """Arrow's file system for an address, and the place of the file in it."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else path
    if scheme not in ARROW_SCHEMES:
        raise ValueError(f"Arrow has no file system for {scheme!r}")
    root, slash, place = rest.lstrip("/").partition("/")
    files, base = fs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}://{root}/")
    return files, f"{base.rstrip('/')}/{place}"


def _read_heads(spark, landing):
    # the content column is left out, so this is a listing: one row per file
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing).where("length > 0").select(
        F.col("_metadata.file_path").alias("file"), "path")
    return listed.mapInArrow(_heads_of_files, "file string, line string")


def _heads_of_files(batches):
    for batch in batches:
        lines = [_first_line(path) for path in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(lines, pa.string())], ["file", "line"]).filter(
            pc.is_valid(pa.array(lines, pa.string())))


def _first_line(path):
    """The first line of a file that is not blank; of JSON, whose lines may be long, its first character."""
    files, place = _arrow_place(path)
    with files.open_input_stream(place) as stream:
        seen, size = b"", HEAD_BYTES
        while chunk := stream.read(size):
            size *= 2
            lines = (seen + chunk).splitlines()
            # the last line may go on in the next piece, also behind a final line break of two bytes
            seen = lines.pop() if not chunk.endswith((b"\n", b"\r")) else b""
            for line in lines:
                if line.strip(b" "):
                    return _shown(line, path)
            start = seen.strip(b" ")
            if start.startswith(b"[") or start and path.endswith(".json"):
                return _shown(start, path)
        return _shown(seen, path) if seen.strip(b" ") else None


def _shown(line, path):
    text = line.strip(b" ").decode("utf-8", "replace")
    return text[0] if text.startswith("[") or path.endswith(".json") else text


def _scan_heads(spark, landing):
    """As ``_read_heads``, by a scan of all lines; only those of a file's first block can be its first."""
    lines = (
        _landed(spark, landing)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.trim("value").alias("line"),
            F.monotonically_increasing_id().alias("at"),
        )
        .where((F.col("block") == 0) & (F.col("line") != ""))
    )
    return lines.groupBy("file").agg(F.min_by("line", "at").alias("line"))


def _landed(spark, landing):
    return spark.read.option("recursiveFileLookup", True).text(landing)


def _one_form(file):
    """The address of a file written in one way, however many slashes a local one has."""
    return re.sub("^file:/+", "file:///", file)


def _one_form_column():
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")


def _header(line):
    return [name.strip() for name in next(csv.reader([line.removeprefix("\ufeff")]))]


def _reader(spark, fmt, multiline):
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        return reader.options(**CSV).option("multiLine", multiline).format("csv")
    return reader.option("multiLine", fmt == "json").format("json")


def _common_type(a, b):
    """The type that holds the values of two files; text if nothing else does."""
    order = [T.IntegerType(), T.LongType(), T.DoubleType()]
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    return order[max(order.index(a), order.index(b))] if a in order and b in order else T.StringType()


def _inferred(spark, groups, multiline):
    """A schema from the files themselves: columns in the order met, of a type that all files fit."""
    found = {}
    for fmt, _, files in groups:
        reader = _reader(spark, fmt, multiline)
        for field in reader.option("inferSchema", True).load(files).schema.fields:
            if field.name != CORRUPT:
                found[field.name] = _common_type(found.get(field.name, field.dataType), field.dataType)
    return T.StructType([T.StructField(n, k if not isinstance(k, T.NullType) else T.StringType()) for n, k in found.items()])


def ingest_landing(spark, landing, schema=None, multiline=False):
    """Ingest a folder of mixed CSV and JSON uploads against one schema.

    CSV columns are matched by the names in each file's header; a file whose
    header has other names is rejected. Without ``schema`` the files are read
    once more to infer one, and columns that a file lacks are null. ``multiline``
    reads CSV values with line breaks. Returns ``(rows, report)``. ``rows``
    carries ``source_file`` and ``format`` and leaves out every file with an
    unparseable record; ``report`` has one row per file with its status
    (``ingested``, ``rejected`` or ``empty``), row count and columns. File names
    and headers are collected to the driver, which lists the files for the scan anyway.
    """
    # the metadata column gives encoded addresses, a reader takes plain ones
    sniffed = [(_one_form(r["file"]), r["format"], r["head"]) for r in sniff_formats(spark, landing).collect()]
    filled = {file for file, _, _ in sniffed}
    sniffed += [(file, "empty", None) for file in map(_one_form, _landed(spark, landing).inputFiles()) if file not in filled]
    grouped = {}
    for file, fmt, head in sniffed:
        if fmt != "empty":
            grouped.setdefault((fmt, tuple(_header(head)) if fmt == "csv" else None), []).append(unquote(file))
    groups = [(fmt, header, files) for (fmt, header), files in sorted(grouped.items(), key=str)]
    lacking = schema is None
    if schema is None:
        schema = _inferred(spark, groups, multiline)
    names = [field.name for field in schema.fields]
    fields = {field.name: field for field in schema.fields}
    parts, refused = [], set()
    for fmt, header, files in groups:
        if fmt == "csv" and not (set(header) <= set(names) if lacking else sorted(header) == sorted(names)):
            refused |= set(files)
            continue
        own = T.StructType([fields[n] for n in header or names]).add(CORRUPT, "string")
        read = _reader(spark, fmt, multiline).schema(own).load(files)
        parts.append(read.select(
            *[F.col(f"`{n}`") if n in own.names else F.lit(None).cast(fields[n].dataType).alias(n) for n in names], CORRUPT,
            _one_form_column().alias("source_file"), F.lit(fmt).alias("format")))
    if not parts:
        empty = spark.createDataFrame([], T.StructType([*schema.fields]).add(CORRUPT, "string"))
        parts = [empty.withColumns({"source_file": F.lit(""), "format": F.lit("")})]
    everything = reduce(lambda a, b: a.unionByName(b), parts)
    # The parser checks only the columns it has to read, so the count of bad
    # records reads them all; the added remainder is always 0.
    bad = F.when(F.col(CORRUPT).isNotNull(), 1 + F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in names]), F.lit(1))).otherwise(0)
    seen = everything.groupBy("source_file").agg(F.count("*").alias("rows_seen"), F.sum(bad).alias("bad_rows"))
    listed = spark.createDataFrame(
        [(file, fmt, unquote(file) in refused) for file, fmt, _ in sniffed], "source_file string, format string, refused boolean")
    rejected = F.col("refused") | (F.coalesce("bad_rows", F.lit(0)) > 0)
    report = listed.join(seen, "source_file", "left").select(
        "source_file", "format",
        F.when(F.col("format") == "empty", "empty").when(rejected, "rejected").otherwise("ingested").alias("status"),
        F.when(rejected, 0).otherwise(F.coalesce("rows_seen", F.lit(0))).alias("row_count"),
        F.array(*[F.lit(n) for n in names]).alias("columns"),
    )
    rows = everything.join(report.where("status = 'rejected'").select("source_file"), "source_file", "left_anti")
    return rows.select(*[F.col(f"`{n}`") for n in names], "source_file", "format"), report


def parse_lines(lines, schema, fmt, column="value", header=None):
    """Parse a column of text lines; returns ``(good, bad)``, bad rows with their error text.

    ``header`` is the header line to leave out of CSV input. A null line is a bad one.
    """
    permissive = type(schema)(list(schema.fields)).add(CORRUPT, "string")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in permissive.fields)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if header is not None:
        lines = lines.where(~F.col(column).eqNullSafe(F.lit(header)))
    parse = F.from_csv if fmt == "csv" else F.from_json
    parsed = lines.withColumn("_row", parse(F.col(column), ddl, options))
    broken = F.col(column).isNull() | F.col(f"_row.{CORRUPT}").isNotNull()
    good = parsed.where(~broken).select(*[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields])
    bad = parsed.where(broken).select(
        F.col(column).alias("raw"), F.lit(f"unparseable {fmt} record").alias("error"))
    return good, bad
