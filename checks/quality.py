"""Cleaning, de-duplication, quarantine, repeated batches, versions and partitions."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkelt.operators.layout import cells_within, read_clustered, write_clustered
from sparkelt.operators.quality import (
    append_version, batch_hashes, dedup_by_hash, dedup_by_key, latest_version, new_batches, normalise_nulls,
    reprocess, split_quarantine, try_cast_schema)
from sparkelt.sources.files import parse_lines, read_dataset, write_dataset

from .registry import query, scratch, table

# Customers with texts that mean nothing and numbers that are none, by nation.
NOTE = """CASE c_nationkey WHEN 0 THEN ' N/A ' WHEN 1 THEN 'null' WHEN 2 THEN '' WHEN 3 THEN 'NaN' WHEN 4 THEN NULL
    WHEN 5 THEN 'nullable' ELSE c_name END"""
AMOUNT = """CASE c_nationkey WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN '-17' WHEN 3 THEN NULL WHEN 4 THEN '1e3x'
    ELSE concat(c_custkey) END"""


@query("silver_null_normalise", f"""
    SELECT c_custkey, CASE WHEN lower(trim(note)) IN ('', 'null', 'n/a', 'nan') THEN NULL ELSE note END AS note, c_mktsegment
    FROM (SELECT c_custkey, {NOTE} AS note, c_mktsegment FROM customer)""")
def null_normalise(spark, sf):
    return normalise_nulls(table(spark, sf, "customer").selectExpr("c_custkey", f"{NOTE} AS note", "c_mktsegment"))


@query("silver_try_cast", f"""
    SELECT TRY_CAST(c_custkey AS INTEGER) AS c_custkey, TRY_CAST(amount AS BIGINT) AS amount,
           TRY_CAST(amount AS DOUBLE) AS ratio
    FROM (SELECT c_custkey, {AMOUNT} AS amount FROM customer)""")
def try_cast(spark, sf):
    raw = table(spark, sf, "customer").selectExpr("c_custkey", f"{AMOUNT} AS amount", f"{AMOUNT} AS ratio", "c_name")
    return try_cast_schema(raw, StructType.fromDDL("c_custkey int, amount long, ratio double"))


ITEM = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query("dedup_composite_key", f"""
    SELECT {ITEM} FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ITEM}) AS place FROM lineitem)
    WHERE place = 1""")
def composite_key(spark, sf):
    items = table(spark, sf, "lineitem").select(*ITEM.split(", "))
    return dedup_by_key(items, ["l_orderkey", "l_linenumber"], order=["l_partkey", "l_suppkey"])


@query("dedup_record_hash", """
    SELECT MIN(doc_id) AS doc_id, text, COUNT(*) > 0 AS kept FROM documents GROUP BY text""")
def record_hash(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_by_hash(documents, ["text"], order=["doc_id"]).withColumn("kept", F.lit(True))


@query("dedup_record_hash_zero", """
    SELECT MIN(l_orderkey * 8 + l_linenumber) AS line, l_returnflag, l_discount * 0.0 AS signed_zero, l_discount AS discount
    FROM lineitem GROUP BY l_returnflag, l_discount""")
def record_hash_zero(spark, sf):
    """Zeros of both signs are one value, in plain columns, lists and structs."""
    items = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS line", "l_returnflag", "CASE WHEN l_linenumber % 2 = 0 THEN -0.0D ELSE 0.0D END AS signed_zero", "l_discount AS discount")
    nested = items.selectExpr("*", "array(signed_zero, discount) AS listed", "named_struct('z', CAST(signed_zero AS FLOAT)) AS held")
    kept = dedup_by_hash(nested, ["l_returnflag", "signed_zero", "listed", "held"], order=["line"])
    return kept.selectExpr("line", "l_returnflag", "signed_zero + 0.0D AS signed_zero", "discount")


@query("dedup_record_hash_time", """
    SELECT MIN(event_id) AS event_id, event_type, epoch_us(moment) AS moment FROM (
        SELECT event_id, event_type, date_trunc('hour', ts) + to_microseconds(event_id % 3) AS moment FROM events)
    GROUP BY event_type, moment""")
def record_hash_time(spark, sf):
    """Events by the hour, told apart by microseconds alone, in plain and in nested columns."""
    at = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    moved = F.timestamp_micros(F.unix_micros(at) + F.col("event_id") % 3)
    events = table(spark, sf, "events").select("event_id", "event_type", F.struct(F.array(moved).alias("times")).alias("nested"))
    kept = dedup_by_hash(events, ["event_type", "nested"], order=["event_id"])
    return kept.select("event_id", "event_type", F.unix_micros(F.col("nested.times")[0]).alias("moment"))


# -- quarantine -------------------------------------------------------------

def rules():
    return {
        "negative_balance": F.col("c_acctbal") >= 0,
        "no_segment": F.col("segment").isNotNull(),
        "foreign_key": F.col("c_nationkey").between(0, 19),
    }


def marked(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_nationkey", "c_acctbal", "nullif(c_mktsegment, 'MACHINERY') AS segment")


MARKED = "(SELECT c_custkey, c_nationkey, c_acctbal, nullif(c_mktsegment, 'MACHINERY') AS segment FROM customer)"
IS_GOOD = "c_acctbal >= 0 AND segment IS NOT NULL AND c_nationkey BETWEEN 0 AND 19"


@query("quarantine_good", f"SELECT * FROM {MARKED} WHERE {IS_GOOD}")
def good(spark, sf):
    return split_quarantine(marked(spark, sf), rules())[0]


@query("quarantine_bad", f"""
    SELECT *, concat_ws(',', CASE WHEN NOT c_acctbal >= 0 THEN 'negative_balance' END,
        CASE WHEN segment IS NULL THEN 'no_segment' END,
        CASE WHEN NOT c_nationkey BETWEEN 0 AND 19 THEN 'foreign_key' END) AS errors
    FROM {MARKED} WHERE NOT ({IS_GOOD})""")
def bad(spark, sf):
    return split_quarantine(marked(spark, sf), rules())[1].withColumn("errors", F.array_join("errors", ","))


@query("quarantine_reprocess", f"""
    SELECT c_custkey, c_nationkey, GREATEST(c_acctbal, 0) AS c_acctbal, COALESCE(segment, 'UNKNOWN') AS segment
    FROM {MARKED} WHERE c_nationkey BETWEEN 0 AND 19""")
def reprocessed(spark, sf):
    """Rows that were good, and those that a repair of balance and segment makes good."""
    def repair(df):
        return df.withColumns({"c_acctbal": F.greatest("c_acctbal", F.lit(0.0)),
                               "segment": F.coalesce("segment", F.lit("UNKNOWN"))})
    fine, broken = split_quarantine(marked(spark, sf), rules())
    return fine.unionByName(reprocess(broken, repair, rules())[0])


BROKEN_PROPS = "CASE event_type WHEN 'error' THEN substr(props, 1, 5) ELSE props END"


def parsed(spark, sf):
    lines = table(spark, sf, "events").selectExpr(f"{BROKEN_PROPS} AS value")
    return parse_lines(lines, StructType.fromDDL("k long"), "json")


@query("quarantine_parse_good", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def parsed_good(spark, sf):
    return parsed(spark, sf)[0]


@query("quarantine_parse_bad", """
    SELECT substr(props, 1, 5) AS raw, 'unparseable json record' AS error FROM events WHERE event_type = 'error'""")
def parsed_bad(spark, sf):
    return parsed(spark, sf)[1]


# -- batches, versions, partitions ------------------------------------------

@query("ingest_dedup_anti", """
    WITH content AS (SELECT conv_id, string_agg(turn || '|' || role || '|' || text, '~' ORDER BY turn, role, text) AS c,
                            MAX(turn) AS last FROM conversations GROUP BY conv_id),
    fresh AS (SELECT MIN(conv_id) AS conv_id FROM content WHERE c NOT IN (SELECT c FROM content WHERE last < 3) GROUP BY c)
    SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM fresh)""")
def dedup_anti(spark, sf):
    """Conversations as batches; those of at most three turns were ingested before."""
    incoming = table(spark, sf, "conversations")
    short = incoming.groupBy("conv_id").agg(F.max("turn").alias("last")).where("last < 3").select("conv_id")
    ledger = batch_hashes(incoming, "conv_id").join(short, "conv_id", "left_semi")
    return new_batches(incoming, ledger, "conv_id")[0].select("conv_id", "turn", "role")


@query("bronze_latest_version", "SELECT conv_id, turn, role, text, 2::BIGINT AS version FROM conversations")
def latest(spark, sf):
    path = scratch(spark, "versions")
    talks = table(spark, sf, "conversations")
    append_version(talks.where("role = 'user'"), path, 1)
    append_version(talks, path, 2)
    return latest_version(spark, path).withColumn("version", F.col("version").cast("long"))


@query("partition_overwrite", """
    SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM customer""")
def overwrite(spark, sf):
    path = scratch(spark, "partitions") + "/customer.parquet"
    buyers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    write_dataset(buyers, path, partition_by=["c_mktsegment"])
    changed = buyers.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(0.0))
    write_dataset(changed, path, partition_by=["c_mktsegment"], replace_partitions=True)
    return read_dataset(spark, path)


@query("partition_pruned_scan", """
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000""")
def pruned(spark, sf):
    path = scratch(spark, "pruned") + "/orders.parquet"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    write_dataset(orders, path, partition_by=["o_orderpriority"], compression="zstd")
    return read_dataset(spark, path).where("o_orderpriority = '1-URGENT' AND o_totalprice > 1000")


WITHIN = {"date": {"o_orderdate": ("1995-01-01", "1995-03-31")}, "price": {"o_totalprice": (100000.0, 120000.0)}}


@query("partition_clustered_scan", """
    SELECT 'date' AS filter, TRUE AS under_a_third, o_orderkey, o_totalprice FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN '1995-01-01' AND '1995-03-31'
    UNION ALL SELECT 'price', TRUE, o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000""")
def clustered(spark, sf):
    """Orders along a curve over date and price; a filter on either reads less than a third of the cells."""
    path = scratch(spark, "clustered") + "/orders.parquet"
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    write_clustered(orders, path, ["o_orderdate", "o_totalprice"], cells=64)
    parts = []
    for name, ranges in WITHIN.items():
        cells, total = cells_within(spark, path, ranges)
        parts.append(read_clustered(spark, path, ranges).select(
            F.lit(name).alias("filter"), F.lit(3 * len(cells) < total).alias("under_a_third"), "o_orderkey", "o_totalprice"))
    return parts[0].unionByName(parts[1])
