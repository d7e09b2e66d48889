"""Flows, SQL over one table, user code, previews and run records."""

from pyspark.sql import functions as F

from sparkelt.operators.audit import verify
from sparkelt.operators.profile import aggregate_series
from sparkelt.plans.flow import Flow, Place
from sparkelt.plans.runlog import run_transform
from sparkelt.plans.sql import pandas_group_transform, pandas_transform, schema_report, sql_transform
from sparkelt.sources.memory import read_memory, write_memory

from .registry import money, query, scratch, table, total

# -- the flagship flow ------------------------------------------------------
# Lineitem, filtered and joined to orders on the renamed key.

SPEC = {
    "nodes": [
        {"id": "items", "type": "input", "config": {"key": "items"}},
        {"id": "orders", "type": "input", "config": {"key": "orders"}},
        {"id": "kept", "type": "filter", "config": {"condition": "l_discount >= 0.05 and l_returnflag in ['A', 'R']"}},
        {"id": "renamed", "type": "transform", "config": {
            "select_columns": ["o_orderkey", "o_orderpriority"], "rename_columns": {"o_orderkey": "l_orderkey"}}},
        {"id": "joined", "type": "join", "config": {"on": "l_orderkey", "how": "inner"}},
        {"id": "sink", "type": "output", "config": {"key": "joined.parquet"}},
    ],
    "edges": [
        {"source": "items", "target": "kept"},
        {"source": "orders", "target": "renamed"},
        {"source": "kept", "target": "joined", "target_port": "left"},
        {"source": "renamed", "target": "joined", "target_port": "right"},
        {"source": "joined", "target": "sink"},
    ],
}
PLACE = Place(tenant="tenant-a", project="checks")
KEPT = "(SELECT * FROM lineitem WHERE l_discount >= 0.05::DOUBLE AND l_returnflag IN ('A', 'R'))"


def prepare(spark, sf):
    """The flow's inputs as named tables of one tenant."""
    items = money(table(spark, sf, "lineitem"), "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag")
    write_memory(items, PLACE.tenant, "items", PLACE.project)
    write_memory(table(spark, sf, "orders"), PLACE.tenant, "orders", PLACE.project)
    return Flow(SPEC)


@query("flow_end_to_end", f"""
    SELECT o_orderpriority AS label, {total('l_extendedprice')} AS value
    FROM {KEPT} JOIN orders ON l_orderkey = o_orderkey GROUP BY label ORDER BY value DESC, label LIMIT 15""")
def end_to_end(spark, sf):
    joined = prepare(spark, sf).build(spark, PLACE)["sink"]
    return aggregate_series(joined, "o_orderpriority", "l_extendedprice", "SUM", 15)


@query("flow_ports", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM {KEPT} RIGHT JOIN orders ON l_orderkey = o_orderkey""")
def ports(spark, sf):
    """A right join with its ports given in reverse order of the edges."""
    nodes = [dict(n) for n in SPEC["nodes"]]
    nodes[4] = {"id": "joined", "type": "join", "config": {"on": ["l_orderkey"], "how": "right"}}
    edges = [SPEC["edges"][3], *SPEC["edges"][:3], SPEC["edges"][4]]
    prepare(spark, sf)
    joined = Flow({"nodes": nodes, "edges": edges}).build(spark, PLACE)["joined"]
    unmatched = F.when(F.col("l_linenumber").isNotNull(), F.col("l_orderkey"))
    return joined.select(unmatched.alias("l_orderkey"), "l_linenumber", "l_partkey", "o_orderpriority")


@query("flow_node_counts", f"""
    WITH j AS (SELECT COUNT(*) AS n FROM {KEPT} JOIN orders ON l_orderkey = o_orderkey)
    SELECT 'items' AS node_id, COUNT(*) AS rows FROM lineitem UNION ALL SELECT 'orders', COUNT(*) FROM orders
    UNION ALL SELECT 'kept', COUNT(*) FROM {KEPT} UNION ALL SELECT 'renamed', COUNT(*) FROM orders
    UNION ALL SELECT 'joined', n FROM j UNION ALL SELECT 'sink', n FROM j""")
def node_counts(spark, sf):
    return prepare(spark, sf).node_counts(spark, PLACE)


@query("flow_run", f"""
    SELECT l_orderkey, l_linenumber, o_orderpriority FROM {KEPT} JOIN orders ON l_orderkey = o_orderkey""")
def flow_run(spark, sf):
    """Files in, file out: the sink is read back from where the run wrote it."""
    place = Place(tenant="tenant-a", project="checks", base=scratch(spark, "flow"))
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag").write.parquet(
        place.path("items.parquet"))
    table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").write.parquet(place.path("orders.parquet"))
    nodes = [{**n, "config": {"key": n["id"] + ".parquet"}} if n["type"] == "input" else n for n in SPEC["nodes"]]
    outputs, _ = Flow({**SPEC, "nodes": nodes}).run(spark, place)
    return outputs["sink"].select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("flow_twin_nodes", f"""
    WITH j AS (SELECT l_orderkey, l_linenumber, l_discount, o_orderpriority FROM {KEPT} JOIN orders ON l_orderkey = o_orderkey)
    SELECT 'dear' AS sink, l_orderkey, l_linenumber, o_orderpriority FROM j WHERE l_discount >= 0.08::DOUBLE
    UNION ALL SELECT 'all', l_orderkey, l_linenumber, o_orderpriority FROM j""")
def flow_twin_nodes(spark, sf):
    """A spec that declares one join twice, with the filter before it written in two ways: the run computes it once."""
    place = Place(tenant="tenant-a", project="checks", base=scratch(spark, "flow"))
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag").write.parquet(
        place.path("items.parquet"))
    table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").write.parquet(place.path("orders.parquet"))
    nodes = [{**n, "config": {"key": n["id"] + ".parquet"}} if n["type"] == "input" else n for n in SPEC["nodes"]]
    nodes += [
        {"id": "kept2", "type": "filter", "config": {"condition": "l_returnflag in ['A', 'R'] and 0.05 <= l_discount"}},
        {"id": "joined2", "type": "join", "config": {"on": ["l_orderkey"]}},
        {"id": "dear", "type": "filter", "config": {"condition": "l_discount >= 0.08"}},
        {"id": "sink2", "type": "output", "config": {"key": "dear.parquet"}},
    ]
    edges = [*SPEC["edges"], {"source": "items", "target": "kept2"}, {"source": "kept2", "target": "joined2", "target_port": "left"},
             {"source": "renamed", "target": "joined2", "target_port": "right"}, {"source": "joined2", "target": "dear"},
             {"source": "dear", "target": "sink2"}]
    outputs, _ = Flow({"nodes": nodes, "edges": edges}).run(spark, place)
    kept = ["l_orderkey", "l_linenumber", "o_orderpriority"]
    return outputs["sink2"].select(F.lit("dear").alias("sink"), *kept).unionByName(
        outputs["sink"].select(F.lit("all").alias("sink"), *kept))


@query("flow_named_sink", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000""")
def flow_named_sink(spark, sf):
    """A flow between named tables: its output is one of them."""
    write_memory(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), PLACE.tenant, "plain", PLACE.project)
    spec = {
        "nodes": [{"id": "in", "type": "input", "config": {"key": "plain"}},
                  {"id": "big", "type": "filter", "config": {"condition": "o_totalprice > 1000"}},
                  {"id": "out", "type": "output", "config": {"key": "large"}}],
        "edges": [{"source": "in", "target": "big"}, {"source": "big", "target": "out"}],
    }
    Flow(spec).run(spark, PLACE)
    return read_memory(spark, PLACE.tenant, "large", PLACE.project)


@query("preview_node", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 100""")
def preview(spark, sf):
    """The first rows of a filter over ordered orders; the flow's sink is not written."""
    ordered = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    write_memory(ordered, PLACE.tenant, "ordered", PLACE.project)
    spec = {
        "nodes": [{"id": "in", "type": "input", "config": {"key": "ordered"}},
                  {"id": "big", "type": "filter", "config": {"condition": "o_totalprice > 400000"}},
                  {"id": "out", "type": "output", "config": {"key": "never.parquet"}}],
        "edges": [{"source": "in", "target": "big"}, {"source": "big", "target": "out"}],
    }
    return Flow(spec).preview(spark, PLACE, "big", 100, order=["o_orderkey"])


# -- SQL over the table "data" ----------------------------------------------

def sql_query(name, source, text, columns=None):
    """The same text runs in both engines; in the twin, ``data`` is the given table."""
    @query(name, f"WITH data AS (SELECT {columns or '*'} FROM {source}) SELECT * FROM ({text})")
    def run(spark, sf):
        df = table(spark, sf, source)
        return sql_transform(df.selectExpr(*columns.split(", ")) if columns else df, text)


EVENT = "event_id, user_id, event_type, value, props"
sql_query("sql_select_star", "part", "SELECT * FROM data")
sql_query("sql_project_where", "lineitem",
          "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM data WHERE l_quantity >= 8")
sql_query("sql_group_by", "events", """
    SELECT event_type, COUNT(event_id) AS total_events, CAST(ROUND(SUM(CAST(value AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_value
    FROM data GROUP BY event_type ORDER BY total_value DESC""", EVENT)
sql_query("sql_order_limit", "orders",
          "SELECT o_orderkey, o_totalprice FROM data WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
sql_query("sql_cte", "events", """
    WITH spent AS (SELECT user_id, SUM(CAST(value AS DECIMAL(18,2))) AS s FROM data WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT user_id, CAST(s AS DOUBLE) AS spent FROM spent WHERE s > 20""", EVENT)
sql_query("sql_delegated_agg", "lineitem", """
    SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size,
           COUNT(DISTINCT l_suppkey) AS suppliers, MIN(l_discount) AS lowest, COUNT(*) AS lines
    FROM data WHERE l_extendedprice < (SELECT MAX(l_extendedprice) FROM data WHERE l_returnflag = 'R')
    GROUP BY 1 HAVING COUNT(*) > 10""")
# the window runs over the types of one user, which are few whatever the number of events
sql_query("sql_delegated_window", "events", """
    WITH typed AS (SELECT user_id, event_type, COUNT(*) AS n FROM data GROUP BY user_id, event_type)
    SELECT user_id, event_type, n, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS BIGINT) AS place,
           LAG(n) OVER (PARTITION BY user_id ORDER BY event_type) AS before,
           CAST(SUM(n) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent
    FROM typed""", EVENT)
sql_query("sql_delegated_selfjoin", "conversations", """
    SELECT a.conv_id, a.turn, a.role AS asked, b.role AS answered, CAST(LENGTH(b.text) AS BIGINT) AS answer_length
    FROM data AS a JOIN data AS b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
# DISTINCT on every side: each task hands on a user once
sql_query("sql_delegated_setops", "events", """
    SELECT DISTINCT user_id FROM data WHERE event_type = 'view' AND value > 30
    INTERSECT SELECT DISTINCT user_id FROM data WHERE event_type = 'click' AND value > 30
    UNION SELECT user_id + 1000 FROM (
        SELECT DISTINCT user_id FROM data
        EXCEPT SELECT DISTINCT user_id FROM data WHERE event_type = 'error' AND value > 20)""", EVENT)
SCALAR = """
    SELECT o_orderkey, UPPER(SUBSTR(o_orderpriority, 3)) AS priority, LENGTH(o_orderstatus) AS width,
           ABS(o_totalprice - 100000) AS distance, EXTRACT(YEAR FROM o_orderdate) AS year,
           REPLACE(o_orderpriority, '-', '_') AS flat, COALESCE(NULLIF(o_orderstatus, 'P'), 'open') AS state,
           FLOOR(o_totalprice / 1000) AS thousands
    FROM data"""


@query("sql_delegated_scalar", f"""
    WITH data AS (SELECT * FROM orders) SELECT * REPLACE (CAST(year AS INTEGER) AS year, CAST(thousands AS BIGINT) AS thousands,
        CAST(width AS INTEGER) AS width) FROM ({SCALAR})""")
def scalar(spark, sf):
    return sql_transform(table(spark, sf, "orders"), SCALAR)


@query("sql_delegated_json", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_scalar(spark, sf):
    return sql_transform(table(spark, sf, "events"),
                         "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM data")


LITERALS = """
    SELECT event_id, 'a/*b*/c' AS slashes, 'a--b' AS dashes, 'update; drop' AS words /* a comment */
    FROM data WHERE event_type <> 'insert' -- the end"""
sql_query("sql_literals", "events", LITERALS + "\n", EVENT)


# -- user code --------------------------------------------------------------

@query("udf_map_in_pandas", "SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS squared FROM lineitem")
def map_in_pandas(spark, sf):
    def square(batch):
        return batch.assign(squared=batch["l_quantity"] ** 2).drop(columns="l_quantity")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return pandas_transform(items, square, "l_orderkey long, l_linenumber int, squared double")


@query("udf_apply_in_pandas", """
    WITH daily AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, day, n, n - LAG(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM daily""")
def apply_in_pandas(spark, sf):
    """pandas code per event type, over a daily mart: one row per day is all a group can hold."""
    def changes(group):
        group = group.sort_values("day")
        return group.assign(change=group["n"].diff().astype("Int64"))
    daily = table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"))
    return pandas_group_transform(daily, ["event_type"], changes, "event_type string, day string, n long, change long")


# -- reports ----------------------------------------------------------------

@query("schema_report", """
    SELECT CAST(position AS INTEGER) AS position, name, type, (SELECT COUNT(*) FROM lineitem WHERE l_quantity >= 25) AS row_count
    FROM (VALUES (0, 'l_orderkey', 'bigint'), (1, 'l_linenumber', 'int'), (2, 'l_quantity', 'double'),
                 (3, 'l_returnflag', 'string')) AS t(position, name, type)""")
def report(spark, sf):
    """Schema and size of a transform's result."""
    result = sql_transform(table(spark, sf, "lineitem"),
                           "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM data WHERE l_quantity >= 25")
    return schema_report(result)


GROUPED = "SELECT event_type, COUNT(*) AS n FROM data GROUP BY event_type"


@query("run_log", f"""
    SELECT 'sql' AS engine, 'succeeded' AS status, 'tenant-a' AS tenant_id, COUNT(DISTINCT event_type) AS row_count,
           sha256('{GROUPED}') AS code_hash, TRUE AS valid, 2 AS column_count, 'SCALED_TO_DISTRIBUTED_SPARK' AS governor_action
    FROM events
    UNION ALL SELECT 'filter', 'succeeded', 'tenant-a', COUNT(*), sha256('value > 20'), TRUE, 5, 'SCALED_TO_DISTRIBUTED_SPARK'
    FROM events WHERE value > 20
    UNION ALL SELECT 'sql', 'failed', 'tenant-a', 0, sha256('DROP TABLE data'), TRUE, 0, 'SCALED_TO_DISTRIBUTED_SPARK'""")
def run_log(spark, sf):
    """Three runs, one of which is refused; the records keep no times here."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    records = None
    for engine, code in (("sql", GROUPED), ("filter", "value > 20"), ("sql", "DROP TABLE data")):
        record = verify(run_transform(events, engine, code, tenant="tenant-a")[2])
        records = record if records is None else records.unionByName(record)
    return records.select("engine", "status", "tenant_id", F.col("row_count").cast("long").alias("row_count"), "code_hash",
                          "valid", "column_count", "governor_action")
