"""SQL over one table."""

import threading

from pyspark.errors import ParseException
from pyspark.sql import functions as F

from ..errors import UnsafeQueryError

VIEW = "data"
#: Functions of Spark that call into the JVM or name the files of a table.
CALLS_OUT = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
#: What a query may consist of, as the parser sees it and after analysis. All else is refused.
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "LateralJoin", "Union", "Except",
    "Intersect", "Generate", "Pivot", "Unpivot", "Expand", "Window", "Sample", "RepartitionByExpression", "Repartition", "SubqueryAlias",
    "OneRowRelation", "LocalRelation", "PipeOperator",
}
PARSED_NODES = QUERY_NODES | {
    "UnresolvedWith", "UnresolvedRelation", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "WithWindowDefinition",
}
ANALYSED_NODES = QUERY_NODES | {"WithCTE", "CTERelationDef", "CTERelationRef", "UnionLoop", "UnionLoopRef", "Range", "ResolvedHint"}
#: Expressions that lead out of the query: names made from text, variables of the session, functions that are not Spark's own.
REFUSED_EXPRESSIONS = {
    "ExpressionWithUnresolvedIdentifier", "VariableReference", "ScalaUDF", "ScalaUDAF", "ScalaAggregator", "PythonUDF", "PythonUDAF", "PythonUDTF",
    "UnresolvedPolymorphicPythonUDTF", "HiveSimpleUDF", "HiveGenericUDF", "HiveGenericUDTF", "HiveUDAFFunction", "ApplyFunctionExpression",
    "V2Aggregator", "SQLFunctionExpression", "SQLScalarFunction", "CallMethodViaReflection",
}

_naming = threading.Lock()


def _items(java_list):
    return [java_list.apply(i) for i in range(java_list.size())]


def _kind(node):
    return node.getClass().getSimpleName().rstrip("$")


_own = {}


def _own_functions(spark):
    """Names of Spark's own functions, without those that call out."""
    if spark.version not in _own:
        _own[spark.version] = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - CALLS_OUT
    return _own[spark.version]


def _refuse_call(parts, known):
    if len(parts) != 1 or parts[0].lower() not in known:
        raise UnsafeQueryError(f"the function {'.'.join(parts)} is not allowed")


def _check_expression(expression, functions_):
    kind = _kind(expression)
    if kind in REFUSED_EXPRESSIONS:
        raise UnsafeQueryError(f"{kind} is not allowed")
    if functions_ is not None and kind == "UnresolvedFunction":
        _refuse_call(_items(expression.nameParts().toIndexedSeq()), functions_)
    if functions_ is not None and kind == "UnresolvedGenerator":
        _refuse_call([expression.name().unquotedString()], functions_)
    for child in _items(expression.children().toIndexedSeq()):
        _check_expression(child, functions_)


def _check_parsed(plan, known, functions_):
    """Refuse every node that is not on the list, and every name but ``data`` and the query's own parts."""
    kind = _kind(plan)
    if kind not in PARSED_NODES:
        raise UnsafeQueryError(f"{kind} is not allowed")
    if kind == "UnresolvedWith":
        known = set(known)
        entries = _items(plan.cteRelations().toIndexedSeq())
        if plan.allowRecursion():
            known |= {entry._1().lower() for entry in entries}
        for entry in entries:
            _check_parsed(entry._2(), known, functions_)
            known.add(entry._1().lower())
    if kind == "UnresolvedRelation":
        parts = _items(plan.multipartIdentifier().toIndexedSeq())
        if len(parts) != 1 or parts[0].lower() not in known:
            raise UnsafeQueryError(f"only the table {VIEW!r} can be read, not {'.'.join(parts)!r}")
    if kind == "UnresolvedTableValuedFunction":
        _refuse_call(_items(plan.name().toIndexedSeq()), TABLE_FUNCTIONS)
    for expression in _items(plan.expressions().toIndexedSeq()):
        _check_expression(expression, functions_)
    for inner in (*_items(plan.children().toIndexedSeq()), *_items(plan.subqueries().toIndexedSeq())):
        _check_parsed(inner, known, functions_)


def _check_analysed(plan):
    """Every leaf of an analysed plan is the view ``data``, constant rows or a part of the query itself."""
    kind = _kind(plan)
    if kind == "View" and plan.isTempView() and plan.desc().identifier().unquotedString() == VIEW:
        return
    if kind not in ANALYSED_NODES:
        raise UnsafeQueryError(f"{kind} is not allowed")
    for expression in _items(plan.expressions().toIndexedSeq()):
        _check_expression(expression, None)
    for inner in (*_items(plan.children().toIndexedSeq()), *_items(plan.subqueries().toIndexedSeq())):
        _check_analysed(inner)


def check_confined(spark, query):
    """Refuse a text that is not one query over ``data`` alone, as Spark's own parser reads it; tells whether it only explains one.

    What is not on a list is refused: kinds of clauses, Spark's own functions
    by name, and names of tables. Nothing is analysed or run.
    """
    if not (query or "").strip():
        raise UnsafeQueryError("the query is empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except ParseException as error:
        raise UnsafeQueryError(f"not one SQL query: {error}") from error
    explains = _kind(plan) == "ExplainCommand"
    _check_parsed(plan.logicalPlan() if explains else plan, {VIEW}, _own_functions(spark))
    return explains


def sql_transform(df, query):
    """Run one read-only query over ``df``, which it sees as the table ``data``, and nothing else.

    The text is checked as it is parsed, and again as Spark has analysed it:
    then every leaf must be the given frame or rows of the query's own. It runs
    as it is given. Its name for the table is bound while Spark analyses it, by
    one caller at a time, and given back afterwards.
    """
    spark = df.sparkSession
    explains = check_confined(spark, query)
    with _naming:
        found = spark.catalog.getTable(VIEW) if spark.catalog.tableExists(VIEW) else None
        before = spark.table(VIEW) if found is not None and found.isTemporary else None
        df.createOrReplaceTempView(VIEW)
        try:
            result = spark.sql(query)
            if not explains:
                _check_analysed(result._jdf.queryExecution().analyzed())
            return result
        finally:
            spark.catalog.dropTempView(VIEW)
            if before is not None:
                before.createOrReplaceTempView(VIEW)


def pandas_transform(df, function, schema):
    """Row-wise pandas code, run on Arrow batches wherever the rows are."""
    return df.mapInPandas(lambda batches: map(function, batches), schema)


def pandas_group_transform(mart, keys, function, schema):
    """pandas code per group of an aggregated table; each group must fit one task."""
    return mart.groupBy(*keys).applyInPandas(function, schema)


def user_transform(df, function):
    """A user's function from DataFrame to DataFrame."""
    return df.transform(function)


def schema_report(df):
    """One row per column: position, name, type, and the row count of the table."""
    columns = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.lit(kind).alias("type"))
               for i, (name, kind) in enumerate(df.dtypes)]
    counted = df.agg(F.count("*").alias("row_count"))
    return counted.select(F.inline(F.array(*columns)), "row_count")
