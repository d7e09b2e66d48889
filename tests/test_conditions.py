import pytest

from conftest import plan, rows
from sparkelt.errors import ConditionError
from sparkelt.operators.conditions import condition_column, condition_columns, safe_filter


@pytest.fixture
def staff(spark):
    return spark.createDataFrame(
        [(20, "intern", True), (25, "engineer", True), (30, "manager", False), (35, "director", True)],
        "age long, role string, active boolean")


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame([(1, True), (5, False), (None, None)], "x long, flag boolean")


@pytest.mark.parametrize("text, ages", [
    ("age >= 25 and role == 'engineer' and active == True", [25]),
    ("active", [20, 25, 35]),
    ("not active", [30]),
    ("20 < age <= 30", [25, 30]),
    ("20 < age < 30 or role == 'director'", [25, 35]),
    ("age in [20, 35]", [20, 35]),
    ("age not in (20, 35)", [25, 30]),
    ("role in []", []),
    ("not True", []),
    ("True", [20, 25, 30, 35]),
    ("age > -1 and age < +21", [20]),
    ("'engineer' == role", [25]),
])
def test_conditions(staff, text, ages):
    assert [r[0] for r in rows(safe_filter(staff, text))] == ages


@pytest.mark.parametrize("text, values", [
    ("x != 5", [1]), ("x not in [5]", [1]), ("x == None", [None]), ("x != None", [1, 5]),
    ("None == x", [None]), ("flag", [1]), ("not flag", [5]), ("not (x == 1)", [5]),
])
def test_nulls_follow_sql(gaps, text, values):
    assert [r[0] for r in rows(safe_filter(gaps, text))] == values


@pytest.mark.parametrize("text", [
    "__import__('os').system('ls')", "getattr(x, 'y')", "lambda: 1", "open('f')", "math.sqrt(x) > 10", "frame.iloc[0]",
    "missing == 1", "", "  ", "x ==", "x + 1 > 2", "x if flag else 1", "x is None", "x in flag", "x in [flag]", "x == b'1'",
    "x in {1, 2}", "[x for x in flag]", "x == -'a'", "x == ~1", "f'{x}' == '1'", "x := 1", "-x > 1",
])
def test_refused(gaps, text):
    with pytest.raises(ConditionError):
        safe_filter(gaps, text)


def test_columns_read():
    assert condition_columns("a > 1 and (b == 'x' or not c)") == {"a", "b", "c"}


def test_no_columns_given_means_no_name_check(spark, staff):
    assert staff.where(condition_column("age > 30")).count() == 1


def test_empty_table(spark):
    assert safe_filter(spark.createDataFrame([], "x long"), "x > 1").count() == 0


def test_predicate_reaches_the_scan(tables):
    text = plan(safe_filter(tables["lineitem"], "l_quantity >= 10 and l_returnflag in ['A', 'R']").select("l_orderkey"))
    pushed = text.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(l_quantity,10.0)" in pushed and "In(l_returnflag, [A,R])" in pushed
    assert "l_extendedprice" not in text
