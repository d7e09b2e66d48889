"""Sample datasets, each a function of a row index.

The formulas and word lists are fixed values: a preset row must equal the
published one for the same index. ``preset`` makes any number of rows;
``preset_over`` takes the index from a column of an existing table.
"""

from pyspark.sql import functions as F


def _pick(i, *words):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))


def _step(base, i, step, cycle):
    return F.round(F.lit(base) + (i.cast("double") * step) % F.lit(cycle), 2)


def _pad(number, width):
    # like a zero-padded format: wider numbers keep all their digits
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def _ecommerce(i):
    return {
        "order_id": 5000 + i,
        "customer_id": 1000 + i % 30,
        "country": _pick(i, "USA", "Canada", "UK", "Germany", "Japan"),
        "category": _pick(i, "Electronics", "Clothing", "Home", "Books", "Sports"),
        "amount": _step(15.0, i, 7.5, 450.0),
        "status": _pick(i, "Completed", "Completed", "Pending", "Cancelled"),
    }


def _iot(i):
    return {
        "device_id": F.concat(F.lit("sensor-"), _pad(i % 10 + 1, 3)),
        "temperature": _step(20.0, i, 0.3, 15.0),
        "humidity": _step(45.0, i, 0.5, 35.0),
        "battery_pct": 100 - i % 60,
        "alert": F.when(i % 7 == 0, "High Temp").otherwise("Normal"),
    }


def _ledger(i):
    return {
        "txn_id": 100000 + i,
        "account_id": F.concat(F.lit("ACC-"), (100 + i % 25).cast("string")),
        "txn_type": _pick(i, "Deposit", "Withdrawal", "Transfer", "Payment"),
        "amount": _step(10.0, i, 19.5, 2500.0),
        "currency": _pick(i, "USD", "EUR", "GBP", "JPY"),
        "status": _pick(i, "Settled", "Settled", "Pending", "Flagged"),
    }


def _healthcare(i):
    ssn = F.concat_ws("-", _pad(100 + i % 900, 3), _pad(10 + i % 90, 2), _pad(1000 + i % 9000, 4))
    return {
        "patient_id": F.concat(F.lit("PAT-"), (500 + i).cast("string")),
        "age": 20 + i % 60,
        "gender": _pick(i, "Female", "Male", "Non-Binary"),
        "condition": _pick(i, "Hypertension", "Diabetes", "Asthma", "Healthy"),
        "email": F.concat(F.lit("patient"), i.cast("string"), F.lit("@example.com")),
        "ssn": ssn,
        "visit_cost": _step(75.0, i, 12.3, 800.0),
    }


def _customers(i):
    return {
        "customer_id": 1000 + i,
        "age": 18 + i % 55,
        "country": _pick(i, "USA", "Germany", "France", "Japan", "Brazil"),
        "plan_type": _pick(i, "Basic", "Pro", "Enterprise"),
        "monthly_spend": _step(29.0, i, 3.7, 300.0),
        "churn_risk": F.when(i % 4 == 0, "High").otherwise("Low"),
    }


PRESETS = {
    "ecommerce": _ecommerce,
    "iot": _iot,
    "ledger": _ledger,
    "healthcare": _healthcare,
    "customers": _customers,
}


def preset_over(df, index, name):
    """The preset's columns for every row of ``df``, indexed by its column ``index``."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {sorted(PRESETS)}")
    columns = PRESETS[name](F.col(index).cast("long"))
    return df.select(*[column.alias(label) for label, column in columns.items()])


def preset(spark, name, rows=100):
    return preset_over(spark.range(rows), "id", name)
