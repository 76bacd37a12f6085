from __future__ import annotations

import pytest

from postlode.operators.units import FACTORS, detect_units, to_annual

SCHEMA = "job_id string, title string, description string, salary_min double, salary_max double, salary_period string, alias string, value double, unit string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.0, "y") for r in rows], SCHEMA)
    return {r["job_id"]: r["unit"] for r in detect_units(df).collect()}


@pytest.mark.parametrize(
    ("lo", "hi", "period", "title", "text", "unit"),
    [
        (30000.0, 40000.0, "annual", "Engineer", "Salary £30,000 to £40,000 per annum.", "annual"),
        (18.25, 20.0, "unknown", "Engineer", "Hourly rate £18.25 to £20.00.", "hourly"),
        (39.0, 48.25, None, "Engineer", "Rate of £48.25 an hour, paid weekly.", "hourly"),
        (200.0, 265.0, "annual", "Engineer", "£200 to £265 per day outside IR35.", "daily"),
        (1080.0, 1380.0, None, "Engineer", "Weekly wage of £1,080 to £1,380.", "weekly"),
        (3250.0, 4100.0, "annual", "Engineer", "£3,250 per month.", "monthly"),
        (52.0, 62.0, None, "Engineer", "Salary £52k to £62k.", "thousands"),
        (19.0, 24.0, None, "Coach", "Pays £19,000 a year.", "thousands"),
        (6200000.0, 7550000.0, None, "Engineer", "Pay: £62k-£75k.", "pence"),
        (57.0, 75.0, "annual", "Developer", "No figures here.", "thousands"),
        (28.0, None, "hourly", "Engineer", "You get a £25 a day on-call supplement.", "hourly"),
        (180.0, 205.0, "daily", "Engineer", None, "daily"),
        (45000.0, None, "daily", "Engineer", "", "annual"),
        (None, 475.0, None, "Engineer £475pd", "", "daily"),
    ],
)
def test_cases(spark, lo, hi, period, title, text, unit):
    assert run(spark, [("a", title, text, lo, hi, period)]) == {"a": unit}


def test_edges(spark):
    rows = [
        ("none", "t", "d", None, None, "annual"),
        ("zero", "t", "d", 0.0, 0.0, "annual"),
        ("nulls", None, None, 50000.0, None, None),
        ("long", "t", "word " * 50000 + " £300 per day", 300.0, None, "annual"),
        ("twice", "t", "d", 40000.0, None, "annual"),
        ("twice", "t", "d", 40000.0, None, "annual"),
        (None, "t", "d", 40000.0, None, "annual"),
    ]
    got = run(spark, rows)
    assert "none" not in got and "zero" not in got
    assert got["nulls"] == "annual" and got["long"] == "daily" and got["twice"] == "annual"


def test_empty_and_factors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert to_annual(detect_units(df)).collect() == []
    one = spark.createDataFrame([("a", "Engineer 300pd", "", 300.0, None, None, "", 0.0, "")], SCHEMA)
    assert to_annual(detect_units(one)).first()["annual_min"] == 300.0 * FACTORS["daily"]
