import math

import pytest
from pyspark.sql import functions as F

from thermogrid.functions import (
    clamp_to, cyclic_calendar, day_of_common_year, diurnal_profile, future_hours, hour_of_year, in_range,
    is_plain_number, label_of_hour_of_year, parse_celsius, parse_encoded, parse_timestamp, wind_components,
)

FORMS = [
    # text, lenient, strict
    ("+0050,1", 5.0, 5.0), ("-0061,1", -6.1, -6.1), ("9999,9", None, None), ("+9999,1", None, None), ("-9999,1", None, None),
    ("0999,1", None, 99.9), ("-0999,1", None, -99.9), ("+0123", 12.3, None), ("+0123,1,extra", 12.3, None),
    ("  +0123,1 ", 12.3, 12.3), ("14.2,1", None, None), ("14.2", None, None), ("", None, None), (None, None, None),
    ("+0123,3", None, None), ("+0123,7", None, None), ("+0123,9", None, None), ("+0123,4", 12.3, 12.3), ("abc,1", None, None),
    ("+0123,9,1", 12.3, None), (",1", None, None),
]


def evaluate(spark, exprs, rows, schema):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


@pytest.mark.parametrize("strict, place", [(False, 1), (True, 2)])
def test_encoded_text(spark, strict, place):
    got = evaluate(spark, [parse_encoded(F.col("v"), strict)], [(f[0],) for f in FORMS], "v string")
    for form, (value,) in zip(FORMS, got):
        assert value == (None if form[place] is None else pytest.approx(form[place])), form


def test_plain_degrees(spark):
    rows = [("14.2",), ("9999",), ("-9999.0",), ("999.9",), ("-999.9",), ("NaN",), ("x",), ("999",)]
    got = [v for (v,) in evaluate(spark, [parse_celsius(F.col("v"))], rows, "v string")]
    assert got == [14.2, None, None, None, None, None, None, 999.0]
    assert evaluate(spark, [is_plain_number(F.col("v"))], [("14.2",), ("-3",), ("+0050,1",), ("x",)], "v string") == [
        (True,), (True,), (False,), (False,)]


def test_range_keeps_bounds_and_clamp_needs_both(spark):
    rows = [(1.0, 5.0), (10.0, None), (None, 2.0), (10.1, 3.0), (0.9, 0.0), (4.0, 4.0)]
    got = evaluate(spark, [in_range(F.col("t"), 1.0, 10.0), clamp_to(F.col("d"), F.col("t"))], rows, "t double, d double")
    assert got == [(1.0, 1.0), (10.0, None), (None, 2.0), (None, 3.0), (None, 0.0), (4.0, 4.0)]


def test_timestamps(spark):
    rows = [("2024-02-29 13:45:00",), ("2024-02-29T13:45:00",), ("29/02/2024 13:45",), ("never",), ("2023-02-29",)]
    got = evaluate(spark, [parse_timestamp(F.col("v"), ["dd/MM/yyyy HH:mm"]).cast("string")], rows, "v string")
    assert [v for (v,) in got] == ["2024-02-29 13:45:00"] * 3 + [None, None]


def test_calendar(spark):
    rows = [("2024-03-01 05:00:00",), ("2023-03-01 05:00:00",), ("2024-02-29 05:00:00",), ("2024-12-31 23:00:00",), ("2023-01-01 00:00:00",)]
    ts = F.col("v").cast("timestamp")
    got = evaluate(spark, [day_of_common_year(ts), hour_of_year(ts)], rows, "v string")
    assert got == [(59, 59 * 24 + 5), (59, 59 * 24 + 5), (None, None), (364, 8759), (0, 0)]
    parts = cyclic_calendar(ts)
    (sin_hour, cos_doy), = evaluate(spark, [parts["sin_hour"], parts["cos_doy"]], rows[:1], "v string")
    assert sin_hour == pytest.approx(math.sin(2 * math.pi * 5 / 24))
    assert cos_doy == pytest.approx(math.cos(2 * math.pi * 61 / 365.25))
    assert evaluate(spark, [label_of_hour_of_year(F.col("h"))], [(0,), (8759,)], "h int") == [("Jan 01 00:00",), ("Dec 31 23:00",)]
    (stamps,), = evaluate(spark, [future_hours(ts).cast("array<string>")], rows[3:4], "v string")
    assert len(stamps) == 24 and stamps[0] == "2025-01-01 00:00:00" and stamps[-1] == "2025-01-01 23:00:00"


def test_wind_and_diurnal(spark):
    x, y = wind_components(F.col("d"))
    (a, b), = evaluate(spark, [x, y], [(90.0,)], "d double")
    assert a == pytest.approx(0.0, abs=1e-12) and b == pytest.approx(1.0)
    (day,), = evaluate(spark, [diurnal_profile(F.lit(15.0), F.lit(8.0))], [(1.0,)], "d double")
    assert day == pytest.approx([15 + 4.5 * math.sin((h - 9) * math.pi / 12) - 1.05 for h in range(1, 25)], abs=0.0501)


def test_figures_of_a_day_are_worked_out_before_its_hours(spark):
    from catalog.queries import REGISTRY

    plan = REGISTRY["diurnal"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("array_max(") and "transform(" not in plan
