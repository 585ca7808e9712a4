from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernbrand.functions import instants
from fernbrand.operators import times

EDMONTON = "America/Edmonton"


def resolve(spark, rows, clock=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, d string, h string, source string, zone string, clock string")
    out = times.resolve_times(df, "d", "h", "source", "zone", "clock").orderBy("id").collect()
    return [(r["utc_second"], r["time_status"]) for r in out]


def utc(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


FORMS = [
    (("2024-03-05", "09:05"), utc(2024, 3, 5, 16, 5)), (("20240305", "0905"), utc(2024, 3, 5, 16, 5)), (("2024-065", "0905"), utc(2024, 3, 5, 16, 5)),
    (("5 Mar 2024", "09"), utc(2024, 3, 5, 16)), (("05-Mar-2024", "09:05 CST"), utc(2024, 3, 5, 15, 5)), (("Mar 05, 2024 9:05 PM", None), utc(2024, 3, 6, 4, 5)),
    (("Tue, 05 Mar 2024 09:05:07 GMT", None), utc(2024, 3, 5, 9, 5, 7)), (("2024-03-05T09:05:07-03:30", None), utc(2024, 3, 5, 12, 35, 7)),
    (("2024-03-05T09:05:07-07:00[America/Vancouver]", None), utc(2024, 3, 5, 16, 5, 7)), (("2024-03-05 09:05:07.999 -0700", None), utc(2024, 3, 5, 16, 5, 7)),
    (("1709629507", None), 1709629507), (("1709629507123", None), 1709629507), (("2024-03-05", "15.25"), utc(2024, 3, 5, 22, 15)), (("2024-03-05", "24"), utc(2024, 3, 6, 7)),
    (("2024-03-05", "12 AM"), utc(2024, 3, 5, 7)), (("2024-03-05", "12 PM"), utc(2024, 3, 5, 19)), (("2024-03-05", "2305Z"), utc(2024, 3, 5, 23, 5)), (("2024-03-05", "03h38"), utc(2024, 3, 5, 10, 38)),
]


def test_forms(spark):
    got = resolve(spark, [(d, h, "a", EDMONTON, None) for (d, h), _ in FORMS])
    assert got == [(second, "resolved") for _, second in FORMS]


def test_unreadable_and_clock_changes(spark):
    rows = [
        ("2023-13-45", "10:00"), (None, None), ("", ""), ("n/a", "9"), ("2024-03-05", None), ("2024-03-05", "24:30"), ("2024-03-05", "13 PM"), ("2023-02-29", "1"), ("x" * 5000, "1"),
        ("2024-03-05", "09:05 XYZ"), ("2024-03-10", "02:30"), ("2024-11-03", "01:30"), ("2024-11-03", "01:30 MDT"),
    ]
    got = resolve(spark, [(d, h, "a", EDMONTON, None) for d, h in rows])
    assert [s for _, s in got[:10]] == ["unreadable"] * 8 + ["too_long", "unreadable"]
    assert [s for _, s in got[10:]] == ["nonexistent", "twice", "resolved"]
    assert got[12][0] == utc(2024, 11, 3, 7, 30)


def test_clocks_and_missing_zone(spark):
    rows = [("2024-07-05", "09:00", "a", EDMONTON, c) for c in ("utc", "standard", "wall")] + [("2024-07-05", "09:00", "a", z, None) for z in (None, "Nowhere/Land")]
    assert resolve(spark, rows) == [
        (utc(2024, 7, 5, 9), "resolved"), (utc(2024, 7, 5, 16), "resolved"), (utc(2024, 7, 5, 15), "resolved"), (None, "no_zone"), (None, "no_zone"),
    ]


def test_order_of_day_and_month_is_fitted_per_source(spark):
    rows = [(f"{d:02d}/03/2024", "12", "dmy", EDMONTON, "utc") for d in range(1, 29)] + [(f"03/{d:02d}/2024", "12", "mdy", EDMONTON, "utc") for d in range(1, 29)]
    rows += [("01/02/2024", "12", "open", EDMONTON, "utc"), ("02/02/2024", "12", "open", EDMONTON, "utc"), ("05.06.24", "12", "dmy", EDMONTON, "utc")]
    got = resolve(spark, rows)
    assert [s for s, _ in got[:28]] == [utc(2024, 3, d, 12) for d in range(1, 29)]
    assert [s for s, _ in got[28:56]] == [utc(2024, 3, d, 12) for d in range(1, 29)]
    assert got[56] == (None, "undecided") and got[57] == (utc(2024, 2, 2, 12), "resolved")
    assert got[58] == (utc(2024, 6, 5, 12), "resolved")


def test_empty_table_nulls_and_clashing_columns(spark):
    schema = "id int, d string, h string, source string, zone string, clock string, utc_second string, _source int, share_dmy int"
    empty = spark.createDataFrame([], schema)
    assert times.resolve_times(empty, "d", "h", "source", "zone").collect() == []
    one = spark.createDataFrame([(1, "2024-01-02", "3", None, None, None, "x", 5, 6)] * 2, schema.replace(", _source int, share_dmy int", ", note int, more int"))
    out = times.resolve_times(one, "d", "h", "source", "zone", "clock").collect()
    assert len(out) == 2 and out[0] == out[1] and out[0]["time_status"] == "no_zone" and out[0]["note"] == 5


@settings(max_examples=60, deadline=None)
@given(st.integers(utc(1995, 1, 1), utc(2035, 1, 1)), st.sampled_from([EDMONTON, "America/St_Johns", "Europe/Dublin", "Australia/Lord_Howe"]))
def test_wall_clock_round_trip(second, zone):
    import pyarrow as pa

    local = datetime.fromtimestamp(second, ZoneInfo(zone))
    text = local.strftime("%Y-%m-%d %H:%M:%S")
    got, status, _ = instants.instants(pa.array([text]), np.array([np.nan]), pa.array([zone]), pa.array(["wall"]), 0.01, 0.95)
    both = {int(local.replace(fold=f).timestamp()) for f in (0, 1)}
    if status[0] == instants.RESOLVED:
        assert got[0] == second
    else:
        assert status[0] == instants.TWICE and len(both) == 2


def test_mixture_shares():
    share = times.fit_mixture(np.array([[1, 0], [1, 1], [0, 1]], float), np.array([30.0, 40.0, 10.0]))
    assert share == pytest.approx([0.75, 0.25], abs=1e-6)


def test_dates_in_an_order_that_the_source_does_not_use(spark):
    rows = [(f"{d:02d}/{m:02d}/2024", "12", "dmy", EDMONTON, "utc") for d in range(13, 29) for m in range(1, 13)] + [("03/25/2024", "12", "dmy", EDMONTON, "utc")]
    got = resolve(spark, rows)
    assert {s for _, s in got[:-1]} == {"resolved"} and got[-1] == (None, "other_order")


def test_shares_of_all_forms(spark):
    rows = [("a", f"{d:02d}/03/2024", "12") for d in range(1, 29)] + [("a", "2024-03-05", "9")] * 12 + [("a", "5 Mar 2024", "9")] * 4 + [("a", "1709629200", None)] * 6 + [("a", "junk", "1"), ("a", None, None)]
    rows += [("b", "05/04/2024", "1"), ("b", "04/25/2024", "1"), (None, "2024-123", "01:00"), ("c", "31/31/2024", "1")]
    df = spark.createDataFrame(rows, "feed string, d string, h string")
    got = {(r["source"], r["form"]): (r["share"], r["n_values"]) for r in times.form_shares(df, "d", "h", "feed").collect()}
    assert got["a", "day-month-year"][1] == pytest.approx(28, abs=0.05) and got["a", "month-day-year"][0] < 0.001
    assert [got["a", f][1] for f in ("year-month-day", "day-month name-year", "epoch")] == pytest.approx([12, 4, 6]) and sum(v[0] for (s, _), v in got.items() if s == "a") == pytest.approx(1)
    assert got["b", "month-day-year"][0] > 0.99 and got[None, "year-day of year"] == (1.0, 1.0) and not any(s == "c" for s, _ in got)
    assert times.form_shares(df.limit(0), "d", "h", "feed").count() == 0
