"""Stand-ins for fire data over the driver's tables: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBS = """select event_type station_code, event_id, ts, cast(ts as date) obs_date, cast(hour(ts) as int) obs_hour,
    10e0 + ((event_id*7)%250)/10e0 temp, 20e0 + ((event_id*13)%700)/10e0 rh, ((event_id*11)%400)/10e0 ws, cast((event_id*37)%360 as double) wd,
    case when event_id%17=0 then value/50e0 else 0e0 end precip, ((event_id*29)%300)/20e0 isi from events"""
DAILY = """select l_suppkey station_code, cast(l_shipdate as date) obs_date, avg(5e0+l_quantity*0.5e0) temp, avg(20e0+l_tax*900e0) rh,
    avg(l_linenumber*5e0) ws, sum(case when l_discount>0.08e0 then l_discount*100e0 else 0e0 end) precip from lineitem group by 1,2"""
CELLS = """select cast(floor((p_partkey-lo)/50e0) as int) grid_row, cast((p_partkey-lo)%50 as int) grid_col,
    ((p_partkey-lo)%50+0.5e0)*30e0 x, (-floor((p_partkey-lo)/50e0)-0.5e0)*30e0 y, 1000e0+((p_partkey*31)%500) elev,
    case p_size%12 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 5 when 5 then 6 when 6 then 7 when 7 then 11 when 8 then 31
                   when 9 then 40 when 10 then 101 else 21 end fuel_id, p_size
    from part cross join (select min(p_partkey) lo from part) m"""
IGNITIONS = """select s_suppkey fire_id, s_nationkey iteration, ((s_suppkey*17)%50+0.5e0)*30e0 x, -((s_suppkey*13)%4+0.5e0)*30e0 y,
    case when s_suppkey%2=0 then 'Lightning' else 'Human' end cause, case s_suppkey%3 when 0 then 'Spring' when 1 then 'Summer' else 'Fall' end season from supplier"""
RATES = """select n_nationkey eco_id, 0.5e0+n_regionkey*0.25e0 e_rate, case when n_nationkey%7=0 then 0e0 else 1e0+(n_nationkey%5) end f_rate from nation"""
RING = """select s_suppkey fire_id, cast(i as int) vertex_id, ((s_suppkey*17)%50+0.5e0)*30e0 + (10e0+s_suppkey%7)*cos(2e0*pi()*i/60e0) x,
    -((s_suppkey*13)%4+0.5e0)*30e0 + (10e0+s_suppkey%7)*sin(2e0*pi()*i/60e0) y from supplier cross join ({idx}) r"""
INDEX = {"spark": "select id i from range(60)", "duck": "select range i from range(60)"}
ALL = {"obs": OBS, "daily": DAILY, "cells": CELLS, "ignitions": IGNITIONS, "rates": RATES, "ring": RING}
TABLES = {"obs": ["events"], "daily": ["lineitem"], "cells": ["part"], "ignitions": ["supplier"], "rates": ["nation"], "ring": ["supplier"]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame."""
    text = ALL[name].replace("{idx}", INDEX["spark"])
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    for t, df in args.items():
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **args)


def duck(name: str) -> str:
    """The stand-in as a subquery for DuckDB."""
    return "(" + ALL[name].replace("{idx}", INDEX["duck"]) + ")"
