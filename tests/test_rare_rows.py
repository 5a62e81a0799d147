"""Queries against their SQL on hand-made tables with rows that the smallest tables lack."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F
from test_functions import derive
from test_queries import plain

from quillmark.functions import metrics
from quillmark.operators import validate
from quillmark.plans.all import registry

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderstatus string, o_orderpriority string"


def agree(spark, folder, name, **tables):
    """The rows of a query over `tables` (name -> its parts, in the order of the names of files), which must be those of its SQL."""
    con = duckdb.connect(config={"threads": 1})
    for t, parts in tables.items():
        for i, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(f"{folder}/parts/{t}{i}")
            (folder / f"{t}.parquet").mkdir(exist_ok=True)
            next((folder / "parts" / f"{t}{i}").glob("*.parquet")).rename(folder / f"{t}.parquet" / f"{i}.parquet")
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet/*.parquet'")
    df, rel = registry.QUERIES[name](spark, str(folder)), con.sql(registry.ORACLE[name])
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return [dict(zip(df.columns, r, strict=True)) for r in got]


def issuers(spark):
    """Customers whose days of receivables are 0 and then untold (289), or 0 and then told (27), and one without orders (3)."""
    orders = [(k * 10000 + y, k, datetime(y, 5, 1), 1000.0, "F", "LOW") for k in (289, 27) for y in (1997, 1998)]
    return {"orders": [spark.createDataFrame(orders, ORDERS)], "customer": [spark.createDataFrame([(289,), (27,), (3,)], "c_custkey long")]}


def test_states_of_untold_receivable_days(spark, tmp_path):
    rows = agree(spark, tmp_path, "metrics_all_states", **issuers(spark))
    assert {r["state"]: r["n"] for r in rows if r["metric_id"] == "receivable_days_yoy_pct"} == {"NOT_APPLICABLE": 1, "UNKNOWN": 2}


def test_growth_of_untold_receivable_days(spark, tmp_path):
    rows = agree(spark, tmp_path, "metrics_growth", **issuers(spark))
    assert {r["ipo_id"]: r["receivable_days_yoy_pct_state"] for r in rows} == {289: "UNKNOWN", 27: "NOT_APPLICABLE", 3: "UNKNOWN"}


def test_growth_of_orders_without_a_date(spark, tmp_path):
    orders = [(y, 27, datetime(y, 5, 1) if y > 1992 else None, 1000.0 * y, "F", "LOW") for y in range(1992, 1999)]
    rows = agree(spark, tmp_path, "metrics_growth", orders=[spark.createDataFrame(orders, ORDERS)], customer=[spark.createDataFrame([(27,)], "c_custkey long")])
    assert [(r["pat_latest"], r["net_worth_latest"], r["receivable_days_yoy_pct_state"]) for r in rows] == [(None, None, "UNKNOWN")]


def test_percentages_of_receivable_days_need_both_years(spark):
    state = lambda *days: derive(spark, ["receivable_days_yoy_pct"], years=[{"receivable_days": d} for d in days])["receivable_days_yoy_pct"][0]
    assert [state(0.0, None), state(None, 0.0), state(0.0, 5.0), state(5.0, 0.0), state(0.0)] == ["UNKNOWN", "UNKNOWN", "NOT_APPLICABLE", "VALUE", "UNKNOWN"]


def test_issuers_without_orders_have_too_few_periods(spark, tmp_path):
    rows = agree(spark, tmp_path, "r12_issue_rules", **issuers(spark))
    assert {r["ipo_id"] for r in rows if r["code"] == "TOO_FEW_PERIODS"} == {289, 27, 3}


@pytest.mark.parametrize("years", ["null", "array()", "array(named_struct('fy', '1998', 'is_stub', true))"])
def test_issues_without_full_years_have_too_few_periods(spark, years):
    rows = spark.range(1).select("id", F.expr(years).alias("periods"), F.lit(2.0).alias("post_issue_eps"), F.lit(1e6).alias("post_issue_shares"))
    typed = rows.withColumn("periods", F.from_json(F.to_json("periods"), metrics.ARRAYS["periods"]) if "struct" in years else F.col("periods").cast(metrics.ARRAYS["periods"]))
    assert [r["code"] for r in validate.findings(metrics.complete(typed), "id", validate.issue_rules()).collect()] == ["TOO_FEW_PERIODS"]


def lines(spark):
    """Order 1 has two lines of the same number and part, of which the second is in the later and larger file, which is read first."""
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    line = lambda order, part, number, discount, tax: (order, part, 1, number, 9.0, 90.0, discount, tax, "N", "F", datetime(1998, 1, 1))
    part = lambda tied, keys: spark.createDataFrame([*[line(1, 1, n, tied + n / 1000, tied - n / 1000) for n in (1, 3)], *[line(2 + k % 999, k, 1 + k % 7, k % 10 / 100, k % 7 / 100) for k in keys]], kinds)
    orders = [(k, k % 50, datetime(1998, 1, 1), 1000.0, "F", "LOW") for k in range(1, 1001)]
    return {"lineitem": [part(0.08, range(2000)), part(0.05, range(2000, 8000))], "orders": [spark.createDataFrame(orders, ORDERS)]}


def test_tied_lines_come_as_they_are_stored(spark, tmp_path):
    rows = agree(spark, tmp_path, "p13_post_listing", **lines(spark))
    assert [(r["listing_gain"], r["absolute_return"]) for r in rows if r["evaluation_id"] == 1] == [(0.081, 0.079)]


def test_tied_lines_of_the_backtest_come_as_they_are_stored(spark, tmp_path):
    rows = agree(spark, tmp_path, "p14_backtest", **lines(spark))
    assert [r["return_6m"] for r in rows if r["evaluation_id"] == 1] == [0.077]
