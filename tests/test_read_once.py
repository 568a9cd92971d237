"""Steps that read what they compare once."""

from __future__ import annotations

import re

from brookcheck.operators import results, topology
from brookcheck.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"


def test_drift_reads_each_side_once_and_tells_all_problems(spark, tmp_path, capsys):
    r = fx.runtimes(spark)
    for name, df in (("b", fx.bindings(spark).unionByName(fx.bindings(spark).limit(1).selectExpr("* except (version_id)", "' ' as version_id"))), ("r", r.unionByName(r.limit(1).selectExpr("* except (version_id)", "'other' as version_id")))):
        df.write.parquet(f"{tmp_path}/{name}")
    out = topology.runtime_drift(spark.read.parquet(f"{tmp_path}/b"), spark.read.parquet(f"{tmp_path}/r"))
    assert sorted((x.problem, x.identity is None) for x in out.collect()) == [("binding_runtime_invalid", True), ("runtime_without_binding", False)]
    out.explain()
    assert len(re.findall(r"FileScan", capsys.readouterr().out.split("Initial Plan")[-1])) == 2


def test_runtimes_of_orders_are_derived_once(spark, capsys):
    b, r = fx.order_topology(spark, DATA)
    b.join(r.select("version_id"), "version_id").explain()
    assert "orders.parquet" not in capsys.readouterr().out


def _plan(df, capsys, mode="simple"):
    df.explain(mode)
    return capsys.readouterr().out


def test_records_read_their_events_once_and_deal_them_without_sorting(spark, capsys):
    plan = _plan(fx.records(spark, DATA), capsys)
    assert len(re.findall("FileScan", plan)) == 1 and "RoundRobin" not in plan
    rows = fx.records(spark, DATA)
    assert rows.where("seq >= 10000000").count() == rows.where("seq < 10000000 and offset % 50 = 0").count() > 0


def test_steps_to_results_are_small_enough_to_be_compiled(spark, capsys):
    """The JVM leaves methods of more than 8,000 bytes uncompiled."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = _plan(results.results_summary(results.latest_results(fx.results(spark, DATA))), capsys, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000


def test_latest_results_pass_on_no_more_than_is_wanted(spark):
    every = results.latest_results(fx.results(spark, DATA))
    some = results.latest_results(fx.results(spark, DATA), ["seq", "status"])
    assert some.columns == ["seq", "status"] and sorted(some.collect()) == sorted(every.select("seq", "status").collect())
