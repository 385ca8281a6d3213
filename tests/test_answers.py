import datetime

from pyspark.sql import functions as F

from workload import answers


def test_large_order_tables_are_dealt_in_bounded_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(answers, "TASK_ROWS", 50, raising=False)
    day = datetime.date(2024, 1, 1)
    orders = [(k, k % 7 if k % 5 else None, 1.5 * k, day, "1-URGENT") for k in range(1000)] + [(None, 1, 2.5, day, None)] * 2
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string").coalesce(1).write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(c, c + 10) for c in range(6)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    rows = answers.base(spark, str(tmp_path))
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) <= 100
    got = sorted((r.k is None, r.k or 0, r.n) for r in rows.select("k", F.coalesce("n", F.lit(-1)).alias("n")).collect())
    assert got == sorted((k is None, k or 0, c + 10 if c is not None and c < 6 else -1) for k, c, *_ in orders)
    assert answers.spread(spark.range(0, 1000, 1, 1)).rdd.getNumPartitions() == 20


def test_lines_are_made_outside_whole_stage_code(spark, tmp_path):
    """Beside a lambda Spark cuts the lines' code into methods; in whole-stage code they are one method, too long to be compiled."""
    day = datetime.date(2024, 1, 1)
    orders = [(k, 1, 1.5, day, "1-URGENT") for k in (58, 59, 118)] + [(None, 1, 2.5, day, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 10)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    rows = answers.responses(spark, str(tmp_path))
    made = [p for p in rows._jdf.queryExecution().optimizedPlan().toString().split("Project [") if "concat_ws(" in p]
    assert len(made) == 1 and "lambda" in made[0]
    assert {r.ID: "\r\n" in r.response for r in rows.collect()} == {"D58": False, "D59": True, "D118": True, None: False}
