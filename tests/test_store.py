"""A store's joins and windows by particle read bucket beside bucket."""

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.operators import frames
from granulon.sources.store import write_store


def test_pairs_and_windows_need_no_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(f, p, float(f), 1.0, 0.0) for f in range(4) for p in [*range(40), None]], "frame long, particle long, x double, y double, z double")
    kept = write_store(rows, f"store_{uuid.uuid4().hex}", f"file://{tmp_path}/store", 8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        of = {name: frames.complete_pairs(t, 0, 3) for name, t in (("store", kept), ("rows", rows))}
        assert plan(of["store"]).count("Exchange") == 0 and plan(of["rows"]).count("Exchange") == 2
        assert sorted(of["store"].collect()) == sorted(of["rows"].collect()) and of["store"].count() == 40
        lag = kept.withColumn("before", F.lag("x").over(W.partitionBy("particle").orderBy("frame")))
        assert "Exchange" not in plan(lag) and lag.where("before = x - 1").count() == 41 * 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept.where("particle is null").count() == 4
    assert write_store(rows.limit(0), f"store_{uuid.uuid4().hex}", f"file://{tmp_path}/none", 8).count() == 0
