"""Bands, verdicts and gauge positions at their limits, and for missing values."""

import math

from pyspark.sql import functions as F

from sondage.functions import display

NAN = float("nan")


def shown(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r["x"] for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_auc_as_text(spark):
    assert shown(spark, display.format_auc, [None, NAN, 0.5, 0.12345, 1.0]) == ["—", "—", "0,500", "0,123", "1,000"]


def test_auc_rounds_as_the_double_does(spark):
    values = [k / 16 for k in range(17)] + [(2 * k + 1) / 2000 for k in range(1000)] + [-0.0005, 0.0004999, 0.4375005, 1234567.8915]
    assert shown(spark, display.format_auc, values) == [f"{v:.3f}".replace(".", ",") for v in values]
    assert shown(spark, display.format_auc, [math.inf, -math.inf]) == ["Infinity", "-Infinity"]


def test_bands(spark):
    got = shown(spark, display.band, [None, NAN, 0.0, 0.5499, 0.55, 0.6999, 0.7, 0.8999, 0.9, 1.0])
    assert [tuple(r)[0] for r in got] == ["info", "info", "ok", "ok", "info", "info", "warn", "warn", "bad", "bad"]


def test_verdicts(spark):
    for sep, want in ((None, ["ruim", "meio", "meio", "bom"]), (0.95, ["ruim", "meio", "meio", "meio"]), (0.5, ["ruim", "meio", "meio", "bom"])):
        assert shown(spark, lambda v, sep=sep: display.verdict(v, F.lit(sep).cast("double")), [0.5999, 0.6, 0.6999, 0.7]) == want


def test_gauge(spark):
    got = shown(spark, display.gauge_position, [None, NAN, 0.2, 0.5, 0.75, 1.0, 1.2])
    assert [round(x, 6) for x in got] == [0, 0, 0, 0, 50, 100, 100] and not any(math.isnan(x) for x in got)


def test_sanitising_stays_in_the_jvm(spark):
    from sondage.operators import ingest
    from sondage.plans import records, views

    plan = ingest.sample_rows(records._manifests(views.samples(spark, "/root/testdata/sf0.001"), 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
