import pytest
from pyspark.sql import functions as F

from helpers import rows
from nocturne.operators import metrics, sites
from nocturne.plans import jobs
from nocturne.sources import sinks

TRUTH = [("S002", 1), ("S003", 0), ("S004", 1), ("S005", 0), ("S006", 0)]


@pytest.fixture
def pair(spark):
    truth = spark.createDataFrame(TRUTH, "SID string, sleep_deprivation_label_gt int")
    predicted = [(s, int(s == "S002"), 0.9 if y else 0.1, y) for s, y in TRUTH]
    return spark.createDataFrame(
        predicted, "SID string, prediction int, probability_sleep_deprivation double, sleep_deprivation_label int"
    ), truth


def test_golden_report(spark, pair, tmp_path):
    report = jobs.clinical_report(*pair, str(tmp_path / "r")).first().asDict()
    assert [report[c] for c in ("N", "TP", "TN", "FP", "FN")] == [5, 1, 3, 0, 1]
    assert [report[c] for c in ("Sensitivity", "Specificity", "PPV", "NPV", "Cohen_Kappa", "AUC_ROC")] == [
        0.5, 1.0, 1.0, 0.75, 0.5455, 1.0,
    ]
    assert (report["Sensitivity_low"], report["Sensitivity_high"]) == (0.0, 1.0)
    assert (report["Specificity_low"], report["Specificity_high"]) == (1.0, 1.0)
    sinks.write_report(spark.read.parquet(str(tmp_path / "r")), str(tmp_path / "csv"), True)
    shown = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert shown["Sensitivity_CI_95"] == "0.0–1.0"


def test_targets(pair):
    joined = metrics.join_truth(*pair)
    got = {r["measure"]: (r["meets_minimum"], r["meets_target"]) for r in metrics.meets_targets(metrics.clinical_metrics(joined)).collect()}
    assert got == {"Sensitivity": (False, False), "Specificity": (True, True), "Cohen_Kappa": (False, False)}


def test_truth_column_and_empty_join(spark, pair, tmp_path):
    predicted, truth = pair
    other = truth.withColumnRenamed("sleep_deprivation_label_gt", "psg_sleep_deprivation")
    assert "sleep_deprivation_label_gt" in metrics.join_truth(predicted, other).columns
    plain = truth.withColumnRenamed("sleep_deprivation_label_gt", "sleep_deprivation_label")
    assert metrics.clinical_metrics(metrics.join_truth(predicted, plain)).first()["tp"] == 1
    with pytest.raises(ValueError, match="truth column"):
        metrics.join_truth(predicted, truth.select("SID", F.lit(1).alias("y")))
    with pytest.raises(ValueError, match="no SID"):
        jobs.clinical_report(predicted, truth.withColumn("SID", F.lit("x")), str(tmp_path / "r"))


def test_single_class(spark, pair):
    joined = metrics.join_truth(*pair).filter("sleep_deprivation_label_gt = 0")
    got = metrics.clinical_metrics(joined).first()
    assert (got["Sensitivity"], got["Specificity"], got["Cohen_Kappa"]) == (0.0, 1.0, None)


def test_bootstrap_brackets_the_point(spark):
    data = [(i % 2, (i % 5 != 0) * (i % 2) + (i % 7 == 0) * (1 - i % 2)) for i in range(400)]
    df = spark.createDataFrame(data, "sleep_deprivation_label_gt int, prediction int")
    point = metrics.clinical_metrics(df).first()
    ci = metrics.bootstrap_ci(df).first()
    assert ci["ci_low"] < point["Sensitivity"] < ci["ci_high"] and ci["replicates"] == 1000
    assert ci["ci_high"] - ci["ci_low"] < 0.15
    assert metrics.bootstrap_ci(df).first() == ci
    own = metrics.bootstrap_ci(df, "try_divide(tp + tn, tp + tn + fp + fn)", n_iter=200).first()
    accuracy = (point["tp"] + point["tn"]) / point["n"]
    assert own["ci_low"] < accuracy < own["ci_high"]
    assert metrics.bootstrap_ci(df, "try_divide(1, 0)").first()["ci_low"] is None


def test_site_summaries_merge(spark):
    data = [("a", 1.0), ("a", 2.5), ("b", 7.0), ("b", None), ("c", 4.0), ("d", None)]
    df = spark.createDataFrame(data, "site string, x double")
    summary = sites.site_summary(df, "site", ["x"])
    merged = sites.merge_summaries(summary).first()
    whole = df.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    assert merged["n"] == 4 and merged["mean"] == pytest.approx(whole["m"]) and merged["std"] == pytest.approx(whole["s"])
    maps = {r["site"]: r for r in rows(sites.summary_maps(summary))}
    assert maps["a"]["mean"] == {"x": 1.75} and maps["b"]["n_rows"] == 2


def test_leaderboard_orders(spark):
    board = spark.createDataFrame(
        [("b", 0.5, 0.6, None), ("a", 0.5, 0.6, None), ("c", None, 0.9, 0.9), ("d", 0.5, 0.6, 0.7)],
        "model_name string, f1 double, accuracy double, roc_auc double",
    ).withColumns({"precision": F.lit(0.1), "recall": F.lit(None).cast("double")})
    assert [r["model_name"] for r in metrics.rank_models(board).collect()] == ["d", "a", "b", "c"]
    view = rows(metrics.leaderboard_view(board, "roc_auc", "d"))
    assert [r["name"] for r in view] == ["c", "d", "a", "b"] and view[1]["isActive"] and view[0]["recall"] == 0.0
