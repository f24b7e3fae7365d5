"""Shapes of physical plans that must hold at scale."""

import re

import __spark_entry__ as entry
from nocturne.operators import features, sessions
from nocturne.plans import adapters as a
from nocturne.plans import catalogue as c


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_partial_aggregate(spark, sf):
    text = plan(features.recording_features(a.readings(spark, sf)))
    assert text.count("Exchange") == 1 and "partial_avg" in text and "Python" not in text


def test_scan_reads_only_what_is_used(spark, sf):
    text = plan(c.stage_shares(spark, sf))
    assert re.search(r"ReadSchema: struct<user_id:bigint,event_type:string", text)
    assert "ts:" not in text.split("ReadSchema")[1]


def test_owner_filter_reaches_the_scan(spark, sf, tmp_path):
    a.sessions(spark, sf).write.parquet(str(tmp_path / "s"))
    own = sessions.scope_to_user(spark.read.parquet(str(tmp_path / "s")), 7, "patient")
    assert "EqualTo(user_id,7)" in plan(own)
    assert "EqualTo" not in plan(sessions.scope_to_user(spark.read.parquet(str(tmp_path / "s")), 7, "admin"))


def test_newest_row_is_preselected_before_the_shuffle(spark, sf):
    for name in ("latest_prediction", "trend7"):
        text = plan(entry.queries()[name](spark, sf))
        assert "WindowGroupLimit" in text, name


def test_paging_keeps_the_top_rows_only(spark, sf):
    assert "TakeOrderedAndProject" in plan(c.page(spark, sf))
