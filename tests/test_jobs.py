"""End-to-end jobs on small folders and tables."""

import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from nocturne.operators import sessions
from nocturne.plans import jobs
from nocturne.schemas import PREDICTIONS, SESSIONS
from nocturne.sources import recordings, sinks, tables


def write_world(folder, people=24):
    rng = np.random.default_rng(1)
    lines = ["SID,AGE,GENDER,BMI,OAHI,AHI,Mean_SaO2,Arousal Index,MEDICAL_HISTORY,Sleep_Disorders"]
    for i in range(people):
        sick = i % 2
        lines.append(f"S{i:03d},{30 + i},{'MF'[i % 2]},{22 + i},{20 if sick else 3},{22 if sick else 4},9{i % 9}.0%,10,None,None")
        stages = rng.choice(["W", "N1", "N2", "N3", "R"], 30)
        body = [
            f"{rng.normal(20 + 5 * sick, 2):.3f},0.5,0.5,0.5,33,{rng.normal(2, .3):.3f},{rng.normal(65 + 15 * sick, 3):.2f},850,{s}"
            for s in stages
        ]
        text = "\n".join(["BVP,ACC_X,ACC_Y,ACC_Z,TEMP,EDA,HR,IBI,Sleep_Stage", *body])
        (folder / f"compressed_S{i:03d}_whole_df.csv").write_text(text + "\n")
    (folder / "participant_info.csv").write_text("\n".join(lines) + "\n")


def test_train_predict_and_store(spark, tmp_path):
    write_world(tmp_path)
    people = str(tmp_path / "participant_info.csv")
    table = jobs.preprocess(spark, str(tmp_path), people, str(tmp_path / "art"))
    assert table.count() == 24
    trained = jobs.train(spark, str(tmp_path / "art" / "features"), str(tmp_path / "art" / "t"),
                         only=["logistic_regression", "knn"], exclude=("OAHI", "AHI"))
    summary = spark.read.json(str(tmp_path / "art" / "t" / "summary")).first()
    assert summary["best_model"] == trained.best and len(summary["leaderboard"]) == 2 and summary["num_rows"] == 24
    names = ["id", "sid", "user_id", "status"]
    state = spark.createDataFrame(
        [(1, "S000", 5, "complete"), (2, "S001", 5, "completed"), (3, "S002", 6, "recording"), (4, "S003", 6, "complete")],
        "id long, sid string, user_id long, status string",
    )
    empty = spark.createDataFrame([], SESSIONS)
    stored = spark.createDataFrame([(9, 4, "knn", 1, 0.9)], "id long, session_id long, model_name string, prediction int, probability double")
    service = {
        "sessions": empty.unionByName(state, allowMissingColumns=True).select(*SESSIONS.names),
        "predictions": spark.createDataFrame([], PREDICTIONS).unionByName(stored, allowMissingColumns=True),
    }
    assert set(names) <= set(service["sessions"].columns)
    readings, persons = recordings.read_readings(spark, str(tmp_path)), tables.read_participants(spark, people)
    done = jobs.score_finished(
        spark, readings, persons, service,
        str(tmp_path / "art" / "t" / "bundle"), str(tmp_path / "scored"),
    )
    got = rows(done, "session_id")
    assert [r["session_id"] for r in got] == [1, 2]
    assert [r["prediction"] for r in got] == [0, 1]
    assert got[1]["label"] in ("MODERATE RISK", "HIGH RISK") and '"code"' in got[0]["recommendations_json"]
    again = jobs.score_finished(
        spark, readings, persons, service,
        str(tmp_path / "art" / "t" / "bundle"), str(tmp_path / "scored"),
    )
    assert again.count() == 0
    kept = spark.read.parquet(str(tmp_path / "scored" / "new_predictions"))
    assert rows(kept.drop("run_id"), "session_id") == got
    later = spark.createDataFrame([("S005",)], "SID string")
    jobs.predict(
        spark, readings, persons, later,
        str(tmp_path / "art" / "t" / "bundle"), str(tmp_path / "scored"),
    )
    stored_now = sinks.newest_by_sid(spark.read.parquet(str(tmp_path / "scored" / "predictions")))
    assert {r["SID"] for r in stored_now.collect()} == {"S000", "S001", "S005"}
    both = service["predictions"].unionByName(kept, allowMissingColumns=True)
    again = sessions.new_predictions(service["sessions"].select(F.col("id").alias("session_id")), both)
    assert [r["session_id"] for r in again.collect()] == [3]
    board, total = jobs.dashboard({**service, "predictions": both}, table)
    assert board.count() == 4 and total.first()["totalSessions"] == 4
    detail = rows(sessions.session_detail(board), "sid")
    assert detail[2]["prediction"]["model_name"] is None and detail[2]["riskProbability"] == 0.0


def test_rollup_without_sessions(spark):
    users = spark.createDataFrame([(1, "A", "a@x", "patient"), (2, "B", "b@x", "patient"), (3, "C", "c@x", "admin")], "id long, name string, email string, role string")
    board = spark.createDataFrame([(1, 69.5, "2024-01-02", 453), (1, 69.5, "2024-01-01", 453)], "user_id long, sleep_efficiency double, date string, duration int")
    got = rows(sessions.patient_rollup(users, board), "id")
    assert [(r["riskLevel"], r["lastSession"], r["sessionsCount"], r["avgQuality"]) for r in got] == [
        ("low", "2024-01-02", 2, 70), ("high", "No sessions", 0, 0),
    ]
    kpis = sessions.cohort_kpis(sessions.patient_rollup(users, board)).first().asDict()
    assert kpis == {"total": 2, "high": 1, "moderate": 0, "low": 1}
