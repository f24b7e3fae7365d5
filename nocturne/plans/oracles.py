"""The same queries as SQL text for DuckDB, to check results against."""

from __future__ import annotations

from nocturne.functions import rules
from nocturne.schemas import CHANNELS, EVENTS, PROFILE_COLUMNS, STAGES

READINGS = """
readings AS (
  SELECT *, floor(60000 / "HR") AS "IBI" FROM (
    SELECT 'S' || user_id AS "SID", event_id AS reading_id, ts, event_type,
      CASE WHEN k % 10 <> 0 THEN floor(value) / 2 END AS "BVP",
      (k % 7) / 8 AS "ACC_X", (k % 5) / 4 AS "ACC_Y", 0.5::DOUBLE AS "ACC_Z",
      33 + (k % 8) / 4 AS "TEMP", k / 8 AS "EDA",
      CASE WHEN k % 25 <> 24 THEN 40.0::DOUBLE + floor(value) END AS "HR",
      CASE event_type WHEN 'view' THEN 'W' WHEN 'click' THEN 'N1'
        WHEN 'purchase' THEN CASE WHEN k < 50 THEN 'N2' ELSE 'R' END
        WHEN 'signup' THEN 'N3' END AS "Sleep_Stage",
      CASE WHEN event_type = 'error' AND k < 20 THEN 1 END AS "Obstructive_Apnea",
      CASE WHEN event_type = 'error' AND k >= 20 AND k < 40 THEN 1 END AS "Central_Apnea",
      CASE WHEN event_type = 'error' AND k >= 40 AND k < 60 THEN 1 END AS "Hypopnea",
      CASE WHEN event_type = 'error' AND k >= 60 AND k < 100 THEN 1 END AS "Multiple_Events"
    FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)
  )
)"""

RAW_PEOPLE = """
raw_people AS (
  SELECT ' S' || c_custkey || ' ' AS "SID", (20 + c_custkey % 60)::VARCHAR AS "AGE",
    CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS "GENDER",
    (18 + c_custkey % 30)::VARCHAR AS "BMI",
    floor(CASE WHEN c_custkey % 13 <> 0 THEN b % 20 END * 0.75::DOUBLE)::BIGINT::VARCHAR AS "OAHI",
    coalesce((CASE WHEN c_custkey % 13 <> 0 THEN b % 20 END)::VARCHAR, 'N/A') AS "AHI",
    CASE WHEN c_custkey % 17 = 0 THEN 'bad' ELSE (85 + c_custkey % 15) || '%' END AS "Mean_SaO2",
    (b % 40)::VARCHAR AS "Arousal Index",
    CASE c_nationkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'Hypertension, Sleep Apnea' ELSE 'Asthma' END
      AS "MEDICAL_HISTORY",
    CASE c_mktsegment WHEN 'BUILDING' THEN 'OSA, snoring' WHEN 'HOUSEHOLD' THEN 'Difficulty Breathing'
      WHEN 'MACHINERY' THEN 'None' WHEN 'FURNITURE' THEN '' ELSE 'insomnia' END AS "Sleep_Disorders"
  FROM (SELECT *, floor(abs(c_acctbal))::BIGINT AS b FROM customer)
)"""

PEOPLE = RAW_PEOPLE + """,
people AS (
  SELECT trim("SID") AS "SID", "AGE"::DOUBLE AS "AGE", "GENDER", "BMI"::DOUBLE AS "BMI",
    "OAHI"::DOUBLE AS "OAHI", try_cast("AHI" AS DOUBLE) AS "AHI",
    try_cast(replace("Mean_SaO2", '%', '') AS DOUBLE) AS "Mean_SaO2",
    "Arousal Index"::DOUBLE AS "Arousal Index",
    nullif("MEDICAL_HISTORY", 'None') AS "MEDICAL_HISTORY",
    CASE WHEN "Sleep_Disorders" NOT IN ('None', '') THEN "Sleep_Disorders" END AS "Sleep_Disorders"
  FROM raw_people
),
flagged AS (
  SELECT *, (regexp_matches(lower(coalesce("Sleep_Disorders", '')), 'apnea|difficulty breathing|snoring')
      OR contains(lower(coalesce("MEDICAL_HISTORY", '')), 'sleep apnea')) AS flag
  FROM people
),
labelled AS (
  SELECT * EXCLUDE (flag), flag, (coalesce("OAHI" >= 15, false) OR coalesce("AHI" >= 15, false)
      OR coalesce("Arousal Index" >= 30, false) OR flag)::INT AS sleep_deprivation_label
  FROM flagged
),
middles AS (
  SELECT median("OAHI") AS m_oahi, median("AHI") AS m_ahi, median("Arousal Index") AS m_arousal,
    median("BMI") AS m_bmi, median("Mean_SaO2") AS m_sao2, median("AGE") AS m_age
  FROM people
),
hours AS (
  SELECT "SID", least(greatest(8.0::DOUBLE + 0.02::DOUBLE * (coalesce("BMI", m_bmi) - 25)
      + 0.015::DOUBLE * coalesce("Arousal Index", m_arousal) + 0.01::DOUBLE * coalesce("AHI", m_ahi)
      - 0.03::DOUBLE * (coalesce("Mean_SaO2", m_sao2) - 94), 6.0::DOUBLE), 10.0::DOUBLE)
      AS recommended_sleep_hours
  FROM people, middles
)"""

STAT = ", ".join(
    f'avg("{c}") AS "{c}_mean", round(stddev_samp("{c}"), 6) AS "{c}_std", '
    f'min("{c}") AS "{c}_min", max("{c}") AS "{c}_max"'
    for c in CHANNELS
)
COUNTS = ", ".join(f'count("{c}") AS "{c}_count"' for c in EVENTS)
RATE = "(" + " + ".join(f'count("{c}")' for c in EVENTS) + ")::DOUBLE / greatest(count(*), 1) AS event_rate"
SHARES = ", ".join(
    f"""count(CASE WHEN coalesce("Sleep_Stage", 'Unknown') = '{s}' THEN 1 END)::DOUBLE / count(*) """
    f'AS "sleep_stage_pct_{s}"'
    for s in STAGES
)
FEATURES = f"""
features AS (
  SELECT "SID", count(*) AS records, {STAT}, {COUNTS}, {RATE}, {SHARES} FROM readings GROUP BY "SID"
)"""
EFFICIENCY = (
    "least(greatest(100.0::DOUBLE - sleep_stage_pct_W * 100.0::DOUBLE - event_rate * 200.0::DOUBLE, 0), 100)"
)
TABLE = f"""
feature_table AS (
  SELECT f.*, p.* EXCLUDE ("SID", flag), round(h.recommended_sleep_hours, 6) AS recommended_sleep_hours
  FROM features f JOIN labelled p USING ("SID") JOIN hours h USING ("SID")
)"""

SESSIONS = """
sessions AS (
  SELECT o_orderkey AS id, 'S' || o_orderkey AS sid,
    CASE WHEN o_custkey % 97 <> 0 THEN o_custkey END AS user_id,
    CASE WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'F' THEN 'complete'
      WHEN o_orderkey % 3 = 0 THEN 'recording' WHEN o_orderkey % 3 = 1 THEN 'created' ELSE 'failed' END AS status,
    CASE WHEN o_orderkey % 11 <> 0 THEN (3600 * (4 + o_orderkey % 6) + o_orderkey % 600)::INT END AS duration_seconds,
    o_orderdate AS created_at
  FROM orders
)"""
PREDICTIONS = """
predictions AS (
  SELECT *, (probability >= 0.5)::INT AS prediction FROM (
    SELECT l_orderkey AS session_id,
      CASE l_returnflag WHEN 'A' THEN 'random_forest' WHEN 'N' THEN 'knn' ELSE 'svc_rbf' END AS model_name,
      CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice / 1000) / 128 END AS probability,
      CASE WHEN l_tax = 0.0 OR l_tax = 0.08 THEN NULL ELSE l_quantity END AS hr_impact,
      CASE WHEN l_tax = 0.0 OR l_tax = 0.08 THEN NULL ELSE l_linenumber END AS eda_impact,
      l_shipdate AS created_at, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax
    FROM lineitem
  )
)"""
NEWEST = (
    "created_at DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, "
    "l_extendedprice DESC, l_tax DESC"
)
LATEST = f"""
latest AS (
  SELECT * FROM predictions
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY {NEWEST}) = 1
)"""
SCORED = """
judged AS (
  SELECT lang AS segment, quality::INT AS y, score, (score >= 0.5)::INT AS p
  FROM (SELECT doc_id, lang, least(n_chars / 5000, 1.0)::DOUBLE AS score FROM documents)
  JOIN labels USING (doc_id)
)"""
CELLS = (
    "count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, "
    "count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn"
)
KAPPA = """CASE WHEN n::DOUBLE * n <> (tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp) THEN
  ((tp + tn)::DOUBLE / n - ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n::DOUBLE * n))
  / (1 - ((tp + fp)::DOUBLE * (tp + fn) + (tn + fn)::DOUBLE * (tn + fp)) / (n::DOUBLE * n)) END"""


def _share(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0::DOUBLE ELSE ({top})::DOUBLE / ({bottom}) END"


def _auc(source: str, keys: str, y: str, score: str) -> str:
    """Rank form of the area: mean rank of the positives."""
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""
      SELECT {head}CASE WHEN count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0 THEN
        (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
        / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) END AS auc
      FROM (
        SELECT {head}{y} AS y,
          rank() OVER ({part} ORDER BY {score})
          + (count(*) OVER (PARTITION BY {head}{score}) - 1) / 2 AS r
        FROM {source}
      ) {tail}"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _rule_rows(table, default, source: str) -> str:
    """Long form of a rule table; positions count the rules that fired."""
    branches = [
        f"""SELECT "SID", {i} AS rule_no, '{r.code}' AS code, '{r.severity}' AS severity,
        '{r.message.replace("'", "''")}' AS message FROM {source}
        WHERE {r.condition.replace("D", "::DOUBLE").replace("E::DOUBLEA_std", "EDA_std")}"""
        for i, r in enumerate(table)
    ]
    fired = " UNION ALL ".join(branches)
    out = f"""fired AS ({fired}), placed AS (
      SELECT "SID", (row_number() OVER (PARTITION BY "SID" ORDER BY rule_no) - 1)::INT AS pos, code, severity, message
      FROM fired)"""
    rest = "" if default is None else f""" UNION ALL
      SELECT "SID", 0, '{default.code}', '{default.severity}', '{default.message}' FROM {source}
      WHERE "SID" NOT IN (SELECT "SID" FROM fired)"""
    return out + "||SELECT * FROM placed" + rest


def _rules(table, default, *sources: str, source: str, columns: str = "*") -> str:
    ctes, final = _rule_rows(table, default, source).split("||")
    return _with(*sources, ctes) + (final if columns == "*" else f"SELECT {columns} FROM ({final})")


PEOPLE_COLUMNS = '"SID", "AGE", "GENDER", "BMI", "OAHI", "AHI", "Mean_SaO2", "Arousal Index", "MEDICAL_HISTORY", "Sleep_Disorders"'
READING_COLUMNS = ["SID", "reading_id", "ts", *[c for c in CHANNELS], "Sleep_Stage", *EVENTS]


def _missing(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS missing_count,
        (count(*) - count("{c}")) * 100.0::DOUBLE / count(*) AS missing_percent FROM {source}"""
        for c in columns
    )


def _describe_numeric(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS "count", round(avg("{c}"), 6) AS mean,
        round(stddev_samp("{c}"), 6) AS std, min("{c}") AS min, round(quantile_cont("{c}", 0.25), 6) AS q25,
        round(quantile_cont("{c}", 0.5), 6) AS q50, round(quantile_cont("{c}", 0.75), 6) AS q75,
        max("{c}") AS max FROM {source}"""
        for c in columns
    )


def _describe_text(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS "count", count(*) AS "unique",
        first(v ORDER BY n DESC, v) AS top, first(n ORDER BY n DESC, v) AS freq
        FROM (SELECT "{c}" AS v, count(*) AS n FROM {source} WHERE "{c}" IS NOT NULL GROUP BY 1)"""
        for c in columns
    )


def _corr(columns: tuple[str, ...], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{x}' AS column_a, '{y}' AS column_b,
        round(regr_sxy("{y}", "{x}") / sqrt(nullif(regr_sxx("{y}", "{x}") * regr_syy("{y}", "{x}"), 0)), 6) AS r
        FROM {source}"""
        for x in columns
        for y in columns
    )


CORE = ["HR", "EDA", "TEMP", "BVP"]
SITES = " UNION ALL ".join(
    f"""SELECT event_type AS site, count(*) AS n_rows, '{c}' AS "column", count("{c}") AS n, avg("{c}") AS mean,
    round(stddev_samp("{c}"), 6) AS std, round(var_pop("{c}") * count("{c}"), 2) AS m2 FROM readings GROUP BY 1"""
    for c in CORE
)
DASHBOARD = f"""
dashboard AS (
  SELECT s.id, s.sid, s.user_id, s.created_at,
    strftime(s.created_at, '%Y-%m-%dT%H:%M:%S') AS date,
    floor(coalesce(duration_seconds, 0) / 60)::INT AS duration,
    coalesce(l.probability, 0) AS "riskProbability",
    CASE WHEN coalesce(l.probability, 0) >= 0.7 THEN 'high' WHEN coalesce(l.probability, 0) >= 0.4 THEN 'moderate'
      ELSE 'low' END AS "riskLevel",
    CASE WHEN status IN ('completed', 'processing', 'recording') THEN status ELSE 'completed' END AS status,
    coalesce(f."HR_mean", 0) AS "HR_mean", coalesce(f."HR_std", 0) AS "HR_std",
    coalesce(f."EDA_mean", 0) AS "EDA_mean", coalesce(f."TEMP_mean", 0) AS "TEMP_mean",
    coalesce(f.event_rate, 0) AS event_rate,
    coalesce({EFFICIENCY}, 0) AS sleep_efficiency,
    coalesce(round_even(sleep_stage_pct_W * 100, 0), 0)::INT AS wake,
    coalesce(round_even(sleep_stage_pct_N1 * 100, 0), 0)::INT AS n1,
    coalesce(round_even(sleep_stage_pct_N2 * 100, 0), 0)::INT AS n2,
    coalesce(round_even(sleep_stage_pct_N3 * 100, 0), 0)::INT AS n3,
    coalesce(round_even(sleep_stage_pct_R * 100, 0), 0)::INT AS rem,
    l.model_name, l.hr_impact, l.eda_impact
  FROM sessions s LEFT JOIN latest l ON l.session_id = s.id LEFT JOIN features f ON f."SID" = s.sid
)"""
USERS = """
users AS (
  SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.org' AS email,
    CASE WHEN c_custkey % 41 = 0 THEN 'admin' WHEN c_custkey % 40 = 0 THEN 'clinician' ELSE 'patient' END AS role
  FROM customer
)"""
ROLLUP = """
rollup_rows AS (
  SELECT u.id, u.name, u.email,
    CASE WHEN coalesce(floor(q + 0.5), 0) < 50 OR coalesce(n, 0) = 0 THEN 'high'
      WHEN coalesce(floor(q + 0.5), 0) < 70 THEN 'moderate' ELSE 'low' END AS "riskLevel",
    coalesce(last, 'No sessions') AS "lastSession", coalesce(n, 0) AS "sessionsCount",
    coalesce(floor(q + 0.5), 0)::INT AS "avgQuality", floor(coalesce(m, 0) / 6 + 0.5) / 10 AS "avgHours"
  FROM users u LEFT JOIN (
    SELECT user_id, count(*) AS n, avg(sleep_efficiency) AS q, max(date) AS last, avg(duration) AS m
    FROM dashboard GROUP BY 1) s ON s.user_id = u.id
  WHERE u.role = 'patient'
)"""
BOARD = _with(SESSIONS, PREDICTIONS, LATEST, READINGS, FEATURES, DASHBOARD)
BOARD_SOURCES = (SESSIONS, PREDICTIONS, LATEST, READINGS, FEATURES, DASHBOARD)
MODELS = f"""
judged_models AS (
  SELECT model_name, probability AS score, prediction AS p, (status = 'complete')::INT AS y
  FROM predictions JOIN sessions ON id = session_id WHERE probability IS NOT NULL
),
model_cells AS (SELECT model_name, {CELLS} FROM judged_models GROUP BY 1),
model_areas AS ({_auc("judged_models", "model_name", "y", "score")}),
board AS (
  SELECT model_name, round({_share("tp + tn", "n")}, 9) AS accuracy,
    round({_share("2 * tp", "2 * tp + fp + fn")}, 9) AS f1,
    round({_share("tp", "tp + fp")}, 9) AS precision, round({_share("tp", "tp + fn")}, 9) AS recall,
    round(auc, 9) AS roc_auc
  FROM model_cells JOIN model_areas USING (model_name)
)"""
MESSAGES = """
msgs AS (
  SELECT event_id, user_id, ts, k % 20 AS kind, CASE WHEN k % 20 = 2 THEN 0 ELSE value END AS bpm,
    CASE WHEN k % 20 NOT IN (0, 3) THEN 1 ELSE 0 END AS ok
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)
),
live AS (
  SELECT event_id, user_id, ts, bpm, 20.0::DOUBLE + bpm % 10 AS "BVP", 0.5::DOUBLE AS "ACC_X", 0.5::DOUBLE AS "ACC_Y",
    0.5::DOUBLE AS "ACC_Z", 33.0::DOUBLE + bpm % 2 AS "TEMP", 2.0::DOUBLE + bpm % 3 AS "EDA", bpm AS "HR",
    CASE WHEN bpm > 0 THEN 60000.0::DOUBLE / bpm ELSE 0 END AS "IBI"
  FROM msgs WHERE ok = 1
)"""
NIGHTS = f"""
night_rows AS (
  SELECT "SID", CAST(ts AS DATE) AS night, count(*) AS records, {STAT}, {RATE}, {SHARES}
  FROM readings GROUP BY 1, 2
),
nights AS (
  SELECT *, dense_rank() OVER (PARTITION BY "SID" ORDER BY night)::INT AS night_index FROM night_rows
)"""
SEQUENCES = """
complete AS (
  SELECT n."SID", night_index, sleep_deprivation_label, "HR_mean", "EDA_std", "BVP_mean", "TEMP_mean", event_rate,
    "sleep_stage_pct_N3", "sleep_stage_pct_R", "sleep_stage_pct_W",
    row_number() OVER (PARTITION BY n."SID" ORDER BY night_index) AS rn
  FROM nights n JOIN labelled USING ("SID")
  WHERE "HR_mean" IS NOT NULL AND "EDA_std" IS NOT NULL AND "BVP_mean" IS NOT NULL AND "TEMP_mean" IS NOT NULL
)"""
EPOCHS = """
modes AS (
  SELECT "SID", time_bucket(INTERVAL '{step}', ts) AS start, "Sleep_Stage" AS stage, count(*) AS n
  FROM readings WHERE "Sleep_Stage" IS NOT NULL GROUP BY 1, 2, 3
),
epochs AS (
  SELECT "SID", start, stage FROM modes
  QUALIFY row_number() OVER (PARTITION BY "SID", start ORDER BY n DESC, stage) = 1
)"""
RAW_SESSIONS = """
raw AS (
  SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS c,
    CASE WHEN o_orderkey % 50 <> 0 THEN 's' || o_orderkey ELSE ' ' END AS id,
    CASE o_orderkey % 5 WHEN 0 THEN '7.' || (o_orderkey % 10) || ' H' WHEN 1 THEN (o_orderkey % 600) || ' min'
      WHEN 2 THEN 'soon' ELSE (o_orderkey % 480)::VARCHAR END AS duration,
    CASE o_orderkey % 5 WHEN 0 THEN floor((7 + (o_orderkey % 10) / 10) * 60 + 0.5)::BIGINT
      WHEN 1 THEN o_orderkey % 600 WHEN 2 THEN 0 ELSE o_orderkey % 480 END AS minutes,
    o_orderdate
  FROM orders
)"""


ORACLES = {
    "feature_table": _with(READINGS, FEATURES, PEOPLE, TABLE) + "SELECT * FROM feature_table",
    "attribution_sum": _with(READINGS, FEATURES, PEOPLE, TABLE) + 'SELECT "SID", 0.0::DOUBLE AS gap FROM feature_table',
    "linear_attribution": _with(READINGS, FEATURES, PEOPLE, TABLE) + 'SELECT "SID", 0.0::DOUBLE AS gap FROM feature_table',
    "score_checks": _with(READINGS, FEATURES, PEOPLE, TABLE)
    + 'SELECT "SID", true AS decided, true AS in_range, true AS banded FROM feature_table',
    "channel_stats": _with(READINGS) + f'SELECT "SID", count(*) AS records, {STAT} FROM readings GROUP BY 1',
    "event_rates": _with(READINGS) + f'SELECT "SID", {COUNTS}, {RATE} FROM readings GROUP BY 1',
    "stage_shares": _with(READINGS) + f'SELECT "SID", {SHARES} FROM readings GROUP BY 1',
    "stage_pivot": _with(READINGS) + 'SELECT "SID", ' + ", ".join(
        f"""count(*) FILTER (coalesce("Sleep_Stage", 'Unknown') = '{s}') AS "n_{s}" """ for s in STAGES
    ) + 'FROM readings GROUP BY 1',
    "participants_clean": _with(PEOPLE) + f"SELECT {PEOPLE_COLUMNS}, sleep_deprivation_label FROM labelled",
    "deprivation_label": _with(PEOPLE) + 'SELECT "SID", sleep_deprivation_label FROM labelled',
    "severity_topk": _with(PEOPLE) + """, ranked AS (
        SELECT "SID", coalesce("OAHI", m_oahi) + coalesce("AHI", m_ahi) + 0.5::DOUBLE * coalesce("Arousal Index", m_arousal)
          + 10 * flag::INT AS severity FROM flagged, middles)
        SELECT "SID", severity, (row_number() OVER (ORDER BY severity DESC, "SID")
          <= least(greatest(1, (SELECT count(*) FROM people) // 2), (SELECT count(*) FROM people) - 1))::INT
          AS sleep_deprivation_label FROM ranked""",
    "recommended_hours": _with(PEOPLE) + 'SELECT "SID", round(recommended_sleep_hours, 6) AS recommended_sleep_hours FROM hours',
    "truth_proxy": _with(PEOPLE) + """SELECT "SID", (coalesce("AHI", m_ahi) >= 15 OR coalesce("OAHI", m_oahi) >= 15)::INT
        AS sleep_deprivation_label_gt FROM people, middles""",
    "median_fill": _with(PEOPLE) + """SELECT "SID", coalesce("AGE", m_age) AS "AGE", "GENDER", coalesce("BMI", m_bmi) AS "BMI",
        coalesce("OAHI", m_oahi) AS "OAHI", coalesce("AHI", m_ahi) AS "AHI", coalesce("Mean_SaO2", m_sao2) AS "Mean_SaO2",
        coalesce("Arousal Index", m_arousal) AS "Arousal Index", coalesce("MEDICAL_HISTORY", 'Unknown') AS "MEDICAL_HISTORY",
        coalesce("Sleep_Disorders", 'Unknown') AS "Sleep_Disorders" FROM people, middles""",
    "harmonise": _with(READINGS) + """SELECT reading_id, CASE WHEN length("SID") > 3 THEN upper(substr("SID", 1, 4))
        ELSE 'rec_' || lower("SID") END AS "SID", "ACC_X", "ACC_Y", "ACC_Z",
        CASE event_type WHEN 'click' THEN 'N1' WHEN 'purchase' THEN 'N2' WHEN 'signup' THEN 'N3' ELSE 'W' END AS "Sleep_Stage",
        'absent' AS events FROM readings""",
    "onehot_stage": """SELECT event_id AS reading_id, CASE event_type WHEN 'click' THEN 'N1' WHEN 'purchase' THEN 'N2'
        WHEN 'signup' THEN 'N3' ELSE 'W' END AS "Sleep_Stage" FROM events""",
    "synonym_pick": _with(RAW_PEOPLE) + """SELECT trim("SID") AS "SID", "AGE", "GENDER", "BMI", NULL::VARCHAR AS "OAHI", "AHI",
        "Mean_SaO2", NULL::VARCHAR AS "Arousal Index", '' AS "MEDICAL_HISTORY", "Sleep_Disorders" FROM raw_people""",
    "missing_profile": _with(READINGS) + _missing(READING_COLUMNS, "readings"),
    "top_missing": _with(READINGS, FEATURES, PEOPLE, TABLE) + 'SELECT * FROM (' + _missing(
        ["SID", "records", *[f"{c}_{m}" for c in CHANNELS for m in ("mean", "std", "min", "max")],
         *[f"{c}_count" for c in EVENTS], "event_rate", *[f"sleep_stage_pct_{s}" for s in STAGES],
         "AGE", "GENDER", "BMI", "OAHI", "AHI", "Mean_SaO2", "Arousal Index", "MEDICAL_HISTORY", "Sleep_Disorders",
         "sleep_deprivation_label", "recommended_sleep_hours"], "feature_table"
    ) + ') ORDER BY missing_percent DESC, "column" LIMIT 15',
    "describe_numeric": _with(PEOPLE) + _describe_numeric(["AGE", "BMI", "OAHI", "AHI", "Mean_SaO2", "Arousal Index"], "people"),
    "describe_text": _with(PEOPLE) + _describe_text(["GENDER", "MEDICAL_HISTORY", "Sleep_Disorders"], "people"),
    "corr_matrix": _with(READINGS, FEATURES, PEOPLE, TABLE) + _corr(PROFILE_COLUMNS, "feature_table"),
    "histogram": _with(PEOPLE) + """, ends AS (SELECT min("AHI") AS lo, max("AHI") AS hi,
        least(8, greatest(3, count(DISTINCT "AHI"))) AS bins FROM people),
        spots AS (SELECT least(floor(("AHI" - lo) / ((hi - lo) / bins)), bins - 1) AS b FROM people, ends WHERE "AHI" IS NOT NULL)
        SELECT g.bin::INT AS bin, lo + g.bin * ((hi - lo) / bins) AS bin_low, lo + (g.bin + 1) * ((hi - lo) / bins) AS bin_high,
          (SELECT count(*) FROM spots WHERE b = g.bin) AS n
        FROM ends, (SELECT unnest(range(8)) AS bin) g WHERE g.bin < bins""",
    "class_counts": _with(PEOPLE) + """SELECT c.label, count(l."SID") AS n FROM (SELECT unnest([0, 1])::INT AS label) c
        LEFT JOIN labelled l ON l.sleep_deprivation_label = c.label GROUP BY 1""",
    "site_summary": _with(READINGS) + SITES,
    "merged_summary": _with(READINGS) + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS n, round(avg("{c}"), 6) AS mean, round(stddev_samp("{c}"), 6) AS std
        FROM readings""" for c in CORE
    ),
    "confusion_by_segment": _with(SCORED) + f"SELECT segment, {CELLS} FROM judged GROUP BY 1",
    "clinical_metrics": _with(SCORED) + f"""SELECT n, tp, tn, fp, fn, round({_share("tp", "tp + fn")}, 6) AS "Sensitivity",
        round({_share("tn", "tn + fp")}, 6) AS "Specificity", round({_share("tp", "tp + fp")}, 6) AS "PPV",
        round({_share("tn", "tn + fn")}, 6) AS "NPV", round({KAPPA}, 6) AS "Cohen_Kappa"
        FROM (SELECT {CELLS} FROM judged)""",
    "kappa": _with(SCORED) + f"""SELECT segment, round({KAPPA}, 6) AS "Cohen_Kappa"
        FROM (SELECT segment, {CELLS} FROM judged GROUP BY 1)""",
    "roc_auc": _with(SCORED) + f"""SELECT segment, round(auc, 9) AS "AUC_ROC" FROM ({_auc("judged", "segment", "y", "score")})""",
    "targets_met": _with(SCORED) + f""", m AS (SELECT n, {_share("tp", "tp + fn")} AS se, {_share("tn", "tn + fp")} AS sp,
        auc, {KAPPA} AS ka FROM (SELECT {CELLS} FROM judged), ({_auc("judged", "", "y", "score")}))
        SELECT n, measure, round(value, 6) AS value, minimum, target, value >= minimum AS meets_minimum,
          value >= target AS meets_target FROM (
          SELECT n, 'Sensitivity' AS measure, se AS value, 0.75::DOUBLE AS minimum, 0.85::DOUBLE AS target FROM m
          UNION ALL SELECT n, 'Specificity', sp, 0.70::DOUBLE, 0.80::DOUBLE FROM m
          UNION ALL SELECT n, 'AUC_ROC', auc, 0.80::DOUBLE, 0.88::DOUBLE FROM m
          UNION ALL SELECT n, 'Cohen_Kappa', ka, 0.60::DOUBLE, 0.70::DOUBLE FROM m)""",
    "model_metrics": _with(SESSIONS, PREDICTIONS, MODELS) + "SELECT * FROM board",
    "leaderboard": _with(SESSIONS, PREDICTIONS, MODELS) + """SELECT model_name, f1, accuracy, roc_auc FROM board
        ORDER BY f1 DESC, accuracy DESC, roc_auc DESC, model_name""",
    "leaderboard_view": _with(SESSIONS, PREDICTIONS, MODELS) + """SELECT model_name AS name, accuracy, precision, recall,
        f1 AS "f1Score", roc_auc AS "aucRoc", 0.0::DOUBLE AS "trainTime", model_name = 'knn' AS "isActive" FROM board""",
    "risk_bands": _with(PREDICTIONS) + """SELECT
        CASE WHEN probability < 0.3 THEN 'LOW RISK' WHEN probability < 0.65 THEN 'MODERATE RISK'
          WHEN probability IS NOT NULL THEN 'HIGH RISK' END AS task_band,
        CASE WHEN probability >= 0.7 THEN 'high' WHEN probability >= 0.4 THEN 'moderate'
          WHEN probability IS NOT NULL THEN 'low' END AS dashboard_band,
        CASE WHEN floor(probability * 100) < 50 OR l_linenumber = 1 THEN 'high' WHEN floor(probability * 100) < 70 THEN 'moderate'
          ELSE 'low' END AS quality_band,
        CASE WHEN probability >= 0.5 THEN 'Likely sleep deprivation / sleep-disordered breathing risk'
          WHEN probability < 0.5 THEN 'No strong sleep deprivation signal' END AS decision,
        count(*) AS n FROM predictions GROUP BY 1, 2, 3, 4""",
    "sleep_efficiency": _with(READINGS, FEATURES) + f'SELECT "SID", round({EFFICIENCY}, 6) AS sleep_efficiency FROM features',
    "stage_percents": _with(READINGS, FEATURES) + 'SELECT "SID", ' + ", ".join(
        f'round_even("sleep_stage_pct_{c}" * 100, 0)::INT AS {n}'
        for n, c in (("wake", "W"), ("n1", "N1"), ("n2", "N2"), ("n3", "N3"), ("rem", "R"))
    ) + " FROM features",
    "recommendations": _rules(rules.SERVICE_RULES, rules.SERVICE_DEFAULT, READINGS, FEATURES, source="features"),
    "recommendations_ui": _rules(
        rules.UI_RULES, None, READINGS, FEATURES,
        f"""shown AS (SELECT "SID", event_rate, "HR_mean", {EFFICIENCY} AS sleep_efficiency,
        round_even("sleep_stage_pct_N3" * 100, 0) AS n3, round_even("sleep_stage_pct_R" * 100, 0) AS rem FROM features)""",
        source="shown", columns='"SID", pos, code, severity',
    ),
    "latest_prediction": _with(PREDICTIONS, LATEST) + "SELECT session_id, model_name, prediction, probability, l_linenumber FROM latest",
    "trend7": _with(SESSIONS, PREDICTIONS) + f""", recent AS (
        SELECT user_id, sid, s.created_at AS session_at, probability,
          row_number() OVER (PARTITION BY user_id ORDER BY s.created_at DESC, session_id DESC, {NEWEST.replace("created_at", "p.created_at")}) AS back
        FROM sessions s JOIN predictions p ON s.id = p.session_id WHERE probability IS NOT NULL AND user_id IS NOT NULL
        QUALIFY back <= 7)
        SELECT user_id, (count(*) OVER (PARTITION BY user_id) - back + 1)::INT AS day, sid,
          strftime(session_at, '%Y-%m-%dT%H:%M:%S') AS date, probability,
          CASE WHEN probability < 0.3 THEN 'LOW RISK' WHEN probability < 0.65 THEN 'MODERATE RISK' ELSE 'HIGH RISK' END AS label
        FROM recent""",
    "trend_change": _with(SESSIONS, PREDICTIONS) + f""", seen AS (
        SELECT user_id, session_id, l_linenumber, l_partkey, l_suppkey, probability,
          avg(probability) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trend_score,
          avg(probability) OVER (w ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS previous
        FROM sessions s JOIN predictions p ON s.id = p.session_id WHERE probability IS NOT NULL AND user_id IS NOT NULL
        WINDOW w AS (PARTITION BY user_id ORDER BY s.created_at, session_id, {NEWEST.replace("created_at", "p.created_at").replace(" DESC", "")}))
        SELECT user_id, session_id, l_linenumber, l_partkey, l_suppkey, probability, trend_score,
          trend_score - previous AS trend_change FROM seen""",
    "page": _with(SESSIONS) + """SELECT id, sid, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM sessions
        ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""",
    "dashboard_sessions": BOARD + """SELECT * EXCLUDE (created_at, hr_impact, eda_impact) REPLACE (round("HR_std", 6) AS "HR_std",
        round(sleep_efficiency, 6) AS sleep_efficiency) FROM dashboard""",
    "session_detail": BOARD + """SELECT sid, "riskLevel", status, n3, event_rate,
        CASE WHEN hr_impact IS NULL THEN 0 ELSE 2 END::INT AS impacts, hr_impact AS first_impact FROM dashboard""",
    "dashboard_summary": BOARD + """SELECT round(avg("riskProbability"), 6) AS "avgRisk", round(avg(sleep_efficiency), 6) AS "avgEfficiency",
        round(avg(n3), 6) AS "avgDeepSleep", count(*) AS "totalSessions",
        strftime(max(created_at), '%Y-%m-%dT%H:%M:%S') AS "lastSessionDate" FROM dashboard""",
    "patient_rollup": _with(*BOARD_SOURCES, USERS, ROLLUP) + "SELECT * FROM rollup_rows",
    "cohort_kpis": _with(*BOARD_SOURCES, USERS, ROLLUP) + """SELECT count(*) AS total, count(*) FILTER ("riskLevel" = 'high') AS high,
        count(*) FILTER ("riskLevel" = 'moderate') AS moderate, count(*) FILTER ("riskLevel" = 'low') AS low FROM rollup_rows""",
    "scoped_listing": _with(SESSIONS) + "SELECT id, sid, user_id, status FROM sessions WHERE user_id = 7",
    "search": _with(USERS) + """SELECT id, name, email FROM users WHERE contains(lower(name), 'r#00000001') OR contains(email, 'r#00000001')""",
    "new_predictions": _with(SESSIONS, PREDICTIONS) + """SELECT id AS session_id, sid FROM sessions
        WHERE id NOT IN (SELECT session_id FROM predictions WHERE prediction IS NOT NULL)""",
    "reject_existing": _with(SESSIONS) + """SELECT DISTINCT 'S' || (l_partkey * 100) AS sid FROM lineitem
        WHERE 'S' || (l_partkey * 100) NOT IN (SELECT sid FROM sessions)""",
    "session_report": _with(SESSIONS, PREDICTIONS) + f""", own AS (SELECT * FROM predictions WHERE prediction = 1
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY {NEWEST}) = 1)
        SELECT session_id, 'own' AS origin, probability FROM own
        UNION ALL SELECT id, 'shared', 0.0::DOUBLE FROM sessions WHERE id NOT IN (SELECT session_id FROM own)""",
    "inference_rows": _with(READINGS, FEATURES, PEOPLE) + """SELECT f."SID", records, "HR_mean", "AGE", "BMI", "Arousal Index"
        FROM features f JOIN people p USING ("SID") WHERE f."SID" IN (SELECT 'S' || user_id FROM events WHERE event_type = 'purchase')""",
    "missing_requests": """SELECT DISTINCT 'S' || o_custkey AS "SID", 'features' AS missing_in FROM orders
        WHERE o_custkey NOT IN (SELECT user_id FROM events)
        UNION ALL SELECT DISTINCT 'S' || o_custkey, 'participants' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "scored_decisions": """SELECT 'D' || doc_id AS "SID", (n_chars >= 2500)::INT AS prediction,
        CASE WHEN n_chars >= 2500 THEN 'Likely sleep deprivation / sleep-disordered breathing risk'
          ELSE 'No strong sleep deprivation signal' END AS prediction_label,
        CASE WHEN n_chars < 1500 THEN 'LOW RISK' WHEN n_chars < 3250 THEN 'MODERATE RISK' ELSE 'HIGH RISK' END AS risk
        FROM documents""",
    "top_features": _with(PREDICTIONS) + """SELECT pos, feature, count(*) AS n, max(impact)::DOUBLE AS largest, sum(impact)::DOUBLE AS total FROM (
          SELECT feature, impact, (row_number() OVER (PARTITION BY row ORDER BY impact DESC, feature) - 1)::INT AS pos FROM (
            SELECT row, unnest(['HR_mean', 'EDA_std']) AS feature, unnest([hr_impact, eda_impact]) AS impact
            FROM (SELECT *, row_number() OVER () AS row FROM predictions) WHERE hr_impact IS NOT NULL))
        GROUP BY 1, 2""",
    "importance": _with(PREDICTIONS) + """SELECT 'HR_mean' AS feature, round(avg(hr_impact), 6) AS mean_abs_impact FROM predictions
        UNION ALL SELECT 'EDA_std', round(avg(eda_impact), 6) FROM predictions""",
    "downsample": _with(READINGS) + """SELECT "SID", reading_id, "HR", "EDA" FROM readings
        QUALIFY (row_number() OVER (PARTITION BY "SID" ORDER BY ts, reading_id) - 1) % 5 = 0""",
    "hypnogram": _with(READINGS, EPOCHS.replace("{step}", "5 minutes")) + """SELECT "SID", strftime(start, '%Y-%m-%d %H:%M:%S') AS start, stage,
        CASE stage WHEN 'W' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 WHEN 'R' THEN 4 END::INT AS code FROM epochs""",
    "minute_series": _with(READINGS) + """SELECT "SID", strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS ts, """ + ", ".join(
        f'avg("{c}") AS "{c}"' for c in CHANNELS
    ) + " FROM readings GROUP BY 1, 2",
    "stage_runs": _with(READINGS, EPOCHS.replace("{step}", "1 day")) + """, marked AS (
        SELECT *, CASE WHEN lag(stage) OVER w = stage AND lag(start) OVER w + INTERVAL 1 DAY = start THEN 0 ELSE 1 END AS fresh
        FROM epochs WINDOW w AS (PARTITION BY "SID" ORDER BY start)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY "SID" ORDER BY start) AS run FROM marked)
        SELECT "SID", stage, strftime(min(start), '%Y-%m-%d %H:%M:%S') AS start,
          strftime(max(start) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS epochs
        FROM numbered GROUP BY "SID", run, stage""",
    "night_index": _with(READINGS, NIGHTS) + """SELECT "SID", strftime(night, '%Y-%m-%d') AS night, night_index, records, event_rate FROM nights""",
    "night_sequences": _with(READINGS, NIGHTS, PEOPLE, SEQUENCES) + """SELECT c."SID", c.night_index, c.sleep_deprivation_label,
        (p.rn - c.rn + 7)::INT AS pos, p."HR_mean", p."EDA_std", p."BVP_mean", p."TEMP_mean", p.event_rate,
        p."sleep_stage_pct_N3", p."sleep_stage_pct_R", p."sleep_stage_pct_W"
        FROM complete c JOIN complete p ON p."SID" = c."SID" AND p.rn BETWEEN c.rn - 7 AND c.rn - 1 WHERE c.rn > 7""",
    "status_normalise": _with(RAW_SESSIONS) + """SELECT id, CASE WHEN k % 3 = 0 THEN 'S' || k ELSE id END AS sid,
        CASE WHEN k % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN k % 8 = 0 THEN '2001-01-01' ELSE '2024-01-01' END AS date,
        minutes AS duration, risk AS "riskProbability",
        CASE WHEN k % 10 = 0 THEN 'high' WHEN k % 10 = 2 THEN 'low' WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.4 THEN 'moderate'
          ELSE 'low' END AS "riskLevel",
        CASE WHEN k % 2 = 0 THEN 'processing' ELSE 'completed' END AS status, (c % 30)::DOUBLE AS n3,
        CASE WHEN k % 7 = 0 THEN c % 150 ELSE least(c % 130, 100) END::DOUBLE AS sleep_efficiency
        FROM (SELECT *, least(CASE WHEN k % 6 = 0 THEN 0 WHEN k % 6 < 4 THEN (c % 200) / 128 ELSE (c % 120) / 100 END, 1)::DOUBLE AS risk FROM raw)
        WHERE trim(id) <> ''""",
    "duration_parse": _with(RAW_SESSIONS) + "SELECT duration, minutes, count(*) AS n FROM raw GROUP BY 1, 2",
    "safe_json": _with(PREDICTIONS) + """SELECT session_id, sum(CASE WHEN hr_impact IS NULL THEN 0 ELSE 2 END)::BIGINT AS entries,
        max(hr_impact) AS largest FROM predictions GROUP BY 1""",
    "hm_text": _with(SESSIONS) + """SELECT id, m AS minutes, (m // 60) || 'h ' || (m % 60) || 'm' AS shown
        FROM (SELECT id, floor(coalesce(duration_seconds, 0) / 60)::INT AS m FROM sessions)""",
    "live_derive": _with(MESSAGES) + "SELECT event_id, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in CHANNELS) + " FROM live",
    "live_rejects": _with(MESSAGES) + """SELECT CASE kind WHEN 0 THEN 'notjson' ELSE '{"bpm":null}' END AS value, count(*) AS n
        FROM msgs WHERE ok = 0 GROUP BY 1""",
    "live_impute_bins": _with(READINGS, MESSAGES) + """, bins AS (SELECT floor("HR" / 5)::BIGINT AS b, avg("EDA") AS e, avg("TEMP") AS t,
        avg("BVP") AS v FROM readings WHERE "HR" IS NOT NULL AND "EDA" IS NOT NULL AND "TEMP" IS NOT NULL AND "BVP" IS NOT NULL GROUP BY 1)
        SELECT event_id, round(coalesce(e, "EDA"), 6) AS "EDA", round(coalesce(t, "TEMP"), 6) AS "TEMP",
          round(coalesce(v, "BVP"), 6) AS "BVP", e IS NOT NULL AS imputed
        FROM live LEFT JOIN bins ON bpm > 0 AND b = floor(bpm / 5)::BIGINT""",
    "gated_live": _with(MESSAGES) + """SELECT 'REC' || c_custkey AS "SID", event_id, round(bpm, 6) AS "HR"
        FROM live JOIN customer ON c_custkey = user_id
        WHERE ts >= TIMESTAMP '2024-01-01' + to_days((c_custkey % 20)::INT)
          AND (c_nationkey % 5 = 0 OR ts < TIMESTAMP '2024-01-11' + to_days((c_custkey % 20)::INT))""",
    "live_payload": _with(MESSAGES) + """SELECT event_id, round("HR", 6) AS "HR", round("EDA", 6) AS "EDA",
        strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM live""",
    "stream_features": _with(READINGS) + f"""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d 00:00:00') AS start,
        strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d 00:00:00') AS "end", "SID", count(*) AS records, {STAT}, {COUNTS}, {RATE}, {SHARES}
        FROM readings GROUP BY "SID", CAST(ts AS DATE)""",
    "live_vitals": _with(READINGS) + """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start,
        strftime(date_trunc('minute', ts) + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", "SID", count(*) AS n, """
    + ", ".join(f'avg("{c}") AS "{c}"' for c in CHANNELS)
    + """ FROM readings GROUP BY "SID", date_trunc('minute', ts)""",
    "live_vitals_sliding": _with(READINGS) + """SELECT "SID", strftime(opens, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, """
    + ", ".join(f'avg("{c}") AS "{c}"' for c in CHANNELS)
    + """ FROM (SELECT *, unnest([date_trunc('minute', ts) - to_minutes(i) for i in range(5)]) AS opens FROM readings)
        GROUP BY "SID", opens""",
    "stream_sessions": _with(READINGS) + """, marked AS (SELECT "SID", ts,
          CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh
          FROM readings WINDOW w AS (PARTITION BY "SID" ORDER BY ts)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY "SID" ORDER BY ts) AS run FROM marked)
        SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS "end",
          "SID", count(*) AS records FROM numbered GROUP BY "SID", run""",
    "stream_dedup": "SELECT event_id, 'sensor/S' || user_id || '/hr' AS topic FROM events",
    "pivot_channels": _with(READINGS) + """SELECT 'S' || user_id AS "SID", strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start,
        max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click,
        max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'signup') AS signup,
        max(value) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id, date_trunc('hour', ts)""",
    "stream_recording": _with(READINGS, MESSAGES) + """, bins AS (SELECT floor("HR" / 5)::BIGINT AS b, avg("EDA") AS e, avg("TEMP") AS t,
        avg("BVP") AS v FROM readings WHERE "HR" IS NOT NULL AND "EDA" IS NOT NULL AND "TEMP" IS NOT NULL AND "BVP" IS NOT NULL GROUP BY 1)
        SELECT 'REC' || c_custkey AS "SID", count(*) AS records, round(avg(coalesce(v, "BVP")), 6) AS "BVP", avg("ACC_X") AS "ACC_X",
          avg("ACC_Y") AS "ACC_Y", avg("ACC_Z") AS "ACC_Z", round(avg(coalesce(t, "TEMP")), 6) AS "TEMP",
          round(avg(coalesce(e, "EDA")), 6) AS "EDA", round(avg(bpm), 6) AS "HR", round(avg("IBI"), 6) AS "IBI"
        FROM live JOIN customer ON c_custkey = user_id LEFT JOIN bins ON bpm > 0 AND b = floor(bpm / 5)::BIGINT
        WHERE ts >= TIMESTAMP '2024-01-01' + to_days((c_custkey % 20)::INT)
          AND (c_nationkey % 5 = 0 OR ts < TIMESTAMP '2024-01-11' + to_days((c_custkey % 20)::INT)) GROUP BY c_custkey""",
    "stream_payload": _with(MESSAGES) + """SELECT 'REC' || c_custkey AS "SID", round("HR", 6) AS "HR", round("EDA", 6) AS "EDA",
        round("TEMP", 6) AS "TEMP", round("BVP", 6) AS "BVP", strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM live JOIN customer ON c_custkey = user_id
        WHERE ts >= TIMESTAMP '2024-01-01' + to_days((c_custkey % 20)::INT)
          AND (c_nationkey % 5 = 0 OR ts < TIMESTAMP '2024-01-11' + to_days((c_custkey % 20)::INT))""",
    "session_state": """WITH changes AS (SELECT 'S' || l_orderkey AS sid, CASE WHEN l_linenumber <= 2 THEN 'recording'
          WHEN l_linenumber <= 4 THEN 'processing' WHEN l_linenumber = 5 THEN 'failed' ELSE 'complete' END AS status,
          l_shipdate AS moment, l_linenumber::BIGINT * 100000000 + l_partkey AS seq FROM lineitem)
        SELECT sid, first(status ORDER BY moment DESC, seq DESC) AS status,
          strftime(max(moment) FILTER (status = 'recording'), '%Y-%m-%d %H:%M:%S') AS started_at,
          strftime(max(moment) FILTER (status IN ('complete', 'failed')), '%Y-%m-%d %H:%M:%S') AS ended_at,
          count(*) AS changes FROM changes GROUP BY 1""",
    "stream_stale": """SELECT 'S' || user_id AS "SID", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
        epoch_ms(max(ts)) + 432000000 <= (SELECT epoch_ms(max(ts)) FROM events) AS stale FROM events GROUP BY 1""",
    "stream_completion": _with(READINGS, PEOPLE, SESSIONS) + """SELECT id AS session_id, 1::BIGINT AS scored, true AS decided, 3::INT AS impacts
        FROM sessions WHERE status = 'complete' AND id % 2 <> 0
          AND sid IN (SELECT "SID" FROM readings) AND sid IN (SELECT "SID" FROM people)""",
    "last_seen": """SELECT 'S' || user_id AS "SID", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
        floor(epoch(max(ts))) < epoch(TIMESTAMP '2024-01-31') - 86400 AS stale FROM events GROUP BY 1""",
    "stratified_split": _with(PEOPLE) + """, drawn AS (SELECT "SID", sleep_deprivation_label, md5("SID" || '#42') AS draw FROM labelled)
        SELECT "SID", sleep_deprivation_label,
          row_number() OVER (PARTITION BY sleep_deprivation_label ORDER BY draw, "SID")
          <= floor(count(*) OVER (PARTITION BY sleep_deprivation_label) * 0.4::DOUBLE + 0.5) AS is_test FROM drawn""",
}


def _drawn(turn: int, count: str, rest: str, seed: int) -> str:
    """Adds ``b<turn>``: the binomial draw of ``count`` of ``rest`` in what the draws before left (``left_n``)."""
    before = "cells" if turn == 0 else f"drawn{turn - 1}"
    u = f"('0x' || substr(md5('{seed}#' || replicate || '#{turn}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"""
asked{turn} AS (SELECT *, CASE WHEN {rest} > 0 THEN {count}::DOUBLE / ({rest}) ELSE 0 END AS p, {u} AS u FROM {before}),
steps{turn} AS (SELECT segment, replicate, u, k, sum(CASE WHEN k = 0 THEN 0 ELSE ln((left_n - k + 1)::DOUBLE / k) + ln(p / (1 - p)) END)
  OVER (PARTITION BY segment, replicate ORDER BY k) AS w
  FROM (SELECT segment, replicate, left_n, p, u, unnest(range(0, left_n + 1)) AS k FROM asked{turn} WHERE p > 0 AND p < 1 AND left_n > 0)),
found{turn} AS (SELECT segment, replicate, count(*) FILTER (upto / total <= u) AS b FROM (
  SELECT segment, replicate, u, sum(x) OVER (PARTITION BY segment, replicate ORDER BY k) AS upto, sum(x) OVER (PARTITION BY segment, replicate) AS total
  FROM (SELECT *, exp(w - max(w) OVER (PARTITION BY segment, replicate)) AS x FROM steps{turn})) GROUP BY 1, 2),
drawn{turn} AS (SELECT * EXCLUDE (p, u, b, left_n), b AS b{turn}, left_n - b AS left_n FROM (
  SELECT a.*, CASE WHEN left_n = 0 OR p <= 0 THEN 0 WHEN p >= 1 THEN left_n ELSE f.b END AS b
  FROM asked{turn} a LEFT JOIN found{turn} f USING (segment, replicate)))"""


def _bootstrap(segment: str, seed: int, top: str, other: str) -> str:
    """The interval of ``top`` among ``top`` and ``other``, both of b0 (tp), b1 (tn), b2 (fp), left_n (fn)."""
    return f""", cells AS (SELECT *, n AS left_n, unnest(range(0, 1000)) AS replicate FROM (SELECT {segment} AS segment, {CELLS} FROM judged GROUP BY 1)),
{_drawn(0, "tp", "n", seed)},{_drawn(1, "tn", "n - tp", seed)},{_drawn(2, "fp", "n - tp - tn", seed)},
scores AS (SELECT segment, CASE WHEN {top} + {other} = 0 THEN 0.0::DOUBLE ELSE ({top})::DOUBLE / ({top} + {other}) END AS score FROM drawn2),
ends AS (SELECT segment, count(*) AS replicates, round(quantile_cont(score, 0.025), 4) AS ci_low, round(quantile_cont(score, 0.975), 4) AS ci_high
  FROM scores GROUP BY 1)
"""


ORACLES["bootstrap_ci"] = _with(SCORED) + _bootstrap("segment", 42, "b0", "left_n") + "SELECT * FROM ends"
ORACLES["clinical_report"] = f"""SELECT n AS "N", tp AS "TP", tn AS "TN", fp AS "FP", fn AS "FN",
  round_even({_share("tp", "tp + fn")}, 4) AS "Sensitivity", round_even({_share("tn", "tn + fp")}, 4) AS "Specificity",
  round_even({_share("tp", "tp + fp")}, 4) AS "PPV", round_even({_share("tn", "tn + fn")}, 4) AS "NPV",
  round_even(auc, 4) AS "AUC_ROC", round_even({KAPPA}, 4) AS "Cohen_Kappa", se.ci_low AS "Sensitivity_low", se.ci_high AS "Sensitivity_high",
  sp.ci_low AS "Specificity_low", sp.ci_high AS "Specificity_high"
FROM ({_with(SCORED)} SELECT {CELLS} FROM judged) c, ({_with(SCORED)} SELECT auc FROM ({_auc("judged", "", "y", "score")})) a,
  ({_with(SCORED)}{_bootstrap("1", 42, "b0", "left_n")} SELECT * FROM ends) se, ({_with(SCORED)}{_bootstrap("1", 43, "b1", "b2")} SELECT * FROM ends) sp"""
ORACLES["stream_gated"] = ORACLES["gated_live"]


_KIND = "substr(\"SID\", 2)::INT % 3"
ORACLES["read_recordings"] = _with(READINGS) + f"""SELECT "SID", count(*) AS records, count(CASE WHEN {_KIND} < 2 THEN ts END) AS times,
  count(CASE WHEN {_KIND} <> 1 THEN "Sleep_Stage" END) AS stages, any_value({_KIND}) <> 1 AS stage_present,
  """ + ", ".join(f'count(CASE WHEN {_KIND} = 0 {"OR " + _KIND + " = 1" if c == EVENTS[0] else ""} THEN "{c}" END) AS "{c}_count"' for c in EVENTS) + ", " + ", ".join(
    f'round(sum(CASE WHEN {_KIND} < 2 {"OR true" if c in ("HR", "EDA", "BVP") else ""} THEN "{c}" END), 6) AS "{c}"' for c in CHANNELS
) + """ FROM readings GROUP BY "SID" """
ORACLES["preprocess_files"] = ORACLES["feature_table"]
ORACLES["participants_file"] = ORACLES["participants_clean"]
ORACLES["external_participants"] = _with(PEOPLE) + """SELECT "SID", "AGE", "GENDER", NULL::DOUBLE AS "BMI", "AHI", "Mean_SaO2", "Sleep_Disorders" FROM people"""
ORACLES["harmonise_files"] = _with(READINGS) + """SELECT coalesce("Sleep_Stage", 'W') AS "Sleep_Stage", count(*) AS n, round(sum("EDA"), 6) AS "EDA", count("IBI") AS ibi, 1::BIGINT AS refused
  FROM readings WHERE reading_id % 3 <> 0 GROUP BY 1"""
ORACLES["service_files"] = _with(SESSIONS, PREDICTIONS) + """SELECT CASE WHEN user_id % 41 = 0 THEN 'admin' WHEN user_id % 40 = 0 THEN 'clinician' ELSE 'patient' END AS role,
  status, count(*) AS sessions, sum(n)::BIGINT AS scored FROM sessions LEFT JOIN (SELECT session_id, count(prediction) AS n FROM predictions GROUP BY 1) ON session_id = id
  WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY 1, 2"""
ORACLES["leaderboard_files"] = _with(SESSIONS, PREDICTIONS, MODELS) + """SELECT model_name, accuracy, f1, precision,
  CASE WHEN model_name <> 'knn' THEN recall END AS recall, roc_auc FROM board"""
ORACLES["report_files"] = f"""SELECT "N"::DOUBLE AS "N", "Sensitivity", "AUC_ROC", "Sensitivity_low" || '–' || "Sensitivity_high" AS "Sensitivity_CI_95",
  "Sensitivity_low", "Sensitivity_high" FROM ({ORACLES["clinical_report"]})"""
ORACLES["stored_by_sid"] = """SELECT CASE WHEN n_chars >= 2500 THEN 7 ELSE 0 END::INT AS prediction, CASE WHEN n_chars >= 2500 THEN 'r1' ELSE 'r0' END AS run_id,
  count(*) AS n, (SELECT sum(1 + (n_chars >= 2500)::INT)::BIGINT FROM documents WHERE doc_id = 5) AS rows_of_one FROM documents GROUP BY 1, 2"""
_FILLED = _with(READINGS, FEATURES, PEOPLE, TABLE)
ORACLES["stored_profile"] = _FILLED + """, whole AS (SELECT unnest(map_entries(json_transform(to_json(f), '"MAP(VARCHAR, VARCHAR)"'))) AS e FROM feature_table f),
  by_column AS (SELECT e.key AS "column", count(e.value) AS held, count(*) AS n FROM whole GROUP BY 1)
  SELECT "column", CASE WHEN held > 0 OR "column" IN ('GENDER', 'MEDICAL_HISTORY', 'Sleep_Disorders') THEN n ELSE 0 END AS present,
    CASE WHEN held > 0 OR "column" IN ('GENDER', 'MEDICAL_HISTORY', 'Sleep_Disorders') THEN 0 ELSE n END AS missing_count, n AS rows FROM by_column"""
ORACLES["model_inputs"] = _FILLED + """SELECT count(*) AS rows, 54::INT AS inputs, true AS guarded, 'my_sleep_deprivation_truth' AS truth_column FROM feature_table"""
