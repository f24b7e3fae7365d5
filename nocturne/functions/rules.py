"""Recommendation rules as tables of (code, condition, message, severity)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from nocturne.functions.numeric import holds


class Rule(NamedTuple):
    code: str
    condition: str
    message: str
    severity: str


# Thresholds and texts users see.
SERVICE_RULES = (
    Rule(
        "low_deep_sleep", "sleep_stage_pct_N3 < 0.10D",
        "Deep sleep (N3) was below 10%. Consider reducing evening caffeine (after 2pm) "
        "and maintaining a consistent sleep schedule.", "warning",
    ),
    Rule(
        "elevated_apnea_rate", "event_rate > 0.05D",
        "Apnea event rate is elevated. A sleep clinic referral for PSG confirmation is "
        "recommended.", "critical",
    ),
    Rule(
        "high_nocturnal_hr", "HR_mean > 75D",
        "Resting heart rate during sleep was above 75 bpm. Evening breathing exercises "
        "or a 10-minute wind-down routine may help.", "info",
    ),
    Rule(
        "high_arousal", "EDA_std > 0.5D",
        "Electrodermal activity variability was high, indicating frequent arousal. "
        "Review bedroom temperature and noise exposure.", "warning",
    ),
    Rule(
        "low_rem", "sleep_stage_pct_R < 0.15D",
        "REM sleep was below 15%. Alcohol within 3 hours of bed is a common REM suppressant.",
        "info",
    ),
    Rule(
        "high_wake", "sleep_stage_pct_W > 0.15D",
        "More than 15% of the night was spent awake. Sleep restriction therapy "
        "or CBT-I may be beneficial.", "warning",
    ),
)
SERVICE_DEFAULT = Rule(
    "normal", "true",
    "Sleep metrics are within normal ranges. Keep up the good sleep habits!", "ok",
)
UI_RULES = (
    Rule(
        "ui_low_deep_sleep", "n3 < 10",
        "⚠️ Deep sleep (N3) was below 10% — consider reducing evening caffeine intake", "warning",
    ),
    Rule(
        "ui_event_rate", "event_rate > 0.05D",
        "⚠️ Elevated apnea event rate detected — sleep clinic referral recommended", "warning",
    ),
    Rule(
        "ui_heart_rate", "HR_mean > 75D",
        "💡 Resting heart rate elevated — evening relaxation exercises may help", "info",
    ),
    Rule(
        "ui_efficiency", "sleep_efficiency > 90D",
        "✅ Excellent sleep efficiency — maintain current sleep hygiene practices", "ok",
    ),
    Rule(
        "ui_low_rem", "rem < 12",
        "💡 REM sleep below optimal range — ensure 7-9 hours of total sleep time", "info",
    ),
)


def _entry(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.code).alias("code"),
        F.lit(rule.message).alias("message"),
        F.lit(rule.severity).alias("severity"),
    )


def advice(rules: tuple[Rule, ...] = SERVICE_RULES, default: Rule | None = SERVICE_DEFAULT) -> Column:
    """Array of the rules that fire, in table order; the default if none does."""
    fired = F.filter(
        F.array(*[F.when(holds(F.expr(r.condition)), _entry(r)) for r in rules]),
        lambda r: r.isNotNull(),
    )
    if default is None:
        return fired
    return F.when(F.size(fired) == 0, F.array(_entry(default))).otherwise(fired)
