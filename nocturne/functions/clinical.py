"""Labels and targets derived from clinical columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nocturne.functions.numeric import clamp, holds

# Clinical cut-offs, weights and search texts.
OAHI_CUT = 15
AHI_CUT = 15
AROUSAL_CUT = 30
DISORDER_PATTERN = "apnea|difficulty breathing|snoring"
HISTORY_TEXT = "sleep apnea"
HOURS_BASE, HOURS_LOW, HOURS_HIGH = 8.0, 6.0, 10.0


def apnea_flag(disorders: Column, history: Column) -> Column:
    named = F.lower(disorders).rlike(DISORDER_PATTERN)
    past = F.lower(history).contains(HISTORY_TEXT)
    return holds(named) | holds(past)


def heuristic_label(oahi: Column, ahi: Column, arousal: Column, flag: Column) -> Column:
    over = holds(oahi >= OAHI_CUT) | holds(ahi >= AHI_CUT) | holds(arousal >= AROUSAL_CUT)
    return (over | flag).cast("int")


def severity(oahi: Column, ahi: Column, arousal: Column, flag: Column) -> Column:
    """Ranking score; the numbers must already be filled."""
    return oahi + ahi + 0.5 * arousal + 10 * flag.cast("int")


def recommended_hours(bmi: Column, arousal: Column, ahi: Column, sao2: Column) -> Column:
    """Hours of sleep to recommend; the numbers must already be filled."""
    hours = HOURS_BASE + 0.02 * (bmi - 25) + 0.015 * arousal + 0.01 * ahi - 0.03 * (sao2 - 94)
    return clamp(hours, HOURS_LOW, HOURS_HIGH)


def truth_label(ahi: Column, oahi: Column) -> Column:
    """Stand-in for a clinical truth label; the numbers must already be filled."""
    return (holds(ahi >= AHI_CUT) | holds(oahi >= OAHI_CUT)).cast("int")
