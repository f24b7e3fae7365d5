"""Secret scan: known shapes, and sliding-window Shannon entropy per character class.

Known shapes are matched leftmost and without overlap. For each character class, runs of the
class that are long enough are candidates; a window moves over a run, and as it moves the
counts of one leaving and one entering character change, and with them the sum of
``c * log2(c)``, from which the entropy follows. A run is reported from the first to the last
window whose entropy reaches the class's threshold, unless the run matches the allow-list or
overlaps a known shape.

All of it is SQL expressions on one row; nothing is shuffled. Positions are code points, ends
exclusive; they follow from the lengths of matches and of the gaps between them.

Defined cases: null or empty text has no spans; a null text stays null when redacted.
Repeated rows: scanned each. Columns of the input are kept; those named like the added ones
are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """A pattern; ``value`` of its groups must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars``, a window's width and least entropy in bits, what a run must contain."""

    kind: str
    chars: str
    alphabet: str
    width: int
    threshold: float
    needs: tuple[str, ...]


#: The known shapes. Hex and access runs are maximal, so their least length is in the pattern.
SHAPES = (
    Shape(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        value=2,
        least=12,
    ),
    Shape("access", "AKIA[A-Z0-9]{14,}"),
    Shape("hex", "[0-9a-f]{16,}"),
)

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", "[0-9A-Fa-f]", "0123456789abcdef", 16, 2.8, ("[0-9]", "[A-Fa-f]")),
    CharClass("entropy_base64", "[A-Za-z0-9+/_=-]", _UPPER + _LOWER + _DIGITS + "+/_=-", 24, 3.9, ("[0-9]", "[A-Z]", "[a-z]")),
    CharClass("entropy_lower", "[a-z0-9]", _LOWER + _DIGITS, 24, 3.7, ("[0-9].*[a-z].*[0-9].*[a-z].*[0-9]",)),
)
#: Runs that look random but are not secrets: identifiers, samples, paths of plain words.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|redacted",
    r"^(?:[A-Za-z]+[/_=-])+[A-Za-z]+[0-9]*$",
    r"^[A-Za-z]+[0-9]+$",
)

_SPAN = "struct<start:int,turn:int,end:int,kind:string>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _found(text: Column, pattern: str, value: int = 0, least: int = 1) -> Column:
    """``array<struct(start, end, value)>`` of the matches whose value is long enough."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else matches
    pieces = F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(matches)).alias("g"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["g"])
        end = start + F.length(piece["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), piece["v"].alias("value")))
        held = F.when(F.length(piece["v"]) >= least, F.concat(state["held"], one)).otherwise(state["held"])
        return F.struct(end.alias("at"), held.alias("held"))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("held"))
    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step)["held"]).otherwise(empty)


def _weight(count: Column) -> Column:
    """``c * log2(c)``, 0 for 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def entropy_windows(run: Column, kind: CharClass) -> Column:
    """``struct(first, last)``: starts of the first and last window of ``run`` that reach the threshold, or nulls."""
    width, size = kind.width, len(kind.alphabet)
    text = F.lower(run) if kind.alphabet.islower() or kind.alphabet == "0123456789abcdef" else run
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.instr(F.lit(kind.alphabet), c) - 1)
    most = width * (math.log2(width) - kind.threshold)

    def over(codes: Column) -> Column:
        def step(state: Column, place: Column) -> Column:
            def moved(pair: Column) -> Column:
                came, left = pair["came"], pair["left"]
                leaving = F.when(left >= 0, F.get(state["counts"], left)).otherwise(F.lit(0))
                entering = F.get(state["counts"], came) - F.when(came == left, 1).otherwise(0)
                total = state["sum"] - _weight(leaving) + _weight(leaving - 1) - _weight(entering) + _weight(entering + 1)
                counts = F.transform(
                    state["counts"], lambda c, i: c + F.when(i == came, 1).otherwise(0) - F.when(i == left, 1).otherwise(0)
                )
                hit = (place >= width - 1) & (total <= most + 1e-9)
                return F.struct(
                    counts.alias("counts"),
                    total.alias("sum"),
                    F.when(hit & state["first"].isNull(), place - width + 1).otherwise(state["first"]).alias("first"),
                    F.when(hit, place - width + 1).otherwise(state["last"]).alias("last"),
                )

            left = F.when(place >= width, F.get(codes, place - width)).otherwise(F.lit(-1))
            return _let(F.struct(F.get(codes, place).alias("came"), left.alias("left")), moved)

        start = F.struct(
            F.array_repeat(F.lit(0), size).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(None).cast("int").alias("first"),
            F.lit(None).cast("int").alias("last"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return _let(codes, over)


def _random_runs(text: Column, kind: CharClass, turn: int, allowed: tuple[str, ...]) -> Column:
    """Spans of the class's runs that are random enough and not allowed."""
    runs = _found(text, f"{kind.chars}{{{kind.width},}}")

    def candidate(run: Column) -> Column:
        held = F.lit(True)
        for need in kind.needs:
            held = held & run["value"].rlike(need)
        for pattern in allowed:
            held = held & ~run["value"].rlike(pattern)
        return held

    def measured(run: Column) -> Column:
        return _let(
            entropy_windows(run["value"], kind),
            lambda w: F.struct(
                (run["start"] + w["first"]).alias("start"),
                F.lit(turn).alias("turn"),
                (run["start"] + w["last"] + kind.width).alias("end"),
                F.lit(kind.kind).alias("kind"),
            ),
        )

    return F.filter(F.transform(F.filter(runs, candidate), measured), lambda s: s["start"].isNotNull())


def _known(text: Column, shape: Shape, turn: int) -> Column:
    def span(match: Column) -> Column:
        return F.struct(match["start"].alias("start"), F.lit(turn).alias("turn"), match["end"].alias("end"), F.lit(shape.kind).alias("kind"))

    return F.transform(_found(text, shape.pattern, shape.value, shape.least), span)


def count(spans: str, kind: str) -> Column:
    """How many of ``spans`` are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(
    docs: DataFrame,
    shapes: tuple[Shape, ...] = SHAPES,
    classes: tuple[CharClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """``docs`` with ``known_spans`` and ``spans``, arrays of ``struct(start, turn, end, kind)`` by start, then turn."""
    text = F.coalesce("text", F.lit(""))
    known = [_known(text, shape, turn) for turn, shape in enumerate(shapes)]
    base = F.array_sort(F.concat(*known).cast(f"array<{_SPAN}>"))
    extra = [_random_runs(text, kind, len(shapes) + k, allowed) for k, kind in enumerate(classes)]
    scanned = docs.drop("known_spans", "spans", "random_spans").withColumn("known_spans", base).withColumn("random_spans", F.concat(*extra).cast(f"array<{_SPAN}>"))
    fresh = F.filter(
        "random_spans", lambda s: ~F.exists("known_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    return scanned.withColumn("spans", F.array_sort(F.concat("known_spans", fresh))).drop("random_spans")


def span_list(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[kind]``; overlapping spans become one, of the first kind."""
    columns = docs.columns
    scanned = scan(docs.select(F.struct("*").alias("row"), "text"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        gap = F.substring(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], gap, F.lit("["), span["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("text"))
    return scanned.select(*(clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns))
