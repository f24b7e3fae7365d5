"""Exact order statistics by counted cuts: a few passes, fixed-size aggregates, no sort.

The cells that may hold the wanted rank are cut at pivots, distinct values drawn by hash, and counted
between and at them. The piece that holds the rank is cut again, until it is one value or small
enough to be read. So a value that fills a column settles at once, and no task and no
driver ever holds a column. All columns are searched together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.functions.numeric import no_nan
from nocturne.runtime import cut_lineage

#: Cells that are read of one search, or of all if that is all there is.
READ = 10_000
#: Pivots of a cut.
PIVOTS = 128
#: Accuracy of the first brackets: about ``2 / ACCURACY`` of a column stays between them.
ACCURACY = 1_000


def pick_ranks(cells: DataFrame, ranks: dict[int, int]) -> dict[int, object]:
    """The value of each search's 0-based rank among its ``cells(search int, value)``; no NULL among them.

    A search without so many cells has no entry.
    """
    found: dict[int, object] = {}
    if not ranks:
        return found
    cells = cells.filter(F.col("search").isin(*ranks)).select("search", "value")
    few = cells.limit(READ + 1).collect()
    if len(few) <= READ:  # all there is
        held: dict[int, list] = {}
        for row in few:
            held.setdefault(row["search"], []).append(row["value"])
        return {s: sorted(held[s])[r] for s, r in ranks.items() if 0 <= r < len(held.get(s, ()))}
    sizes = {r["search"]: r["n"] for r in cells.groupBy("search").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = {s: r for s, r in ranks.items() if 0 <= r < sizes.get(s, 0)}
    while left:
        small = [s for s in left if sizes[s] <= READ]
        if small:
            read: dict[int, list] = {}
            for row in cells.filter(F.col("search").isin(*small)).select("search", "value").collect():
                read.setdefault(row["search"], []).append(row["value"])
            for s in small:
                found[s] = sorted(read[s])[left.pop(s)]
        if not left:
            break
        cells = cut_lineage(cells.filter(F.col("search").isin(*left)))
        hashed = F.xxhash64("value")
        drawn = cells.groupBy("search", F.pmod(hashed, F.lit(PIVOTS)).alias("slot")).agg(F.min_by("value", hashed).alias("value"))
        sets = drawn.groupBy("search").agg(F.array_sort(F.collect_set("value")).alias("pivots"))  # at most PIVOTS of a search
        placed = cells.join(F.broadcast(cut_lineage(sets)), "search")
        below = F.size(F.filter("pivots", lambda p: p < F.col("value")))
        piece = 2 * below + F.array_contains("pivots", F.col("value")).cast("int")
        placed = placed.select("search", "value", piece.alias("piece"))
        counts: dict[int, list] = {}
        for row in placed.groupBy("search", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least")).collect():
            counts.setdefault(row["search"], []).append((row["piece"], row["n"], row["least"]))
        kept = F.lit(False)
        for s, pieces in counts.items():
            for number, n, least in sorted(pieces):
                if left[s] < n:
                    if number % 2:  # at a pivot: all its cells are equal
                        found[s] = least
                        del left[s]
                    else:
                        kept |= (F.col("search") == s) & (F.col("piece") == number)
                        sizes[s] = n
                    break
                left[s] -= n
        cells = placed.filter(kept).select("search", "value")
    return found


def _searches(cell: Column, brackets: list[tuple[int, object, object]]) -> list[Column]:
    return [
        F.when(cell.between(F.lit(low), F.lit(high)), F.struct(F.lit(s).alias("search"), cell.alias("value")))
        for s, low, high in brackets
    ]


def quantiles(df: DataFrame, columns: list[str], points: list[float]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of numeric columns, missing cells ignored; None for an empty column."""
    if not columns:
        return {}
    cells = [no_nan(F.col(f"`{c}`").cast("double")) for c in columns]
    near = [min(max(p + d, 0.0), 1.0) for p in points for d in (-2 / ACCURACY, 2 / ACCURACY)]
    first = df.agg(
        *[F.count(x).alias(f"n{i}") for i, x in enumerate(cells)],
        *[F.percentile_approx(x, near, ACCURACY).alias(f"q{i}") for i, x in enumerate(cells)],
        *[F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias(f"e{i}") for i, x in enumerate(cells)],
    ).first()
    spots = {(i, j): (first[f"n{i}"] - 1) * p for i in range(len(cells)) for j, p in enumerate(points) if first[f"n{i}"]}
    wanted = {key: sorted({math.floor(x), math.ceil(x)}) for key, x in spots.items()}
    spans = {(i, j): (first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1]) for i, j in wanted}
    if not wanted:
        return {c: [None] * len(points) for c in columns}
    counted = df.agg(
        *[F.count_if(cells[i] < F.lit(low)).alias(f"b{i}_{j}") for (i, j), (low, _) in spans.items()],
        *[F.count_if(cells[i] <= F.lit(high)).alias(f"u{i}_{j}") for (i, j), (_, high) in spans.items()],
    ).first()
    ranks, brackets, of = {}, {}, {}
    for key, places in wanted.items():
        i, j = key
        low, high = spans[key]
        below = counted[f"b{i}_{j}"]
        if below > places[0] or counted[f"u{i}_{j}"] <= places[-1]:  # the brackets missed: the whole column
            (low, high), below = first[f"e{i}"], 0
        for place in places:
            s = len(ranks)
            ranks[s], of[key, place] = place - below, s
            brackets.setdefault(i, []).append((s, low, high))
    settled = {s: low for held in brackets.values() for s, low, high in held if low == high}
    open_ = [c for i, held in brackets.items() for c in _searches(cells[i], [b for b in held if b[0] not in settled])]
    found = dict(settled)
    if open_:
        spread = df.select(F.explode(F.array_compact(F.array(*open_))).alias("cell")).select("cell.search", "cell.value")
        found |= pick_ranks(spread, {s: r for s, r in ranks.items() if s not in settled})
    out: dict[str, list[float | None]] = {c: [None] * len(points) for c in columns}
    for (i, j), x in spots.items():
        low, high = (found[of[(i, j), place]] for place in (wanted[i, j][0], wanted[i, j][-1]))
        out[columns[i]][j] = low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high
    return out
