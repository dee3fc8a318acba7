"""Exact quantiles (linear interpolation) of all columns together, exact and bounded on any table size.

Every pass reads the table once for all columns. On a plan whose estimated size is small, and whose counted rows are few,
values are dealt by column and sorted there. On a large one they would not fit one buffer, so the wanted order statistics are
bracketed instead: mergeable KLL sketches of all columns, from one scan, propose intervals; one scan counts exactly how many
values lie below, on and between the ends of all intervals; the intervals shrink by a factor of a hundred a round until few
enough values are left to sort. Ties of any size end in one round. Only counts and interval ends reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, plan_bytes

SMALL_PLAN_BYTES = 32 * 1024 * 1024
SMALL_ROWS = 5_000_000
#: Ranks found by a sketch are off by one in so many at most.
SKETCH_ACCURACY = 1500
GRID = 400
SORTABLE = 50_000

@dataclass
class Bracket:
    """One wanted order statistic: its rank, and the open interval (low, high) known to hold it.

    ``start`` values lie at or below ``low`` and ``inside`` values lie inside; both are counted, not estimated.
    A missing end means unbounded.
    """

    rank: int
    start: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None
    trial: tuple[float | None, float | None] = (None, None)

    def propose(self, grid: Sequence[float]) -> None:
        """Try a narrower interval: sketch values three sketch errors away from the wanted rank."""
        share = (self.rank - self.start + 0.5) / self.inside
        slack = 3.0 / SKETCH_ACCURACY + 1.0 / self.inside
        left, right = math.floor((share - slack) * GRID), math.ceil((share + slack) * GRID)
        self.trial = (grid[left] if left >= 0 else self.low, grid[right] if right <= GRID else self.high)

    def settle(self, under_low: int, upto_low: int, under_high: int, upto_high: int) -> bool:
        """Use the exact counts around the trial; True when the trial interval holds the rank."""
        low, high = self.trial
        if self.rank < under_low:
            self.high, self.inside = low, under_low - self.start
        elif self.rank < upto_low:
            self.value = low
        elif self.rank < under_high:
            self.low, self.high, self.start, self.inside = low, high, upto_low, under_high - upto_low
            return True
        elif self.rank < upto_high:
            self.value = high
        else:
            self.inside -= upto_high - self.start
            self.low, self.start = high, upto_high
        self.trial = (self.low, self.high)
        return False


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Small by the optimizer's estimate and, since files may be compressed well, by a count of the rows."""
    return plan_bytes(df) <= (SMALL_PLAN_BYTES if limit is None else limit) and df.count() <= SMALL_ROWS


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], small_bytes: int | None = None
) -> dict[str, list[float | None]]:
    """Interpolated quantiles per column; a column without values gives ``None``."""
    narrow = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    ranks = _sorted_ranks if is_small(narrow, small_bytes) else _refined_ranks
    found = ranks(narrow, len(columns), probabilities) if columns else []
    return {
        name: [None if n == 0 else _interpolate(values, p * (n - 1)) for p in probabilities]
        for name, (n, values) in zip(columns, found)
    }


def _interpolate(values: dict[int, float], place: float) -> float:
    low, high = math.floor(place), math.ceil(place)
    if low == high or values[low] == values[high]:
        return values[low]
    return (high - place) * values[low] + (place - low) * values[high]


def _ranks(n: int, probabilities: Sequence[float]) -> list[int]:
    return sorted({r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})


def _cells(df: DataFrame, width: int) -> DataFrame:
    """One row for each value that is present: the number of its column, ``i``, and the value, ``x``."""
    values = F.array(*[F.col(f"x{i}") for i in range(width)])
    return df.select(F.posexplode(values).alias("i", "x")).where("x IS NOT NULL")


def _sorted_ranks(df: DataFrame, width: int, probabilities: Sequence[float]) -> list[tuple[int, dict[int, float]]]:
    places = F.array(*[F.lit(float(p)) for p in probabilities])
    at = lambda rounded: F.transform(places, lambda p: F.get("ordered", rounded(p * (F.size("ordered") - 1)).cast("int")))
    ordered = _cells(df, width).groupBy("i").agg(F.sort_array(F.collect_list("x")).alias("ordered"))
    rows = {r["i"]: r for r in ordered.select("i", F.size("ordered").alias("n"), at(F.floor).alias("a"), at(F.ceil).alias("b")).collect()}
    found = []
    for i in range(width):
        n, values = (rows[i]["n"] if i in rows else 0), {}
        for p, a, b in zip(probabilities, rows[i]["a"], rows[i]["b"]) if n else ():
            values[math.floor(p * (n - 1))], values[math.ceil(p * (n - 1))] = a, b
        found.append((n, values))
    return found


def _refined_ranks(df: DataFrame, width: int, probabilities: Sequence[float]) -> list[tuple[int, dict[int, float]]]:
    columns = [a for i in range(width) for a in (F.count(f"x{i}").alias(f"n{i}"), _grid(F.col(f"x{i}")).alias(f"g{i}"))]
    first = df.agg(*columns).first()
    counts = [first[f"n{i}"] for i in range(width)]
    brackets = {i: [Bracket(rank, 0, counts[i]) for rank in _ranks(counts[i], probabilities)] if counts[i] else [] for i in range(width)}
    for i, wanted in brackets.items():
        for b in wanted:
            b.propose(first[f"g{i}"])
    cells = _cells(df, width)
    while True:
        _settle(cells, counts, {i: [b for b in wanted if b.value is None and b.inside > SORTABLE] for i, wanted in brackets.items()})
        open_ = {i: [b for b in wanted if b.value is None] for i, wanted in brackets.items()}
        if not any(open_.values()):
            return [(counts[i], {b.rank: b.value for b in brackets[i]}) for i in range(width)]
        _look_inside(cells, open_)


def _settle(cells: DataFrame, counts: Sequence[int], wanted: dict[int, list[Bracket]]) -> None:
    """Count all values around the trial intervals of all columns in one scan."""
    edges = {i: sorted({e for b in bs for e in b.trial if e is not None}) for i, bs in wanted.items() if bs}
    if not edges:
        return
    # Between and on the edges of its column, a value is in cell 0, 1, 2, ...; odd cells are edges.
    steps = []
    for j in range(max(map(len, edges.values()))):
        edge = _listed([edges[i][j] if i in edges and j < len(edges[i]) else None for i in range(len(counts))])
        steps.append(F.when(F.col("x") > edge, 2).when(F.col("x") == edge, 1).otherwise(0))
    cell = sum(steps[1:], steps[0]) if steps else F.lit(0)
    of_column = cells.where(F.col("i").isin(list(edges)))
    found = {(r["i"], r["cell"]): r["n"] for r in of_column.groupBy("i", cell.alias("cell")).agg(F.count("x").alias("n")).collect()}
    for i, ends in edges.items():
        below, upto, so_far = {}, {}, 0
        for j, e in enumerate(ends):
            so_far += found.get((i, 2 * j), 0)
            below[e] = so_far
            so_far += found.get((i, 2 * j + 1), 0)
            upto[e] = so_far
        for b in wanted[i]:
            low, high = b.trial
            under = (0, 0) if low is None else (below[low], upto[low])
            b.settle(*under, *((counts[i], counts[i]) if high is None else (below[high], upto[high])))


def _look_inside(cells: DataFrame, wanted: dict[int, list[Bracket]]) -> None:
    """Read the value of a bracket that holds few, propose a narrower trial for the others, all in one scan."""
    spans = {i: sorted({(b.low, b.high, b.inside <= SORTABLE) for b in bs}, key=repr) for i, bs in wanted.items() if bs}
    width = max(spans) + 1
    most = max(map(len, spans.values()))
    slots = []
    for j in range(most):
        column = [spans.get(i, [])[j] if j < len(spans.get(i, [])) else None for i in range(width)]
        low, high = _listed([c and c[0] for c in column]), _listed([c and c[1] for c in column])
        within = (low.isNull() | (F.col("x") > low)) & (high.isNull() | (F.col("x") < high))
        used = F.array(*[F.lit(c is not None) for c in column])
        slots.append(F.when(F.get(used, F.col("i")) & within, F.lit(j)))
    inside = cells.where(F.col("i").isin(list(spans))).select("i", "x", F.explode(F.array_compact(F.array(*slots))).alias("slot"))
    short = F.array(*[F.array(*[F.lit(j < len(spans.get(i, [])) and spans[i][j][2]) for j in range(most)]) for i in range(width)])
    few = F.get(F.get(short, F.col("i")), F.col("slot"))
    rows = inside.withColumn("few", few).groupBy("i", "slot", "few").agg(
        F.sort_array(F.collect_list(F.when(F.col("few"), F.col("x")))).alias("all"), _grid(F.when(~F.col("few"), F.col("x"))).alias("grid")
    )
    ranks = F.array(*[
        F.array(*[F.array(*[F.lit(r) for r in _wanted_in(wanted.get(i, []), spans.get(i, []), j)]).cast("array<int>") for j in range(most)])
        for i in range(width)
    ])
    of_slot = F.get(F.get(ranks, F.col("i")), F.col("slot"))
    values = F.when(F.col("few"), F.transform(of_slot, lambda r: F.get("all", r))).otherwise(F.col("grid"))
    found = {(r["i"], r["slot"]): r["values"] for r in rows.select("i", "slot", values.alias("values")).collect()}
    for i, bs in wanted.items():
        for b in bs:
            j = spans[i].index((b.low, b.high, b.inside <= SORTABLE))
            if b.inside <= SORTABLE:
                b.value = found[i, j][_wanted_in(bs, spans[i], j).index(b.rank - b.start)]
            else:
                b.propose(found[i, j])


def _wanted_in(brackets: Sequence[Bracket], spans: Sequence[tuple], j: int) -> list[int]:
    """Places of the wanted values within a span that is read whole."""
    if j >= len(spans) or not spans[j][2]:
        return []
    return sorted({b.rank - b.start for b in brackets if (b.low, b.high, b.inside <= SORTABLE) == spans[j]})


def _listed(values: Sequence[float | None]) -> Column:
    """A number for each column, picked by the column of the row."""
    return F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.col("i"))


def _grid(x: Column) -> Column:
    """Values at even shares of the rows, by a KLL sketch whose size follows from its accuracy; NULL without values."""
    size = min(65535, max(8, math.ceil((2.296 * SKETCH_ACCURACY) ** (1 / 0.9723))))
    shares = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, F.lit(size)), shares))
