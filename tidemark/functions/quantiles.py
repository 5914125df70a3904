"""Exact quantiles of many columns by bracketing.

A sketch of all columns, taken in one aggregate, gives two values that enclose
each wanted quantile.  A second aggregate counts what lies below and inside;
only the values inside are then counted one by one.  Values themselves are
never shuffled but for this small share, and no column is turned into rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor, inf

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The sketch misses a rank by at most this share of the rows, inverted.
ACCURACY = 10_000
#: Half widths of the brackets, of which the narrowest one is taken that is wide enough for the number of rows.
WIDTHS = (2 / ACCURACY, 0.005, 0.05, 0.25)
#: Brackets that hold more rows are narrowed before their values are counted.
MOST_INSIDE = 2_000_000
GRID = 100
#: Edges of so many groups are constants of the plan; those of more are a table.
PLAN_GROUPS = 16


def _point(p: float) -> float:
    return min(1.0, max(0.0, p))


def _literal(value: float) -> Column:
    return F.lit(float(value))


class _Brackets:
    """Enclosing values by group, column and quantile, and the counts below and inside them."""

    def __init__(self, groups: Sequence[tuple], columns: int, quantiles: int):
        self.groups, self.columns, self.quantiles = list(groups), columns, quantiles
        self.edges: dict[tuple[int, int, int], tuple[float, float]] = {}

    def beside(self, df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[list[tuple[Column, Column]]]]:
        """``df`` with the edges of its group, as columns by column and quantile; constants where there are no groups."""
        wanted = range(self.quantiles)
        if not by:
            row = [[tuple(map(_literal, self.edges[0, c, q])) for q in wanted] for c in range(self.columns)]
            return df, row
        if len(self.groups) <= PLAN_GROUPS:
            number = F.lit(None).cast("int")
            for g, group in reversed(list(enumerate(self.groups))):
                same = F.lit(True)
                for b, value in zip(by, group):
                    same = same & F.col(b).eqNullSafe(F.lit(value))
                number = F.when(same, g).otherwise(number)

            def constant(c: int, q: int, side: int) -> Column:
                return F.get(F.array(*[_literal(self.edges[g, c, q][side]) for g in range(len(self.groups))]), F.col("_g"))

            sides = [[(constant(c, q, 0), constant(c, q, 1)) for q in wanted] for c in range(self.columns)]
            return df.withColumn("_g", number), sides
        spark = df.sparkSession
        rows = [
            (g, [float(e) for c in range(self.columns) for q in wanted for e in self.edges[g, c, q]])
            for g in range(len(self.groups))
        ]
        table = spark.createDataFrame(rows, "_g int, _edges array<double>")
        kinds = ", ".join(f"`_b{i}` {df.schema[b].dataType.simpleString()}" for i, b in enumerate(by))
        names = spark.createDataFrame([(i, *g) for i, g in enumerate(self.groups)], f"_g int, {kinds}")
        # one row for each group, whose number is set by the caller
        edges = F.broadcast(names.join(table, "_g"))
        same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
        joined = df.join(edges, same)

        def edge(c: int, q: int, side: int) -> Column:
            return F.get("_edges", F.lit((c * self.quantiles + q) * 2 + side))

        return joined, [[(edge(c, q, 0), edge(c, q, 1)) for q in wanted] for c in range(self.columns)]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    most_inside: int = MOST_INSIDE,
) -> DataFrame:
    """``by``, ``feature`` and a column for each of ``probabilities``: linearly interpolated quantiles.

    Nulls are passed over, and a column without values in a group has no row.
    ``by`` has few groups, a number set by the caller and not by the data: their
    edges are broadcast.  ``df`` is read three times, and again for each further
    narrowing where a bracket holds more than ``most_inside`` rows, so a long
    plan is best written before.
    """
    by, share = list(by), list(probabilities.values())
    values = [f"_v{i}" for i in range(len(columns))]
    rows = df.select(*by, *[F.col(c).cast("double").alias(v) for c, v in zip(columns, values)])
    places = [range(len(columns)), range(len(share))]
    cells = [(c, q) for c in places[0] for q in places[1]]

    # first: how many values, and edges around each quantile at several widths
    points = [_point(p + sign * w) for p in share for w in WIDTHS for sign in (-1, 1)]
    sketch = rows.groupBy(*by).agg(
        *[F.count(v).alias(f"n{v}") for v in values],
        *[F.percentile_approx(v, points, ACCURACY).alias(f"s{v}") for v in values],
    ).collect()
    found = _Brackets([tuple(r[b] for b in by) for r in sketch], len(columns), len(share))
    size: dict[tuple[int, int], int] = {}
    for g, row in enumerate(sketch):
        for c, v in enumerate(values):
            n = size[g, c] = row[f"n{v}"]
            for q in places[1]:
                fit = next((i for i, w in enumerate(WIDTHS) if w >= 1 / ACCURACY + 2 / max(1, n)), None)
                at = (q * len(WIDTHS) + fit) * 2 if fit is not None else None
                found.edges[g, c, q] = (-inf, inf) if at is None or not n else (row[f"s{v}"][at], row[f"s{v}"][at + 1])

    def ranks(g: int, c: int, q: int) -> tuple[int, int]:
        position = (size[g, c] - 1) * share[q]
        return floor(position), ceil(position)

    # then: what lies below and inside, until every bracket holds its ranks and is small
    grid = [i / GRID for i in range(GRID + 1)]
    large = max(size.values(), default=0) > most_inside
    below: dict[tuple[int, int, int], int] = {}
    while True:
        joined, edges = found.beside(rows, by)
        measures = []
        for c, q in cells:
            (low, high), v = edges[c][q], F.col(values[c])
            inside = (v >= low) & (v <= high)
            measures += [F.count_if(v < low).alias(f"b{c}_{q}"), F.count_if(inside).alias(f"i{c}_{q}")]
            if large:
                measures.append(F.percentile_approx(F.when(inside, v), grid, ACCURACY).alias(f"g{c}_{q}"))
        counted = {tuple(r[b] for b in by): r for r in joined.groupBy(*by).agg(*measures).collect()}
        again = False
        for g, group in enumerate(found.groups):
            row = counted[group]
            for c, q in cells:
                if not size[g, c]:
                    continue
                low, high = found.edges[g, c, q]
                before, inside = row[f"b{c}_{q}"], row[f"i{c}_{q}"]
                below[g, c, q] = before
                first, last = ranks(g, c, q)
                if not before <= first <= last < before + inside:
                    # the sketch was further off than it promises
                    found.edges[g, c, q], again = (-inf, inf), True
                elif large and inside > most_inside and low < high:
                    cut = row[f"g{c}_{q}"]
                    slack = 1 / ACCURACY + 2 / inside
                    near = max(0, floor(((first - before) / inside - slack) * GRID))
                    far = min(GRID, ceil(((last + 1 - before) / inside + slack) * GRID))
                    narrower = (cut[near], cut[far])
                    if narrower != (low, high):
                        found.edges[g, c, q], again = narrower, True
        if not again:
            break

    # last: the values inside, counted
    joined, edges = found.beside(rows, by)
    entries = [
        F.when(
            F.col(values[c]).between(*edges[c][q]),
            F.struct(F.lit(c).alias("_c"), F.lit(q).alias("_q"), F.col(values[c]).alias("_value")),
        )
        for c, q in cells
    ]
    inside = joined.select(*by, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("_e"))
    counts = inside.groupBy(*by, "_e._c", "_e._q", "_e._value").agg(F.count(F.lit(1)).alias("_n"))
    state = [(*found.groups[g], c, q, below[g, c, q], *ranks(g, c, q), (size[g, c] - 1) * share[q]) for g, c, q in sorted(below)]
    kinds = "".join(f"`_b{i}` {df.schema[b].dataType.simpleString()}, " for i, b in enumerate(by))
    spark = df.sparkSession
    wanted = spark.createDataFrame(state, f"{kinds}c int, q int, _below long, _first long, _last long, _position double")
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    ordered = Window.partitionBy(*by, "_c", "_q").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = counts.withColumn("_sum", F.sum("_n").over(ordered))
    passed = passed.join(F.broadcast(wanted), [*same, F.col("_c") == F.col("c"), F.col("_q") == F.col("q")])
    low, high = (F.min(F.when(F.col("_below") + F.col("_sum") > F.col(r), F.col("_value"))) for r in ("_first", "_last"))
    result = low + (high - low) * (F.first("_position") - F.first("_first"))
    each = passed.groupBy(*by, "_c", "_q").agg(result.alias("_result"))
    wide = each.groupBy(*by, "_c").agg(
        *[F.max(F.when(F.col("_q") == q, F.col("_result"))).alias(name) for q, name in enumerate(probabilities)]
    )
    names = F.array(*[F.lit(c) for c in columns])
    return wide.select(*by, F.get(names, F.col("_c")).alias("feature"), *probabilities)
