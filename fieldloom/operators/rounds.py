"""Sweeps in rounds: each round's grid follows from the winner of those before, and finished cells are not run again.

A cell is a configuration: a name, and what it sets. Its results, a row for each target, go to a keyed store; a
restart evaluates only the cells that the store lacks. A round's winner has the highest 0.5 * (mean + least IoU) over the targets, the
first in the round's order among equals. The grids are on the driver: they have a row for each configuration, never for data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import even_round
from ..sources.store import ResultStore

#: What a store of rounds holds; keys: round, cell, target.
SCHEMA = "round int, cell string, ordinal int, target long, iou double"
KEYS = ["round", "cell", "target"]


def summaries(results: DataFrame) -> DataFrame:
    """round, cell, ordinal, targets, mean_iou, min_iou, robust of stored results."""
    six = lambda c: even_round(c, 6)
    return results.groupBy("round", "cell", "ordinal").agg(
        F.count(F.lit(1)).alias("targets"), six(F.avg("iou")).alias("mean_iou"), six(F.min("iou")).alias("min_iou"), six(0.5 * (F.avg("iou") + F.min("iou"))).alias("robust")
    )


def winner(results: DataFrame, number: int) -> str | None:
    """The best cell of a round; None where nothing was evaluated."""
    best = summaries(results.filter(F.col("round") == number)).orderBy(F.desc("robust"), "ordinal").select("cell").first()
    return best["cell"] if best else None


def run(store: ResultStore, rounds: Sequence[Callable[[list[str]], Sequence[str]]], evaluate: Callable[[list[str]], DataFrame]) -> list[str]:
    """The winner of each round.

    A round maps the winners so far to its cells' names, in order; evaluate gives cell, target and iou for a list of
    cells. A round without cells, or whose cells have no target, ends the sweep.
    """
    winners: list[str] = []
    for number, grid in enumerate(rounds):
        cells = list(grid(winners))
        done = {r["cell"] for r in store.read().filter(F.col("round") == number).select("cell").distinct().collect()}  # a row a configuration
        todo = [c for c in cells if c not in done]
        if todo:
            at = F.create_map(*[F.lit(v) for i, c in enumerate(cells) for v in (c, i)])
            rows = evaluate(todo).select(F.lit(number).alias("round"), "cell", at[F.col("cell")].alias("ordinal"), F.col("target").cast("long").alias("target"), "iou")
            store.upsert(rows)
        best = winner(store.read().filter(F.col("cell").isin(cells)), number) if cells else None
        if best is None:
            break
        winners.append(best)
    return winners
