"""Nearest detected attack in forest-leaf space for every missed one.

Two rows are as close as the share of trees that put them in the same leaf. The
search is exact and never joins all missed rows with all detected ones:

* rows with equal leaf vectors are merged, so copies cost nothing;
* steps ask for ever fewer equal leaves. A posting is a set of trees with their
  leaves. Trees are dealt into groups so that two vectors with ``k`` equal leaves
  must share a posting of ``c`` trees within a group: ``g`` groups that each hold
  fewer than ``c`` equal leaves come to at most ``g * (c - 1)``, and ``g`` is
  chosen below ``k / (c - 1)``. A vector whose best partner has ``k`` equal
  leaves or more is settled and leaves the search;
* the last steps compare nothing. Once no partner can have more than ``k`` equal
  leaves, all that share a posting of ``k`` trees are equally near, so the
  smallest key of each posting, one grouped minimum, is the answer;
* a crowded posting is cut into blocks on both sides. A task compares two
  blocks of bounded size and returns one best partner per missed vector.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowweir.functions.ordered import exact_quantiles
from flowweir.session import stage_table

BLOCK_ROWS = 4096
# Postings a vector may have in one step, where pairs of trees leave a choice.
# The choice of steps depends on the trees alone, never on the rows.
MAX_POSTINGS = 200
# Assumed when widths are chosen: share of the vectors in one leaf, and what it costs to
# set a vector against all others, in rows moved. Neither changes a result.
LEAF_SHARE, MEETING = 0.1, 20_000
_POSTING = ["source_label", "posting", "posting_leaves"]
_VECTOR = ["source_label", "leaves"]


@dataclass(frozen=True)
class Step:
    """Partners with ``matches`` equal leaves or more, found by postings over ``trees``.

    ``compared``: vectors of a posting are compared with each other; else all of
    them are equally near and the smallest key is taken.
    """

    matches: int
    trees: tuple[tuple[int, ...], ...]
    compared: bool


def _groups(trees: int, matches: int, width: int) -> list[range]:
    """Groups of trees, one of which holds ``width`` of any ``matches`` equal leaves."""
    groups = (matches - 1) // (width - 1)
    edges = [i * trees // groups for i in range(groups + 1)]
    return [range(lo, hi) for lo, hi in zip(edges, edges[1:])]


def _comparison_step(trees: int, matches: int) -> Step:
    """Postings of the width that moves few rows and lets few vectors meet."""

    def size(width):
        return sum(comb(len(g), width) for g in _groups(trees, matches, width))

    sizes = {width: size(width) for width in range(2, matches + 1)}
    allowed = [w for w in sizes if sizes[w] <= MAX_POSTINGS] or [min(sizes, key=sizes.get)]
    width = min(allowed, key=lambda w: sizes[w] * (1 + MEETING * LEAF_SHARE**w))
    groups = _groups(trees, matches, width)
    return Step(matches, tuple(p for g in groups for p in combinations(g, width)), compared=True)


def search_steps(trees: int) -> list[Step]:
    """Steps from equal vectors down to one equal leaf.

    The last ones, for two trees and as many more as ``MAX_POSTINGS`` allows, look
    up minima.
    """
    looked_up = min(2, trees)
    while looked_up < trees and comb(trees, looked_up + 1) <= MAX_POSTINGS:
        looked_up += 1
    half = trees // 2
    asked = [trees - 2**i for i in range(trees.bit_length()) if trees - 2**i > half]
    while half > looked_up:
        asked.append(half)
        half = (half + looked_up) // 2
    if trees > looked_up + 1:
        asked.append(looked_up + 1)
    compared = [k for k in dict.fromkeys(asked) if k > looked_up]
    return (
        [Step(trees, (tuple(range(trees)),), compared=False)]
        + [_comparison_step(trees, k) for k in compared]
        + [
            Step(k, tuple(combinations(range(trees), k)), compared=False)
            for k in range(min(looked_up, trees - 1), 0, -1)
        ]
    )


def _postings(vectors: DataFrame, step: Step) -> DataFrame:
    """One row per vector and posting: its number and the vector's leaves in it."""
    sets = F.lit([list(trees) for trees in step.trees])

    def entry(trees, number):
        own = F.transform(trees, lambda tree: F.get("leaves", tree))
        return F.struct(number.alias("posting"), own.alias("posting_leaves"))

    return vectors.select("*", F.inline(F.transform(sets, entry)))


def comparisons(missed: DataFrame, found: DataFrame, step: Step) -> DataFrame:
    """Pairs of vectors that a comparing step sets against each other, per posting."""
    left = _postings(missed, step).groupBy(*_POSTING).agg(F.count(F.lit(1)).alias("left_rows"))
    right = _postings(found, step).groupBy(*_POSTING).agg(F.count(F.lit(1)).alias("right_rows"))
    return left.join(right, _POSTING)


_BEST_SCHEMA = (
    "source_label string, leaves array<int>, matches int, best_key string, best_probability double"
)


def _agreements(ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Number of equal leaves for every (missed, detected) pair of one cell."""
    total = np.zeros((len(ours), len(theirs)), dtype=np.int32)
    for tree in range(ours.shape[1]):
        total += ours[:, tree, None] == theirs[None, :, tree]
    return total


def _compare_cells(batches):
    """Best partner per missed vector and cell.

    Rows arrive sorted by cell, missed before detected, detected by key, so the
    first best one is the one wanted. A cell may continue in the next batch; it
    holds at most one block of either side, so what is carried over is bounded.
    """

    def finish(rows):
        leaves = np.stack(rows["leaves"].to_numpy())
        found = rows["is_found"].to_numpy(dtype=bool)
        number = rows["cell"].to_numpy()
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(rows)]
        at, partner, matches = [], [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            split = hi - int(found[lo:hi].sum())
            if lo < split < hi:
                equal = _agreements(leaves[lo:split], leaves[split:hi])
                best = equal.argmax(axis=1)
                at.append(np.arange(lo, split))
                partner.append(best + split)
                matches.append(equal[np.arange(split - lo), best])
        if not at:
            return
        at, partner = np.concatenate(at), np.concatenate(partner)
        yield pd.DataFrame(
            {
                "source_label": rows["source_label"].to_numpy()[at],
                "leaves": rows["leaves"].to_numpy()[at],
                "matches": np.concatenate(matches),
                "best_key": rows["best_key"].to_numpy()[partner],
                "best_probability": rows["best_probability"].to_numpy()[partner],
            }
        )

    kept = None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if rows.empty:
            continue
        number = rows["cell"].to_numpy()
        last = int((number != number[-1]).sum())
        if last:
            yield from finish(rows.iloc[:last])
        kept = rows.iloc[last:]
    if kept is not None and not kept.empty:
        yield from finish(kept)


def _nearest(candidates: DataFrame) -> DataFrame:
    """Most matches, the smallest key on a tie."""
    top = F.min(F.struct((-F.col("matches")).alias("neg"), "best_key", "best_probability"))
    return (
        candidates.groupBy(*_VECTOR)
        .agg(top.alias("top"))
        .select(
            *_VECTOR,
            (-F.col("top.neg")).cast("int").alias("matches"),
            "top.best_key",
            "top.best_probability",
        )
    )


def _looked_up(missed: DataFrame, found: DataFrame, step: Step) -> DataFrame:
    """The smallest key of all postings of a vector; no vector meets another."""
    least = (
        _postings(found, step)
        .groupBy(*_POSTING)
        .agg(F.min(F.struct("best_key", "best_probability")).alias("top"))
    )
    met = _postings(missed, step).join(least, _POSTING)
    return met.groupBy(*_VECTOR).agg(F.min("top").alias("top")).select(
        *_VECTOR, F.lit(step.matches).alias("matches"), "top.best_key", "top.best_probability"
    )


def _compared(missed: DataFrame, found: DataFrame, step: Step, block_rows: int) -> DataFrame:
    left, right = _postings(missed, step), _postings(found, step)
    blocks = comparisons(missed, found, step).select(
        *_POSTING,
        F.ceil(F.col("left_rows") / block_rows).alias("left_blocks"),
        F.ceil(F.col("right_rows") / block_rows).alias("right_blocks"),
    )

    def placed(side, own, other):
        """Own block by hash, one copy for every block of the other side."""
        return side.join(blocks, _POSTING).select(
            *side.columns,
            F.pmod(F.xxhash64("leaves"), F.col(f"{own}_blocks")).alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(
                f"{other}_block"
            ),
        )

    cell = [*_POSTING, "left_block", "right_block"]
    missed_side = placed(left, "left", "right").select(
        *cell,
        "leaves",
        F.lit(False).alias("is_found"),
        F.lit(None).cast("string").alias("best_key"),
        F.lit(None).cast("double").alias("best_probability"),
    )
    found_side = placed(right, "right", "left").select(
        *cell, "leaves", F.lit(True).alias("is_found"), "best_key", "best_probability"
    )
    cells = (
        missed_side.unionByName(found_side)
        .repartition(*cell)
        .sortWithinPartitions(*cell, "is_found", "best_key")
        .select(
            F.concat_ws(
                "|",
                *["source_label", "posting"],
                F.array_join(F.col("posting_leaves").cast("array<string>"), ","),
                "left_block",
                "right_block",
            ).alias("cell"),
            "source_label",
            "leaves",
            "is_found",
            "best_key",
            "best_probability",
        )
    )
    best = _nearest(cells.mapInPandas(_compare_cells, _BEST_SCHEMA))
    return best.filter(F.col("matches") >= step.matches)


def leaf_proximity(rows: DataFrame, trees: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Closest detected row of the same family for every missed row.

    ``rows``: row_key, source_label, error_type, attack_probability and
    ``leaves``, one leaf number per tree. Families without both groups drop out;
    a missed row that shares no leaf gets proximity 0 and the first detected row.
    """
    missed_rows = rows.filter(F.col("error_type") == "FALSE_NEGATIVE")
    found_rows = rows.filter(F.col("error_type") == "CORRECT")
    found = stage_table(
        found_rows.groupBy(*_VECTOR)
        .agg(
            F.min(
                F.struct(
                    F.col("row_key").cast("string").alias("best_key"),
                    F.col("attack_probability").alias("best_probability"),
                )
            ).alias("top")
        )
        .select(*_VECTOR, "top.best_key", "top.best_probability"),
        "found",
    )
    first = found.groupBy("source_label").agg(
        F.min(F.struct("best_key", "best_probability")).alias("top")
    )
    missed = stage_table(missed_rows.select(*_VECTOR).distinct(), "missed")
    settled = None
    waiting = missed
    for number, step in enumerate(search_steps(trees)):
        if step.compared:
            near = _compared(waiting, found, step, block_rows)
        else:
            near = _looked_up(waiting, found, step)
        near = stage_table(near, f"step{number}")
        settled = near if settled is None else settled.unionByName(near)
        waiting = stage_table(waiting.join(near, _VECTOR, "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    apart = waiting.join(first, "source_label").select(
        *_VECTOR, F.lit(0).alias("matches"), "top.best_key", "top.best_probability"
    )
    best = settled.unionByName(apart)
    return missed_rows.join(best, _VECTOR).select(
        "row_key",
        "source_label",
        "best_key",
        (F.col("matches") / F.lit(trees)).alias("proximity"),
        F.abs(F.col("attack_probability") - F.col("best_probability")).alias("probability_gap"),
    )


# Proximity levels reported.
NEAR_LEVELS = (0.25, 0.50, 0.75, 0.90)


def leaf_proximity_summary(proximity: DataFrame) -> DataFrame:
    """Spread of proximity and probability gap per family, counts of near rows."""
    probs = {"min": 0.0, "median": 0.5, "q75": 0.75, "max": 1.0}
    long = proximity.unpivot(
        ["source_label"], ["proximity", "probability_gap"], "measure", "value"
    )
    spread = exact_quantiles(long, ["source_label", "measure"], "value", probs)
    wide = spread.groupBy("source_label").agg(
        *[
            F.max(F.when(F.col("measure") == m, F.col(q))).alias(f"{m}_{q}")
            for m in ("proximity", "probability_gap")
            for q in probs
        ]
    )
    near = proximity.groupBy("source_label").agg(
        F.count(F.lit(1)).alias("missed"),
        *[
            F.count_if(F.col("proximity") >= level).alias(f"near_{int(level * 100)}")
            for level in NEAR_LEVELS
        ],
    )
    return near.join(wide, "source_label")
