"""Sequential greedy cover in rounds, from gains that are kept and lowered.

``gains`` holds, for every set, how many uncovered elements it has left. Only the head of their ranking
can hold the next picks: gains only fall, so a set outside it never gets ahead of the first set
outside, the bound. A round reads the pairs of the head alone, which is bounded in sets and in pairs,
and picks within it until the best set left would rank behind the bound. That is sequential greedy to
the letter, ties included. The elements newly covered then lower the gains: each pair is met once in
that join over all rounds. Rounds don't shuffle the stored pairs: heads and newly covered elements are
small written tables that come to them. A set too large for a head is picked by itself,
without gathering its pairs; there are at most ``elements / HEAD_PAIRS`` such picks.

The pairs are stored twice as lists: the elements of every set, where a round finds its head, and the
sets that hold every element, where it finds what to lower. Both are met list by list, so a round
opens the lists it needs and passes the others by as one row each. Long lists are cut. Those of sets are sorted by
size, so a round whose head begins at some gain skips the files and row groups of smaller sets.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StructType

from ..functions import tie_distance
from ..plans.lanes import Lanes
from ..plans.ranks import ranked
from ..plans.workspace import FOLD, Workspace

#: A head has at most so many sets and pairs for each independent problem.
HEAD_SETS = 4_999
HEAD_PAIRS = 2_000_000
#: A list of stored pairs has about so many entries at most.
LIST = 10_000
#: Newly covered elements and heads are broadcast up to so many bytes as written.
BROADCAST_BYTES = 32 << 20


def drawn(seed, step: int) -> int:
    """The number that breaks the ties of one pick when they are redrawn."""
    return random.Random(f"{seed}:{step}").randint(-9, 9)


def _small(ws: Workspace, df: DataFrame, name: str) -> DataFrame:
    return F.broadcast(df) if ws.bytes(name) <= BROADCAST_BYTES else df


def _head(gains: DataFrame, by: list[str], tie: Column, sets: int, pairs: int, named: bool) -> DataFrame:
    """The first sets of each ranking, which of them are ``chosen``, and the first that is not, the bound.

    ``order`` numbers them by their rule for ties, or by id alone if the rule changes with every pick
    (``named``).
    """
    rule = [F.col("gain").desc(), F.col("tie"), F.col("set_id")]
    able = gains.withColumn("tie", tie)
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*rule))
        top = able.withColumn("place", place).where(F.col("place") <= sets + 1)
    else:
        top = able.orderBy(*rule).limit(sets + 1)
        top = top.withColumn("place", F.row_number().over(Window.orderBy(*rule)))
    every = Window.partitionBy(*by)
    order = F.row_number().over(every.orderBy("set_id") if named else every.orderBy("tie", "set_id"))
    reached = F.sum("gain").over(every.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    chosen = (F.col("place") == 1) | ((F.col("reached") <= pairs) & (F.col("place") <= sets))
    return (
        top.withColumns({"order": order, "reached": reached})
        .withColumn("chosen", chosen)
        .withColumn("bound", F.min(F.when(~F.col("chosen"), F.struct("place", "gain", "order"))).over(every))
        .where("chosen")
        .select(
            *by,
            "set_id",
            F.col("gain").alias("had"),
            "order",
            F.coalesce("bound.gain", F.lit(0)).alias("bound_gain"),
            F.coalesce("bound.order", F.lit(0)).alias("bound_order"),
            (F.col("had") > pairs).alias("solo"),
        )
    )


def _picked(pairs: pd.DataFrame, redraw) -> pd.DataFrame:
    """The pairs by which a head covers elements, with ``seq``, the number of the pick.

    Sets are known by their ``order``; ``redraw`` is None or a function from the number of a pick here to
    its number for ties.
    """
    order, s = np.unique(pairs["order"].to_numpy(), return_inverse=True)
    e, _ = pd.factorize(pairs["elem_key" if "elem_key" in pairs else "elem_id"])
    n, m = len(order), e.max() + 1
    of_set, of_elem = np.argsort(s, kind="stable"), np.argsort(e, kind="stable")
    set_at = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))])
    elem_at = np.concatenate([[0], np.cumsum(np.bincount(e, minlength=m))])
    gain, taken, seq = np.diff(set_at).copy(), np.zeros(m, bool), np.zeros(len(pairs), np.int64)
    bound_gain, bound_order = int(pairs["bound_gain"].iloc[0]), int(pairs["bound_order"].iloc[0])
    if redraw:
        digit = np.zeros(n, np.int64)
        digit[s] = pairs["digit"].to_numpy()
    picks = 0
    while (best := int(gain.max())) > 0:
        equal = np.flatnonzero(gain == best)
        pick = equal[np.argmin(np.abs(redraw(picks) - digit[equal]))] if redraw else equal[0]
        behind = best < bound_gain or (best == bound_gain and (redraw or order[pick] > bound_order))
        if picks and behind:
            break
        picks += 1
        rows = of_set[set_at[pick] : set_at[pick + 1]]
        rows = rows[~taken[e[rows]]]
        taken[e[rows]] = True
        seq[rows] = picks
        # The places of all pairs of the elements just covered, in one pass.
        fresh = e[rows]
        held = elem_at[fresh + 1] - elem_at[fresh]
        places = np.repeat(elem_at[fresh] - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(held.sum())
        gain -= np.bincount(s[of_elem[places]], minlength=n)
    return pairs[seq > 0].assign(seq=seq[seq > 0])


def _settling(redraw_seed, done: int):
    """For applyInPandas: :func:`_picked` after ``done`` picks."""
    redraw = None if redraw_seed is None else lambda picks: drawn(redraw_seed, done + picks + 1)

    def settle(pairs: pd.DataFrame) -> pd.DataFrame:
        return _picked(pairs, redraw)

    return settle


def _of_sets(ws: Workspace, pairs: DataFrame, sizes: DataFrame, own: list[str], name: str) -> DataFrame:
    """``(own, set_id, size, elems)``, sorted by size; ``sizes`` has a ``gain`` for every set.

    The lists are written before they are sorted, as range bounds are sampled and would make them twice.
    """
    sized = pairs.join(sizes.withColumnRenamed("gain", "size"), [*own, "set_id"])
    cut = F.pmod(F.xxhash64("elem_id"), F.ceil(F.col("size") / F.lit(LIST))).alias("cut")
    lists = sized.groupBy(*own, "set_id", "size", cut).agg(F.collect_list("elem_id").alias("elems")).drop("cut")
    lists = ws.write(lists, f"{name}_lists")
    laid = ws.write(lists.repartitionByRange("size", "set_id").sortWithinPartitions("size", "set_id"), name)
    ws.drop(f"{name}_lists")
    return laid


def _of_elems(ws: Workspace, pairs: DataFrame, stored: int, own: list[str]) -> DataFrame:
    """``(own, elem_id, sets)``."""
    lanes = Lanes(ws, "elem", pairs, [*own, "elem_id"], "set_id", LIST, stored)
    lists = lanes.tag(pairs).groupBy(*lanes.on).agg(F.collect_list("set_id").alias("sets"))
    return lists.select(*own, "elem_id", "sets")


def exact_cover(
    ws: Workspace,
    pairs: DataFrame,
    stored: int,
    by: list[str],
    copies: tuple[str, int] | None,
    tie: Column,
    redraw_seed,
    max_rounds: int,
    compact_rows: int,
    head_sets: int = HEAD_SETS,
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """``(by, step, set_id, gain)`` of sequential greedy on distinct ``pairs`` (``stored`` rows)."""
    redraws = redraw_seed is not None
    own = [c for c in by if not copies or c != copies[0]]
    complex_ = isinstance(pairs.schema["elem_id"].dataType, (StructType, ArrayType, MapType, BinaryType))
    elem_key = F.to_json(F.struct("elem_id")) if complex_ else F.col("elem_id")

    counts = ws.write(pairs.groupBy(*own, "set_id").agg(F.count(F.lit(1)).alias("gain")), "sizes")
    base = _of_sets(ws, pairs, counts, own, "sorted")
    holders = ws.write(_of_elems(ws, pairs, stored, own), "holders")
    # A set's place among equals is worked out once, under every key.
    gains = counts
    if copies:
        gains = gains.withColumn(copies[0], F.explode(F.sequence(F.lit(1), F.lit(copies[1]))))
    gains = gains.select(*by, "set_id", "gain", tie.alias("tie"))
    gains, seen = ws.measured(gains, "gains0", left=F.sum("gain"))

    number, done, won_names, covered, schema, stages = 0, 0, [], [], None, ("sorted", "holders")
    while seen["rows"]:
        number += 1
        if number > max_rounds:
            raise RuntimeError(f"cover not finished after {max_rounds} rounds")
        now = tie_distance(F.col("set_id"), drawn(redraw_seed, done + 1)) if redraws else F.col("tie")
        head, lowest = ws.measured(
            _head(gains, by, now, head_sets, head_pairs, redraws),
            f"head{number}",
            least=F.min("had"),
            solo=F.count_if("solo"),
        )
        met = (
            base.where(F.col("size") >= lowest["least"])
            .join(_small(ws, head, f"head{number}"), [*own, "set_id"])
            .select(*head.columns, F.explode("elems").alias("elem_id"))
        )
        if covered:
            met = met.join(ws.read(schema, *covered).select(*by, "elem_id"), [*by, "elem_id"], "left_anti")
        met = met.select(
            *by, "set_id", "elem_id", "order", "bound_gain", "bound_order", "solo",
            *([elem_key.alias("elem_key")] if complex_ else []),
            *([(F.col("set_id") % 10).cast("bigint").alias("digit")] if redraws else []),
        )
        shape = StructType(met.schema.fields).add("seq", LongType())
        settle = _settling(redraw_seed, done)
        inside = met.where("NOT solo").groupBy(*(by or [F.lit(0).alias("all")]))
        won = inside.applyInPandas(settle, shape)
        if lowest["solo"]:
            won = won.union(met.where("solo").withColumn("seq", F.lit(1).cast("bigint")))
        won = won.select(*by, "set_id", "elem_id", "seq", F.lit(number).alias("round"))
        won, got = ws.measured(won, f"won{number}", picks=F.max("seq"))
        schema, done = won.schema, done + got["picks"]
        won_names.append(f"won{number}")
        covered.append(f"won{number}")
        fresh = won.select(*by, "elem_id")
        touched = (
            holders.join(_small(ws, fresh, f"won{number}"), [*own, "elem_id"])
            .select(*by, F.explode("sets").alias("set_id"))
            .groupBy(*by, "set_id")
            .agg(F.count(F.lit(1)).alias("lost"))
        )
        lower = gains.join(touched, [*by, "set_id"], "left").select(
            *by, "set_id", (F.col("gain") - F.coalesce("lost", F.lit(0))).alias("gain"), "tie"
        )
        gains, seen = ws.measured(lower.where("gain > 0"), f"gains{number}", left=F.sum("gain"))
        ws.drop(f"gains{number - 1}")
        ws.drop(f"head{number}")
        if stored >= compact_rows and seen["rows"] and 2 * seen["left"] < stored * (copies[1] if copies else 1):
            # Half the pairs are used up: go on from those that are left under any key.
            gone = ws.read(schema, *covered).groupBy(*own, "elem_id").agg(F.count(F.lit(1)).alias("n"))
            gone = gone.where(F.col("n") == (copies[1] if copies else 1)).drop("n")
            still = holders.join(gone, [*own, "elem_id"], "left_anti")
            holders, kept = ws.measured(still, f"holders{number}", pairs=F.sum(F.size("sets")))
            left = holders.select(*own, "elem_id", F.explode("sets").alias("set_id"))
            base = _of_sets(ws, left, counts, own, f"sorted{number}")
            for name in stages:
                ws.drop(name)
            stages, stored, covered = (f"sorted{number}", f"holders{number}"), kept["pairs"], covered if copies else []
        if len(covered) >= FOLD:
            ws.write(ws.read(schema, *covered), f"folded{number}")
            for name in covered:
                ws.drop(name)
            won_names = [*(n for n in won_names if n not in covered), f"folded{number}"]
            covered = [f"folded{number}"]
    if not won_names:
        return pairs.select(*by, F.lit(0).alias("step"), "set_id", F.lit(0).cast("bigint").alias("gain"))
    picks = (
        ws.read(schema, *won_names)
        .groupBy(*by, "round", "seq", "set_id")
        .agg(F.count(F.lit(1)).alias("gain"))
    )
    placed = ranked(ws, picks, by, [F.col("round"), F.col("seq"), F.col("set_id")], "picks", "step")
    ws.finish("picks")
    return placed.select(*by, F.col("step").cast(IntegerType()).alias("step"), "set_id", "gain")
