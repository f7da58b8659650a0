"""Greedy set cover and greedy hitting set.

Sequential greedy takes the set with the most uncovered elements, one pick per round. Taken
literally that is one Spark job per pick. Exact covers keep the gains and settle the head of their
ranking in each round (see :mod:`.exact_cover`): the picks, their order and their gains are those of
sequential greedy. Covers in batches take near-best sets together, here.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_priority, tie_distance
from ..plans.lanes import HOT_ROWS, Lanes
from ..plans.ranks import ranked
from ..plans.workspace import Workspace
from .exact_cover import HEAD_PAIRS, HEAD_SETS, exact_cover
from .tuples import swap

# The pairs are written anew when half the elements are covered and at least this many are stored.
COMPACT_ROWS = 4_000_000

#: Parts of one, as elements pay for picks.
PRICE = 10**12

TIES = ("id", "hash", "distance", "redraw")


def _tie(ties: str, seed: int | str | None, salt: list[str]) -> Column:
    """What breaks equal gains, before the id: nothing, a seeded hash, or a digit distance.

    The number of the distance rule is drawn once per run, and with ``redraw`` anew for every pick.
    """
    if ties in ("id", "redraw"):
        return F.lit(0)
    if ties == "hash":
        return hash_priority(F.col("set_id"), seed, *[F.col(c) for c in salt])
    if ties == "distance":
        return tie_distance(F.col("set_id"), random.Random(seed).randint(-9, 9))
    raise ValueError(f"ties must be one of {TIES}, got {ties!r}")


def greedy_set_cover(
    pairs: DataFrame,
    batch: float | None = None,
    ties: str = "id",
    seed: int | str | None = None,
    by: list[str] = (),
    hot_rows: int = HOT_ROWS,
    max_rounds: int = 100_000,
    compact_rows: int = COMPACT_ROWS,
    copies: tuple[str, int] | None = None,
    head_sets: int = HEAD_SETS,
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """``(step, set_id, gain)``: sets that together contain every element of ``pairs``.

    ``batch=None`` gives exactly the picks of sequential greedy; ``head_sets`` and ``head_pairs`` bound
    what one task of a round holds and leave them alone. ``ties='redraw'`` draws the number of the
    distance rule for every pick, and runs one exact problem at a time. ``batch=eps`` with 0 < eps < 1
    takes in each round all sets within a factor ``1 - eps`` of the best one that still bring at
    least ``1 - eps`` of that bound when elements go to the first set in hash order: far fewer
    rounds, and every pick gains at least ``(1 - eps)^2`` of the best gain of its round. Gains
    sum to the number of elements either way. ``by`` runs independent problems side by side; those
    that share all pairs and differ in their ties only are asked for by ``copies=(name, n)``: the
    column ``name`` of ``by`` then numbers them from 1 to n, and the pairs are stored once.
    A pair without a set or without an element names nothing and is left out.
    """
    if batch is not None and not 0 < batch < 1:
        raise ValueError(f"batch must lie between 0 and 1, got {batch}")
    if ties == "redraw" and (batch is not None or by):
        raise ValueError("ties='redraw' is for one exact cover, without batch and by")
    rule = _tie(ties, seed, list(by))
    with Workspace(pairs.sparkSession, "cover") as ws:
        own = [c for c in by if not copies or c != copies[0]]
        named = pairs.where("set_id IS NOT NULL AND elem_id IS NOT NULL")
        base, seen = ws.measured(named.select(*own, "set_id", "elem_id").distinct(), "pairs")
        if batch is None:
            redraw = str(seed) if ties == "redraw" else None
            return exact_cover(
                ws, base, seen["rows"], list(by), copies, rule, redraw, max_rounds, compact_rows, head_sets, head_pairs
            )
        return _cover_in_batches(
            ws, base, seen["rows"], batch, rule, list(by), copies, hot_rows, max_rounds, compact_rows
        )


def _cover_in_batches(
    ws, base, stored, batch, rule, by, copies, hot_rows, max_rounds, compact_rows
) -> DataFrame:
    shared = [copies[0]] if copies else []

    def copied(df: DataFrame) -> DataFrame:
        return df.withColumn(copies[0], F.explode(F.sequence(F.lit(1), F.lit(copies[1]))))

    own = [c for c in by if c not in shared]
    by_set = Lanes(ws, "set", base, [*own, "set_id"], "elem_id", hot_rows, stored)
    by_elem = Lanes(ws, "elem", base, [*own, "elem_id"], "set_id", hot_rows, stored)
    if by_set.count or by_elem.count:
        base = ws.write(by_elem.tag(by_set.tag(base)), "pairs_in_lanes")

    left, rounds, to_cover, number = base, [], None, -1
    if shared and stored:
        left = copied(base)
    while stored:
        number += 1
        if number >= max_rounds:
            raise RuntimeError(f"cover not finished after {max_rounds} rounds")
        # One row per uncovered element: the set it goes to, and whether that set is picked now.
        best, seen = ws.measured(
            _batch_winners(left, by, by_set, [*by_set.on, *shared], rule, batch).withColumn("round", F.lit(number)),
            f"best{number}",
            split="won",
            won=F.count_if("won"),
        )
        if number:
            ws.drop(f"best{number - 1}/won=false")
        if seen["won"]:
            rounds = ws.fold(best.schema, [*rounds, f"best{number}"], "won", True, f"picked{number}")
        uncovered_now = seen["rows"] - seen["won"]
        if not uncovered_now:
            break
        to_cover = to_cover or seen["rows"]
        still = ws.half(best.schema, [f"best{number}"], "won", False).select(*by, "elem_id")
        left = base.join(by_elem.copy(still), by_elem.on, "inner" if shared else "left_semi")
        if stored >= compact_rows and 2 * uncovered_now < to_cover:
            # Half the elements are covered: go on from the pairs that are left.
            kept = left
            if shared:
                ends = still.select(*own, "elem_id").distinct()
                kept = base.join(by_elem.copy(ends), by_elem.on, "left_semi")
            base, seen = ws.measured(kept, f"pairs{number}")
            stored, to_cover = seen["rows"], uncovered_now
            left = base.join(by_elem.copy(still), by_elem.on) if shared else base
    if not stored:
        if shared:
            base = copied(base)
        return base.select(
            *by, F.lit(0).alias("step"), "set_id", F.lit(0).cast("bigint").alias("gain")
        )
    picks = (
        ws.half(best.schema, rounds, "won", True)
        .groupBy(*by, "round", "tie", "set_id")
        .agg(F.count(F.lit(1)).alias("gain"))
    )
    order = [F.col("round"), F.col("gain").desc(), F.col("tie"), F.col("set_id")]
    steps = ranked(ws, picks, by, order, "picks", "step").select(
        *by, F.col("step").cast("int").alias("step"), "set_id", "gain"
    )
    ws.finish("picks")
    return steps


def _gains(left: DataFrame, key: list[str], rule: Column) -> DataFrame:
    """The uncovered elements of every set, and its place among equals.

    The tie is worked out here, per set, and not kept with the pairs: so the scan and exchange of
    the pairs are the same as those of the join that follows, and Spark makes them once.
    """
    counts = left.groupBy(*key).agg(F.count(F.lit(1)).alias("gain"))
    return counts.withColumn("tie", rule)


def _batch_winners(left, by, by_set, on, rule, batch) -> DataFrame:
    """Per uncovered element the first picked set that has it; ``won`` if there is one."""
    key = [*by, "set_id"]
    keep = 1.0 - batch
    one = F.lit(0).alias("_all")
    gains = _gains(left, key, rule).select("*", one)
    # One row per independent problem; how it meets the sets is left to its size.
    floor = gains.groupBy(*by, "_all").agg((F.max("gain") * F.lit(keep)).alias("floor"))
    able = gains.join(floor, [*by, "_all"]).where(F.col("gain") >= F.col("floor"))
    hashed = hash_priority(F.col("set_id"), F.col("tie"))
    order = F.struct(hashed.alias("h"), "set_id", "tie", "floor")

    def first_of(pairs: DataFrame, wanted: Column) -> DataFrame:
        return (
            pairs.groupBy(*by, "elem_id")
            .agg(F.min(F.when(wanted, order)).alias("top"))
            .select(*by, "elem_id", "top.set_id", "top.tie", "top.floor")
        )

    rivals = left.join(by_set.copy(able.drop("gain", "_all")), on)
    accepted = (
        first_of(rivals, F.lit(True))
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("floor").alias("floor"),
            F.first("tie").alias("tie"),
        )
        .where(F.col("n") >= F.col("floor") * F.lit(keep))
        .select(*key, "floor", "tie")
    )
    taken = left.join(by_set.copy(accepted), on, "left")
    return first_of(taken, F.col("floor").isNotNull()).select(
        *by, "elem_id", "tie", "set_id", F.col("set_id").isNotNull().alias("won")
    )


def greedy_hitting_set(pairs: DataFrame, **options) -> DataFrame:
    """``(step, elem_id, gain)``: elements that together hit every set; the dual problem.

    Options are those of :func:`greedy_set_cover`; ties are broken on the element.
    """
    picks = greedy_set_cover(swap(pairs), **options)
    return picks.withColumnRenamed("set_id", "elem_id")


def certified(pairs: DataFrame, picks: DataFrame, by: list[str] = ()) -> DataFrame:
    """``picks`` with ``at_least``: no cover of ``pairs`` has fewer sets, so the picks are that near to the best.

    Dual fitting: an element pays ``1 / gain`` of the first pick that covers it, so the elements pay for
    all picks. If no set holds elements that pay more than ``most`` together, then every cover has
    at least ``paid / most`` sets. Payments are whole numbers of ``1 / PRICE``, so the bound does not
    depend on the order of sums; any payments give a valid one.
    """
    by = list(by)
    pairs = pairs.where("set_id IS NOT NULL AND elem_id IS NOT NULL").select(*by, "set_id", "elem_id").distinct()
    price = F.expr(f"{PRICE} div first.gain").alias("price")
    with Workspace(pairs.sparkSession, "certified") as ws:
        prices = ws.write(
            pairs.join(picks.select(*by, "set_id", "step", "gain"), [*by, "set_id"])
            .groupBy(*by, "elem_id")
            .agg(F.min(F.struct("step", "gain")).alias("first"))
            .select(*by, "elem_id", price),
            "prices",
        )
        loads = pairs.join(prices, [*by, "elem_id"]).groupBy(*by, "set_id").agg(F.sum("price").alias("load"))
        most = ws.write(loads.groupBy(*by).agg(F.max("load").alias("most")), "most")
        paid = prices.groupBy(*by).agg(F.sum("price").alias("paid"))
        if by:
            bounds = ws.write(paid.join(most, by).selectExpr(*by, "(paid + most - 1) div most AS at_least"), "bounds")
            ws.finish("bounds")
            return picks.join(bounds, by)
        total, limit = paid.first()["paid"], most.first()["most"]
        ws.finish()
    return picks.withColumn("at_least", F.lit(-(-total // limit) if limit else 0).cast("bigint"))


def uncovered(pairs: DataFrame, picks: DataFrame, by: list[str] = ()) -> DataFrame:
    """Elements no picked set contains; empty for a valid cover."""
    by = list(by)
    held = pairs.join(picks.select(*by, "set_id"), [*by, "set_id"], "left_semi")
    return (
        pairs.select(*by, "elem_id")
        .distinct()
        .join(held.select(*by, "elem_id").distinct(), [*by, "elem_id"], "left_anti")
    )
