"""Seeded trials and parameter sweeps: many runs as one keyed job.

A trial, or a configuration, is a key column. All of them go through the rounds together, so the
number of jobs is that of the longest run, not the sum.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hash_priority
from ..operators.checks import check_at_least, check_strength
from ..operators.coloring import color_greedy, color_repair, color_rounds, n_colors
from ..operators.cover import greedy_set_cover
from ..operators.domains import all_rows, domains, synthetic_domain
from ..operators.graphs import conflict_graph, vertices_of
from ..operators.tuple_coloring import color_tuples
from ..operators.tuples import all_tuples, incidence, tway_tuples
from .workspace import Workspace

COLORINGS = {
    "color_greedy": color_greedy,
    "color_rounds": color_rounds,
    "color_repair": color_repair,
}


def _repeat(df: DataFrame, trials: int) -> DataFrame:
    """Every row once per trial number, in place."""
    return df.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))


def _edges_of_trials(edges: DataFrame, trials: int, algo: str) -> DataFrame:
    """Trials share the stored edges; only repair keeps what it knows of a pair by trial."""
    return _repeat(edges, trials) if algo == "color_repair" else edges


def coloring_trials(
    vertices: DataFrame | None,
    edges: DataFrame,
    trials: int,
    seed: int = 0,
    algo: str = "color_greedy",
    **options,
) -> DataFrame:
    """``(trial, id, color)``: ``trials`` colourings with independent vertex orders."""
    check_at_least("trials", trials, 1)
    vertices = vertices_of(edges) if vertices is None else vertices
    return COLORINGS[algo](
        _repeat(vertices.select("id"), trials),
        _edges_of_trials(edges.select("src", "dst"), trials, algo),
        by=["trial"],
        priority=lambda id_: hash_priority(id_, seed, F.col("trial")),
        **options,
    )


def cover_trials(pairs: DataFrame, trials: int, seed: int = 0, **options) -> DataFrame:
    """``(trial, step, set_id, gain)``: ``trials`` covers with independent tie-breaking."""
    check_at_least("trials", trials, 1)
    return greedy_set_cover(
        pairs.select("set_id", "elem_id"),
        copies=("trial", trials),
        by=["trial"],
        ties="hash",
        seed=seed,
        **options,
    )


def trial_sizes(result: DataFrame) -> DataFrame:
    """``(trial, size)``: colours used, or sets picked."""
    if "color" in result.columns:
        return n_colors(result, ["trial"]).select("trial", F.col("colors").alias("size"))
    return result.groupBy("trial").agg(F.count(F.lit(1)).alias("size"))


def best_of_trials(result: DataFrame) -> DataFrame:
    """The rows of the smallest trial; the lowest trial number among equals."""
    best = trial_sizes(result).agg(F.min(F.struct("size", "trial")).alias("b")).first()["b"]
    return result.where(F.col("trial") == best["trial"])


def _run(
    spark: SparkSession, tuples: DataFrame, configs: list[tuple], algo: str, trials: int, seed: int
) -> DataFrame:
    """Solve all configurations and trials at once; ``tuples`` is keyed by ``config``."""
    ws = Workspace(spark, "sweep")
    began = time.monotonic()
    key = ["config", "trial"]
    if algo == "cover":
        solved = greedy_set_cover(
            tuples, copies=("trial", trials), by=key, ties="hash", seed=seed
        )
        sizes = solved.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    else:
        rank = lambda id_: hash_priority(id_, seed, F.col("trial"))
        if algo == "color_greedy":
            # First fit on tuples needs none of their conflicts written.
            solved = color_tuples(_repeat(tuples, trials), by=key, priority=rank)
        else:
            tuples = ws.write(tuples, "tuples")
            edges = conflict_graph(tuples, by=["config"])
            solved = COLORINGS[algo](
                _repeat(tuples.select("config", F.col("tuple_id").alias("id")), trials),
                _edges_of_trials(edges, trials, algo),
                by=key,
                priority=rank,
            )
        sizes = n_colors(solved, key).select(*key, F.col("colors").alias("size"))
    sizes = ws.write(sizes, "sizes")
    ws.finish("sizes")
    seconds = time.monotonic() - began
    listed = spark.createDataFrame(configs, "config int, t int, n int, v bigint")
    return sizes.join(F.broadcast(listed), "config").select(
        "t",
        "n",
        "v",
        "trial",
        F.lit(algo).alias("algo"),
        F.lit(seconds).alias("seconds"),
        "size",
    )


def sweep(
    df: DataFrame,
    cols: list[str],
    ts: Iterable[int],
    ns: Iterable[int],
    algo: str = "color_greedy",
    trials: int = 1,
    seed: int = 0,
) -> DataFrame:
    """``(t, n, v, trial, algo, seconds, size)`` over the first ``n`` of ``cols``, for each t, n.

    ``algo`` is a colouring of the conflict graph of the observed t-tuples, or ``cover``: the
    fewest rows of the table that contain every observed t-tuple. ``v`` is the size of the
    largest domain. ``seconds`` is the time of the whole job, as all runs share it. Pairs with
    ``t > n`` are left out.
    """
    check_at_least("trials", trials, 1)
    ns = list(ns)
    asked = [(t, n) for t in ts for n in ns if t <= n]
    if not asked:
        raise ValueError("no configuration with t <= n")
    for t, n in asked:
        check_strength(t, n)
        if n > len(cols):
            raise ValueError(f"n={n} is more than the {len(cols)} columns")
    sizes = {
        r["var"]: r["n"]
        for r in domains(df, cols).groupBy("var").agg(F.count("*").alias("n")).collect()
    }
    # The table is read once; every configuration starts from its distinct rows.
    rows = Workspace(df.sparkSession, "sweep").write(df.select(*cols).distinct(), "rows")
    keyed, configs = None, []
    for number, (t, n) in enumerate(asked):
        used = cols[:n]
        if algo == "cover":
            part = incidence(rows, used, t)
        else:
            part = tway_tuples(rows, used, t).drop("support")
        part = part.withColumn("config", F.lit(number))
        keyed = part if keyed is None else keyed.unionByName(part)
        configs.append((number, t, n, max(sizes.get(c, 0) for c in used)))
    return _run(df.sparkSession, keyed, configs, algo, trials, seed)


def synthetic_sweep(
    spark: SparkSession,
    ts: Iterable[int],
    ns: Iterable[int],
    vs: Iterable[int],
    algo: str = "color_greedy",
    trials: int = 1,
    seed: int = 0,
) -> DataFrame:
    """The same over complete domains of ``n`` variables with ``v`` values each.

    ``cover`` takes its candidate rows from the full factorial, so keep ``v ** n`` small.
    """
    ns, vs = list(ns), list(vs)
    keyed, configs = None, []
    for t, n, v in [(t, n, v) for t in ts for n in ns for v in vs if t <= n]:
        check_strength(t, n)
        domain = synthetic_domain(spark, n, v)
        if algo == "cover":
            rows = all_rows(domain)
            part = incidence(rows, [c for c in rows.columns if c != "row_id"], t, row_id="row_id")
        else:
            part = all_tuples(domain, t)
        part = part.withColumn("config", F.lit(len(configs)))
        keyed = part if keyed is None else keyed.unionByName(part)
        configs.append((len(configs), t, n, v))
    if keyed is None:
        raise ValueError("no configuration with t <= n")
    return _run(spark, keyed, configs, algo, trials, seed)
