"""One query per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import covertile as ct
from covertile.functions import canonical
from covertile.plans.ranks import ranked
from covertile.plans.workspace import Workspace

FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]
LINE = [*FLAGS, "l_suppkey"]
PART = ["p_brand", "p_size", "p_type", "p_name"]
ORDER = ["c_mktsegment", "o_orderpriority", "o_orderstatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark, d) -> DataFrame:
    return table(spark, d, "lineitem")


def _orders(spark, d) -> DataFrame:
    """Orders with the market segment of their customer."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def _to_first(df: DataFrame, order: str, group: list[str]) -> DataFrame:
    """Edges between every order of a group and the first order of that group."""
    firsts = df.groupBy(*group).agg(F.min(order).alias("first"))
    return (
        df.select(*group, F.col(order).alias("own"))
        .join(firsts, group)
        .where(F.col("own") != F.col("first"))
        .select(F.col("first").alias("src"), F.col("own").alias("dst"))
    )


def dispatch_edges(spark, d) -> DataFrame:
    """Orders that contend: with the first order a supplier ships on the same day, and with the
    first order of the same customer. As many edges as rows at most, however large a group is."""
    by_day = _to_first(_lineitem(spark, d), "l_orderkey", ["l_suppkey", "l_shipdate"])
    by_customer = _to_first(table(spark, d, "orders"), "o_orderkey", ["o_custkey"])
    return by_day.union(by_customer).distinct()


def order_ids(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))


def _supply(spark, d) -> DataFrame:
    """Suppliers as sets of the parts they ship."""
    return _lineitem(spark, d).select(
        F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("elem_id")
    )


def _text(tuples: DataFrame, *more: str) -> DataFrame:
    return tuples.select("tuple_id", canonical(F.col("items")).alias("tuple"), *more)


def _conflicts(spark, d) -> DataFrame:
    return ct.conflict_graph(ct.tway_tuples(_lineitem(spark, d), FLAGS, 2))


# --- domains, tuples, coverage -----------------------------------------------------------------


def domains(spark, d):
    return ct.domains(table(spark, d, "part"), PART)


def all_rows(spark, d):
    return ct.all_rows(ct.domains(_lineitem(spark, d), FLAGS))


def tway_tuples(spark, d):
    return _text(ct.tway_tuples(_lineitem(spark, d), LINE, 2), "support")


def tway_tuples_strength3(spark, d):
    return _text(ct.tway_tuples(_orders(spark, d), ORDER, 3), "support")


def tway_tuples_sliding(spark, d):
    return _text(ct.tway_tuples(table(spark, d, "part"), PART, 3, mode="sliding"), "support")


def all_tuples(spark, d):
    return _text(ct.all_tuples(ct.domains(_lineitem(spark, d), LINE), 2))


def tway_coverage(spark, d):
    return ct.coverage(table(spark, d, "part"), PART, 3).drop("ratio")


def missing_tuples(spark, d):
    return _text(ct.missing_tuples(table(spark, d, "part"), PART, 3))


def incidence_rows(spark, d):
    return ct.incidence(_lineitem(spark, d), LINE, 2)


def incidence_tuples(spark, d):
    return ct.incidence(_lineitem(spark, d), LINE, 2, by="tuple")


# --- graphs ------------------------------------------------------------------------------------


def conflict_graph(spark, d):
    return _conflicts(spark, d)


def conflict_graph_strength3(spark, d):
    return ct.conflict_graph(ct.tway_tuples(_orders(spark, d), ORDER, 3))


def conflict_vertices(spark, d):
    return ct.vertices_of(_conflicts(spark, d))


def adjacency(spark, d):
    found = ct.adjacency(dispatch_edges(spark, d), order_ids(spark, d))
    nbrs = F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ")
    return found.withColumn("nbrs", nbrs)


def adjacency_blocks(spark, d):
    """Blocks of about three neighbours, so that many vertices have several, put together again."""
    found = ct.adjacency(dispatch_edges(spark, d), neighbours=3)
    whole = found.groupBy("id").agg(
        F.max("degree").alias("degree"), F.flatten(F.collect_list("nbrs")).alias("nbrs")
    )
    nbrs = F.array_join(F.transform(F.sort_array("nbrs"), lambda x: x.cast("string")), " ")
    return whole.withColumn("nbrs", nbrs)


def assign_priority(spark, d):
    return ct.assign_priority(order_ids(spark, d), seed=11)


# --- cover -------------------------------------------------------------------------------------


def greedy_set_cover(spark, d):
    return ct.greedy_set_cover(_supply(spark, d))


def greedy_set_cover_digit_ties(spark, d):
    """Ties by the distance of the last digit of the supplier to a drawn number."""
    return ct.greedy_set_cover(_supply(spark, d), ties="distance", seed=4)


def greedy_hitting_set(spark, d):
    """Fewest distinct rows that together hold every observed pair of values."""
    return ct.greedy_hitting_set(ct.incidence(_lineitem(spark, d), FLAGS, 2, by="tuple"))


def greedy_cover_of_orders(spark, d):
    """Fewest distinct order profiles that hold every observed pair of their values."""
    return ct.greedy_set_cover(ct.incidence(_orders(spark, d), ORDER, 2))


def greedy_set_cover_batched(spark, d):
    """Picks of near-best sets together, and how many sets any cover has at least."""
    pairs = _supply(spark, d)
    return ct.certified(pairs, ct.greedy_set_cover(pairs, batch=0.5))


def cover_trials(spark, d):
    return ct.cover_trials(ct.incidence(_lineitem(spark, d), FLAGS, 2), trials=3, seed=2)


# --- colouring ---------------------------------------------------------------------------------


def color_greedy(spark, d):
    return ct.color_greedy(order_ids(spark, d), dispatch_edges(spark, d))


def color_greedy_broadcast(spark, d):
    return ct.color_greedy(order_ids(spark, d), dispatch_edges(spark, d), join="broadcast")


def color_greedy_adjacency(spark, d):
    return ct.color_greedy(order_ids(spark, d), dispatch_edges(spark, d), layout="adjacency")


def color_rounds(spark, d):
    return ct.color_rounds(order_ids(spark, d), dispatch_edges(spark, d))


def color_repair(spark, d):
    return ct.color_repair(order_ids(spark, d), dispatch_edges(spark, d))


def color_repair_unfrozen(spark, d):
    return ct.color_repair(order_ids(spark, d), dispatch_edges(spark, d), freeze=False)


def color_conflict_graph(spark, d):
    return ct.color_greedy(None, _conflicts(spark, d))


def color_tuples_batched(spark, d):
    """Every pair of values of a line and its supplier, one subset of the columns at a time."""
    tuples = ct.tway_tuples(_lineitem(spark, d), LINE, 2)
    return ct.color_tuples(tuples, batch=True, largest_first=False)


def color_tuples(spark, d):
    return ct.color_tuples(ct.tway_tuples(_lineitem(spark, d), FLAGS, 2))


def rows_from_coloring(spark, d):
    """Test rows that hold every observed pair of values: tuples, colour classes, merged rows."""
    ws = Workspace(spark, "rows")
    tuples = ws.write(ct.tway_tuples(_orders(spark, d), ORDER, 2), "tuples")
    return ct.rows_from_coloring(tuples, ct.color_tuples(tuples), ORDER)


def n_colors(spark, d):
    return ct.n_colors(ct.color_greedy(order_ids(spark, d), dispatch_edges(spark, d)))


def validate_coloring(spark, d):
    """What is wrong with greedy (nothing), with colouring by priority class, and with the same
    where only some orders have a colour."""
    edges = dispatch_edges(spark, d)
    good = ct.color_greedy(order_ids(spark, d), edges)
    naive = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("color")
    )
    some = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    partial = naive.join(some, naive.id == some.o_orderkey, "left_semi")
    found = [
        ct.validate_coloring(partial, edges).select(F.lit("partial").alias("coloring"), "src", "dst"),
        ct.validate_coloring(good, edges).select(F.lit("greedy").alias("coloring"), "src", "dst"),
        ct.validate_coloring(naive, edges).select(F.lit("naive").alias("coloring"), "src", "dst"),
    ]
    return found[0].union(found[1]).union(found[2])


# --- trials and sweeps -------------------------------------------------------------------------


def coloring_trials(spark, d):
    result = ct.coloring_trials(
        order_ids(spark, d), dispatch_edges(spark, d), trials=3, seed=5, algo="color_rounds"
    )
    return ct.trial_sizes(result)


def best_of_trials(spark, d):
    result = ct.coloring_trials(order_ids(spark, d), dispatch_edges(spark, d), trials=3, seed=5)
    return ct.best_of_trials(result)


def sweep_coloring(spark, d):
    found = ct.sweep(_orders(spark, d), ORDER, ts=[2], ns=[2, 3], trials=2, seed=1)
    return found.drop("seconds")


def sweep_cover(spark, d):
    found = ct.sweep(_lineitem(spark, d), FLAGS, ts=[2], ns=[2, 3], algo="cover", seed=1)
    return found.drop("seconds")


# --- text formats ------------------------------------------------------------------------------


def hyperedge_files(spark, d):
    """Rows as sets of numbered value pairs, written as hyperedge text and read back."""
    ws = Workspace(spark, "hyperedge_files")
    pairs = ws.write(ct.incidence(_lineitem(spark, d), LINE, 2), "pairs")
    names = pairs.select("elem_id").distinct()
    numbers = ranked(ws, names, [], [F.col("elem_id")], "names", "number")
    numbered = pairs.join(numbers, "elem_id").select("set_id", F.col("number").alias("elem_id"))
    ct.write_hyperedges(numbered, ws.path("text"))
    back = ct.read_hyperedges(spark, ws.path("text"))
    return (
        back.groupBy("path", "set_id")
        .agg(F.sort_array(F.collect_list("elem_id")).alias("m"))
        .select(F.array_join(F.transform("m", lambda x: x.cast("string")), " ").alias("members"))
        .groupBy("members")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hyperedge_strings(spark, d):
    """Every line item as a text with the count line, a comment and one two-member set."""
    text = _lineitem(spark, d).select(
        "l_orderkey",
        F.concat(
            F.lit("1\n# part and supplier\n\n"),
            F.col("l_partkey").cast("string"),
            F.lit(" "),
            F.col("l_suppkey").cast("string"),
        ).alias("text"),
    )
    back = ct.parse_hyperedges(text)
    return back.groupBy("l_orderkey", "set_id", "elem_id").agg(F.count(F.lit(1)).alias("n"))


def _write_lines(ws: Workspace, lines: DataFrame) -> str:
    lines.select("value").write.text(ws.path("text"))
    return ws.path("text")


def graphviz_files(spark, d):
    ws = Workspace(spark, "graphviz")
    labels = table(spark, d, "orders").selectExpr(
        "concat(o_orderkey, ' [label=\"priority = ', o_orderpriority, '\"];') AS value"
    )
    edges = dispatch_edges(spark, d).selectExpr(
        """concat(src, CASE pmod(src, 3) WHEN 0 THEN ' -- ' WHEN 1 THEN '--' ELSE ' -> ' END, dst,
            CASE pmod(dst, 4) WHEN 0 THEN ' [weight=2, label="8 -- 9"];' WHEN 1 THEN ';'
            WHEN 2 THEN '; // 1 -- 2' ELSE '' END) AS value"""
    )
    return ct.read_graphviz(spark, _write_lines(ws, labels.union(edges)))


def graphviz_strings(spark, d):
    text = dispatch_edges(spark, d).selectExpr(
        "concat('graph G {\n', src, ' [label=\"1 -- 2\"];\n', src, ' -- ', dst, ' -- ', src,"
        " ' [w=1];\n}') AS text"
    )
    return ct.parse_graphviz(text)


def dimacs_files(spark, d):
    """Both directions of every edge are written; each edge comes back once."""
    ws = Workspace(spark, "dimacs")
    lines = ct.both_ways(dispatch_edges(spark, d)).selectExpr(
        "concat('e ', src, ' ', dst, CASE pmod(dst, 2) WHEN 0 THEN ' 5' ELSE '' END) AS value"
    )
    return ct.read_dimacs(spark, _write_lines(ws, lines))


def dimacs_strings(spark, d):
    text = dispatch_edges(spark, d).selectExpr(
        "src AS own", "concat('p edge 2 2\ne ', src, ' ', dst, '\ne ', dst, ' ', src) AS text"
    )
    return ct.parse_dimacs(text)


def dimacs_vertex_range(spark, d):
    """The vertices a DIMACS size line declares, isolated ones included."""
    ws = Workspace(spark, "dimacs_vertices")
    size = table(spark, d, "orders").agg(F.max("o_orderkey").alias("v"))
    lines = size.selectExpr("concat('p edge ', v, ' 0') AS value")
    return ct.dimacs_vertices(spark, _write_lines(ws, lines))


def result_files(spark, d):
    """Coverage figures written as experiment records and read back."""
    ws = Workspace(spark, "results")
    covered = ct.coverage(_orders(spark, d), ORDER, 2)
    for algo in ("covered", "possible"):
        ct.write_results(
            covered.select(
                F.lit(2).alias("t"),
                F.lit(3).alias("n"),
                F.col("possible").alias("v"),
                F.lit(algo).alias("algo"),
                F.lit(0.0).alias("seconds"),
                F.col(algo).alias("size"),
            ),
            ws.path("text"),
        )
    schema = "t int, n int, v bigint, algo string, seconds double, size bigint"
    return spark.read.schema(schema).option("sep", ";").csv(ws.path("text")).drop("seconds")


QUERIES = {
    f.__name__: f
    for f in (
        domains,
        all_rows,
        tway_tuples,
        tway_tuples_strength3,
        tway_tuples_sliding,
        all_tuples,
        tway_coverage,
        missing_tuples,
        incidence_rows,
        incidence_tuples,
        conflict_graph,
        conflict_graph_strength3,
        conflict_vertices,
        adjacency,
        adjacency_blocks,
        assign_priority,
        greedy_set_cover,
        greedy_set_cover_digit_ties,
        greedy_hitting_set,
        greedy_cover_of_orders,
        greedy_set_cover_batched,
        cover_trials,
        color_greedy,
        color_greedy_broadcast,
        color_greedy_adjacency,
        color_rounds,
        color_repair,
        color_repair_unfrozen,
        color_conflict_graph,
        color_tuples,
        color_tuples_batched,
        rows_from_coloring,
        n_colors,
        validate_coloring,
        coloring_trials,
        best_of_trials,
        sweep_coloring,
        sweep_cover,
        hyperedge_files,
        hyperedge_strings,
        graphviz_files,
        graphviz_strings,
        dimacs_files,
        dimacs_strings,
        dimacs_vertex_range,
        result_files,
    )
}
