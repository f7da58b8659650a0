"""Plain SQL for the registered queries, written for DuckDB from the rules, not from the plans.

The iterative rules are recursive queries that carry the whole state of a round.
"""

from __future__ import annotations

import random
from itertools import combinations

from .queries import FLAGS, LINE, ORDER, PART

ORDERS = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"


def _text(cols) -> str:
    """Canonical text of the named columns (the tables hold no separators to escape)."""
    return " || '|' || ".join(f"'{c}:' || CAST({c} AS VARCHAR)" for c in sorted(cols))


def _subsets(cols, t):
    return [tuple(s) for s in combinations(sorted(cols), t)]


def _tuples(source, subsets) -> str:
    """(tuple, support) of the observed tuples."""
    return " UNION ALL ".join(
        f"SELECT {_text(s)} AS tuple, count(*) AS support FROM {source} GROUP BY {', '.join(s)}"
        for s in subsets
    )


def _named(source, subsets) -> str:
    return f"SELECT md5(tuple) AS tuple_id, tuple, support FROM ({_tuples(source, subsets)})"


def _items(source, cols, t) -> str:
    """(tuple_id, var, value), one row per variable of every observed tuple."""
    return " UNION ALL ".join(
        f"SELECT md5({_text(s)}) AS tuple_id, '{c}' AS var, CAST({c} AS VARCHAR) AS value "
        f"FROM (SELECT DISTINCT {', '.join(s)} FROM {source})"
        for s in _subsets(cols, t)
        for c in s
    )


def _incidence(source, cols, t) -> str:
    """(r, x): distinct rows and the tuples in them."""
    return " UNION ALL ".join(
        f"SELECT md5({_text(cols)}) AS r, md5({_text(s)}) AS x "
        f"FROM (SELECT DISTINCT {', '.join(cols)} FROM {source})"
        for s in _subsets(cols, t)
    )


def _possible(source, subset) -> str:
    return ", ".join(
        f"(SELECT DISTINCT {c} FROM {source} WHERE {c} IS NOT NULL) d_{c}" for c in subset
    )


def _conflict_edges(source, cols, t) -> str:
    return f"""SELECT DISTINCT a.tuple_id AS src, b.tuple_id AS dst
        FROM ({_items(source, cols, t)}) a JOIN ({_items(source, cols, t)}) b
        ON a.var = b.var AND a.value <> b.value AND a.tuple_id < b.tuple_id"""


def _matched_classes(source, cols, t) -> str:
    """Colour classes by matching one subset of the columns at a time, subsets by name."""
    every = sorted(cols)
    parts = [f"c AS (SELECT 0 AS color, {', '.join(f'NULL::VARCHAR AS {v}' for v in every)} WHERE false)"]
    last, filled = "c", []
    for k, s in enumerate(_subsets(cols, t)):
        held = ", ".join(f"CAST({v} AS VARCHAR) AS {v}" for v in s)
        parts.append(
            f"t{k} AS (SELECT md5({_text(s)}) AS id, md5(md5({_text(s)})) AS pr, {held} "
            f"FROM (SELECT DISTINCT {', '.join(s)} FROM {source}))"
        )
        met = []
        for size in range(len(s), -1, -1):
            for p in combinations(s, size):
                name = f"{k}_{len(met)}"
                taken = "".join(f" AND id NOT IN (SELECT id FROM {m})" for m in met)
                split = f"PARTITION BY {', '.join(p)} " if p else ""
                kind = " AND ".join(f"{v} IS {'NOT ' if v in p else ''}NULL" for v in s)
                same = "".join(f" AND w.{v} = o.{v}" for v in p)
                parts += [
                    f"w{name} AS (SELECT *, row_number() OVER ({split}ORDER BY pr, id) AS pos FROM t{k} WHERE true{taken})",
                    f"o{name} AS (SELECT *, row_number() OVER ({split}ORDER BY color) AS pos FROM {last} WHERE {kind})",
                    f"m{name} AS (SELECT w.id, o.color, {', '.join(f'w.{v}' for v in s)} "
                    f"FROM w{name} w JOIN o{name} o ON w.pos = o.pos{same})",
                ]
                met.append(f"m{name}")
        taken = "".join(f" AND id NOT IN (SELECT id FROM {m})" for m in met)
        parts.append(
            f"n{k} AS (SELECT id, coalesce((SELECT max(color) FROM {last}), 0) + row_number() OVER (ORDER BY pr, id) "
            f"AS color, {', '.join(s)} FROM t{k} WHERE true{taken})"
        )
        parts.append(f"f{k} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {m}' for m in [*met, f'n{k}'])})")
        grown = ", ".join(f"coalesce(a.{v}, b.{v}) AS {v}" if v in s else f"a.{v}" for v in every)
        parts.append(f"c{k} AS MATERIALIZED (SELECT color, {grown} FROM {last} a FULL JOIN f{k} b USING (color))")
        last = f"c{k}"
        filled.append(f"SELECT id, CAST(color AS INT) AS color FROM f{k}")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(filled)}"


DISPATCH = """SELECT DISTINCT f AS src, o AS dst FROM (
    SELECT l_orderkey AS o, min(l_orderkey) OVER (PARTITION BY l_suppkey, l_shipdate) AS f
    FROM lineitem
    UNION ALL
    SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) FROM orders) WHERE o <> f"""

MEX = """list_min(list_filter(range(1, len({0}) + 2), lambda c: NOT list_contains({0}, c)))"""

# Vertices v(k, id, pr) and undirected edges (k, src, dst); k tells independent problems apart.
HASHED_ORDERS = "SELECT 0 AS k, o_orderkey AS id, md5(CAST(o_orderkey AS VARCHAR)) AS pr FROM orders"


def _graph(vertices: str, edges: str) -> str:
    return f"""v AS MATERIALIZED ({vertices}),
    und AS MATERIALIZED ({edges}),
    e AS MATERIALIZED (
        SELECT k, src AS a, dst AS b FROM und UNION ALL SELECT k, dst, src FROM und),
    ranked AS MATERIALIZED (
        SELECT e.k, e.a, e.b, va.pr AS pa, vb.pr AS pb
        FROM e JOIN v va ON va.k = e.k AND va.id = e.a JOIN v vb ON vb.k = e.k AND vb.id = e.b),
    down AS MATERIALIZED (SELECT k, a, b FROM ranked WHERE (pb, b) < (pa, a))"""


def _schedule(vertices: str, edges: str, new_color: str, select: str) -> str:
    """A vertex is coloured once its smaller neighbours are; ``new_color`` sees their colours."""
    return f"""WITH RECURSIVE {_graph(vertices, edges)},
    st(rd, k, id, color) AS (
        SELECT 0, k, id, CAST(NULL AS BIGINT) FROM v
        UNION ALL
        SELECT s.rd + 1, s.k, s.id,
            CASE WHEN s.color IS NOT NULL THEN s.color
                 WHEN n.id IS NULL THEN 1
                 WHEN n.waits = 0 THEN {new_color} END
        FROM st s LEFT JOIN (
            SELECT d.k, d.a AS id, count(*) FILTER (w.color IS NULL) AS waits,
                   list(DISTINCT w.color) FILTER (w.color IS NOT NULL) AS cs,
                   max(w.color) AS top
            FROM down d JOIN st w ON w.k = d.k AND w.id = d.b GROUP BY d.k, d.a) n
        ON n.k = s.k AND n.id = s.id
        WHERE EXISTS (SELECT 1 FROM st z WHERE z.color IS NULL)),
    colored AS (SELECT k, id, CAST(color AS INTEGER) AS color FROM st
                WHERE rd = (SELECT max(rd) FROM st))
    {select}"""


FIRST_FIT = MEX.format("n.cs")
LONGEST = "n.top + 1"


def _repair(vertices: str, edges: str, freeze: bool) -> str:
    return f"""WITH RECURSIVE {_graph(vertices, edges)},
    st(rd, k, id, color, frozen, changed) AS (
        SELECT 0, k, id, CAST(1 AS BIGINT), false, true FROM v
        UNION ALL
        SELECT s.rd + 1, s.k, s.id,
            CASE WHEN s.frozen OR n.id IS NULL OR n.keeps THEN s.color ELSE n.free END,
            {'true' if freeze else 'false'} AND (s.frozen OR n.id IS NULL OR n.keeps
                OR n.free = s.color),
            NOT (s.frozen OR n.id IS NULL OR n.keeps) AND n.free <> s.color
        FROM st s LEFT JOIN (
            SELECT k, id, {MEX.format("cs")} AS free, clash AND first AS keeps FROM (
                SELECT r.k, r.a AS id, list(DISTINCT w.color) AS cs,
                       bool_or(w.color = o.color) AS clash,
                       bool_and(w.color <> o.color OR (r.pa, r.a) < (r.pb, r.b)) AS first
                FROM ranked r JOIN st w ON w.k = r.k AND w.id = r.b
                              JOIN st o ON o.k = r.k AND o.id = r.a
                GROUP BY r.k, r.a)) n
        ON n.k = s.k AND n.id = s.id
        WHERE EXISTS (SELECT 1 FROM st z WHERE z.changed))
    SELECT id, CAST(color AS INTEGER) AS color FROM st WHERE rd = (SELECT max(rd) FROM st)"""


def _cover(pairs: str, tie: str, select: str) -> str:
    """``pairs`` is (k, s, e); one pick per problem and step. The null row keeps the last pick."""
    best = """SELECT k, s, c FROM (
        SELECT x.k, x.s, count(*) AS c, row_number() OVER (
            PARTITION BY x.k ORDER BY count(*) DESC, min(t.tie), x.s) AS rn
        FROM g x JOIN ties t ON t.k = x.k AND t.s = x.s GROUP BY x.k, x.s) WHERE rn = 1"""
    return f"""WITH RECURSIVE inc AS MATERIALIZED (SELECT DISTINCT k, s, e FROM ({pairs})),
    ties AS MATERIALIZED (SELECT k, s, {tie} AS tie FROM (SELECT DISTINCT k, s FROM inc)),
    g(step, k, pick, gain, s, e) AS (
        SELECT 0, k, CASE WHEN false THEN s END, CAST(NULL AS BIGINT), s, e FROM (
            SELECT k, s, e FROM inc UNION ALL SELECT DISTINCT k, NULL, NULL FROM inc)
        UNION ALL
        SELECT g.step + 1, g.k, b.s, b.c, g.s, g.e
        FROM g JOIN ({best}) b ON b.k = g.k
        LEFT JOIN (SELECT h.k, h.e FROM g h JOIN ({best}) q ON q.k = h.k AND q.s = h.s) gone
            ON gone.k = g.k AND gone.e = g.e
        WHERE gone.e IS NULL),
    picked AS (SELECT k, CAST(step AS INTEGER) AS step, pick, gain FROM g
               WHERE step > 0 AND s IS NULL)
    {select}"""


def _batched_cover(pairs, eps) -> str:
    """Rounds of near-best sets: elements go to their first able set, then to their first accepted one.

    The recursion carries the pairs that are left, and for a covered element the pair that covers it.
    """
    keep = 1 - eps
    return f"""WITH RECURSIVE pair AS MATERIALIZED (SELECT DISTINCT s, e, md5('0:' || s) AS h FROM ({pairs})),
    r AS (
      SELECT 0 AS round, s, e, h, false AS done FROM pair
      UNION ALL
      SELECT round + 1, s, e, h, taken IS NOT NULL FROM (
        SELECT *, min(CASE WHEN able AND n >= best * {keep} * {keep} THEN h END) OVER (PARTITION BY e) AS taken
        FROM (
          SELECT *, count(CASE WHEN able AND h = first THEN 1 END) OVER (PARTITION BY s) AS n FROM (
            SELECT *, min(CASE WHEN able THEN h END) OVER (PARTITION BY e) AS first FROM (
              SELECT *, g >= best * {keep} AS able FROM (
                SELECT *, max(g) OVER () AS best FROM (
                  SELECT *, count(*) OVER (PARTITION BY s) AS g FROM r WHERE NOT done))))))
      WHERE taken IS NULL OR h = taken),
    picked AS (SELECT round, s, count(*) AS gain FROM r WHERE done GROUP BY round, s),
    price AS (SELECT e, 1000000000000 // gain AS price FROM r JOIN picked USING (round, s) WHERE done),
    load AS (SELECT sum(price) AS load FROM pair JOIN price USING (e) GROUP BY s)
    SELECT CAST(row_number() OVER (ORDER BY round, gain DESC, s) AS INT) AS step, s AS set_id, gain,
      CAST(((SELECT sum(price) FROM price) + (SELECT max(load) FROM load) - 1) // (SELECT max(load) FROM load)
        AS BIGINT) AS at_least
    FROM picked"""


SUPPLY = "SELECT 0 AS k, l_suppkey AS s, l_partkey AS e FROM lineitem"
PICKS = "SELECT step, pick AS set_id, gain FROM picked"
COLORS = "SELECT id, color FROM colored"
DISPATCH_K = f"SELECT 0 AS k, src, dst FROM ({DISPATCH})"


def _trials(count: int) -> str:
    return f"(SELECT CAST(range AS INTEGER) AS k FROM range(1, {count + 1}))"


def _tuple_vertices(source, cols, t) -> str:
    ids = f"SELECT DISTINCT tuple_id AS id FROM ({_items(source, cols, t)})"
    return f"SELECT 0 AS k, id, md5(id) AS pr FROM ({ids})"


def _keyed_conflicts(source, cols, t) -> str:
    return f"SELECT 0 AS k, src, dst FROM ({_conflict_edges(source, cols, t)})"


def _rows_from_coloring() -> str:
    cols = sorted(ORDER)
    picked = ", ".join(f"max(value) FILTER (var = '{c}') AS {c}" for c in cols)
    return _schedule(
        _tuple_vertices(ORDERS, ORDER, 2),
        _keyed_conflicts(ORDERS, ORDER, 2),
        FIRST_FIT,
        f"""SELECT color, {picked} FROM colored
        JOIN ({_items(ORDERS, ORDER, 2)}) i ON i.tuple_id = id GROUP BY color""",
    )


def _sweep_coloring() -> str:
    """Problems are (n, trial), k = 10 * n + trial."""
    vertices, edges, sizes = [], [], []
    for n in (2, 3):
        used = ORDER[:n]
        ids = f"SELECT DISTINCT tuple_id AS id FROM ({_items(ORDERS, used, 2)})"
        vertices.append(
            f"SELECT {10 * n} + t.k AS k, id, md5('1:' || t.k || ':' || id) AS pr "
            f"FROM ({ids}), {_trials(2)} t"
        )
        edges.append(
            f"SELECT {10 * n} + t.k AS k, src, dst "
            f"FROM ({_conflict_edges(ORDERS, used, 2)}), {_trials(2)} t"
        )
        most = ", ".join(f"(SELECT count(DISTINCT {c}) FROM {ORDERS})" for c in used)
        sizes.append(f"SELECT {n} AS n, greatest({most}) AS v")
    return _schedule(
        " UNION ALL ".join(vertices),
        " UNION ALL ".join(edges),
        FIRST_FIT,
        f"""SELECT 2 AS t, n, v, CAST(k % 10 AS INTEGER) AS trial, 'color_greedy' AS algo,
            count(DISTINCT color) AS size
        FROM colored JOIN ({" UNION ALL ".join(sizes)}) ON n = k // 10 GROUP BY n, v, k""",
    )


def _sweep_cover() -> str:
    pairs, sizes = [], []
    for config, n in enumerate((2, 3)):
        used = FLAGS[:n]
        pairs.append(f"SELECT {config} AS k, r AS s, x AS e FROM ({_incidence('lineitem', used, 2)})")
        most = ", ".join(f"(SELECT count(DISTINCT {c}) FROM lineitem)" for c in used)
        sizes.append(f"SELECT {config} AS k, {n} AS n, greatest({most}) AS v")
    return _cover(
        " UNION ALL ".join(pairs),
        "md5('1:' || k || ':1:' || s)",
        f"""SELECT 2 AS t, n, v, 1 AS trial, 'cover' AS algo, count(*) AS size
        FROM picked JOIN ({" UNION ALL ".join(sizes)}) z ON z.k = picked.k GROUP BY n, v""",
    )


def _coverage(source, cols, t) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{",".join(s)}' AS variables,
        (SELECT count(*) FROM (SELECT DISTINCT {", ".join(s)} FROM {source})) AS covered,
        {" * ".join(f"(SELECT count(DISTINCT {c}) FROM {source})" for c in s)} AS possible"""
        for s in _subsets(cols, t)
    )


def _all_tuples(source, subsets) -> str:
    return " UNION ALL ".join(
        f"SELECT {_text(s)} AS tuple FROM {_possible(source, s)}" for s in subsets
    )


def _numbered_hyperedges() -> str:
    return f"""WITH inc AS ({_incidence("lineitem", LINE, 2)}),
    num AS (SELECT x, row_number() OVER (ORDER BY x) AS e FROM (SELECT DISTINCT x FROM inc)),
    lines AS (SELECT r, string_agg(CAST(e AS VARCHAR), ' ' ORDER BY e) AS members
              FROM inc JOIN num USING (x) GROUP BY r)
    SELECT members, count(*) AS n FROM lines GROUP BY members"""


def build() -> dict[str, str]:
    greedy = _schedule(HASHED_ORDERS, DISPATCH_K, FIRST_FIT, COLORS)
    sliding = [tuple(sorted(s)) for s in (PART[:3], (PART[0], *PART[2:]), PART[1:])]
    dispatch_once = f"""SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst
        FROM ({DISPATCH})"""
    both = f"SELECT src, dst FROM ({DISPATCH}) UNION ALL SELECT dst, src FROM ({DISPATCH})"
    flags_color = _schedule(
        _tuple_vertices("lineitem", FLAGS, 2),
        _keyed_conflicts("lineitem", FLAGS, 2),
        FIRST_FIT,
        COLORS,
    )
    trial_vertices = f"""SELECT t.k, o_orderkey AS id, md5('5:' || t.k || ':' || o_orderkey) AS pr
        FROM orders, {_trials(3)} t"""
    trial_edges = f"SELECT t.k, src, dst FROM ({DISPATCH}), {_trials(3)} t"
    draw = random.Random(4).randint(-9, 9)
    return {
        "domains": " UNION ALL ".join(
            f"SELECT DISTINCT '{c}' AS var, CAST({c} AS VARCHAR) AS value FROM part" for c in PART
        ),
        "all_rows": f"""SELECT md5({_text(FLAGS)}) AS row_id,
            {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in FLAGS)}
            FROM {_possible("lineitem", FLAGS)}""",
        "tway_tuples": _named("lineitem", _subsets(LINE, 2)),
        "tway_tuples_strength3": _named(ORDERS, _subsets(ORDER, 3)),
        "tway_tuples_sliding": _named("part", sliding),
        "all_tuples": f"""SELECT md5(tuple) AS tuple_id, tuple
            FROM ({_all_tuples("lineitem", _subsets(LINE, 2))})""",
        "tway_coverage": _coverage("part", PART, 3),
        "missing_tuples": f"""SELECT md5(tuple) AS tuple_id, tuple FROM (
            {_all_tuples("part", _subsets(PART, 3))}
            EXCEPT SELECT tuple FROM ({_tuples("part", _subsets(PART, 3))}))""",
        "incidence_rows": f"""SELECT r AS set_id, x AS elem_id
            FROM ({_incidence("lineitem", LINE, 2)})""",
        "incidence_tuples": f"""SELECT x AS set_id, r AS elem_id
            FROM ({_incidence("lineitem", LINE, 2)})""",
        "conflict_graph": _conflict_edges("lineitem", FLAGS, 2),
        "conflict_graph_strength3": _conflict_edges(ORDERS, ORDER, 3),
        "conflict_vertices": f"""WITH c AS ({_conflict_edges("lineitem", FLAGS, 2)})
            SELECT src AS id FROM c UNION SELECT dst FROM c""",
        "adjacency": f"""SELECT o_orderkey AS id, 0 AS block, count(dst) AS degree,
            coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst), '') AS nbrs
            FROM orders LEFT JOIN (SELECT DISTINCT src, dst FROM ({both})) ON src = o_orderkey
            GROUP BY o_orderkey""",
        "adjacency_blocks": f"""SELECT src AS id, count(*) AS degree,
            string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs
            FROM (SELECT DISTINCT src, dst FROM ({both})) GROUP BY src""",
        "assign_priority": """SELECT o_orderkey AS id, md5('11:' || o_orderkey) AS priority
            FROM orders""",
        "greedy_set_cover": _cover(SUPPLY, "0", PICKS),
        "greedy_set_cover_digit_ties": _cover(SUPPLY, f"abs({draw} - s % 10)", PICKS),
        "greedy_hitting_set": _cover(
            f"SELECT 0 AS k, r AS s, x AS e FROM ({_incidence('lineitem', FLAGS, 2)})",
            "0",
            "SELECT step, pick AS elem_id, gain FROM picked",
        ),
        "greedy_cover_of_orders": _cover(
            f"SELECT 0 AS k, r AS s, x AS e FROM ({_incidence(ORDERS, ORDER, 2)})", "0", PICKS
        ),
        "greedy_set_cover_batched": _batched_cover(SUPPLY, 0.5),
        "cover_trials": _cover(
            f"""SELECT t.k, r AS s, x AS e
            FROM ({_incidence("lineitem", FLAGS, 2)}), {_trials(3)} t""",
            "md5('2:' || k || ':' || s)",
            "SELECT k AS trial, step, pick AS set_id, gain FROM picked",
        ),
        "color_greedy": greedy,
        "color_greedy_broadcast": greedy,
        "color_greedy_adjacency": greedy,
        "color_rounds": _schedule(HASHED_ORDERS, DISPATCH_K, LONGEST, COLORS),
        "color_repair": _repair(HASHED_ORDERS, DISPATCH_K, True),
        "color_repair_unfrozen": _repair(HASHED_ORDERS, DISPATCH_K, False),
        "color_conflict_graph": flags_color,
        "color_tuples": flags_color,
        "color_tuples_batched": _matched_classes("lineitem", LINE, 2),
        "rows_from_coloring": _rows_from_coloring(),
        "n_colors": _schedule(
            HASHED_ORDERS,
            DISPATCH_K,
            FIRST_FIT,
            "SELECT count(DISTINCT color) AS colors, max(color) AS max_color FROM colored",
        ),
        "validate_coloring": f"""WITH half AS MATERIALIZED (
                SELECT src, dst, o_orderpriority AS p, o_orderstatus AS s FROM ({DISPATCH})
                JOIN orders ON o_orderkey = src)
            SELECT 'naive' AS coloring, src, dst FROM half
            JOIN orders ON o_orderkey = dst AND o_orderpriority = p
            UNION ALL
            SELECT 'partial', src, dst FROM half JOIN orders ON o_orderkey = dst
            WHERE s <> 'F' OR o_orderstatus <> 'F' OR o_orderpriority = p""",
        "coloring_trials": _schedule(
            trial_vertices,
            trial_edges,
            LONGEST,
            "SELECT k AS trial, count(DISTINCT color) AS size FROM colored GROUP BY k",
        ),
        "best_of_trials": _schedule(
            trial_vertices,
            trial_edges,
            FIRST_FIT,
            """SELECT k AS trial, id, color FROM colored WHERE k = (
                SELECT k FROM colored GROUP BY k ORDER BY count(DISTINCT color), k LIMIT 1)""",
        ),
        "sweep_coloring": _sweep_coloring(),
        "sweep_cover": _sweep_cover(),
        "hyperedge_files": _numbered_hyperedges(),
        "hyperedge_strings": """SELECT l_orderkey, CAST(1 AS BIGINT) AS set_id, elem_id,
            count(*) AS n FROM (
                SELECT l_orderkey, l_partkey AS elem_id FROM lineitem
                UNION ALL
                SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey <> l_partkey)
            GROUP BY l_orderkey, elem_id""",
        "graphviz_files": DISPATCH,
        "graphviz_strings": f"""SELECT src, dst FROM ({DISPATCH})
            UNION ALL SELECT dst, src FROM ({DISPATCH})""",
        "dimacs_files": dispatch_once,
        "dimacs_strings": f"SELECT src AS own, src, dst FROM ({dispatch_once})",
        "dimacs_vertex_range": """SELECT range AS id
            FROM range(1, (SELECT max(o_orderkey) + 1 FROM orders))""",
        "result_files": f"""SELECT 2 AS t, 3 AS n, possible AS v, algo,
            CASE algo WHEN 'covered' THEN covered ELSE possible END AS size
            FROM ({_coverage(ORDERS, ORDER, 2)}), (VALUES ('covered'), ('possible')) a(algo)""",
    }
