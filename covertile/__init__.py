"""Combinatorial coverage, greedy cover and graph colouring over Spark DataFrames."""

from .operators.coloring import (
    NotConverged,
    color_greedy,
    color_repair,
    color_rounds,
    n_colors,
    rows_from_coloring,
    validate_coloring,
)
from .operators.cover import certified, greedy_hitting_set, greedy_set_cover, uncovered
from .operators.domains import all_rows, domains, synthetic_domain
from .operators.graphs import (
    adjacency,
    assign_priority,
    both_ways,
    conflict_graph,
    undirected,
    vertices_of,
)
from .operators.tuples import (
    all_tuples,
    coverage,
    incidence,
    missing_tuples,
    swap,
    tway_tuples,
)
from .operators.tuple_coloring import color_tuples
from .plans.trials import (
    best_of_trials,
    coloring_trials,
    cover_trials,
    sweep,
    synthetic_sweep,
    trial_sizes,
)
from .sources import (
    dimacs_vertices,
    parse_dimacs,
    parse_graphviz,
    parse_hyperedges,
    read_dimacs,
    read_graphviz,
    read_hyperedges,
    write_hyperedges,
    write_results,
)
