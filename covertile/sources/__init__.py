"""Text formats for hypergraphs, graphs and experiment records."""

from .graphs import dimacs_vertices, parse_dimacs, parse_graphviz, read_dimacs, read_graphviz
from .hyperedges import parse_hyperedges, read_hyperedges, write_hyperedges
from .results import RESULT_COLUMNS, write_results

__all__ = [
    "RESULT_COLUMNS",
    "dimacs_vertices",
    "parse_dimacs",
    "parse_graphviz",
    "parse_hyperedges",
    "read_dimacs",
    "read_graphviz",
    "read_hyperedges",
    "write_hyperedges",
    "write_results",
]
