"""Graph text: Graphviz edge lines and DIMACS. Ids are taken as written, never shifted.

Only the start of a line is fixed by its grammar: attributes, weights and comments may follow, and
are not kept. A line that starts like an edge and has no two ids raises when rows are taken, so no
edge is lost without a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import undirected

# Fixed patterns of the two grammars. A Graphviz line that starts with an id is a vertex line
# (`0 [label="..."];`, `0;`, `0 // comment`) or an edge line; edge lines may be chains (`7 -- 8 -- 9`) and
# directed ones (`->`), and any other word between two ids is taken for a connector.
GRAPHVIZ_VERTEX = r"^\s*\d+\s*(\[.*|;.*|//.*|#.*)?$"
GRAPHVIZ_CHAIN = r"^\s*\d+(\s*(--|->)\s*\d+)+"
# A chain that goes on to something that is no number, as a subgraph or a quoted id.
GRAPHVIZ_TAIL = r"^\s*\d++(\s*(--|->)\s*\d++)++\s*(--|->)"
GRAPHVIZ_OTHER = r"^\s*(\d+)\s+[^\s\[;]+\s+(\d+)"
GRAPHVIZ_ID = r"^\s*\d"
# A `;` with an id after it, and the statements between such: quotes, brackets and comments stay whole.
GRAPHVIZ_MORE = r"^\s*\d.*;\s*\d"
GRAPHVIZ_STATEMENT = (
    r'(?://.*|#.*|/\*.*?\*/|\[(?:"(?:\\.|[^"\\])*"|[^\]"])*\]|\[.*|"(?:\\.|[^"\\])*"|".*|[^;\["])+'
)
DIMACS_EDGE = r"^\s*e\s+(\d+)\s+(\d+)(\s.*)?$"
DIMACS_START = r"^\s*e(\s|$)"
DIMACS_SIZE = r"^\s*p\s+\S+\s+(\d+)\s+(\d+)"


def _wrong(line: Column) -> Column:
    return F.raise_error(F.concat(F.lit("not an edge line: "), line))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("bigint").alias("src"), b.cast("bigint").alias("dst"))


def _graphviz(lines: DataFrame, rest: list[str]) -> DataFrame:
    """The edges of every statement of lines that start with an id, a chain giving one for each step."""
    line = F.col("value")
    statements = F.regexp_extract_all(line, F.lit(GRAPHVIZ_STATEMENT), 0)
    statements = F.when(line.rlike(GRAPHVIZ_MORE), statements).otherwise(F.array(line))
    lines = lines.select(*rest, F.explode(statements).alias("value"))
    ids = F.regexp_extract_all(F.regexp_extract(line, GRAPHVIZ_CHAIN, 0), F.lit(r"\d+"), 0)
    chain = F.transform(
        F.sequence(F.lit(0), F.size(ids) - 2), lambda i: _pair(F.get(ids, i), F.get(ids, i + 1))
    )
    other = F.array(_pair(*(F.regexp_extract(line, GRAPHVIZ_OTHER, i) for i in (1, 2))))
    edges = (
        F.when(line.rlike(GRAPHVIZ_TAIL), _wrong(line))
        .when(line.rlike(GRAPHVIZ_CHAIN), chain)
        .when(line.rlike(GRAPHVIZ_OTHER), other)
        .otherwise(_wrong(line))
    )
    found = lines.where(line.rlike(GRAPHVIZ_ID) & ~line.rlike(GRAPHVIZ_VERTEX))
    return found.select(*rest, F.inline(edges))


def _dimacs(lines: DataFrame, rest: list[str]) -> DataFrame:
    line = F.col("value")
    edge = F.when(
        line.rlike(DIMACS_EDGE), _pair(*(F.regexp_extract(line, DIMACS_EDGE, i) for i in (1, 2)))
    ).otherwise(_wrong(line))
    found = lines.where(line.rlike(DIMACS_START)).select(*rest, edge.alias("edge"))
    return undirected(found.select(*rest, "edge.*"), rest)


def _lines_of(df: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(F.split(F.col(text), r"\r?\n")).alias("value")), rest


def _lines_in(spark: SparkSession, path, by_path: bool) -> tuple[DataFrame, list[str]]:
    lines = spark.read.text(path)
    if by_path:
        return lines.select(F.input_file_name().alias("path"), "value"), ["path"]
    return lines.select("value"), []


def read_graphviz(spark: SparkSession, path: str | list[str], by_path: bool = False) -> DataFrame:
    """``(src, dst)`` of every edge, repeats included; with ``by_path`` a ``path`` first.

    Without it the files of a folder are parts of one graph.
    """
    return _graphviz(*_lines_in(spark, path, by_path))


def parse_graphviz(df: DataFrame, text: str = "text") -> DataFrame:
    """The same over a string column; the other columns are kept."""
    return _graphviz(*_lines_of(df, text))


def read_dimacs(spark: SparkSession, path: str | list[str], by_path: bool = False) -> DataFrame:
    """``(src, dst)`` of the edges, each undirected edge once; with ``by_path`` once per file."""
    return _dimacs(*_lines_in(spark, path, by_path))


def parse_dimacs(df: DataFrame, text: str = "text") -> DataFrame:
    """The same over a string column; edges are told apart by the other columns."""
    return _dimacs(*_lines_of(df, text))


def dimacs_vertices(spark: SparkSession, path: str | list[str], by_path: bool = False) -> DataFrame:
    """``id`` 1..V as declared by the ``p`` line, isolated vertices included.

    With ``by_path`` every file has its own range; else the largest one counts.
    """
    lines, rest = _lines_in(spark, path, by_path)
    declared = lines.where(F.col("value").rlike(DIMACS_SIZE)).groupBy(*rest).agg(
        F.max(F.regexp_extract("value", DIMACS_SIZE, 1).cast("bigint")).alias("v")
    )
    if by_path:
        return declared.where("v > 0").select(*rest, F.explode(F.expr("sequence(1L, v)")).alias("id"))
    largest = declared.first()
    if largest is None or largest["v"] is None:
        raise ValueError("no 'p' line found")
    return spark.range(1, largest["v"] + 1)
