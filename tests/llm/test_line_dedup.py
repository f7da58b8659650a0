"""Repeated three-line windows against plain Python."""

import random
import re

from pyspark.sql import functions as F

from covertile.llm.line_dedup import drop_repeated_windows


def plain(rows):
    """Rows in the order of (id, place); returns (id, kept text, lines, removed) of each."""
    seen, out = set(), []
    for d, text in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if re.search(r"[^\x20\x09-\x0D]", "".join(w)):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_equals_plain(spark):
    rng = random.Random(7)
    vocabulary = ["a", "b", "", " ", "c d", "é", "footer", "\x1c", "x\ty"]
    rows = [(None, None), (None, "a\nb\nc d\na\nb\nc d"), (1, ""), (2, "\n\n\n\n"), (3, "a\nb"), (4, "q\nq\nq\nq\nq")]
    for i in range(10, 200):
        lines = rng.choices(vocabulary, k=rng.choice([1, 3, 8])) + [f"own {i} {k}" for k in range(rng.randrange(4))]
        if rng.random() < 0.4:
            lines += ["footer", "of all", "documents"]
        rows.append((i, "\n".join(lines)))
    rows.append((300, "\n".join(f"line {i % 700}" for i in range(20_000))))
    rows += [(301, rows[-1][1]), (302, rows[40][1]), (302, rows[40][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.withColumn("n_lines", F.lit("clash")).withColumn("pos", F.lit(9)).withColumn("h1", F.lit(9))
    got = drop_repeated_windows(docs.coalesce(1))
    assert got.columns == ["doc_id", "text", "pos", "h1", "n_lines", "n_removed"]
    mine = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()]
    assert sorted(mine, key=repr) == sorted(plain(rows), key=repr)


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd")], "doc_id bigint, text string")
    drop_repeated_windows(docs).explain("formatted")
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_empty_table(spark):
    assert drop_repeated_windows(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
