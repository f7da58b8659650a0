"""One registered query per operator, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    decontaminate,
    jaccard_join,
    license_scan,
    line_dedup,
    mixing,
    quality,
    resample,
    sharding,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
)

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    score = toxicity.scorer(toxicity.fit(documents, labels))
    return documents.select("doc_id", score("text").alias("t")).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "t.score",
        F.when(F.col("t.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "t.hits",
        "t.misspelled",
        "t.quoted",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and license notice it holds: most shingles shared by a window."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.license_scan(documents, license_scan.notices(spark))
    matches = found.select("doc_id", F.explode("licenses").alias("m")).select("doc_id", "m.*")
    return matches.groupBy("doc_id", "license").agg(
        F.max("shared").alias("shared"), F.first("shingles").alias("shingles")
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.write_token_files(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)
    )
    return token_files.read_token_files(spark, manifest, ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.drop_repeated_windows(documents)
    return left.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item it contains."""
    documents, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(documents.select("doc_id", "text"), items)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(_table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *base, "base_failed", "kept", "posterior")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.drop_repeated_spans(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(damaged, gone="gone"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents"), scan=True)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_token_files": op3_token_files,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_resample": op13_resample,
}

#: Words of decontaminate.folded_words and the distinct five-word shingles of a table's texts.
_SHINGLES = r"""
{name}_words AS (
  SELECT {id} AS id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') AS w
  FROM {table}),
{name}_shingles AS (
  SELECT DISTINCT id, w[i : i + 4] AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM {name}_words WHERE len(w) >= 5))
"""



def _license_sql() -> str:
    """Windows of two blocks of w shingles, w by the size of the notice."""
    rows = []
    for name, text in license_scan.NOTICES.items():
        n = len(decontaminate.shingle_set(decontaminate.folded_words(text)))
        quoted = text.replace("'", "''")
        w, least = license_scan.window_class(n), license_scan.least_shared(n)
        rows.append(f"('{name}', '{quoted}', {n}, {w}, {least})")
    words = r"""regexp_extract_all(
    translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+')"""
    return f"""
WITH notices AS (
  SELECT *, {words.format(text="text")} AS v
  FROM (VALUES {", ".join(rows)}) AS t(license, text, shingles, w, least)),
parts AS (
  SELECT DISTINCT license, shingles, w, least, v[i : i + 4] AS s
  FROM (SELECT *, unnest(range(1, len(v) - 3)) AS i FROM notices)),
cut AS (SELECT doc_id, {words.format(text="text")} AS v FROM documents),
own AS (
  SELECT doc_id, i - 1 AS pos, v[i : i + 4] AS s
  FROM (SELECT doc_id, v, unnest(range(1, len(v) - 3)) AS i FROM cut WHERE len(v) >= 5)),
met AS (
  SELECT doc_id, license, shingles, least, p.s, unnest([pos // w, greatest(pos // w - 1, 0)]) AS g
  FROM own JOIN parts p ON own.s = p.s),
counts AS (
  SELECT doc_id, license, shingles, least, g, count(DISTINCT s) AS shared
  FROM met GROUP BY ALL)
SELECT doc_id, license, max(shared) AS shared, shingles
FROM counts WHERE shared >= least GROUP BY doc_id, license, shingles"""


ORACLES: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op5_line_dedup": r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, pos, lines[pos + 1 : pos + 3] AS w
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM cut WHERE len(lines) >= 3)),
numbered AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k
  FROM windows WHERE regexp_matches(array_to_string(w, ''), '[^\x20\x09-\x0D]')),
gone AS (
  SELECT DISTINCT doc_id, pos + o AS line_at
  FROM numbered, (VALUES (0), (1), (2)) AS t(o) WHERE k > 1),
every AS (SELECT doc_id, lines[line_at + 1] AS line, line_at
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS line_at FROM cut)),
kept AS (
  SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.line_at) AS text
  FROM every e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.line_at = g.line_at GROUP BY e.doc_id),
counts AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT c.doc_id, coalesce(len(c.lines), 0) AS n_lines, coalesce(n.n_removed, 0) AS n_removed,
  md5(coalesce(k.text, CASE WHEN c.lines IS NULL THEN NULL ELSE '' END)) AS kept_md5
FROM cut c LEFT JOIN kept k USING (doc_id) LEFT JOIN counts n USING (doc_id)""",
    "op6_decontaminate": f"""
WITH {_SHINGLES.format(name="doc", id="doc_id", table="documents")},
{_SHINGLES.format(name="item", id="item_id", table="benchmark")},
sizes AS (SELECT id, count(*) AS item_shingles FROM item_shingles GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, z.item_shingles
FROM doc_shingles d JOIN item_shingles i ON d.s = i.s JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id, z.item_shingles HAVING 5 * count(*) >= 4 * z.item_shingles
UNION ALL
SELECT d.id, i.id, 1, 1
FROM doc_words d JOIN item_words i ON len(i.w) BETWEEN 1 AND 4
WHERE len(list_filter(range(1, len(d.w) - len(i.w) + 2), lambda p: d.w[p : p + len(i.w) - 1] = i.w)) > 0""",
    "op12_jaccard_join": r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i : i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM cut WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * o >= 90 * (p.n + q.n - o)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
}
