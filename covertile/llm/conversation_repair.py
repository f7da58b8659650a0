"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation shall be nothing or an optional system turn and pairs of a user and an assistant turn:
``(s?(ua)+)?`` in initials of roles. A node of the lattice is (rows used up, state of that pattern).
Edits lead on: Keep a row as it is, Rerole it to user or assistant, Delete it, Insert an empty turn.
The state says which of user and assistant comes next, so initials of edits tell the whole repair.

Method. A forward heap grows from the start and a reverse heap from the ends; nodes leave them by
(cost, rows), so all cheapest ways to a node are known when it does, and the least audit with them.
The heaps go on until their tops together exceed the best crossing, so every equal-cost crossing is
finished, and the least concatenated audit is taken. Two cheapest audits of one node never begin
with each other, as every edit beyond a common start would cost something: so least parts make a
least whole.

Conversations are sorted by one shuffle and streamed; up to ``ROWS`` rows and ``BYTES`` of text one is
solved at once. A longer one is cut into segments over range partitions: a task finds the cheapest
audit of each segment between each two states, and audits of neighbouring segments are combined
``FAN`` at a time, in rounds, with states as the only thing they share. Its turns are then streamed
past the pieces of its audit, so no task holds more than a segment of rows; only the audit is one value.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from covertile.plans.ranks import ranked
from covertile.plans.workspace import Workspace

ROWS = 2000
BYTES = 32 << 20
SEGMENT = 512
FAN = 32
FLUSH = 4 << 20

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. What comes next in each.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
BEFORE = {q: [p for p in range(4) if NEXT[p] == q] for q in (2, 3)}
LEGAL = ("su", "ua", "au")

WORD = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
DONE = StructType([*(StructField(n, LongType()) for n in COUNTS), StructField("audit", StringType())])
_ARROW_DONE = pa.struct([*((n, pa.int64()) for n in COUNTS), ("audit", pa.string())])


# -- one conversation or segment -----------------------------------------------------------------


def cheapest(rows: list[tuple[bool, int, str]], start: int, ends: tuple, last: bool = True):
    """(cost, least audit) from state ``start`` to one of ``ends``, or None.

    A row is (must be deleted, cost of not deleting it, initial of its role). Unless the rows are the
    ``last`` of a conversation, nothing is inserted behind them: it would be ahead of the next ones.
    """
    n = len(rows)

    def onward(i, q):
        if i < n:
            gone, extra, initial = rows[i]
            yield DELETE, "D", i + 1, q
            if not gone:
                yield REROLE + extra, "R", i + 1, NEXT[q]
                if q in KEEP.get(initial, ()):
                    yield extra, "K", i + 1, KEEP[initial][q]
        if i < n or last:
            yield INSERT, "I", i, NEXT[q]

    def back(i, q):
        if i:
            gone, extra, initial = rows[i - 1]
            yield DELETE, "D", i - 1, q
            if not gone:
                for p in BEFORE.get(q, ()):
                    yield REROLE + extra, "R", i - 1, p
                for p, r in KEEP.get(initial, {}).items():
                    if r == q:
                        yield extra, "K", i - 1, p
        if i < n or last:
            for p in BEFORE.get(q, ()):
                yield INSERT, "I", i, p

    ahead, behind = [(0, 0, "", start)], [(0, -n, "", q) for q in ends]
    known: tuple[dict, dict] = ({}, {})
    best, audit = None, None
    while ahead or behind:
        tops = [h[0][0] if h else float("inf") for h in (ahead, behind)]
        if best is not None and sum(tops) > best:
            break
        forward = tops[0] < tops[1]
        heap, mine, other = (ahead, known[0], known[1]) if forward else (behind, known[1], known[0])
        cost, i, so_far, q = heapq.heappop(heap)
        i = abs(i)
        if (i, q) in mine:
            continue
        mine[i, q] = cost, so_far
        steps = [(0, "", i, q), *(onward if forward else back)(i, q)]
        for price, letter, j, r in steps:
            met = other.get((j, r))
            if met:
                whole = so_far + letter + met[1] if forward else met[1] + letter + so_far
                found = cost + price + met[0], whole
                if best is None or found < (best, audit):
                    best, audit = found
            if letter and (j, r) not in mine:
                if forward:
                    heapq.heappush(heap, (cost + price, j, so_far + letter, r))
                else:
                    heapq.heappush(heap, (cost + price, -j, letter + so_far, r))
    return None if best is None else (best, audit)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit makes of (role, text) rows."""
    turns = len(audit) - audit.count("D")
    yield from Applied(turns % 2 == 1).through(audit, rows)


class Applied:
    """Applies the pieces of one audit in order; an odd number of turns begins with system."""

    def __init__(self, odd: bool):
        self.odd, self.made = odd, 0

    def through(self, piece: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        for edit in piece:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            if edit != "K":
                role = ROLE[2 if self.made % 2 == self.odd else 3]
            self.made += 1
            yield edit, role, text


def solved(rows: list[tuple]) -> dict:
    """Counts and audit of a whole conversation: rows (turn, role, text, blank, cut) in order."""
    seen, codes = set(), []
    count = dict.fromkeys(COUNTS, 0)
    for _, role, text, blank, cut in rows:
        fault = "blank" if blank else "duplicate" if (role, text) in seen else "truncated" if cut else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        codes.append((fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0, role[:1]))
    turns = {r[0] for r in rows if r[0] is not None}
    if turns:
        count["gaps"] = max(turns) - min(turns) + 1 - len(turns)
    count["illegal"] = sum(a[2] + b[2] not in LEGAL for a, b in zip(codes, codes[1:]))
    cost, audit = cheapest(codes, 0, ENDS)
    return count | {"cost": cost, "audit": audit}


# -- streams -------------------------------------------------------------------------------------


class _Out:
    """Records of repaired conversations, sent on in batches of bounded size."""

    def __init__(self, conv: pa.DataType):
        self.conv = conv
        self._clear()

    def _clear(self):
        self.rows, self.bytes = ([], [], [], [], [], []), 0

    def add(self, *values) -> None:
        for column, v in zip(self.rows, values):
            column.append(v)
        self.bytes += 64 + len(values[4] or "")

    def full(self) -> bool:
        return self.bytes > FLUSH

    def batch(self) -> pa.RecordBatch:
        types = (self.conv, pa.int64(), pa.string(), pa.string(), pa.string(), _ARROW_DONE)
        arrays = [pa.array(v, t) for v, t in zip(self.rows, types)]
        self._clear()
        return pa.RecordBatch.from_arrays(arrays, ["conv", "place", "edit", "role", "text", "done"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: sorted rows of whole conversations -> their repaired turns and summaries."""
    out, key, rows = None, None, []

    def close():
        done = solved(rows)
        lines = ((r[1], r[2]) for r in rows)
        for place, turn in enumerate(repaired(done["audit"], lines), 1):
            out.add(key["id"], place, *turn, None)
        out.add(key["id"], None, None, None, None, done)

    for batch in batches:
        out = out or _Out(batch.schema.field("conv").type.field(0).type)
        names = ("conv", "turn", "role", "text", "blank", "cut", "gone")
        for conv, *row, gone in zip(*(batch.column(n).to_pylist() for n in names)):
            if conv != key:
                if key is not None:
                    close()
                    if out.full():
                        yield out.batch()
                key, rows = conv, []
            if not gone:
                rows.append(row)
    if key is not None:
        close()
        yield out.batch()


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (conv, seq, last, codes) -> cheapest audits between states."""
    for batch in batches:
        found = []
        for seq, last, codes in zip(*(batch.column(n).to_pylist() for n in ("seq", "last", "codes"))):
            rows = [(c["gone"], c["extra"], c["initial"]) for c in codes]
            ways = []
            for a in range(4) if seq else (0,):
                for b in (ENDS,) if last else ((q,) for q in range(4)):
                    way = cheapest(rows, a, b, last)
                    if way:
                        ways.append({"a": a, "b": b[0], "cost": way[0], "audit": way[1]})
            found.append(ways)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("seq"), pa.array(found, _WAYS)], ["conv", "seq", "ways"]
        )


_WAYS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def joined(parts: list[list[dict]]) -> list[dict]:
    """Cheapest audits over neighbouring parts, from those over each."""
    ways = {(w["a"], w["b"]): (w["cost"], w["audit"]) for w in parts[0]}
    for part in parts[1:]:
        longer: dict = {}
        for (a, b), (cost, audit) in ways.items():
            for w in part:
                if w["a"] == b:
                    way = cost + w["cost"], audit + w["audit"]
                    longer[a, w["b"]] = min(longer.get((a, w["b"]), way), way)
        ways = longer
    return [{"a": a, "b": b, "cost": c, "audit": s} for (a, b), (c, s) in ways.items()]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (conv, seq, parts in order) -> (conv, seq, ways over all of them)."""
    for batch in batches:
        ways = [joined([p["ways"] for p in parts]) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("seq"), pa.array(ways, _WAYS)], ["conv", "seq", "ways"]
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (conv, audit) -> the piece of each segment, inserts ahead of their row."""
    for batch in batches:
        for i, audit in enumerate(batch.column("audit").to_pylist()):
            starts, used = [0], 0
            for at, edit in enumerate(audit):
                if edit != "I":
                    used += 1
                    if used % SEGMENT == 0:
                        starts.append(at + 1)
            # Inserts behind the last row belong to its segment, also where that is full.
            n = max(1, -(-used // SEGMENT))
            starts = starts[:n]
            cuts = [audit[a:b] for a, b in zip(starts, [*starts[1:], len(audit)])]
            odd = (len(audit) - audit.count("D")) % 2 == 1
            conv = batch.column("conv").take(pa.array([i] * n))
            yield pa.RecordBatch.from_arrays(
                [conv, pa.array(range(n), pa.int64()), pa.array(cuts, pa.string()), pa.array([odd] * n)],
                ["conv", "seq", "piece", "odd"],
            )


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: sorted pieces and rows of long conversations -> turns and summaries."""
    out, state, key, edits, at, place = None, None, None, "", 0, 0
    names = ("conv", "rank", "role", "text", "piece", "odd", "done")
    for batch in batches:
        out = out or _Out(batch.schema.field("conv").type.field(0).type)
        for conv, rank, role, text, piece, odd, done in zip(*(batch.column(n).to_pylist() for n in names)):
            if conv != key:
                key, state, place, edits, at = conv, Applied(odd), 0, "", 0
            if piece is not None or done is not None:
                # What is left of the last piece are inserts.
                for turn in state.through(edits[at:], iter(())):
                    place += 1
                    out.add(key["id"], place, *turn, None)
                edits, at = piece, 0
            else:
                end = at
                while edits[end] == "I":
                    end += 1
                for turn in state.through(edits[at : end + 1], iter([(role, text)])):
                    place += 1
                    out.add(key["id"], place, *turn, None)
                at = end + 1
            if done is not None:
                out.add(key["id"], None, None, None, None, done)
            if out.full():
                yield out.batch()
    if out:
        yield out.batch()


# -- operator ------------------------------------------------------------------------------------


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone) after seeded faults: lost, emptied, unended, doubled, misnamed.

    A lost row stays as one that is ``gone``, so that its conversation is still known.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part(conv_id), F.lit(":"), part(turn))) % 20
    kept = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(part(text), "[.!?]", "")).otherwise(part(text))
    return rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(hit == 4, "user").otherwise(part(role)).alias("role"),
        kept.alias("text"),
        (hit == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def repair(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    gone: str | None = None,
) -> DataFrame:
    """Repaired turns (conv_id, place, edit, role, text, done), summaries in ``done``.

    Rows of one conversation are taken by turn, nulls first, then by role and text. Its records stand
    together in one partition, in order: its turns, numbered from 1, with the edit that made them
    (K, R or I), and last one record without a place, whose ``done`` holds the counts of faults by the
    first of each row, the cost and the audit. Null roles and texts are one space; a null id is a
    conversation as any other. ``gone`` names a boolean column of rows that only name their
    conversation: one without other rows has zeros and an empty audit. Repeated rows are duplicates.
    An empty table has no records.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(
        F.struct(F.col(conv_id).alias("id")).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        filled(role).alias("role"),
        filled(text).alias("text"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    ).withColumns({"blank": ~F.col("text").rlike(WORD), "cut": ~F.col("text").rlike(ENDED)})
    schema = StructType(
        [
            StructField("conv", rows.schema["conv"].dataType["id"].dataType),
            StructField("place", LongType()),
            *(StructField(n, StringType()) for n in ("edit", "role", "text")),
            StructField("done", DONE),
        ]
    )
    with Workspace(rows.sparkSession, "conversations") as ws:
        weight = F.octet_length("text") + F.octet_length("role")
        sizes = rows.where("NOT gone").groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("bytes"))
        long, seen = ws.measured(sizes.where((F.col("n") > ROWS) | (F.col("bytes") > BYTES)), "long")
        short = rows.join(long, "conv", "left_anti") if seen["rows"] else rows
        order = ["conv", "turn", "role", "text"]
        found = short.repartition("conv").sortWithinPartitions(*order).mapInArrow(_whole, schema)
        if seen["rows"]:
            lengthy = rows.where("NOT gone").join(long.select("conv"), "conv", "left_semi").drop("gone")
            found = found.union(_repaired_in_segments(ws, lengthy, long, schema))
        else:
            ws.finish()
        return found.withColumnRenamed("conv", "conv_id")


def _repaired_in_segments(ws: Workspace, rows: DataFrame, sizes: DataFrame, schema: StructType) -> DataFrame:
    """The records of long conversations; ``sizes`` has their numbers of rows."""
    order = [F.col("turn"), F.col("role"), F.col("text")]
    laid = ranked(ws, rows, ["conv"], order, "laid", "rank")
    same = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("second"), "role", "text").alias("k2")]
    keyed = ws.write(
        laid.select("conv", "rank", "turn", "blank", "cut", F.substring("role", 1, 1).alias("initial"), *same), "keyed"
    )
    firsts = keyed.groupBy("conv", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    firsts = ws.write(firsts.where("n > 1").drop("n"), "firsts")
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("rank") > F.col("first"), "duplicate")
        .when(F.col("cut"), "truncated")
    )
    facts = ws.write(
        keyed.join(firsts, ["conv", "k1", "k2"], "left").select("conv", "rank", "turn", "initial", fault.alias("fault")),
        "facts",
    )
    named = lambda f: F.count_if(F.col("fault") == f).alias(f)
    after = facts.select("conv", (F.col("rank") - 1).alias("rank"), F.col("initial").alias("next"))
    illegal = (
        facts.join(after, ["conv", "rank"])
        .groupBy("conv")
        .agg(F.count_if(~F.concat("initial", "next").isin(*LEGAL)).alias("illegal"))
    )
    turns = facts.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"), *(named(f) for f in COUNTS[1:4]))
    counts = turns.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
        *(F.sum(f).cast("bigint").alias(f) for f in COUNTS[1:4]),
    )
    code = F.struct(
        "rank",
        F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("gone"),
        F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).alias("extra"),
        "initial",
    )
    seq = F.floor((F.col("rank") - 1) / SEGMENT).cast("bigint").alias("seq")
    segments = (
        facts.groupBy("conv", seq)
        .agg(F.sort_array(F.collect_list(code)).alias("codes"))
        .join(sizes.select("conv", F.floor((F.col("n") - 1) / SEGMENT).alias("end")), "conv")
        .select("conv", "seq", (F.col("seq") == F.col("end")).alias("last"), "codes")
    )
    conv = rows.schema["conv"].dataType.simpleString()
    shape = f"conv {conv}, seq bigint, ways array<struct<a:int,b:int,cost:bigint,audit:string>>"
    number = 0
    ways, seen = ws.measured(segments.mapInArrow(_paths, shape), "ways0", most=F.max("seq"))
    while seen["most"]:
        number += 1
        grouped = ways.groupBy("conv", F.floor(F.col("seq") / FAN).cast("bigint").alias("seq")).agg(
            F.sort_array(F.collect_list(F.struct("seq", "ways"))).alias("parts")
        )
        ways, seen = ws.measured(grouped.mapInArrow(_folded, shape), f"ways{number}", most=F.max("seq"))
        ws.drop(f"ways{number - 1}")
    audits = ways.select("conv", F.element_at("ways", 1).alias("w")).select("conv", "w.cost", "w.audit")
    done = (
        counts.join(audits, "conv")
        .join(illegal, "conv", "left")
        .select(
            "conv",
            F.struct(
                F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"),
                *COUNTS[1:4],
                F.coalesce("illegal", F.lit(0)).cast("bigint").alias("illegal"),
                "cost",
                "audit",
            ).alias("done"),
        )
    )
    done = ws.write(done, "done")
    pieces = done.select("conv", "done.audit").mapInArrow(_pieces, f"conv {conv}, seq bigint, piece string, odd boolean")
    none = lambda t: F.lit(None).cast(t)
    nothing = F.lit(None).cast(DONE)
    stream = (
        pieces.select("conv", "seq", F.lit(-1).cast("bigint").alias("rank"), none("string").alias("role"),
                      none("string").alias("text"), "piece", "odd", nothing.alias("done"))
        .union(laid.select("conv", seq, "rank", "role", "text", none("string"), none("boolean"), nothing))
        .union(done.select("conv", F.lit((1 << 62)).alias("seq"), F.lit(0).cast("bigint"), none("string"),
                           none("string"), none("string"), none("boolean"), "done"))
    )
    ws.finish("long", "laid", "done")
    return stream.repartition("conv").sortWithinPartitions("conv", "seq", "rank").mapInArrow(_passed, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: records of :func:`repair` -> the SHA-256 of each conversation's turns."""
    h = hashlib.sha256()
    fresh = True
    for batch in batches:
        sums = []
        for place, role, text in zip(*(batch.column(n).to_pylist() for n in ("place", "role", "text"))):
            if place is None:
                sums.append(h.hexdigest())
                h, fresh = hashlib.sha256(), True
                continue
            h.update(("" if fresh else "\n").encode() + f"{role}:{text}".encode())
            fresh = False
        ended = batch.filter(pc.is_null(batch.column("place")))
        done = ended.column("done").flatten() if len(ended) else [pa.array([], t.type) for t in _ARROW_DONE]
        yield pa.RecordBatch.from_arrays(
            [ended.column("conv_id"), *done, pa.array(sums, pa.string())],
            ["conv_id", *COUNTS, "audit", "repaired_sha256"],
        )


def digests(records: DataFrame) -> DataFrame:
    """A row for each conversation of :func:`repair`: its counts, audit, and the hash of its turns.

    The hash is over ``role:text`` joined by newlines. A hash over a whole conversation is one pass in
    order by its nature; it is taken on the stream, nothing is gathered.
    """
    schema = StructType(
        [records.schema["conv_id"], *DONE.fields, StructField("repaired_sha256", StringType())]
    )
    return records.mapInArrow(_digests, schema)
