"""Conversation repair against a plain-Python version of its rules."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from covertile.llm import conversation_repair as cr
from covertile.llm.queries import op11_conversation_repair

LEGAL = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_audit(rows):
    """(cost, audit) by trying all edits; rows are (must go, extra, initial)."""

    @functools.cache
    def best(i, last, inserts):
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        follows = "u" if last != "u" else "a"
        if i < len(rows):
            gone, extra, initial = rows[i]
            c, s = best(i + 1, last, 0)
            ways.append((c + 4, "D" + s))
            if not gone:
                c, s = best(i + 1, follows, 0)
                ways.append((c + 3 + extra, "R" + s))
                if initial in LEGAL[last]:
                    c, s = best(i + 1, initial, 0)
                    ways.append((c + extra, "K" + s))
        if inserts < 3:
            c, s = best(i, follows, inserts + 1)
            ways.append((c + 3, "I" + s))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


def plain(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash) over undamaged rows."""
    sp = lambda x: " " if x is None else str(x)
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        hit = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        if hit == 0:
            continue
        role, text = "user" if hit == 4 else sp(role), sp(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        kept += [(turn, role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, codes = [], []
        for k, (_, role, text) in enumerate(kept):
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = (
                "b" if not bare else "d" if (role, text) in [r[1:] for r in kept[:k]] else "" if bare[-1] in ".!?" else "t"
            )
            faults.append(fault)
            codes.append((fault in ("b", "d"), 3 * (fault == "t"), role[:1]))
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[2] + y[2] not in ("su", "ua", "au") for x, y in zip(codes, codes[1:]))
        cost, audit = plain_audit(tuple(codes))
        lines, left, last = [], iter(kept), ""
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(left)
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)
    return out


def conversations(n=150, most=14):
    rng = random.Random(6)
    roles = ["user", "assistant", "assistant", "system", "tool", "unknown", "", None, "User"]
    texts = ["Hi.", "Yes!\n", "no end", "", " \n", None, "Why? ", "a.b", "É.", "\x1c"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(most)):
            tidy = rng.random() < 0.6
            role = ("user", "assistant")[turn % 2] if tidy else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(texts)))
    rows += [(None, t, "user", f"line {t}.") for t in range(9)] + [(None, None, None, None)] * 2
    rows += [(7, 3, "user", "Hi.")] * 3 + [(9999, i, ("user", "assistant")[i % 2], f"turn {i // 3}.") for i in range(400)]
    return rows


@pytest.mark.parametrize("limit, segment, fan", [(2000, 512, 32), (3, 4, 2), (0, 1, 3)])
def test_equals_plain_version(spark, monkeypatch, limit, segment, fan):
    rows = conversations()
    monkeypatch.setattr(cr, "ROWS", limit)
    monkeypatch.setattr(cr, "SEGMENT", segment)
    monkeypatch.setattr(cr, "FAN", fan)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    records = cr.repair(cr.damage(df), gone="gone")
    got = cr.digests(records)
    assert got.columns == ["conv_id", *cr.COUNTS, "audit", "repaired_sha256"]
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert got.count() == len(found)
    assert found == plain(rows)


def test_the_query_is_the_operator_over_the_table(spark, tmp_path):
    rows = conversations(40)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plain(rows)


def test_random_lattices():
    rng = random.Random(8)
    for _ in range(600):
        rows = tuple(
            (rng.random() < 0.15, rng.choice([0, 0, 3]), rng.choice("suaaux")) for _ in range(rng.randrange(12))
        )
        assert cr.cheapest(list(rows), 0, cr.ENDS) == plain_audit(rows)


def test_empty_table_string_ids_and_clashing_columns(spark):
    schema = "conv_id string, turn int, role string, text string, conv int, place int, done string, gone int"
    assert cr.digests(cr.repair(spark.createDataFrame([], schema))).count() == 0
    df = spark.createDataFrame([("x", 1, "user", "Hi.", 1, 2, "d", 3), ("x", 2, "assistant", "Yes.", 1, 2, "d", 3)], schema)
    turns = cr.repair(df).where("place IS NOT NULL").orderBy("place").collect()
    assert [(r.conv_id, r.place, r.edit, r.role, r.text) for r in turns] == [
        ("x", 1, "K", "user", "Hi."),
        ("x", 2, "K", "assistant", "Yes."),
    ]
    assert cr.damage(df).columns == ["conv_id", "turn", "role", "text", "gone"]


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(cr, "BYTES", 1000)
    rows = [(1, i, ("user", "assistant")[i % 2], "word " * 50_000 + f"{i}.") for i in range(4)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    (got,) = cr.digests(cr.repair(df)).collect()
    want = "\n".join(f"{r}:{t}" for _, _, r, t in rows)
    assert got.audit == "KKKK" and got.repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()
