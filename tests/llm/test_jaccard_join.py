"""Jaccard classes against a plain-Python version that compares all pairs of sets."""

import random

import pytest

from covertile.llm import jaccard_join as jj


def plain_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)))


def plain_classes(docs):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=repr)


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def texts(rng):
    words = [f"w{i}" for i in range(400)] + ["Été", "ÀB", "x\x1cy", "非"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    bases = [line(rng.choice([5, 30, 60, 120, 250])) for _ in range(60)]
    out = []
    for t in bases:
        out += [t, t.upper(), *(changed(rng, t, n) for n in (1, 1, 2, 4))]
    # A chain, each link near the last one only, and a crowd around one text.
    step = line(150)
    for _ in range(25):
        out.append(step)
        step = changed(rng, step, 2)
    crowd = line(100)
    out += [changed(rng, crowd, rng.choice([1, 1, 2])) for _ in range(150)]
    # Strangers of one size that share a passage.
    passage = line(25)
    out += [f"{line(20)} {passage} {line(20)}" for _ in range(120)]
    # Equal but for an order of passages: many shared shingles at other places.
    out += [" ".join([bases[0], bases[1]]), " ".join([bases[1], bases[0]])]
    out += [None, "", " \n", "one", "ONE", "one two", "one  two", "one two three", "one two three four"]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = texts(rng)
    docs = [(7 * i % 5003, t) for i, t in enumerate(out)]
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(30_000))
    return docs + [(None, "one"), (None, None), (3, out[5]), (3, out[5]), (None, "alone null id here"), (9001, long), (9002, changed(rng, long, 60))]


@pytest.mark.parametrize("widen, hot_sets, hot_list", [(16, 32, 200_000), (2, 4, 30), (3, 1, 200_000), (1000, 10**6, 1)])
def test_equals_comparing_all_pairs(spark, rows, monkeypatch, widen, hot_sets, hot_list):
    monkeypatch.setattr(jj, "WIDEN", widen)
    monkeypatch.setattr(jj, "HOT_SETS", hot_sets)
    monkeypatch.setattr(jj, "HOT_LIST", hot_list)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = jj.classes(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_classes(rows)


def test_scan_empty_table_and_clashing_columns(spark, tmp_path):
    docs = [(3, "a b c d"), (1, "A  b c d"), (2, "x")]
    clash = [(i, t, 1, 2, 3, "p") for i, t in docs]
    df = spark.createDataFrame(clash, "doc_id bigint, text string, id int, n int, node int, place string")
    df.write.parquet(str(tmp_path / "docs"))
    for d, scan in ((df, False), (spark.read.parquet(str(tmp_path / "docs")), True)):
        assert sorted(map(tuple, jj.classes(d, scan=scan).collect())) == [(1, 2, 1), (2, 1, 2), (3, 2, 1)]
    assert jj.classes(df.where("doc_id > 5")).count() == 0
    named = df.select(df.doc_id.cast("string").alias("key"), df.text.alias("body"))
    assert sorted(map(tuple, jj.classes(named, "key", "body").collect())) == [("1", 2, "1"), ("2", 1, "2"), ("3", 2, "1")]


def test_prefixes_hold_what_a_link_must_share():
    for n in range(1, 400):
        p = jj.prefix_size(n)
        # A set that links to this one shares at least 0.9 n shingles, so at least one of any n - 0.9 n + 1.
        assert p == n - (9 * n + 9) // 10 + 1 and 1 <= p <= n


def test_a_crowd_is_not_paired_off(spark, monkeypatch):
    """Near copies of one text cost stars, not their square."""
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(300))
    docs = [(i, changed(rng, base, 1)) for i in range(600)]
    seen = []
    measured = jj.Workspace.measured

    def watch(self, df, name, **kw):
        out = measured(self, df, name, **kw)
        if name.startswith("pairs"):
            seen.append(out[1]["rows"])
        return out

    monkeypatch.setattr(jj.Workspace, "measured", watch)
    got = jj.classes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.component_id for r in got.collect()} == {0}
    assert sum(seen) < 20 * len(docs)


def test_members_too_far_from_a_group_do_not_go_on_to_it(spark):
    """Pairs of a member and a group are dropped by what is known of the whole group, before it is expanded."""
    near, far = [0, 0, 0, 0], [-1, 0, 0, 0]
    rows = [(1, 1, near, 2), (1, 2, far, 2), (3, 3, near + near, 2), (3, 4, near + near, 2)]
    members = spark.createDataFrame(
        [(g, m, node, 100, sketch, node) for g, node, sketch, m in rows],
        "g bigint, m bigint, node bigint, n bigint, sketch array<bigint>, root bigint",
    )

    def met(radius, kind):
        known = spark.createDataFrame([(1, 3, 1.0, (100, near, radius, kind))], f"a bigint, b bigint, level double, far {jj.FAR}")
        return {tuple(r) for r in jj._member_pairs(known, members, 16, 0).collect()}

    both = {(1, 3), (1, 4), (2, 3), (2, 4)}
    assert met(0, None) == {(1, 3), (1, 4)}
    assert met(53, None) == {(1, 3), (1, 4)}
    assert met(54, None) == both
    assert met(0, 1) == set()
    unknown = spark.createDataFrame([(1, 3, 1.0, None)], f"a bigint, b bigint, level double, far {jj.FAR}")
    assert {tuple(r) for r in jj._member_pairs(unknown, members, 16, 0).collect()} == both


def test_what_fine_sketches_tell_apart_is_not_sent_whole(spark, monkeypatch):
    """Long texts somewhat below the threshold pass the coarse sketches, not the fine ones, whatever their lengths."""
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(10**6)}"
    docs = []
    for start in (2000, 2044):
        base = [word() for _ in range(start)]
        # Each keeps 0.96 of the shingles of a base, so two of them share some 0.85.
        for i in range(6):
            own = list(base)
            for at in rng.sample(range(0, start - 2, 3), start // 72):
                own[at] = word()
            docs.append((len(docs), " ".join(own + [word() for _ in range(2 * i)])))
    docs += [(len(docs), " ".join(base[::-1])), (len(docs) + 1, " ".join(base[::-1][:-9]))]
    found = {}
    write = jj.Workspace.write

    def watch(self, df, name, split=None):
        out = write(self, df, name, split)
        if name.startswith(("pairs", "near")):
            found[name] = out.select("x", "y").collect()
        return out

    monkeypatch.setattr(jj.Workspace, "write", watch)
    got = jj.classes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_classes(docs)
    looked = {tuple(p) for n, rows in found.items() if n.startswith("pairs") for p in rows}
    sent = {tuple(p) for n, rows in found.items() if n.startswith("near") for p in rows}
    sets = [plain_set(t) for _, t in docs]
    links = sum(10 * len(a & b) >= 9 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert links == 1 and 0 < len(sent) <= links + 2 and len(looked) > 2 * len(sent)


def test_small_tables_are_shuffled_with_the_same_result(spark, rows, monkeypatch):
    monkeypatch.setattr(jj, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(jj, "HOT_SETS", 4)
    got = jj.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_classes(rows)


def test_halved_sketches_are_those_of_half_the_cells(spark):
    rng = random.Random(2)
    s = jj.np.unique(jj.np.array([rng.getrandbits(64) for _ in range(1500)], jj.np.uint64))
    long, short = (jj.sketch_of(s, c).tolist() for c in (4, 2))
    assert len(long) == 2 * len(short)
    df = spark.createDataFrame([(long, short)], "a array<bigint>, b array<bigint>")
    row = df.select(jj._halved("a", "b").alias("a"), jj._halved("b", "a").alias("b")).first()
    assert row.a == short and row.b == short
