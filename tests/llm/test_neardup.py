import random

import pytest

from relflow.llm import neardup
from relflow.llm.components import components
from relflow.llm.neardup import near_duplicates
from relflow.sources import scratch


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(id, n, component, kept) of distinct ids, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        near = {j for g in s for j in holders.get(g, ())}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def family(rng, n, words, edits, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def ran(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(tuple(r) for r in near_duplicates(df).collect())


def test_real_rows(spark, small):
    rows = list(zip(small.doc_id.tolist(), small.text.tolist(), strict=True))
    assert ran(spark, rows) == brute(rows)


@pytest.mark.parametrize("tight", [False, True])
def test_families_near_the_threshold(spark, monkeypatch, tight):
    """``tight`` makes nodes, blocks and groups tiny, so that every way through the join is taken."""
    if tight:
        for name, value in (("NODE", 6), ("BLOCK", 4), ("COHERENT", 0.3), ("LEVELS", 4)):
            monkeypatch.setattr(neardup, name, value)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [t for n, words, edits in ((60, 120, 6), (40, 60, 3), (30, 200, 20), (3, 40, 1), (2, 9, 1)) for t in family(rng, n, words, edits, vocabulary)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(60)) + " " + passage for _ in range(80)]
    texts += ["a b c d e f"] * 20 + ["a b", "A  B", "a b c", "c b a", "", " "]
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    assert ran(spark, rows) == brute(rows)


def test_odd_rows(spark, odd, odd_rows):
    got = near_duplicates(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    assert all(r["kept"] for r in rows) and all(r["component_id"] == r["doc_id"] for r in rows)
    assert {r["doc_id"]: r["n_shingles"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 8)} == {1: 0, 2: 0, 3: 0, 4: 1, 8: 0}


def test_empty_table(spark, empty):
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("relflow.llm.components.FEW", few)
    edges = [(b"%03d" % (i * 37 % 200), b"%03d" % ((i + 1) * 37 % 200)) for i in range(0, 150)] + [(b"x", b"x"), (b"y", b"z"), (b"z", b"y")]
    got = {bytes(r["v"]): bytes(r["c"]) for r in components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()}
    assert len(got) == 153 and got[b"y"] == got[b"z"]
    assert len({got[v] for v in got if v not in (b"y", b"z")}) == 1
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def chained(rng, n, gap):
    """Texts cut from one long row of words, each alike its neighbours but not near them; some with a near copy."""
    words = [f"c{rng.randrange(10**9)}" for _ in range(gap * n + 120)]
    texts = [" ".join(words[i * gap : i * gap + 120]) for i in range(n)]
    copies = [t.rsplit(" ", 4)[0] + " some other few words" for t in texts[::7]]
    return texts + copies


def test_chains_are_checked_node_by_node(spark, monkeypatch):
    """Neighbours at 0.70 make one chain of candidates, of which only the near copies are links."""
    rng = random.Random(9)
    texts = chained(rng, 600, 20)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    monkeypatch.setattr(neardup, "NODE", 24)
    checked = []
    cells = neardup.group_cells
    monkeypatch.setattr(neardup, "group_cells", lambda members, *more: checked.append(members) or cells(members, *more))
    sizes = []
    linked = neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda cells, *more: sizes.append(cells.count()) or linked(cells, *more))
    got = ran(spark, rows)
    pairs = {r[0] for r in want if not r[3]}
    assert len(pairs) > 60 and len(pairs & {r[0] for r in got if not r[3]}) >= 0.99 * len(pairs)
    assert got == want
    # every class stands in a bounded number of cells, however long the chain
    assert sum(sizes) <= 2 * neardup.TREES * neardup.CHOICES**neardup.DEPTH * len(rows)


def test_a_large_family_is_linked_through_its_first_member(spark, monkeypatch):
    """Full sets are shipped about once a member, not once for each block of the family."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = family(rng, 400, 150, 4, vocabulary) + family(rng, 3, 80, 2, vocabulary)
    rows = list(enumerate(texts))
    for name, value in (("NODE", 50), ("BLOCK", 10)):
        monkeypatch.setattr(neardup, name, value)
    sizes = []
    linked = neardup.linked
    monkeypatch.setattr(neardup, "linked", lambda cells, *more: sizes.append(cells.count()) or linked(cells, *more))
    assert ran(spark, rows) == brute(rows)
    assert sum(sizes) < 10 * len(rows)


def test_each_table_is_made_once(spark, monkeypatch):
    """Keys that several jobs read are written, not made anew by each."""
    rng = random.Random(13)
    rows = list(enumerate(family(rng, 60, 120, 4, [f"w{i}" for i in range(2000)])))
    for name, value in (("NODE", 6), ("BLOCK", 4)):
        monkeypatch.setattr(neardup, name, value)
    made = []
    read = neardup.full_sets
    monkeypatch.setattr(neardup, "full_sets", lambda docs, text, wanted: made.append(wanted) or read(docs, text, wanted))
    assert ran(spark, rows) == brute(rows)
    plans = [w._jdf.queryExecution().analyzed().toString() for w in made]
    assert made and not any("Join" in p or "Aggregate" in p for p in plans)


def test_small_tables_are_few_files(spark, monkeypatch):
    """A session's many partitions cost a task and a file each; tables of few rows don't take them."""
    rng = random.Random(17)
    rows = list(enumerate(family(rng, 150, 120, 8, [f"w{i}" for i in range(2000)])))
    for name, value in (("NODE", 6), ("BLOCK", 4)):
        monkeypatch.setattr(neardup, name, value)
    files = {}
    write = scratch._written

    def counted(df, path):
        out = write(df, path)
        files.setdefault(path.rsplit("/", 1)[1].rsplit("-", 1)[0], []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(scratch, "_written", counted)
    few = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        got = ran(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows)
    assert {"classes", "nodes", "children", "cells", "links", "groups", "named"} <= set(files)
    assert max(n for name, ns in files.items() if name != "edges" for n in ns) <= spark.sparkContext.defaultParallelism
