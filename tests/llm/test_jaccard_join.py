import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import jaccard_join as J


def brute(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = {i: 0 for i in sets}, {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[ids[a]] += 1
                links[ids[b]] += 1
                ra, rb = top(ids[a]), top(ids[b])
                root[max(ra, rb)] = min(ra, rb)
    copy = {i: min(k for k in ids if sets[k] == sets[i]) if sets[i] else i for i in ids}
    return {i: (copy[i], top(i), links[i]) for i in ids}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: rng.choices(vocabulary, k=n)
    passage, rows = text(40), []
    for _ in range(60):
        rows.append(text(rng.randint(5, 120)) + (passage if rng.random() < 0.5 else []))
    for _ in range(25):
        base = text(rng.randint(60, 150))
        for _ in range(rng.randint(1, 4)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append(other)
    family = text(200)
    for k in range(70):
        other = list(family)
        other[rng.randrange(200)] = f"x{k}"
        rows.append(other)
    rows += [["a"], ["a"], ["a", "b"], ["a", "b", "c", "d", "e"], [], text(5000)]
    out = [" ".join(r) for r in rows]
    out += [out[0]] * 30 + [None, " \n"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("leaf", [1000, 16])
def test_equals_brute_force(spark, leaf):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "path": F.lit(1), "fp": F.lit(2)}).repartition(5)
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in J.joined(df, leaf=leaf).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    missed = sum(w[2] for w in want.values()) - sum(g[2] for g in got.values())
    assert 0 <= missed <= 0.002 * sum(w[2] for w in want.values())
    if not missed:
        assert got == want


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None)], "doc_id long, text string")
    assert {tuple(r) for r in J.joined(df).drop("th").collect()} == {(1, 1, 1, 2, True), (2, 1, 1, 2, False), (None, 1, 1, 2, False), (3, 3, 3, 0, True)}
    assert J.joined(df.where("false")).count() == 0


def test_ids_that_are_missing_or_hold_several_texts(spark):
    """As with ids of their own, given in the order of doc_id (none last) and text hash; nothing is left out."""
    rng, rows = random.Random(8), [(i, t) for i, t in corpus(6)]
    given = {i: None if rng.random() < 0.3 else i // 3 for i, _ in rows}
    df = spark.createDataFrame([(given[i], t) for i, t in rows] + [(given[i], t) for i, t in rows[:20]], "doc_id long, text string").repartition(5)
    order = df.select("doc_id", "text", F.xxhash64("text").alias("th")).distinct().orderBy(F.asc_nulls_last("doc_id"), "th").collect()
    want = brute([(k, r.text) for k, r in enumerate(order)])
    expected = sorted(((r.doc_id, r.th, order[w[0]].doc_id, order[w[1]].doc_id, w[2], w[1] == k) for k, (r, w) in enumerate(zip(order, want.values(), strict=True))), key=str)
    assert sorted((tuple(r) for r in J.joined(df).collect()), key=str) == expected


def test_runs_reach_the_recall():
    assert J.runs_for(0.999, 0.8, 6) > J.runs_for(0.9, 0.8, 6) >= J.runs_for(0.9, 0.8, 1)


def test_missed_pairs_as_simulated():
    """The tree itself, drawn for many pairs at a time: agree has the positions where a pair agrees."""
    rng, n = np.random.default_rng(6), 40_000
    pairs = rng.random((n, J.T)) < 0.8
    met = np.zeros(n, bool)
    for _ in range(J.runs_for(0.999, 0.8, 6)):
        at = np.arange(n)  # one entry for each node that still holds both sets
        for _ in range(6):
            one, two = rng.integers(0, J.T, (2, len(at)))
            second = (rng.random(len(at)) < 0.25) & (one != two)
            at = np.concatenate([at[pairs[at, one]], at[second & pairs[at, two]]])
        met[at] = True
    assert 1 - (met & (pairs.sum(axis=1) >= J.NEED)).mean() <= 0.0013


def test_family_at_the_threshold(spark):
    """Two words of 184 are replaced in each text, so every pair shares 160 of 200 5-grams or more."""
    rng, n, rows = random.Random(8), 2600, []
    for k in range(n):
        words = [f"w{i}" for i in range(184)]
        for j, at in enumerate(rng.sample(range(184), 2)):
            words[at] = f"x{k}_{j}"
        rows.append((k, " ".join(words)))
    out = J.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).agg(F.sum("n_links"), F.max("class_id")).first()
    assert out[1] == 0
    assert 0.999 * n * (n - 1) <= out[0] <= n * (n - 1)


@pytest.mark.parametrize("plain", [1_000_000, 0])
def test_components(spark, plain):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, 9), (9, 2), (7, 2)] + [(50, k) for k in range(51, 90)]
    got = {r.id: r.top for r in J.components(spark.createDataFrame(edges, "x long, y long"), plain).collect()}
    want = {i: 100 for i in range(101, 131)} | {5: 2, 9: 2, 7: 2} | {k: 50 for k in range(51, 90)}
    assert got == want


def test_components_of_a_path(spark):
    """10,000 nodes in a row, in shuffled names: as far apart as nodes can be."""
    names = list(range(10_000))
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "x long, y long")
    assert J.components(edges).agg(F.count("*"), F.max("top")).first() == (9999, 0)


def test_frequent_keys_stay_in_place(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v")
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    want = {(r.k, r.v, r.top) for r in rows.join(per_key, "k").collect()}
    got = J.common.by_heavy(rows, per_key.where("k <> 7"), "k", "n", 5000)
    assert {(r.k, r.v, r.top) for r in got.collect()} == {x for x in want if x[0] != 7}


def test_recall_on_documents(spark):
    """All links of the documents at sf0.01, found by comparing all pairs that share a 5-gram."""
    docs = J.common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {i: set(J.shingles(t).tolist()) for i, t in rows}
    holders = {}
    for i, x in sets.items():
        for g in x:
            holders.setdefault(g, []).append(i)
    pairs = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    links = dict.fromkeys(sets, 0)
    for (a, b), n in pairs.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
    got = {r.doc_id: r.n_links for r in J.joined(docs).collect()}
    assert got.keys() == links.keys() and all(got[i] <= links[i] for i in got)
    assert sum(got.values()) >= 0.999 * sum(links.values()) > 0


def test_minhash_estimates():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    a, b = J._final(a * J._MIX), J._final(b * J._MIX)
    assert abs((J.minhash(a) == J.minhash(b)).mean() - 900 / 1100) < 0.2


def test_bitmap_loses_nothing(spark):
    df = spark.range(20_000).selectExpr("id as a", "id * 7 as b", "'t' as h")
    wanted = df.where("a % 97 = 3").select("a", "b")
    got = {r.a for r in J.possible(df, wanted, ["a", "b"]).collect()}
    want = {i for i in range(20_000) if i % 97 == 3}
    assert want <= got and len(got) <= len(want) + 40
    assert J.possible(df, wanted.where("false"), ["a", "b"]).count() == 0


def test_no_pass_for_dense_nodes_where_there_are_none(spark, monkeypatch):
    """Each gathering reads all sets again: two levels without a dense node take two of them."""
    seen, gather = [], J._gathered
    monkeypatch.setattr(J, "_gathered", lambda members, nodes: seen.append(1) or gather(members, nodes))
    monkeypatch.setattr(J, "DENSE", 1.1)
    reps = spark.createDataFrame([(i, [i % 2] * J.T) for i in range(40)], "rep_id long, sig array<int>")
    found = J.leaves(reps, leaf=8, depth=2, recall=0.1).groupBy("rep_id").count().count()
    assert found == 40 and len(seen) == 2


@pytest.mark.parametrize("dense", [1.1, 0.75])
def test_each_level_reads_the_sets_once(spark, monkeypatch, dense):
    """Two levels, with and without dense nodes: counting, gathering and splitting a level share one reading."""
    monkeypatch.setattr(J, "DENSE", dense)
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    reps = spark.createDataFrame([(i, [i % 2] * J.T) for i in range(40)], "rep_id long, sig array<int>").mapInArrow(rows, "rep_id long, sig array<int>")
    assert J.leaves(reps, leaf=8, depth=2, recall=0.1).select("rep_id").distinct().count() == 40
    assert read.value == 2 * 40
