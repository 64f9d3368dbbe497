import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import byte_bpe, common, quality_model, quality_rules, secret_scan, source_mix

SF = "/root/testdata/sf0.001"


def brute_statistics(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a a", "x\n\nx\nx \n", "é ü # $%&|<> *", "A B\x1cC\x85D", "l1 w w w w w\nl1 w w w w w\nl2"]
    out += [" ".join(rng.choices("abc", k=rng.randint(1, 60))) + rng.choice(["", "\n", "#", "\x0b"]) for _ in range(60)]
    return out + [" ".join(rng.choices([f"w{i}" for i in range(50)], k=30_000)), "z" * 100_000] + out[:5]


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"quality": F.lit(9), "rule": F.lit("x"), "n_words": F.lit(0)}).repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judged(df, []).select("doc_id", "quality.*").collect()}
    for i, t in rows:
        assert got[i] == brute_statistics(t), t and t[:80]


def test_rules_are_learned_and_keep_clean_documents(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    rules = quality_rules.fit(docs, labels)
    assert rules
    out = quality_rules.judged(docs, rules).join(labels.withColumnRenamed("quality", "label"), "doc_id").select("quality.kept", "label").collect()
    clean = [r.kept for r in out if r.label == 1]
    bad = [r.kept for r in out if r.label == 0]
    assert sum(clean) / len(clean) > 0.95 and sum(bad) / len(bad) < 0.5
    plan = quality_rules.judged(docs, rules).where("quality.kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b c d e f g h i j k")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules == [] and {r.doc_id: r.quality.kept for r in quality_rules.judged(docs, rules).collect()} == {1: False, 2: True}


def test_covering_finds_planted_rule():
    rng = random.Random(1)
    cells = []
    for _ in range(3000):
        bins = {k: rng.randint(0, len(e)) for k, e in quality_rules.EDGES.items()}
        bad = bins["symbol_ratio"] > 4 or (bins["upper_ratio"] > 5 and bins["bang_ratio"] > 3)
        cells.append((bins, rng.random() < 0.33, int(not bad), int(bad)))
    rules = quality_rules.learn(cells)
    fires = lambda b: any(all(c.holds(b) for c in r) for r in rules)
    wrong = sum(fires(b) != bool(bad) for b, _, _, bad in cells)
    assert wrong <= 60 and all(len(r) <= 4 for r in rules)


def mix_docs(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 900), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(400, None, "en", "a"), (401, "", None, None), (401, "", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"mix": F.lit(1), "factor": F.lit(2), "tokens": F.lit(3), "topic": F.lit("t")})


def test_raking_reaches_the_margins(spark):
    out = source_mix.mixed(mix_docs(spark)).select("doc_id", "mix.*").collect()
    assert len(out) == 403
    total = sum(r.tokens for r in out)
    for d, power in source_mix.TEMPERS.items():
        have, got = {}, {}
        for r in out:
            have[r[d]] = have.get(r[d], 0) + r.tokens
            got[r[d]] = got.get(r[d], 0) + r.tokens * r.factor
        norm = sum(v**power for v in have.values())
        assert all(abs(got[k] / total - v**power / norm) < 1e-6 for k, v in have.items())
    assert all(0 <= r.probability <= 1 for r in out)
    assert abs(sum(r.tokens * r.probability for r in out) / total - source_mix.BUDGET) < 1e-6
    assert abs(sum(r.tokens for r in out if r.kept) / total - source_mix.BUDGET) < 0.1


def test_both_ways_of_raking_agree(spark):
    local = {r.doc_id: r.mix for r in source_mix.mixed(mix_docs(spark)).collect()}
    spread = {r.doc_id: r.mix for r in source_mix.mixed(mix_docs(spark), max_cells=0).collect()}
    assert local.keys() == spread.keys()
    assert all(abs(local[i].factor - spread[i].factor) < 1e-9 * max(1, local[i].factor) and local[i].kept == spread[i].kept for i in local)


def brute_rake(cells, targets):
    """Iterative proportional fitting over a dense array of cells."""
    names = [sorted({c[i] for c in cells}) for i in range(3)]
    w = np.zeros([len(x) for x in names])
    for c, t in cells.items():
        w[tuple(x.index(v) for x, v in zip(names, c, strict=True))] = t
    total = w.sum()
    for _ in range(3000):
        for i, (x, share) in enumerate(zip(names, targets, strict=True)):
            others = tuple(j for j in range(3) if j != i)
            want = np.array([share.get(v, 0.0) for v in x])
            now = w.sum(axis=others)
            want = total * want / want[now > 0].sum()
            f = np.divide(want, now, out=np.zeros_like(now), where=now > 0)
            w = w * f.reshape([-1 if j == i else 1 for j in range(3)])
    return {c: w[tuple(x.index(v) for x, v in zip(names, c, strict=True))] / t for c, t in cells.items()}


@pytest.mark.parametrize("max_cells", [50_000, 0])
def test_given_targets_equal_brute_force(spark, max_cells):
    """Targets of the user's own, for classes that are there, are not there, and are to vanish; a topic from a column."""
    docs = mix_docs(spark).drop("topic").withColumn("subject", F.expr("case doc_id % 7 when 0 then 'law' when 1 then null else 'art' end"))
    shares = {"source": {"a": 0.2, "b": 0.5, "(none)": 0.3, "gone": 0.4}, "lang": {"en": 3.0, "de": 1.0, "(none)": 1.0}, "topic": {"law": 0.1, "art": 0.7, "(none)": 0.2}}
    tables = {d: spark.createDataFrame(list(x.items()), "class string, share double") for d, x in shares.items()}
    mix = source_mix.mixed(docs, targets=tables, max_cells=max_cells, topics=F.col("subject"), budget=0.3)
    out = mix.select("doc_id", "mix.*").collect()
    cells = {}
    for r in out:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.tokens
    want = brute_rake(cells, list(shares.values()))
    total = sum(cells.values())
    assert all(abs(r.factor - want[r.source, r.lang, r.topic]) < 1e-6 for r in out) and {r.factor for r in out if r.source == "c"} == {0.0}
    assert not any(r.kept for r in out if r.source == "c")
    assert abs(sum(r.tokens * r.probability for r in out) / total - 0.3) < 1e-6
    of = {(r.dimension, r["class"]): r for r in source_mix.margins(mix).collect()}
    assert abs(of["lang", "en"].weight / total - 0.6) < 1e-6 and abs(of["source", "b"].weight / total - 0.5) < 1e-6


def test_targets_that_contradict_each_other(spark):
    docs = spark.createDataFrame([(1, "w", "en", "a"), (2, "w", "de", "b")], "doc_id long, text string, lang string, source string")
    tables = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "class string, share double"), "lang": spark.createDataFrame([("en", 0.1), ("de", 0.9)], "class string, share double")}
    with pytest.warns(UserWarning, match="margin"):
        assert source_mix.mixed(docs, targets=tables).count() == 2


def test_mix_of_nothing(spark):
    assert source_mix.mixed(mix_docs(spark).where("false")).count() == 0


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 900)
    rows = [np.unique(np.concatenate([rng.integers(100, 400, 12), [int(g) + 10] if rng.random() < 0.9 else []]).astype(np.int64)) for g in y]
    model = quality_model.CumulativeLink().fit(rows[:700], y[:700])
    s = np.array([model.weights[r].sum() for r in rows[700:]])
    expected, top = model.judge(s)
    assert (np.diff(model.thresholds) > 0).all() and ((0 <= expected) & (expected <= 2)).all()
    assert np.corrcoef(expected, y[700:])[0, 1] > 0.7 and ((top > 0.5) == (y[700:] == 2)).mean() > 0.8
    assert (quality_model.CumulativeLink().fit([], np.array([], int)).weights == 0).all()
    assert (quality_model.CumulativeLink().fit(rows[:3], np.array([1, 1, 1])).weights == 0).all()


def test_likelihood_equals_brute_force():
    rng = np.random.default_rng(4)
    y, sets = rng.integers(0, 3, 40), [rng.choice(7, rng.integers(0, 5), replace=False) for _ in range(40)]
    row, feature = np.repeat(np.arange(40), [len(x) for x in sets]), np.concatenate(sets).astype(int)
    params = rng.normal(size=9)

    def plain(p):
        cuts, total = [p[7], p[7] + np.exp(p[8])], 0.0
        for grade, x in zip(y, sets, strict=True):
            at_most = [1 / (1 + np.exp(-(c - sum(p[i] for i in x)))) for c in cuts]
            total -= np.log([at_most[0], at_most[1] - at_most[0], 1 - at_most[1]][grade])
        return total / len(y)

    value, slope = quality_model.likelihood(params, y, row, feature, 7, 2)
    assert abs(value - plain(params)) < 1e-9
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        assert abs(slope[i] - (plain(params + step) - plain(params - step)) / 2e-6) < 1e-6


def test_grades_equal_brute_force(spark):
    """The query's rows against one text at a time, with the same fitted model."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality_model.fit(docs, labels)
    for r in quality_model.graded(docs, model).select("text", "grade.*").collect():
        s = sum(float(model.weights[i]) for i in quality_model.features(r.text))
        at_most = [1 / (1 + np.exp(-(c - s))) for c in model.thresholds]
        assert abs(r.expected_grade - sum(1 - p for p in at_most)) < 1e-4 and abs(r.top_probability - (1 - at_most[-1])) < 1e-4


def test_quality_model_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality_model.fit(docs, labels, 3000)
    test = docs.withColumn("grade", F.lit(0)).where(quality_model.held_out()).join(labels, "doc_id")
    out = quality_model.graded(test, model).select("grade.kept", "quality", "toxic").collect()
    clean = [r.kept for r in out if r.quality == 1 and not r.toxic]
    foul = [r.kept for r in out if r.toxic]
    poor = [r.kept for r in out if not r.quality and not r.toxic]
    assert sum(clean) / len(clean) > 0.9 and sum(foul) / len(foul) < 0.3 and sum(poor) / len(poor) < 0.4


def test_quality_model_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 1)], "doc_id long, quality int, toxic int")
    out = quality_model.graded(df, quality_model.fit(df, labels)).select("grade.*").collect()
    assert len(out) == 3 and out[0] == out[1]


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P
    from test_jaccard_join import brute

    docs = common.table(spark, SF, "documents")
    extra = spark.createDataFrame([(None, "w " * 30, "en", "s", 60), (900_001, None, None, None, 0), (900_002, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    outs = []
    for _, stage in P.STAGES:
        docs = common.written(stage(spark, docs, SF), "test")
        outs.append({r.doc_id: r for r in docs.collect()})
    good, distinct, redacted, mixed, encoded = outs
    assert good and all(not brute_statistics(r.text)[5] for r in good.values())
    classes = brute([(1 << 60 if i is None else i, r.text) for i, r in good.items()])  # the one without an id comes last
    assert set(distinct) == {None if i == 1 << 60 else i for i, c in classes.items() if c[1] == i}
    assert set(redacted) == set(distinct)
    for i, r in redacted.items():
        found = secret_scan.spans(distinct[i].text)[1]
        assert r.text == (secret_scan.redact(distinct[i].text, found) if found else distinct[i].text) and r.n_chars == len(r.text)
    assert set(mixed) < set(redacted) and len(mixed) > len(redacted) / 5
    assert set(encoded) == set(mixed)
    assert all(r.n_tokens == len(byte_bpe.encode(mixed[i].text, byte_bpe.vocabulary_path())) for i, r in encoded.items())
    assert [len(s) for s in P.STAGES] == [2] * 5


def test_distinct_keeps_clean_documents_whatever_their_ids(spark):
    """Null and shared ids, repeated rows and extra columns: only members of a class go, and each class keeps its first."""
    import corpus_pipeline as P

    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("a")), (7, text("c")), (7, text("d")), (7, text("d")), (8, text("c") + " more"), (9, text("a")), (None, None), (10, ""), (None, text("e")), (None, text("e") + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars", "5 as path", "map(1, 2) as m").repartition(3)
    got = P.keep_distinct(spark, df, SF)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    firsts = [x for x in kept if x[0] is None and x[1] and x[1].startswith("ew")]
    assert len(firsts) == 1 and firsts[0][1] in (text("e"), text("e") + " x")
    assert sorted((x for x in kept if x not in firsts), key=str) == sorted([(9, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (None, None), (10, "")], key=str)


@pytest.mark.parametrize("name", ["documents"])
def test_pipeline_of_nothing(spark, tmp_path, name):
    import corpus_pipeline as P

    common.table(spark, SF, name).where("false").write.parquet(f"file://{tmp_path}/{name}.parquet")
    common.table(spark, SF, "labels").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
