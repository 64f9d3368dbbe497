"""Page analytics: fixtures with values worked out by hand, invariants, and every cheap query against its SQL."""

import json
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators import audit, enrich, html, vectors
from pagelens.operators import keywords as K
from pagelens.plans import fixtures as X
from pagelens.plans import keyword_queries, page_queries, registry, table_queries
from pagelens.sources import fetch
from pagelens.streaming import pages as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages conversations part events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(table_queries.ORACLES) + ["e20_fields", "e14_external_hosts", "e15_json_ld_types", "audit_outcomes", "r30_score", "r32_findings", "u1_normalize", "u2_normalize_strict", "u3_private_host", "u4_display", "n6_top_phrases", "a6_scores", "k3_cosine_distance", "k6_silhouette"])
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: term: coverage, strength of competitors and target, score, status; worked out by hand.
TABLE = [
    ("battery storage", 1.0, 0.505952, 0, 80, "missing"), ("panel cost", 1.0, 0.40873, 0.125, 71, "underused"), ("battery", 1.0, 0.505952, 0, 66, "missing"), ("storage", 1.0, 0.505952, 0, 66, "missing"),
    ("solar panel cost", 1.0, 0.380952, 0.125, 65, "underused"), ("cost", 1.0, 0.40873, 0.125, 58, "underused"), ("solar panel", 1.0, 0.380952, 0.875, 41, "defend"), ("solar", 1.0, 0.519841, 1.0, 36, "defend"),
    ("panel", 1.0, 0.40873, 0.875, 34, "defend"), ("guide", 0.333333, 0.857143, 0.75, 24, "competitive"), ("welcome", 0, 0, 0.625, 0, "unique"), ("panels", 0, 0, 0.125, 0, "unique"), ("cut", 0, 0, 0.125, 0, "unique"),
    ("bills", 0, 0, 0.125, 0, "unique"), ("varies", 0, 0, 0.125, 0, "unique"),
]


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_keyword_table(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = K.keywords(X.pages(spark).where("group_id = 'f'")).orderBy("rank").collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.term, round(r.coverage, 6), round(r.comp_strength, 6), round(r.target_strength, 6), r.score, r.status) for r in got] == [(a, pytest.approx(b, abs=1e-6), pytest.approx(s, abs=1e-6), t, x, y) for a, b, s, t, x, y in TABLE]


def test_audit_scores(spark):
    got = {r.page_id: r for r in audit.scores(audit.outcomes(html.extract(X.html(spark)))).collect()}
    assert all(0 <= r.score <= 100 for r in got.values())
    assert got[-1].score > got[-2].score and got[-2].critical >= 1
    dom = html.extract(X.html(spark), "dom").where("page_id = -1").first()
    assert dom.links.generic_anchor == 1 and dom.dom_nodes > 20 and dom.schema_types == ["Product", "Article", "Thing", "Person"]


def test_random_stream():
    draw = vectors.random_stream(42)
    assert [next(draw) for _ in range(3)] == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]


def test_clustering():
    rng = np.random.default_rng(0)
    two = np.concatenate([rng.normal([1, 0, 0], 0.05, (15, 3)), rng.normal([0, 1, 0], 0.05, (15, 3))])
    x = vectors._unit(two)
    own, k, score = vectors.auto_cluster(x)
    assert k == 2 and len(set(own[:15])) == 1 and own[0] != own[-1] and score > 0.5
    again = vectors.auto_cluster(x)
    assert (again[0] == own).all()
    same = vectors._unit(np.ones((6, 3)))
    assert set(vectors.kmeans(same, 2)[0]) <= {0, 1}
    assert [vectors.auto_cluster(x[:n])[1] for n in (0, 1, 3)] == [0, 1, 1]
    assert vectors.silhouette(x, own, 1) == -1


def test_clusters_cover_keywords(spark):
    docs = X.pages(spark).where("group_id = 'f'")
    kw = vectors.selected(K.keywords(docs))
    got = vectors.clustered(vectors.assembled(kw, docs))
    assert got.count() == kw.count() == got.select("term").distinct().count()
    assert vectors.summaries(kw.join(got, ["group_id", "term"])).agg(F.sum("size")).first()[0] == kw.count()


def test_stream_of_pages(spark, tmp_path):
    X.html(spark).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp")).repartition(2).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(stream.PAGES).parquet(f"{tmp_path}/in")
    q = stream.audited(source).writeStream.format("memory").queryName("audited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("audited").count() == audit.outcomes(html.extract(X.html(spark))).count()
    q = stream.newest(source).writeStream.format("memory").queryName("newest").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("newest").count() == len(X.HTML)


def test_http_source_reports_failures(spark):
    spark.dataSource.register(fetch.HttpPages)
    got = spark.read.format("pagelens_http").option("urls", "http://127.0.0.1:9/a, http://127.0.0.1:9/b").load().collect()
    assert [r.error for r in got] == ["NETWORK", "NETWORK"]


def test_enrichment_failure_is_null(spark):
    def call(p):
        if "x" in p:
            raise ValueError(p)
        return json.dumps({"p": p})

    got = enrich.enriched(spark.createDataFrame([("a",), ("x",)], "prompt string"), call).collect()
    assert [r.reply for r in got] == ['{"p": "a"}', None]


def test_every_rule_is_registered():
    assert sum(n.startswith("rule") for n in page_queries.QUERIES) == 29


def test_summaries_add_up_in_order_of_rank(spark):
    """Four shares whose mean is 0.4, the limit of a theme, in one order and just below it in the other."""
    shares = [0.2, 0.4, 0.6, 0.4]
    rows = [(g, 0, f"t{i}", i + 1, x, 0.05, 0.5, 10, 5, 0.0) for g, xs in (("a", shares), ("b", shares[::-1])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "group_id string, cluster int, term string, rank int, coverage double, target_strength double, comp_strength double, score int, comp_count long, silhouette double")
    for dealt in (df.orderBy("rank").coalesce(1), df.orderBy(F.desc("rank")).coalesce(1), df.repartition(5, "rank")):
        got = {r.group_id: (r.avg_coverage, r.theme) for r in vectors.summaries(dealt).collect()}
        assert got == {"a": (0.4, "gap"), "b": (0.39999999999999997, "contested")}


@pytest.mark.parametrize("name", ["n8_tfidf", "o1_stable_sort", "a15_vectors"])
def test_pages_are_shuffled_and_phrases_are_not(spark, name):
    """A profile is many times the size of its pages: it stays where its group is, and nothing kept goes to disk."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\((.*?)\)", plan)]
    assert any(keys.startswith("group_id, ") for keys in dealt)
    assert not [keys for keys in dealt if re.search("term|token|doc_idx|dim", keys)]
    assert not [k for k, (_, df) in page_queries._KEPT.items() if df.storageLevel.useDisk]


@pytest.mark.parametrize("name", ["p10_map_of_dealt", "a17_cluster_labels", "a8_placements", "g12_arg_max", "p1_filter_all"])
def test_queries_of_the_keyword_table_shuffle_no_phrases(spark, name):
    """At most the clustered terms of a group, 180 rows, are dealt out by term, to meet their keywords."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = {re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\((.*?)\)", plan)}
    assert any(keys.startswith("group_id, ") for keys in dealt)
    assert not [keys for keys in dealt if re.search("token|doc_idx|dim", keys) or ("term" in keys and name != "a17_cluster_labels")]


def shuffled(spark):
    """Bytes that the session has written for shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_pages_are_shuffled_once_for_all_queries(spark):
    """The first of them shuffles the pages, once; the others, and clustering, add next to nothing."""
    sf = SF.replace("0.001", "0.01")
    size, each = os.path.getsize(f"{sf}/pages.parquet"), []
    for name in ["p1_filter_all", "a15_vectors", "a17_cluster_labels"]:
        before = shuffled(spark)
        registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        each.append((shuffled(spark) - before) / size)
    assert each[0] < 1.3 and max(each[1:]) < 0.2, each


def numbered(df):
    return sorted(tuple(r) for r in df.select("page_id", "group_id", "doc_idx").collect())


def test_groups_without_a_shuffle_of_pages(spark):
    """Languages that take turns, gaps, far ids, and blocks in which ids occur twice, in one language and in two."""
    ids = [*range(0, 1500, 2), 599, 600, 601, 10**15, 10**15 + 1, 6000, 6000, 6001, 6002, 6002, 6002, 7000]
    rows = [(p, f"https://h.org/{('en', 'de', 'fr')[i % 3]}/{i}" if i % 7 else "no address", "x") for i, p in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got, want = K.grouped_in_place(df), K.grouped(df)
    assert got.columns == want.columns and numbered(got) == numbered(want) and len(numbered(got)) == len(ids)


def test_dealt_pages_are_those_of_the_window(spark, monkeypatch):
    """Few files or many, numbers broadcast or not: the same records."""
    want, each = keyword_queries.docs(spark, SF), []
    of = lambda df: sorted(map(str, df.select("group_id", "doc_idx", F.xxhash64("title", "meta_description", "hostname", "fields")).collect()))
    for listed in (keyword_queries.LISTED, 0):
        monkeypatch.setattr(keyword_queries, "LISTED", listed)
        for size in ("128m", "8k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            each.append(of(keyword_queries._placed(spark, SF)))
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(x == of(want) for x in each)


def test_clusters_meet_their_keywords_where_these_are(spark):
    docs = X.pages(spark).where("group_id = 'f'")
    kw = vectors.selected(K.keywords(docs))
    groups = vectors.clustered_groups(vectors.assembled(kw, docs))
    got = vectors.members(kw, groups)
    assert got.columns == [*kw.columns, "cluster", "k", "silhouette"]
    of = lambda df: sorted(tuple(r) for r in df.select("group_id", "term", "cluster", "k", "silhouette").collect())
    assert of(got) == of(kw.join(vectors.clustered(vectors.assembled(kw, docs)), ["group_id", "term"])) and got.count() == kw.count()
