"""Queries over phrase profiles and comparisons, each with its DuckDB statement where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens import lexicon as L
from pagelens.functions import text as T
from pagelens.operators import enrich, html, insight, present, vectors
from pagelens.operators import keywords as K
from pagelens.plans import duck as D
from pagelens.plans import fixtures as X
from pagelens.plans.page_queries import kept, records, signature
from pagelens.sources import cache

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


c, q = F.col, D.q


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in groups of a target and five competitors, and the literal groups."""
    r = page_docs(spark, sf_dir)
    cols = ["group_id", "doc_idx", "title", "meta_description", "hostname", "fields"]
    return r.select(*cols).unionByName(X.pages(spark).select(*cols))


#: Bytes of page files to a task: some hundred pages, whose phrases are sorted in memory. Bytes of page numbers that may be broadcast.
PLACED, LISTED = 1 << 20, 1 << 27


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-sum(size for _, size, _ in signature(spark, sf_dir)[1:]) // PLACED), cores)
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id >= 0").select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html")
    n, last = raw.agg(F.count("*"), F.max("page_id")).first()
    listed = 4 * n + 200 * min(n, (last or 0) // 600 + 1) <= LISTED
    df, key = (K.grouped_in_place if listed else K.grouped)(raw), ["group_id", "doc_idx"]
    # Records are smaller than html, so they are dealt out where the files give every core a part of the pages to read.
    few = raw.rdd.getNumPartitions() < cores
    df = html.extract(df.repartition(parts, "group_id") if few else df, "html", *key).select(*key, "title", "meta_description", "hostname", "fields")
    return (df if few else df.repartition(parts, "group_id")).unionByName(X.pages(spark).select(*df.columns).repartition(parts, "group_id"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs dealt out by group, in a number of parts that follows the size of the files: whatever works within groups then stays in place.

    Pages are shuffled once, for all queries of a session: what memory does not hold is read from that shuffle again.
    """
    return kept(spark, sf_dir, "placed", lambda: _placed(spark, sf_dir))


_F = ("title", "description", "h1", "h2", "h3", "anchor", "alt", "body")
_LIT = X.values(X.page_rows(), "lit", ["group_id", "doc_idx", *_F])
_sets = lambda xs: "(" + ", ".join(map(q, sorted(xs))) + ")"
_field = " UNION ALL ".join(f"SELECT group_id, doc_idx, {i} AS field_ord, {w} AS weight, {f} AS text FROM docs" for i, (f, w) in enumerate(L.FIELDS.items()))
_lang = "regexp_extract(url, '^[^:]*://[^/?#]*/([a-z]{2})/', 1)"
_toks = "list_filter(list_transform(regexp_split_to_array({0}, " + q(L.TOKEN_BREAKS) + "), lambda t: " + D.replace("t", "^['’-]+|['’-]+$", "") + "), lambda t: length(t) BETWEEN 2 AND 28 AND t NOT IN " + _sets(L.JUNK) + " AND regexp_matches(t, '[a-z]'))"
DOCS = f"""{D.RECORD},
 num AS (SELECT *, {_lang} AS lg, CAST(floor(page_id / 600) AS BIGINT) AS blk, row_number() OVER (PARTITION BY {_lang}, floor(page_id / 600) ORDER BY page_id) - 1 AS n FROM rec WHERE page_id >= 0),
 {_LIT},
 docs AS (SELECT lg || '-' || blk || '-' || CAST(floor(n / 6) AS BIGINT) AS group_id, CAST(n % 6 AS INTEGER) AS doc_idx, title, meta_description, hostname, f_description AS description, f_h1 AS h1, f_h2 AS h2, f_h3 AS h3, f_anchor AS anchor, f_alt AS alt, body FROM num
   UNION ALL SELECT group_id, doc_idx, title, description, 'www.solar-now.example', description, h1, h2, h3, anchor, alt, body FROM lit)"""
PROFILE = f"""{DOCS},
 fr AS (SELECT * FROM ({_field}) WHERE text <> ''),
 sg AS (SELECT group_id, doc_idx, field_ord, weight, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS seg FROM (SELECT *, regexp_split_to_array(lower(text), {q(L.SEGMENT_BREAKS)}) AS s FROM fr)),
 tk AS (SELECT *, {_toks.format('s')} AS toks FROM sg),
 gm AS (SELECT group_id, doc_idx, field_ord, weight, seg, len, unnest(range(1, len(toks) - len + 2)) AS pos, toks FROM tk, (VALUES (1), (2), (3)) v(len)),
 g2 AS (SELECT *, toks[pos:pos + len - 1] AS g FROM gm),
 ph AS (SELECT *, array_to_string(g, ' ') AS term FROM g2 WHERE len(list_filter(g, lambda t: t IN {_sets(L.STOPWORDS)})) = 0 AND (len > 1 OR length(g[1]) >= 3)),
 pr AS (SELECT group_id, doc_idx, term, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight10, min(struct_pack(a := field_ord, b := seg, c := len, d := pos)) AS first_seen FROM ph GROUP BY 1, 2, 3)"""
CAND = f"""{PROFILE},
 nm AS (SELECT *, weight10 / max(weight10) OVER (PARTITION BY group_id, doc_idx) AS norm FROM pr),
 gs AS (SELECT group_id, count(*) - 1 AS comp_count FROM docs GROUP BY 1),
 cd AS (SELECT group_id, term, coalesce(max(norm) FILTER (doc_idx = 0), 0.0) AS target_w, count(*) FILTER (doc_idx > 0 AND norm >= 0.04) AS comp_df, coalesce(sum(norm) FILTER (doc_idx > 0 AND norm >= 0.04), 0.0) AS comp_sum, CAST(sum(n) AS BIGINT) AS corpus_count,
   min(struct_pack(i := doc_idx, f := first_seen)) FILTER (doc_idx = 0 OR norm >= 0.04) AS first_seen, count(*) AS df FROM nm GROUP BY 1, 2),
 lt AS (SELECT group_id, term, corpus_count AS n, unnest(str_split(term, ' ')) AS token FROM cd WHERE contains(term, ' ')),
 pn AS (SELECT lt.group_id, lt.term, CASE WHEN min(o.corpus_count) IS NULL THEN 1.0 ELSE max(n) / min(o.corpus_count) END AS phraseness FROM lt LEFT JOIN cd o ON o.group_id = lt.group_id AND o.term = lt.token GROUP BY 1, 2)"""
VOCAB = f"""{CAND},
 vb AS (SELECT cd.*, comp_count, phraseness, round(0.8 * target_w + CASE WHEN comp_count > 0 THEN 1.2 * comp_sum / comp_count + 0.6 * comp_df / comp_count ELSE 0.0 END, 9) AS salience FROM cd JOIN gs USING (group_id) LEFT JOIN pn USING (group_id, term)
   WHERE first_seen IS NOT NULL AND (phraseness IS NULL OR (corpus_count >= 2 AND phraseness >= 0.28)) AND (target_w >= 0.06 OR comp_df >= CASE WHEN comp_count >= 3 THEN 2 ELSE 1 END)),
 vo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY salience DESC, first_seen) AS salience_rank FROM vb) WHERE salience_rank <= 400)"""
SCORED = f"""{VOCAB},
 s1 AS (SELECT *, len(str_split(term, ' ')) AS words, CASE WHEN comp_count > 0 THEN comp_df / comp_count ELSE 0.0 END AS coverage, CASE WHEN comp_df > 0 THEN comp_sum / comp_df ELSE 0.0 END AS comp_strength, target_w AS target_strength FROM vo),
 s2 AS (SELECT *, CASE WHEN comp_count > 0 THEN 0.6 * coverage + 0.4 * comp_strength ELSE target_strength END AS demand FROM s1),
 s3 AS (SELECT *, greatest(0.0, least(1.0, demand - target_strength)) AS gap FROM s2),
 s4 AS (SELECT *, CAST(floor(round((0.55 * demand + 0.45 * gap) * CASE words WHEN 1 THEN 0.82 WHEN 2 THEN 1.0 ELSE 0.94 END * 100, 9) + 0.5) AS INTEGER) AS score,
   CASE WHEN comp_count = 0 THEN CASE WHEN target_strength > 0.35 THEN 'primary' ELSE 'secondary' END WHEN target_strength = 0 AND coverage >= 0.5 THEN 'missing' WHEN target_strength = 0 AND coverage > 0 THEN 'absent' WHEN coverage = 0 THEN 'unique'
     WHEN target_strength < comp_strength * 0.55 THEN 'underused' WHEN target_strength >= comp_strength THEN 'defend' ELSE 'competitive' END AS status, term IN {_sets(L.BOILERPLATE)} AS boilerplate FROM s3),
 kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, salience_rank) AS INTEGER) AS rank FROM s4)"""
TFIDF = """
 t1 AS (SELECT pr.*, comp_count, count(*) OVER (PARTITION BY group_id, term) AS df FROM pr JOIN (SELECT group_id, term FROM vo) USING (group_id, term) JOIN gs USING (group_id)),
 tf AS (SELECT group_id, doc_idx, term, df, ln((comp_count + 2) / (df + 1)) + 1 AS idf, weight10 / max(weight10) OVER (PARTITION BY group_id, doc_idx) * (ln((comp_count + 2) / (df + 1)) + 1) AS tfidf FROM t1)"""
r6 = lambda name: f"round({name}, 6) AS {name}"
R6 = lambda name: F.round(name, 6).alias(name)


def prof(s, sf):
    return K.profile(placed(s, sf))


def cand(s, sf):
    return K.candidates(prof(s, sf))


def kw(s, sf):
    return kept(s, sf, "keywords", lambda: K.keywords(placed(s, sf)))


_text = lambda s, sf: docs(s, sf).select("group_id", "doc_idx", c("fields.body").alias("body"))
_seg = f"regexp_split_to_array(lower(body), {q(L.SEGMENT_BREAKS)})"
add("n1_segments", lambda s, sf: _text(s, sf).select("group_id", "doc_idx", F.posexplode(T.segments(c("body"))).alias("seg", "segment")).where("segment <> ''"), f"WITH {DOCS} SELECT * FROM (SELECT group_id, doc_idx, CAST(generate_subscripts({_seg}, 1) - 1 AS INTEGER) AS seg, unnest({_seg}) AS segment FROM docs) WHERE segment <> ''")
add("n2_clean_token", lambda s, sf: _text(s, sf).select(F.explode(F.flatten(F.transform(T.segments(c("body")), T.tokens))).alias("token")).groupBy("token").count().withColumnRenamed("count", "n"), f"WITH {PROFILE} SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM tk WHERE field_ord = 7) GROUP BY 1")
add("n3_tokenize_segment", lambda s, sf: _text(s, sf).select("group_id", "doc_idx", F.posexplode(F.transform(T.segments(c("body")), T.tokens)).alias("seg", "t")).where("size(t) > 0").select("group_id", "doc_idx", "seg", F.array_join("t", " ").alias("tokens")), f"WITH {PROFILE} SELECT group_id, doc_idx, CAST(seg AS INTEGER) AS seg, array_to_string(toks, ' ') AS tokens FROM tk WHERE field_ord = 7 AND len(toks) > 0")
add("n4_tokenize", lambda s, sf: _text(s, sf).select("group_id", "doc_idx", F.size(F.flatten(F.transform(T.segments(c("body")), T.tokens))).cast("long").alias("n_tokens")).where("n_tokens > 0"), f"WITH {PROFILE} SELECT group_id, doc_idx, CAST(sum(len(toks)) AS BIGINT) AS n_tokens FROM tk WHERE field_ord = 7 GROUP BY 1, 2 HAVING sum(len(toks)) > 0")
_phr = lambda s, sf: K.phrases(K.field_rows(docs(s, sf)), ["group_id", "doc_idx", "field_ord"])
_phr_sql = f"WITH {PROFILE} SELECT group_id, doc_idx, field_ord, CAST(len AS INTEGER) AS n, term, count(*) AS c FROM ph GROUP BY ALL"
for _name in ("n5_extract_phrases", "w5_sliding_ngrams", "x1_explode_text", "j5_anti_stopwords"):
    add(_name, lambda s, sf: _phr(s, sf).groupBy("group_id", "doc_idx", "field_ord", "n", "term").agg(F.count("*").alias("c")), _phr_sql)
for _name in ("n6_profile", "g1_hash_aggregate"):
    add(_name, lambda s, sf: prof(s, sf).select("group_id", "doc_idx", "term", "n", "weight10"), f"WITH {PROFILE} SELECT group_id, doc_idx, term, n, weight10 FROM pr")


def top_phrases(s: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 heaviest phrases of each page; ties in order of appearance."""
    w = Window.partitionBy("group_id", "doc_idx").orderBy(F.desc("weight10"), "first_seen")
    return prof(s, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("group_id", "doc_idx", "rank", "term", (c("weight10") / 10).alias("weight"))


_top = f"WITH {PROFILE} SELECT group_id, doc_idx, rank, term, weight10 / 10 AS weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY group_id, doc_idx ORDER BY weight10 DESC, first_seen) AS INTEGER) AS rank FROM pr) WHERE rank <= 20"
for _name in ("n6_top_phrases", "w2_top_k_per_group", "o2_limit"):
    add(_name, top_phrases, _top)
for _name in ("n7_phraseness", "j7_lookup_members"):
    add(_name, lambda s, sf: K.phraseness(cand(s, sf)).select("group_id", "term", R6("phraseness")), f"WITH {CAND} SELECT group_id, term, {r6('phraseness')} FROM pn")


def tfidf(s, sf):
    return K.tfidf(vocab(s, sf)).select("group_id", "doc_idx", "term", "df", R6("idf"), R6("tfidf"))


_tf = f"WITH {VOCAB}, {TFIDF} SELECT group_id, doc_idx, term, df, {r6('idf')}, {r6('tfidf')} FROM tf"
for _name in ("n8_tfidf", "a5_tfidf_final_vocabulary", "j2_semi_join_vocabulary", "j3_left_join_idf"):
    add(_name, tfidf, _tf)
for _name in ("n9_normalize", "g5_max_per_document"):
    add(_name, lambda s, sf: K.normalized(prof(s, sf)).select("group_id", "doc_idx", "term", R6("norm")), f"WITH {CAND} SELECT group_id, doc_idx, term, {r6('norm')} FROM nm")
add("n10_word_lists", lambda s, sf: s.createDataFrame([(k, w) for k, ws in (("stop", sorted(L.STOPWORDS)), ("junk", L.JUNK), ("boilerplate", L.BOILERPLATE)) for w in ws], "list string, word string").groupBy("list").agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars")),
    f"SELECT list, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS chars FROM (SELECT 'stop' AS list, unnest([{', '.join(map(q, sorted(L.STOPWORDS)))}]) AS word UNION ALL SELECT 'junk', unnest([{', '.join(map(q, L.JUNK))}]) UNION ALL SELECT 'boilerplate', unnest([{', '.join(map(q, L.BOILERPLATE))}])) GROUP BY 1")
for _name in ("a1_corpus_counts", "g2_merge_aggregates"):
    add(_name, lambda s, sf: prof(s, sf).groupBy("group_id", "term").agg(F.sum("n").alias("n")), f"WITH {PROFILE} SELECT group_id, term, CAST(sum(n) AS BIGINT) AS n FROM pr GROUP BY 1, 2")
for _name in ("a2_candidates", "j1_full_outer", "g3_conditional_aggregate"):
    add(_name, lambda s, sf: cand(s, sf).select("group_id", "term", R6("target_w"), "comp_df", R6("comp_sum"), "corpus_count"), f"WITH {CAND} SELECT group_id, term, {r6('target_w')}, comp_df, {r6('comp_sum')}, corpus_count FROM cd")
add("g4_document_frequency", lambda s, sf: cand(s, sf).select("group_id", "term", "df"), f"WITH {CAND} SELECT group_id, term, df FROM cd")


def vocab(s, sf):
    return K.vocabulary(cand(s, sf), K.group_sizes(placed(s, sf)))


for _name in ("a3_vocabulary", "a4_salience"):
    add(_name, lambda s, sf: vocab(s, sf).select("group_id", "term", "salience", c("salience_rank").cast("long").alias("salience_rank")), f"WITH {VOCAB} SELECT group_id, term, salience, salience_rank FROM vo")
for _name in ("a6_scores", "a9_ranking", "o1_stable_sort"):
    add(_name, lambda s, sf: kw(s, sf).select("group_id", "term", "rank", "score", R6("coverage"), R6("comp_strength"), R6("target_strength"), R6("demand"), R6("gap")), f"WITH {SCORED} SELECT group_id, term, rank, score, {', '.join(map(r6, ('coverage', 'comp_strength', 'target_strength', 'demand', 'gap')))} FROM kw")
_status = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in K.STATUS.items())
for _name in ("a7_status", "j14_status_lookup"):
    add(_name, lambda s, sf: kw(s, sf).select("group_id", "term", "status").join(F.broadcast(s.createDataFrame([(k, *v) for k, v in K.STATUS.items()], "status string, label string, tone string")), "status", "left"), f"WITH {SCORED} SELECT group_id, term, kw.status, label, tone FROM kw LEFT JOIN (VALUES {_status}) m(status, label, tone) ON m.status = kw.status")
_lack = lambda f: f"NOT contains(lower(coalesce(docs.{f}, '')), term)"
_place = f"array_to_string(list_filter([CASE WHEN {_lack('title')} THEN 'title' END, CASE WHEN {_lack('h1')} THEN 'h1' END, CASE WHEN {_lack('meta_description')} THEN 'meta description' END, CASE WHEN {_lack('h2')} THEN 'a subheading' END], lambda x: x IS NOT NULL), ',')"
for _name in ("a8_placements", "j9_substring_fields"):
    add(_name, lambda s, sf: kw(s, sf).select("group_id", "term", F.array_join("placements", ",").alias("placements")), f"WITH {SCORED} SELECT kw.group_id, term, {_place} AS placements FROM kw JOIN docs ON docs.group_id = kw.group_id AND docs.doc_idx = 0")
add("j6_boilerplate_flag", lambda s, sf: kw(s, sf).select("group_id", "term", "boilerplate"), f"WITH {SCORED} SELECT group_id, term, boilerplate FROM kw")
for _name in ("j4_left_join_default", "x3_pivot_by_document"):
    add(_name, lambda s, sf: kw(s, sf).select("group_id", "term", R6("tfidf"), F.posexplode_outer("competitor_tfidf").alias("i", "x")).select("group_id", "term", "tfidf", F.coalesce("i", F.lit(-1)).alias("i"), R6("x")),
        f"WITH {SCORED}, {TFIDF}, ix AS (SELECT kw.group_id, term, i FROM kw LEFT JOIN LATERAL (SELECT unnest(range(0, comp_count)) AS i) ON true) SELECT ix.group_id, ix.term, round(coalesce(t0.tfidf, 0), 6) AS tfidf, CAST(coalesce(ix.i, -1) AS INTEGER) AS i, CASE WHEN ix.i IS NOT NULL THEN round(coalesce(t1.tfidf, 0), 6) END AS x FROM ix LEFT JOIN tf t0 ON t0.group_id = ix.group_id AND t0.term = ix.term AND t0.doc_idx = 0 LEFT JOIN tf t1 ON t1.group_id = ix.group_id AND t1.term = ix.term AND t1.doc_idx = ix.i + 1")
SEL = f"{SCORED}, sel AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS cnt FROM kw WHERE rank <= 180) WHERE cnt >= 6)"
add("a10_gate", lambda s, sf: vectors.selected(kw(s, sf)).groupBy("group_id").agg(F.count("*").alias("n")), f"WITH {SEL} SELECT group_id, count(*) AS n FROM sel GROUP BY 1")
LEX = f"{SEL}, lx0 AS (SELECT group_id, rank, unnest(str_split(term, ' ')) AS token, generate_subscripts(str_split(term, ' '), 1) AS pos FROM sel), lx1 AS (SELECT group_id, token, count(*) AS freq, min(struct_pack(r := rank, p := pos)) AS first FROM lx0 WHERE token NOT IN {_sets(L.STOPWORDS)} GROUP BY 1, 2), lx AS (SELECT * FROM (SELECT group_id, token, freq, row_number() OVER (PARTITION BY group_id ORDER BY freq DESC, first) - 1 AS dim FROM lx1) WHERE dim < 160)"
add("a11_lexical_vocabulary", lambda s, sf: vectors.lexical_vocabulary(vectors.selected(kw(s, sf))).select("group_id", "token", "freq", c("dim").cast("long").alias("dim")), f"WITH {LEX} SELECT group_id, token, freq, dim FROM lx")
_ctx = "array_to_string(list_filter([title, description, h1, h2, h3, body], lambda x: x <> ''), '. ')"
CTX = f"""cx0 AS (SELECT group_id, doc_idx, regexp_split_to_array(lower({_ctx}), {q(L.SEGMENT_BREAKS)}) AS s FROM docs), cx1 AS (SELECT group_id, doc_idx, generate_subscripts(s, 1) - 1 AS seg, unnest(s) AS s FROM cx0),
 cx2 AS (SELECT group_id, doc_idx, seg, list_filter({_toks.format('s')}, lambda t: t NOT IN {_sets(L.STOPWORDS)} AND length(t) >= 3) AS toks FROM cx1), cs AS (SELECT * FROM cx2 WHERE len(toks) >= 2),
 cv0 AS (SELECT group_id, doc_idx, seg, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM cs), cv1 AS (SELECT group_id, token, count(*) AS freq, min(struct_pack(i := doc_idx, s := seg, p := pos)) AS first FROM cv0 GROUP BY 1, 2),
 cv AS (SELECT * FROM (SELECT group_id, token, freq, row_number() OVER (PARTITION BY group_id ORDER BY freq DESC, first) - 1 AS dim FROM cv1) WHERE dim < 160)"""
add("a12_context_vocabulary", lambda s, sf: vectors.context_vocabulary(vectors.context_segments(docs(s, sf))).select("group_id", "token", "freq", c("dim").cast("long").alias("dim")), f"WITH {DOCS}, {CTX} SELECT group_id, token, freq, dim FROM cv")
COOC = f"{SEL}, {CTX}, co AS (SELECT sel.group_id, term, cv.dim, count(*) AS c FROM sel JOIN cs ON cs.group_id = sel.group_id AND contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || term || ' ') JOIN LATERAL (SELECT unnest(cs.toks) AS token) u ON true JOIN cv ON cv.group_id = sel.group_id AND cv.token = u.token GROUP BY 1, 2, 3)"


def cooc(s, sf):
    segs = vectors.context_segments(placed(s, sf))
    return vectors.cooccurrence(vectors.selected(kw(s, sf)), segs, vectors.context_vocabulary(segs))


for _name in ("a13_cooccurrence", "j8_theta_substring"):
    add(_name, lambda s, sf: cooc(s, sf).select("group_id", "term", c("dim").cast("long").alias("dim"), "c"), f"WITH {COOC} SELECT group_id, term, dim, c FROM co")
PPMI = f"{COOC}, pm AS (SELECT group_id, term, dim, greatest(0.0, ln(c * sum(c) OVER (PARTITION BY group_id) / (sum(c) OVER (PARTITION BY group_id, term) * sum(c) OVER (PARTITION BY group_id, dim)))) AS v FROM co), pp AS (SELECT group_id, term, dim, v / sqrt(sum(v * v) OVER (PARTITION BY group_id, term)) AS v FROM pm WHERE v > 0)"
for _name in ("a14_ppmi", "g9_marginal_totals"):
    add(_name, lambda s, sf: vectors.ppmi(cooc(s, sf)).select("group_id", "term", c("dim").cast("long").alias("dim"), R6("v")).where("v > 0"), f"WITH {PPMI} SELECT * FROM (SELECT group_id, term, dim, {r6('v')} FROM pp) WHERE v > 0")


def assembled(s, sf):
    k = vectors.selected(kw(s, sf))
    return k, vectors.assembled(k, placed(s, sf))


add("a15_vectors", lambda s, sf: assembled(s, sf)[1].groupBy("group_id", "term").agg(F.round(F.sum(c("v") * c("v")), 5).alias("norm2")))
add("k5_kmeans_groups", lambda s, sf: vectors.clustered(assembled(s, sf)[1]))


def members(s, sf):
    k, long = assembled(s, sf)
    return vectors.members(k, kept(s, sf, "clusters", lambda: vectors.clustered_groups(long)))


add("a16_cluster_summary", lambda s, sf: vectors.summaries(members(s, sf)).select("group_id", "id", "label", "size", "avg_score", "theme"))
add("a17_cluster_labels", lambda s, sf: vectors.labels(members(s, sf)))
add("a18_themes", lambda s, sf: vectors.summaries(members(s, sf)).groupBy("theme").agg(F.count("*").alias("n")))
add("k4_seeding", lambda s, sf: vectors.clustered(assembled(s, sf)[1]).groupBy("group_id", "k").agg(F.countDistinct("cluster").alias("used")))
add("k7_auto_k", lambda s, sf: vectors.clustered(assembled(s, sf)[1]).groupBy("group_id").agg(F.max("k").alias("k"), F.max("silhouette").alias("silhouette")))
add("p12_cluster_cards", lambda s, sf: members(s, sf).withColumn("r", F.row_number().over(Window.partitionBy("group_id", "cluster").orderBy("rank"))).groupBy("group_id", "cluster").agg(F.count_if(c("r") <= 12).alias("shown"), F.greatest(F.lit(0), F.count("*") - 12).alias("more")))
add("p10_opportunity_map", lambda s, sf: present.opportunity(members(s, sf)))

RECS = lambda s, sf: insight.recommendations(kw(s, sf), K.targets(placed(s, sf)))
PRIMARY = f"{SCORED}, po AS (SELECT *, CASE WHEN NOT boilerplate AND target_strength > 0 AND (comp_count = 0 OR coverage > 0) THEN 0 WHEN NOT boilerplate AND target_strength > 0 THEN 1 WHEN NOT boilerplate THEN 2 ELSE 3 END AS tier, round(target_strength * CASE WHEN words >= 2 THEN 1.15 ELSE 1.0 END, 9) AS worth FROM kw), pt AS (SELECT group_id, term AS prim FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY tier, CASE WHEN tier <= 1 THEN -worth ELSE 0 END, rank) AS o FROM po) WHERE o = 1)"
for _name in ("g12_arg_max", "o3_first_match"):
    add(_name, lambda s, sf: insight.primary_terms(kw(s, sf)).select("group_id", c("primary").alias("prim")), f"WITH {PRIMARY} SELECT group_id, prim FROM pt")
_tgt = lambda s, sf: insight.primary_terms(kw(s, sf)).join(K.targets(placed(s, sf)), "group_id")
_ex = "trim(regexp_extract(title, '(?s)^([^|\\-–—]*)', 1))"
_brand0 = "str_split(regexp_replace(hostname, '^www\\.', ''), '.')[1]"
_brand = f"(upper(substr({_brand0}, 1, 1)) || substr({_brand0}, 2))"
_nice = "array_to_string(list_transform(regexp_extract_all(prim, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), '')"
_base = f"(CASE WHEN length({_ex}) < 12 OR lower({_ex}) IN ('home', 'welcome', 'index', 'untitled', 'page') THEN {_nice} ELSE {_nice} || ' — ' || {_ex} END || CASE WHEN {_brand} <> '' THEN ' | ' || {_brand} ELSE '' END)"
_of_target = "FROM pt JOIN docs ON docs.group_id = pt.group_id AND docs.doc_idx = 0"
add("a21_title_suggestion", lambda s, sf: _tgt(s, sf).select("group_id", insight.title_suggestion(c("target"), c("primary")).alias("value")), f"WITH {PRIMARY} SELECT pt.group_id, CASE WHEN length({_base}) > 60 THEN substr({_base}, 1, 57) || '…' ELSE {_base} END AS value {_of_target}")
_md = "trim(meta_description)"
add("a22_description_suggestion", lambda s, sf: _tgt(s, sf).select("group_id", insight.description_suggestion(c("target"), c("primary")).alias("value")),
    f"""WITH {PRIMARY} SELECT pt.group_id, CASE WHEN {_md} = '' THEN 'Write ~150 characters covering "' || prim || '" and the outcome a reader gets from this page.' WHEN length({_md} || ' Learn more about ' || prim || '.') <= 160 THEN {_md} || ' Learn more about ' || prim || '.' ELSE 'Rework the existing description to lead with "' || prim || '" (keep it under 160 characters).' END AS value {_of_target}""")


_first = lambda name, test, n: f"{name} AS (SELECT group_id, list(term ORDER BY rank) AS {name}_terms FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY rank) AS r FROM kw WHERE NOT boilerplate AND {test}) WHERE r <= {n} GROUP BY 1)"
_quoted = lambda k: f"array_to_string(list_transform({k}, lambda x: '\"' || x || '\"'), ', ')"
_title_of = f"CASE WHEN length({_base}) > 60 THEN substr({_base}, 1, 57) || '…' ELSE {_base} END"
_lead = "length({0} || ' Learn more about ' || prim || '.') <= 160".format(_md)
_desc_of = f"""CASE WHEN {_md} = '' THEN 'Write ~150 characters covering "' || prim || '" and the outcome a reader gets from this page.' WHEN {_lead} THEN {_md} || ' Learn more about ' || prim || '.' ELSE 'Rework the existing description to lead with "' || prim || '" (keep it under 160 characters).' END"""
_recs = [
    (1, "high", "prim IS NOT NULL AND NOT contains(lower(title), prim)", """'Put "' || prim || '" in the title tag'""", "'It is the strongest topical term for this page but does not appear in the title — the highest-weight element you control.'", _title_of, "NULL"),
    (2, "high", "prim IS NOT NULL AND NOT contains(lower(h1), prim)", """'Work "' || prim || '" into the H1'""", "'The H1 and title should agree on the page topic. Right now they do not both contain the primary term.'", "NULL", "NULL"),
    (3, "medium", "prim IS NOT NULL AND NOT contains(lower(meta_description), prim)", """'Mention "' || prim || '" in the meta description'""", "'Matched terms are bolded in the search snippet, which lifts click-through even when rank is unchanged.'", _desc_of, "NULL"),
    (4, "high", "k > 0 AND gaps_terms IS NOT NULL", "'Cover ' || len(gaps_terms) || CASE WHEN len(gaps_terms) = 1 THEN ' topic' ELSE ' topics' END || ' the category ranks for and you do not'", f"'Competitors consistently cover: ' || {_quoted('gaps_terms')} || '. Each is a section this page is missing.'", "NULL", "gaps_terms"),
    (5, "medium", "k > 0 AND weak_terms IS NOT NULL", "'Strengthen terms you only mention in passing'", f"{_quoted('weak_terms')} || ' appear on this page far more weakly than across the category. Promote them into headings rather than burying them in body copy.'", "NULL", "weak_terms"),
    (6, "low", "strong_terms IS NOT NULL", "'Defend what you already lead on'", f"'You are strongest on ' || {_quoted('strong_terms')} || '. Keep this copy intact and point internal links at this page using those phrases as anchor text.'", "NULL", "strong_terms"),
    (7, "medium", "k = 0", "'Add competitor URLs for the comparison'", "'Keyword scores right now reflect only this page. Add 3–5 sites in the same category to unlock gap analysis, clustering and benchmarks.'", "NULL", "NULL"),
]
_each = " UNION ALL ".join(f"SELECT group_id, {i} AS ord, '{pr}' AS priority, {t} AS title, {d} AS detail, CAST({e} AS VARCHAR) AS example, array_to_string(CAST({x} AS VARCHAR[]), ',') AS terms FROM rc WHERE {when}" for i, pr, when, t, d, e, x in _recs)
add("a20_recommendations", lambda s, sf: RECS(s, sf).select("group_id", "ord", "priority", "title", "detail", "example", F.array_join("terms", ",").alias("terms")),
    f"WITH {PRIMARY}, " + _first("gaps", "status IN ('missing', 'absent') AND words >= 2", 6) + ", " + _first("weak", "status = 'underused'", 5) + ", " + _first("strong", "status IN ('defend', 'primary')", 5)
    + f", cn AS (SELECT group_id, count(*) - 1 AS k FROM docs GROUP BY 1), rc AS (SELECT docs.*, k, prim, gaps_terms, weak_terms, strong_terms FROM docs JOIN cn USING (group_id) LEFT JOIN pt USING (group_id) LEFT JOIN gaps USING (group_id) LEFT JOIN weak USING (group_id) LEFT JOIN strong USING (group_id) WHERE doc_idx = 0) SELECT * FROM ({_each})")
#: averages of coverage, target and competitors, number of competitors; label and advice as stated.
AVERAGES = [
    (0.9, 0.5, 0.5, 0, "On-page topic", "Add competitors to see how this topic compares to the category."), (0.14, 0.0, 0.9, 3, "Only you", "No one else in the set covers this. Either a real differentiator or off-topic drift — decide which."),
    (0.4, 0.09, 0.9, 3, "Content gap", "The category covers this topic and this page does not. Highest-leverage place to add a section."), (0.6, 0.3, 0.5, 3, "Table stakes, underweight", "Everyone covers this and you do so weakly. Strengthen it before chasing new topics."),
    (0.3, 0.5, 0.5, 3, "Your strength", "You lead the set here. Keep this copy and build internal links around it."), (0.3, 0.4, 0.5, 3, "Contested", "You are level with the category. Depth and freshness decide this one."), (0.15, 0.09, 0.5, 1, "Contested", "You are level with the category. Depth and freshness decide this one."),
]


def themed(s, sf):
    df = s.createDataFrame([(i, *x[:4]) for i, x in enumerate(AVERAGES)], "pos int, avg_coverage double, avg_target double, avg_comp double, comp_count long").withColumn("theme", vectors.theme())
    label, text = vectors.theme_texts(c("theme"))
    return df.select("pos", label.alias("label"), text.alias("advice"))


add("a18_theme_texts", themed, f"WITH {X.values([(i, *x[4:]) for i, x in enumerate(AVERAGES)], 'v', ['pos', 'label', 'advice'])} SELECT pos, label, advice FROM v")


def dealt(s, sf):
    """Keywords in clusters by the length of the term, so that SQL can deal them too."""
    return kw(s, sf).withColumns({"cluster": F.length("term") % 4, "silhouette": F.lit(0.0)})


_DEALT = f"{SCORED}, mb AS (SELECT *, length(term) % 4 AS cluster, row_number() OVER (PARTITION BY group_id, length(term) % 4 ORDER BY rank) - 1 AS r FROM kw)"
_NAMED = f"""{_DEALT}, tk1 AS (SELECT group_id, cluster, r, unnest(str_split(term, ' ')) AS token, generate_subscripts(str_split(term, ' '), 1) AS pos FROM mb WHERE r < 25), lw AS (SELECT group_id, cluster, token, round(sum(1 / (1 + 0.15 * r)), 9) AS w, min(struct_pack(r := r, p := pos)) AS first FROM tk1 WHERE token NOT IN {_sets(L.STOPWORDS)} AND length(token) >= 3 GROUP BY 1, 2, 3),
 lo AS (SELECT *, row_number() OVER (PARTITION BY group_id, cluster ORDER BY w DESC, first) AS o FROM lw), ln AS (SELECT group_id, cluster, string_agg(token, ' · ' ORDER BY o) AS label FROM lo WHERE o <= 3 GROUP BY 1, 2), lb AS (SELECT mb.group_id, mb.cluster, coalesce(label, term) AS label FROM mb LEFT JOIN ln USING (group_id, cluster) WHERE r = 0)"""
add("a17_labels_of_dealt", lambda s, sf: vectors.labels(dealt(s, sf)).select("group_id", c("cluster").cast("int").alias("cluster"), "label"), f"WITH {_NAMED} SELECT group_id, CAST(cluster AS INTEGER) AS cluster, label FROM lb")
add("a16_summary_of_dealt", lambda s, sf: vectors.summaries(dealt(s, sf)).select("group_id", c("cluster").cast("int").alias("cluster"), c("size").cast("int").alias("size"), "avg_score", F.round("avg_coverage", 6).alias("avg_coverage"), "theme"),
    f"WITH {_NAMED}, su AS (SELECT group_id, cluster, CAST(count(*) AS INTEGER) AS size, CAST(floor(round(avg(score), 9) + 0.5) AS INTEGER) AS avg_score, avg(coverage) AS cov, avg(target_strength) AS t, avg(comp_strength) AS cs, max(comp_count) AS k FROM mb GROUP BY 1, 2) SELECT group_id, CAST(cluster AS INTEGER) AS cluster, size, avg_score, round(cov, 6) AS avg_coverage, CASE WHEN k = 0 THEN 'onpage' WHEN cov < 0.15 THEN 'unique' WHEN t < 0.1 AND cov >= 0.4 THEN 'gap' WHEN cov >= 0.6 AND t < cs * 0.7 THEN 'weak' WHEN t >= cs THEN 'strength' ELSE 'contested' END AS theme FROM su")
add("p10_map_of_dealt", lambda s, sf: present.opportunity(dealt(s, sf)).select("group_id", c("cluster").cast("int").alias("cluster"), "term", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
    f"WITH {_DEALT} SELECT group_id, CAST(cluster AS INTEGER) AS cluster, term, round(greatest(0.0, least(1.0, target_strength)), 6) AS x, round(greatest(0.0, least(1.0, demand)), 6) AS y FROM mb WHERE r < 30")
_card = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("group_id", "cluster").orderBy("rank"))).groupBy("group_id", "cluster").agg(F.sort_array(F.collect_list(F.when(c("r") <= 12, F.struct("r", "term")))).alias("m"), F.greatest(F.lit(0), F.count("*") - 12).cast("int").alias("more"))  # noqa: E731  lists of 12 at most
add("p12_cards_of_dealt", lambda s, sf: _card(dealt(s, sf)).select("group_id", c("cluster").cast("int").alias("cluster"), F.array_join(F.transform("m", lambda x: x["term"]), ", ").alias("members"), "more"),
    f"WITH {_DEALT} SELECT group_id, CAST(cluster AS INTEGER) AS cluster, string_agg(term, ', ' ORDER BY rank) FILTER (r < 12) AS members, CAST(greatest(0, count(*) - 12) AS INTEGER) AS more FROM mb GROUP BY 1, 2")


def page_docs(s, sf):
    return K.grouped(records(s, sf).where("page_id >= 0"))


_BENCH = f"""WITH {DOCS}, d AS (SELECT lg || '-' || blk || '-' || CAST(floor(n / 6) AS BIGINT) AS group_id, n % 6 AS doc_idx, word_count, length(title) AS tl, len(headings) AS hc, internal, img_total, CASE WHEN meta_description <> '' THEN 100 ELSE 0 END AS md FROM num),
 m AS (SELECT group_id, doc_idx, unnest([struct_pack(o := 0, m := 'Word count', f := 'number', v := word_count::DOUBLE), struct_pack(o := 1, m := 'Title length', f := 'chars', v := tl::DOUBLE), struct_pack(o := 2, m := 'Headings', f := 'number', v := hc::DOUBLE), struct_pack(o := 3, m := 'Internal links', f := 'number', v := internal::DOUBLE), struct_pack(o := 4, m := 'Images', f := 'number', v := img_total::DOUBLE), struct_pack(o := 5, m := 'Uses structured data', f := 'percent', v := 0::DOUBLE), struct_pack(o := 6, m := 'Has meta description', f := 'percent', v := md::DOUBLE)]) AS x FROM d),
 a AS (SELECT group_id, x.o AS ord, x.m AS metric, x.f AS format, max(x.v) FILTER (doc_idx = 0) AS you, count(*) FILTER (doc_idx > 0) AS k, median(x.v) FILTER (doc_idx > 0) AS md, avg(x.v) FILTER (doc_idx > 0) AS av FROM m GROUP BY 1, 2, 3, 4)
 SELECT group_id, ord, metric, format, you, CAST(CASE WHEN format = 'percent' THEN floor(round(av, 9) + 0.5) WHEN k % 2 = 0 THEN floor(md + 0.5) ELSE md END AS DOUBLE) AS category FROM a WHERE k > 0"""
for _name in ("a19_benchmarks", "g7_exact_median", "g8_percentage"):
    add(_name, lambda s, sf: insight.benchmarks(page_docs(s, sf)).select("group_id", "ord", "metric", "format", "you", "category"), _BENCH)
_B = _BENCH.replace(" SELECT group_id, ord, metric", " , b AS (SELECT group_id, ord, metric").rstrip() + ")"
add("p7_benchmark_tone", lambda s, sf: insight.benchmarks(page_docs(s, sf)).select("group_id", "metric", present.benchmark_tone(c("you"), c("category"), c("higher_is_better")).alias("tone")), f"{_B} SELECT group_id, metric, CASE WHEN metric <> 'Title length' AND category > 0 THEN CASE WHEN you / category >= 0.9 THEN 'ok' WHEN you / category >= 0.6 THEN 'warning' ELSE 'critical' END ELSE '' END AS tone FROM b")
add("p8_format", lambda s, sf: insight.benchmarks(page_docs(s, sf)).select("group_id", "metric", present.formatted(c("you"), c("format")).alias("value")), f"{_B} SELECT group_id, metric, CAST(you AS BIGINT) || CASE format WHEN 'percent' THEN '%' WHEN 'chars' THEN ' ch' ELSE '' END AS value FROM b")

# ---- presentation of the keyword table --------------------------------------------------------
for _mode, _in in {**present.MODES, "all": ()}.items():
    add(f"p1_filter_{_mode}", lambda s, sf, m=_mode: present.filtered(kw(s, sf), m, "an").select("group_id", "term", "status"), f"WITH {SCORED} SELECT group_id, term, status FROM kw WHERE contains(term, 'an')" + (f" AND status IN {_sets(_in)}" if _in else ""))
for _key in ("score", "coverage", "target_strength"):
    add(f"p2_sort_{_key}", lambda s, sf, k=_key: present.ordered(kw(s, sf).withColumn(k, F.round(k, 9)), k, False).select("group_id", "term", "position"), f"WITH {SCORED} SELECT group_id, term, CAST(row_number() OVER (PARTITION BY group_id ORDER BY round({_key}, 9), rank) AS INTEGER) AS position FROM kw")
add("p3_page", lambda s, sf: present.page(present.ordered(kw(s, sf))).select("group_id", "term", "position", "remaining"), f"WITH {SCORED} SELECT group_id, term, rank AS position, greatest(0, cnt - 40) AS remaining FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS cnt FROM kw) WHERE rank <= 40")
add("p4_placement_hint", lambda s, sf: kw(s, sf).select("group_id", "term", present.placement_hint().alias("hint")), f"WITH {SCORED}, h AS (SELECT kw.group_id, term, status, {_place} AS p FROM kw JOIN docs ON docs.group_id = kw.group_id AND docs.doc_idx = 0) SELECT group_id, term, CASE WHEN status IN ('missing', 'underused') THEN array_to_string(list_filter(str_split(p, ','), lambda x: x <> '')[1:2], ', ') ELSE '' END AS hint FROM h")
add("s11_export_json", lambda s, sf: cache.exported(kw(s, sf)))
add("s12_api_projection", lambda s, sf: kw(s, sf).where("rank <= 12").select("group_id", "rank", "term", "score", "status"), f"WITH {SCORED} SELECT group_id, rank, term, score, status FROM kw WHERE rank <= 12")


def web(s, sf):
    """Each group's twelve keywords with a model's answer that is absent, failed, empty or full, by the length of the group's name."""
    own = kw(s, sf).where("rank <= 12").groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term", "status"))), lambda k: F.struct(k["term"].alias("term"), k["status"].alias("status"))).alias("keywords"))
    kind, term, rival = F.length("group_id") % 4, "array(named_struct('term', 'ai term', 'intent', 'commercial'))", "array(named_struct('name', string(null), 'url', 'https://r.org/', 'reason', 'same goods'))"
    ai = "named_struct('error', {0}, 'provider', {1}, 'keywords', {2}, 'competitors', {3})".format
    nothing = "cast(array() as array<struct<term: string, intent: string>>)"
    ai = F.when(kind == 1, F.expr(ai("'failed'", "'groq'", term, rival))).when(kind == 2, F.expr(ai("string(null)", "'claude'", nothing, rival))).when(kind == 3, F.expr(ai("string(null)", "'groq'", term, rival)))
    return enrich.shown(own.withColumns({"ai": ai, "rivals": F.array(F.lit("https://hand.org/"))}))


_kind = "length(group_id) % 4"
add("p13_web_keywords", lambda s, sf: web(s, sf).select("group_id", "source", F.posexplode("keyword_rows").alias("pos", "k")).select("group_id", "source", "pos", "k.*"),
    f"WITH {SCORED}, g AS (SELECT DISTINCT group_id FROM kw), r AS (SELECT group_id, 'Groq enhanced' AS source, 0 AS pos, 'ai term' AS term, 'commercial' AS note FROM g WHERE {_kind} = 3 UNION ALL SELECT group_id, CASE WHEN {_kind} = 2 THEN 'Claude enhanced' ELSE 'Page analysis' END, CAST(rank - 1 AS INTEGER), term, status FROM kw WHERE rank <= 12 AND {_kind} <> 3) SELECT * FROM r")
add("p13_web_competitors", lambda s, sf: web(s, sf).select("group_id", F.explode("competitor_rows").alias("r")).select("group_id", "r.*"),
    f"WITH {SCORED} SELECT DISTINCT group_id, CASE WHEN {_kind} >= 2 THEN 'https://r.org/' ELSE 'https://hand.org/' END AS name, CASE WHEN {_kind} >= 2 THEN 'https://r.org/' ELSE 'https://hand.org/' END AS url, CASE WHEN {_kind} >= 2 THEN 'same goods' ELSE 'Added manually' END AS reason FROM kw")
add("u_1_union_documents", lambda s, sf: docs(s, sf).groupBy("group_id").agg(F.count("*").alias("n")), f"WITH {DOCS} SELECT group_id, count(*) AS n FROM docs GROUP BY 1")
_decay = f"WITH {SCORED} SELECT group_id, term, round(1 / (1 + 0.15 * (rank - 1)), 6) AS w FROM kw WHERE rank <= 25"
add("w3_rank_decay", lambda s, sf: kw(s, sf).where("rank <= 25").select("group_id", "term", F.round(1 / (1 + 0.15 * (c("rank") - 1)), 6).alias("w")), _decay)

# ---- vectors ----------------------------------------------------------------------------------
emb = lambda s, sf: s.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").select("vec_id", F.col("label").cast("int").alias("label"), vectors.l2(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
_E = "e0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings), e AS (SELECT vec_id, label, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS v FROM e0)"
add("k2_l2_normalize", lambda s, sf: emb(s, sf).select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", R6("x")), f"WITH {_E} SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS i, round(unnest(v), 6) AS x FROM e")


def centroids(s, sf):
    """Unit mean of the vectors of each label."""
    long = emb(s, sf).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    return long.groupBy("label").agg(vectors.l2(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])).alias("centre"))


_C = f"{_E}, cl AS (SELECT label, i, sum(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY 1, 2), cc AS (SELECT label, list(x ORDER BY i) AS s FROM cl GROUP BY 1), ce AS (SELECT label AS centre_label, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS centre FROM cc)"


def distances(s, sf):
    """Distance of each vector to each centroid: centroids are as many as labels, so they are broadcast."""
    ce = centroids(s, sf).withColumnRenamed("label", "centre_label")
    packed = ce.agg(F.sort_array(F.collect_list(F.struct("centre_label", "centre"))).alias("all"))
    df = emb(s, sf).join(F.broadcast(packed)).select("vec_id", "label", F.explode(F.transform("all", lambda x: F.struct(x["centre_label"].alias("centre_label"), (1 - vectors.dot(F.col("v"), x["centre"])).alias("d")))).alias("x"))
    return df.select("vec_id", "label", "x.*")


_DIST = f"{_C}, ds AS (SELECT vec_id, label, centre_label, 1 - list_dot_product(v, centre) AS d FROM e, ce)"
add("k3_cosine_distance", lambda s, sf: distances(s, sf).select("vec_id", "centre_label", R6("d")), f"WITH {_DIST} SELECT vec_id, centre_label, {r6('d')} FROM ds")
for _name in ("j10_nearest_centroid", "k9_assignment"):
    add(_name, lambda s, sf: distances(s, sf).groupBy("vec_id").agg(F.min(F.struct(F.round("d", 9).alias("d"), "centre_label")).alias("m")).select("vec_id", c("m.centre_label").alias("nearest"), F.round("m.d", 6).alias("d")), f"WITH {_DIST} SELECT vec_id, centre_label AS nearest, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), centre_label) AS r FROM ds) WHERE r = 1")
add("k9_inertia", lambda s, sf: distances(s, sf).groupBy("vec_id").agg(F.min("d").alias("d")).agg(F.round(F.sum(c("d") * c("d")), 4).alias("inertia")), f"WITH {_DIST} SELECT round(sum(d * d), 4) AS inertia FROM (SELECT min(d) AS d FROM ds GROUP BY vec_id)")


def silhouettes(s, sf):
    """Mean silhouette by label in one pass: the sum of cosine distances from a point to a cluster is size minus the dot product with the cluster's sum."""
    e = emb(s, sf)
    sums = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("total"))
    sums = sums.join(e.groupBy("label").agg(F.count("*").alias("n")), "label").agg(F.collect_list(F.struct("label", "total", "n")).alias("all"))
    df = e.join(F.broadcast(sums)).withColumn("m", F.transform("all", lambda k: F.struct(k["label"].alias("label"), (k["n"] - vectors.dot(F.col("v"), k["total"])).alias("s"), k["n"].alias("n"))))
    own = F.get(F.filter("m", lambda k: k["label"] == F.col("label")), F.lit(0))
    a = F.when(own["n"] > 1, own["s"] / (own["n"] - 1)).otherwise(0.0)
    b = F.array_min(F.transform(F.filter("m", lambda k: k["label"] != F.col("label")), lambda k: k["s"] / k["n"]))
    return df.select("label", a.alias("a"), b.alias("b")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((c("b") - c("a")) / F.greatest("a", "b")), 5).alias("silhouette"))


_SIL = f"WITH {_E}, p AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.v, b.v)) AS s, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), z AS (SELECT vec_id, label, coalesce(max(s / n) FILTER (other = label), 0) AS a, min(s / n) FILTER (other <> label) AS b FROM p GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM z GROUP BY 1"
for _name in ("k6_silhouette", "j11_self_join_distances"):
    add(_name, silhouettes, _SIL)
add("g6_average_per_cluster", lambda s, sf: distances(s, sf).where("label = centre_label").groupBy("label").agg(F.round(F.avg("d"), 6).alias("avg_d")), f"WITH {_DIST} SELECT label, round(avg(d), 6) AS avg_d FROM ds WHERE label = centre_label GROUP BY 1")
add("w4_running_sum", lambda s, sf: distances(s, sf).groupBy("label", "vec_id").agg(F.min("d").alias("d")).withColumn("mass", F.round(F.sum(c("d") * c("d")).over(Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)), 5)).select("label", "vec_id", "mass"), f"WITH {_DIST} SELECT label, vec_id, round(sum(d * d) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 5) AS mass FROM (SELECT label, vec_id, min(d) AS d FROM ds GROUP BY 1, 2)")
add("k5_kmeans_mllib", lambda s, sf: vectors.clustered_at_scale(emb(s, sf), 10).groupBy("cluster").agg(F.count("*").alias("n")))
add("k8_singleton_cost", lambda s, sf: vectors.clustered(assembled(s, sf)[1]).groupBy("group_id", "cluster").agg(F.count("*").alias("n"), F.max("k").alias("k")).groupBy("group_id").agg((F.count_if(c("n") < 2) / F.max("k") * vectors.SINGLETON_COST).alias("cost")))
add("k1_random_stream", lambda s, sf: s.createDataFrame([(seed, i, x) for seed in (42, 7, 3) for i, x in zip(range(4), vectors.random_stream(seed))], "seed int, i int, x double"),
    "SELECT CAST(seed AS INTEGER) AS seed, CAST(i AS INTEGER) AS i, CAST(x AS DOUBLE) AS x FROM (VALUES (42, 0, 0.6011037519201636), (42, 1, 0.44829055899754167), (42, 2, 0.8524657934904099), (42, 3, 0.6697340414393693), (7, 0, 0.011704753153026104), (7, 1, 0.06195825257458806), (7, 2, 0.97690763277933), (7, 3, 0.6990287057124078), (3, 0, 0.7202267837710679), (3, 1, 0.03866216051392257), (3, 2, 0.4561921926215291), (3, 3, 0.07492800964973867)) t(seed, i, x)")
