"""Queries over page records and addresses, each with its DuckDB statement."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens import lexicon as L
from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.operators import audit, audit_text, html
from pagelens.plans import duck as D
from pagelens.plans import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than that, as work on a page outweighs moving it; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table, and the literal pages that take the branches it lacks."""
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").unionByName(X.html(spark).coalesce(1)))


_KEPT: dict[tuple[str, str], tuple[object, DataFrame]] = {}


def signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files below a folder: changes when its tables do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/pages.parquet")
    fs, found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    files = fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return (spark.sparkContext.applicationId, *sorted(found))


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that many queries start from (outcomes, dealt pages, keywords, clusters), kept in memory for the session.

    What does not fit, or was on an executor that is lost, is computed again: such a table can be many
    times the size of its pages, so it never goes to disk. Of each name only the last input's is kept, and
    none whose files have changed.
    """
    at, now = (sf_dir, name), signature(spark, sf_dir)
    for key in [k for k, (seen, _) in _KEPT.items() if (k[1] == name and k != at) or (k == at and seen != now)]:
        seen, old = _KEPT.pop(key)
        if seen[0] == now[0]:  # else its session is gone
            old.unpersist()
    if at not in _KEPT:
        # Planned as it stands, so that the plans that read it know by what it is dealt out and leave it there.
        adaptive = "spark.sql.adaptive.enabled"
        before = spark.conf.get(adaptive)
        spark.conf.set(adaptive, "false")
        try:
            _KEPT[at] = (now, make().persist(StorageLevel.MEMORY_ONLY))
        finally:
            spark.conf.set(adaptive, before)
    return _KEPT[at][1]


def records(spark: SparkSession, sf_dir: str, mode: str = "html") -> DataFrame:
    """Not kept: a query computes only the columns that it asks for."""
    return html.extract(pages(spark, sf_dir), mode)


def record(name: str, columns, select: str, mode: str = "html", rest: str = "rec") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir, mode).select("page_id", *(c.alias(k) for k, c in columns().items()))

    add(name, query, D.from_rec("page_id, " + select, rest) if select else None)


def raw(name: str, make, select: str) -> None:
    """A function of the raw html."""
    add(name, lambda spark, sf_dir: pages(spark, sf_dir).select("page_id", make(F.coalesce("html", F.lit(""))).alias("value")), f"WITH {D.RECORD} SELECT page_id, {select} AS value FROM c1")


c = F.col
raw("e1_decode_entities", T.decode_entities, D.decode("html"))
raw("e3_collapse", T.collapse, D.collapse("html"))
raw("e4_strip_tags", T.strip_tags, D.strip_tags("html"))
raw("e5_strip_non_content", T.strip_non_content, "clean")
raw("e6_strip_chrome", T.strip_chrome, D.without("html", L.CHROME))
add(
    "e2_parse_attributes",
    lambda spark, sf: pages(spark, sf).select("page_id", F.posexplode(html.bags(T.strip_non_content(F.coalesce("html", F.lit(""))), "a")).alias("tag", "b")).select("page_id", "tag", F.posexplode("b").alias("at", "a")).groupBy("page_id", "tag", "a.key").agg(F.count("*").alias("n"), F.max_by("a.value", "at").alias("value")).select("page_id", "tag", "key", "n", "value"),
    f"WITH {D.RECORD}, t AS (SELECT page_id, tag - 1 AS tag, b FROM (SELECT page_id, unnest({D.bags('a')}) AS b, generate_subscripts({D.bags('a')}, 1) AS tag FROM c1)) "
    "SELECT page_id, tag, key, count(*) AS n, arg_max(value, nth) AS value FROM (SELECT page_id, tag, unnest(b.k) AS key, unnest(b.v) AS value, generate_subscripts(b.k, 1) AS nth FROM t) GROUP BY ALL",
)
record("e7_title", lambda: {"title": c("title")}, "title")
record("e8_meta", lambda: {"description": c("meta_description"), "robots": c("meta_robots"), "viewport": c("viewport")}, "meta_description AS description, meta_robots AS robots, viewport")
record("e9_link_rel", lambda: {"canonical": c("canonical")}, "canonical")
record("e10_lang", lambda: {"lang": c("lang")}, "lang")
record("e12_image_counters", lambda: {k: c(f"images.{k}").cast("long") for k in ("total", "missing_alt", "empty_alt", "no_dimensions", "no_lazy")}, "img_total AS total, missing_alt, empty_alt, no_dimensions, no_lazy")
record("e13_link_counters", lambda: {k: c(f"links.{k}").cast("long") for k in ("internal", "external", "nofollow")}, "internal, external, nofollow")
record("e16_body_text", lambda: {"body": c("fields.body")}, "body")
record("e17_word_count", lambda: {"word_count": c("word_count").cast("long")}, "word_count")
record("e18_hreflang", lambda: {"hreflang": F.array_join("hreflang", ",")}, "coalesce(array_to_string(hreflang, ','), '') AS hreflang")
record("e19_open_graph", lambda: {f"og_{k}": c(f"og.{k}") for k in ("title", "description", "image", "type", "url")} | {f"twitter_{k}": c(f"twitter.{k}") for k in ("card", "title", "image")},
       ", ".join([f"og_{k}" for k in ("title", "description", "image", "type", "url")] + [f"twitter_{k}" for k in ("card", "title", "image")]))
record("e20_fields", lambda: {k: c(f"fields.{k}") for k in L.FIELDS}, "title, f_h1 AS h1, f_description AS description, f_h2 AS h2, f_h3 AS h3, f_anchor AS anchor, f_alt AS alt, body")
record("e23_sizes", lambda: {"html_bytes": c("html_bytes").cast("long"), "dom_nodes": c("dom_nodes").cast("long")}, "CAST(length(html) + len(regexp_extract_all(html, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS html_bytes, CAST(0 AS BIGINT) AS dom_nodes")
record("s2_page_record", lambda: {k: c(k) for k in ("url", "origin", "hostname", "pathname", "protocol", "title", "meta_description", "canonical", "lang")} | {"h1_count": c("h1_count").cast("long"), "words": c("word_count").cast("long")},
       "url, origin, hostname, pathname, protocol, title, meta_description, canonical, lang, h1_count, word_count AS words")

HEADS = "h AS (SELECT page_id, unnest(headings) AS h, generate_subscripts(headings, 1) AS pos FROM rec)"
add("e11_headings", lambda s, sf: records(s, sf).select("page_id", F.posexplode("headings").alias("p", "h")).select("page_id", (c("p") + 1).cast("long").alias("pos"), "h.level", "h.text"), f"WITH {D.RECORD}, {HEADS} SELECT page_id, pos, h.level AS level, h.text AS text FROM h")
add("w1_heading_step", lambda s, sf: records(s, sf).select("page_id", audit.heading_skip().alias("skips")), f"WITH {D.RECORD}, {HEADS}, l AS (SELECT page_id, h.level - lag(h.level) OVER (PARTITION BY page_id ORDER BY pos) AS d FROM h) SELECT page_id, coalesce((SELECT max(d) > 1 FROM l WHERE l.page_id = rec.page_id), false) AS skips FROM rec")
add("x2_unnest_headings_by_level", lambda s, sf: records(s, sf).select(F.explode("headings").alias("h")).groupBy("h.level").agg(F.count("*").alias("n")), f"WITH {D.RECORD}, {HEADS} SELECT h.level AS level, count(*) AS n FROM h GROUP BY 1")
LINKS = "k AS (SELECT page_id, hostname, unnest(links) AS a, generate_subscripts(links, 1) AS pos FROM rec)"
EXTERNAL = f"{LINKS}, e AS (SELECT page_id, a.host AS host, count(*) AS n, min(pos) AS first FROM k WHERE a.host <> hostname GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS rank FROM e)"
add("e14_external_hosts", lambda s, sf: records(s, sf).select("page_id", F.posexplode("links.external_hosts").alias("p", "x")).select("page_id", (c("p") + 1).cast("long").alias("rank"), "x.host", c("x.count").cast("long").alias("n")), f"WITH {D.RECORD}, {EXTERNAL} SELECT page_id, rank, host, n FROM r WHERE rank <= 40")
add("g11_distinct_in_order", lambda s, sf: records(s, sf).select("page_id", F.array_join(F.array_distinct(F.transform("headings", lambda h: h["level"])), ",").alias("levels")), f"WITH {D.RECORD}, {HEADS}, f AS (SELECT page_id, h.level AS v, min(pos) AS p FROM h GROUP BY 1, 2) SELECT page_id, coalesce((SELECT string_agg(v, ',' ORDER BY p) FROM f WHERE f.page_id = rec.page_id), '') AS levels FROM rec")
LD = "b AS (SELECT page_id, json(x) AS j FROM (SELECT page_id, unnest(blocks) AS x FROM rec) WHERE json_valid(x))"
ENTER = "SELECT page_id, j FROM {0} WHERE json_type(j) = 'OBJECT' UNION ALL SELECT page_id, unnest(CAST(j AS JSON[])) FROM {0} WHERE json_type(j) = 'ARRAY'"
add(
    "e15_json_ld_types",
    lambda s, sf: records(s, sf).select("page_id", F.explode("schema_types").alias("type")),
    f"WITH {D.RECORD}, {LD}, n1 AS ({ENTER.format('b')}), g AS (SELECT page_id, json_extract(j, '$.\"@graph\"') AS j FROM n1 WHERE json_extract(j, '$.\"@graph\"') IS NOT NULL), n2 AS ({ENTER.format('g')}), a AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2), "
    "t AS (SELECT page_id, json_extract(j, '$.\"@type\"') AS t FROM a), u AS (SELECT page_id, t FROM t WHERE json_type(t) = 'VARCHAR' UNION ALL SELECT page_id, unnest(CAST(t AS JSON[])) FROM t WHERE json_type(t) = 'ARRAY') SELECT DISTINCT page_id, t ->> '$' AS type FROM u",
)

# ---- audit -----------------------------------------------------------------------------------
_t, _d, _r = "trim(title)", "trim(meta_description)", "lower(meta_robots)"
_canon = D.resolved("canonical", "url")
_slash = lambda u: f"({D.origin(u)} || regexp_replace({D.pathname(u)}, '/$', ''))"
_slug = "coalesce(list_filter(str_split(pathname, '/'), lambda x: x <> '')[-1], '')"
_words = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]{{4,}}')"
#: id, category, severity, fails, applies; as SQL.
RULES_SQL = [
    ("title-missing", "meta", "'critical'", f"{_t} = ''", "true"),
    ("title-length", "meta", f"CASE WHEN length({_t}) < 20 OR length({_t}) > 70 THEN 'warning' ELSE 'notice' END", f"length({_t}) NOT BETWEEN 30 AND 60", f"{_t} <> ''"),
    ("description-missing", "meta", "'warning'", f"{_d} = ''", "true"),
    ("description-length", "meta", "'notice'", f"length({_d}) NOT BETWEEN 70 AND 165", f"{_d} <> ''"),
    ("noindex", "meta", "'critical'", f"contains({_r}, 'noindex')", "true"),
    ("meta-nofollow", "meta", "'warning'", f"contains({_r}, 'nofollow')", "true"),
    ("canonical-missing", "meta", "'warning'", "canonical = ''", "true"),
    ("canonical-mismatch", "meta", "'notice'", f"hostname <> '' AND coalesce({_slash(f'coalesce({_canon}, chr(32))')} <> {_slash('url')}, false)", "canonical <> '' AND url <> ''"),
    ("h1-missing", "structure", "'critical'", "h1_count = 0", "true"),
    ("h1-multiple", "structure", "'warning'", "h1_count > 1", "true"),
    ("heading-skip", "structure", "'notice'", "len(list_filter(range(2, len(headings) + 1), lambda i: headings[i].level - headings[i - 1].level > 1)) > 0", "true"),
    ("few-headings", "structure", "'notice'", "len(headings) < 3 AND word_count > 400", "true"),
    ("thin-content", "content", "CASE WHEN word_count < 150 THEN 'warning' ELSE 'notice' END", "word_count < 300", "true"),
    ("title-h1-mismatch", "content", "'notice'", f"{_t} <> '' AND f_h1 <> '' AND NOT list_has_any({_words('f_h1')}, {_words('title')})", "true"),
    ("img-alt", "media", "CASE WHEN missing_alt > 5 THEN 'warning' ELSE 'notice' END", "missing_alt > 0", "true"),
    ("img-dimensions", "media", "'notice'", "img_total > 3 AND no_dimensions > img_total * 0.5", "true"),
    ("img-lazy", "media", "'notice'", "img_total > 8 AND no_lazy > img_total * 0.7", "true"),
    ("few-internal-links", "links", "'warning'", "internal < 3", "true"),
    ("generic-anchors", "links", "'notice'", "false", "true"),
    ("empty-anchors", "links", "'notice'", "false", "true"),
    ("og-missing", "social", "'notice'", "og_title = '' OR og_description = ''", "true"),
    ("og-image", "social", "'notice'", "og_image = ''", "true"),
    ("schema-missing", "social", "'warning'", "page_id NOT IN (SELECT page_id FROM typed)", "true"),
    ("schema-invalid", "social", "'warning'", "false", "true"),
    ("no-https", "technical", "'critical'", "protocol = 'http:'", "true"),
    ("viewport", "technical", "'critical'", "viewport = ''", "true"),
    ("lang", "technical", "'notice'", "lang = ''", "true"),
    ("url-slug", "technical", "'notice'", f"length({_slug}) > 60 OR regexp_matches({_slug}, '[_A-Z]') OR regexp_matches({_slug}, '(?i)%[0-9a-f]{{2}}')", "true"),
    ("dom-size", "technical", "'notice'", "false", "true"),
]
#: Pages with a type in their JSON-LD, as rule 23 needs them.
TYPED = f"{LD}, n1 AS ({ENTER.format('b')}), g AS (SELECT page_id, json_extract(j, '$.\"@graph\"') AS j FROM n1 WHERE json_extract(j, '$.\"@graph\"') IS NOT NULL), n2 AS ({ENTER.format('g')}), typed AS (SELECT DISTINCT page_id FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) WHERE json_type(json_extract(j, '$.\"@type\"')) IN ('VARCHAR', 'ARRAY'))"
_cells = ", ".join(f"CASE WHEN {ap} THEN struct_pack(no := {i}, id := '{rid}', category := '{cat}', severity := {sev}, failed := {fails}) END" for i, (rid, cat, sev, fails, ap) in enumerate(RULES_SQL, 1))
OUTCOMES = f"{TYPED}, o0 AS (SELECT page_id, unnest([{_cells}]) AS r FROM rec), o AS (SELECT page_id, r.no AS rule_no, r.id AS rule_id, r.category AS category, r.severity AS severity, r.failed AS failed, CASE r.severity WHEN 'critical' THEN 5 WHEN 'warning' THEN 2 ELSE 1 END AS weight FROM o0 WHERE r IS NOT NULL)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "outcomes", lambda: audit.outcomes(records(spark, sf_dir)))


add("audit_outcomes", outcomes, f"WITH {D.RECORD}, {OUTCOMES} SELECT page_id, rule_no, rule_id, category, severity, failed, weight FROM o")
for _n, (_id, *_rest) in enumerate(RULES_SQL, 1):
    add(f"rule{_n}_{_id.replace('-', '_')}", lambda s, sf, i=_id: outcomes(s, sf).where(c("rule_id") == i).select("page_id", "severity", "failed"), f"WITH {D.RECORD}, {TYPED} SELECT page_id, {_rest[1]} AS severity, {_rest[2]} AS failed FROM rec WHERE {_rest[3]}")
# Rules that only a live document can fail, on counters of the whole source.
_generic = "(" + ", ".join(map(D.q, L.GENERIC_LABELS)) + ")"
DOM = {
    "generic_anchor": f"CAST(len(list_filter(links, lambda a: lower(a.label) IN {_generic})) AS INTEGER)", "empty_anchor": "CAST(len(list_filter(links, lambda a: a.label = '' AND NOT a.image)) AS INTEGER)",
    "invalid": "CAST(len(list_filter(blocks, lambda x: NOT json_valid(x))) AS INTEGER)", "dom_nodes": "CAST(len(regexp_extract_all(html, '<[a-zA-Z]')) AS INTEGER)",
}
DOM_PAGES = [
    (-101, "https://dom.example.org/", "<a href='/1'>click here</a><a href='/2'>Read More</a><a href='/3'>here</a><a href='/4'> LINK </a><a href='/5'></a><a href='/6'><img src=x></a><a href='/7'><img alt=y></a><script type='application/ld+json'>{broken</script><div itemtype='https://schema.org/Event/'></div>" + "<p>" * 2500),
    (-102, "https://dom.example.org/", "<a href='JavaScript:x()'></a><a href='javascript:x()'></a><script type='application/ld+json'>{\"@type\": \"Person\"}</script><script type='application/ld+json'>[1,</script>" + "<p>" * 2498 + "<meta property='description' content='by property'><meta name='description' content='by name'>"),
]


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the rules of live documents, of all pages and of two more that fail what only they can fail."""
    more = spark.createDataFrame(DOM_PAGES, "page_id long, url string, html string")
    return html.extract(pages(spark, sf_dir).unionByName(more), "dom")


_DOM = D.RECORD.replace("SELECT * FROM fix_html", "SELECT * FROM fix_html UNION ALL SELECT * FROM dom_html").replace("\nraw AS", "\n" + X.values(DOM_PAGES, "dom_html", ["page_id", "url", "html"]) + ",\nraw AS")
add("e21_anchor_labels_dom", lambda s, sf: live(s, sf).select("page_id", "links.empty_anchor", "links.generic_anchor"), f"WITH {_DOM} SELECT page_id, {DOM['empty_anchor']} AS empty_anchor, {DOM['generic_anchor']} AS generic_anchor FROM rec")
add("e22_microdata_dom", lambda s, sf: live(s, sf).select("page_id", F.array_join(F.array_sort("schema_types"), ",").alias("types"), c("invalid_json_ld").alias("invalid")),
    f"WITH {_DOM}, {TYPED.replace('typed AS (SELECT DISTINCT page_id FROM', 'ty AS (SELECT page_id, json_extract(j, chr(36) || chr(46) || chr(34) || chr(64) || chr(116) || chr(121) || chr(112) || chr(101) || chr(34)) AS t FROM')}, u AS (SELECT page_id, t ->> '$' AS v FROM ty WHERE json_type(t) = 'VARCHAR' UNION ALL SELECT page_id, unnest(CAST(t AS VARCHAR[])) FROM ty WHERE json_type(t) = 'ARRAY' UNION ALL SELECT page_id, list_filter(str_split(m, '/'), lambda x: x <> '')[-1] FROM (SELECT page_id, unnest(regexp_extract_all(clean, '(?is)itemtype\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS m FROM rec)), "
    f"w AS (SELECT page_id, string_agg(DISTINCT v, ',' ORDER BY v) AS types FROM u GROUP BY 1) SELECT rec.page_id, coalesce(types, '') AS types, {DOM['invalid']} AS invalid FROM rec LEFT JOIN w ON w.page_id = rec.page_id")  # fmt: skip
add("s1_page_record_dom", lambda s, sf: live(s, sf).select("page_id", "dom_nodes", "meta_description", "links.empty_anchor", "invalid_json_ld"),
    f"WITH {_DOM} SELECT page_id, {DOM['dom_nodes']} AS dom_nodes, CASE WHEN page_id = -102 THEN 'by name' ELSE meta_description END AS meta_description, {DOM['empty_anchor']} AS empty_anchor, {DOM['invalid']} AS invalid_json_ld FROM rec")
for _id, _what, _most in (("generic-anchors", "generic_anchor", 3), ("empty-anchors", "empty_anchor", 0), ("schema-invalid", "invalid", 0), ("dom-size", "dom_nodes", 2500)):
    add(f"dom_rule_{_id.replace('-', '_')}", lambda s, sf, i=_id: audit.outcomes(live(s, sf)).where(c("rule_id") == i).select("page_id", "failed"), f"WITH {_DOM} SELECT page_id, {DOM[_what]} > {_most} AS failed FROM rec")
SCORES = f"{OUTCOMES}, sc AS (SELECT page_id, CAST(sum(weight) AS BIGINT) AS total_weight, CAST(sum(CASE WHEN failed THEN weight ELSE 0 END) AS BIGINT) AS lost_weight, count(*) FILTER (failed AND severity = 'critical') AS critical, count(*) FILTER (failed AND severity = 'warning') AS warning, count(*) FILTER (failed AND severity = 'notice') AS notice, count(*) FILTER (NOT failed) AS passed FROM o GROUP BY 1), s AS (SELECT *, CAST(greatest(0, floor(100 - lost_weight / greatest(total_weight, 1) * 100 + 0.5)) AS INTEGER) AS score FROM sc)"
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END"
_score = lambda s, sf: audit.scores(outcomes(s, sf))
add("r30_score", lambda s, sf: _score(s, sf).select("page_id", "total_weight", "lost_weight", "score"), f"WITH {D.RECORD}, {SCORES} SELECT page_id, total_weight, lost_weight, score FROM s")
add("r31_counts", lambda s, sf: _score(s, sf).select("page_id", "critical", "warning", "notice", "passed"), f"WITH {D.RECORD}, {SCORES} SELECT page_id, critical, warning, notice, passed FROM s")
add("r32_findings", lambda s, sf: audit.findings(outcomes(s, sf)), f"WITH {D.RECORD}, {OUTCOMES} SELECT page_id, rule_id, category, severity, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule_no) AS INTEGER) AS position FROM o WHERE failed")
_dash = "→"
_texts = {
    "title_length": f"length({_t})", "description_length": f"length({_d})", "robots": "meta_robots", "canonical": "canonical", "h1_count": "h1_count", "word_count": "word_count", "headings": "len(headings)",
    "step": f"(SELECT coalesce(arg_min('H' || a || ' {_dash} H' || b, p), '') FROM (SELECT h.pos AS p, lag(h.h.level) OVER (ORDER BY h.pos) AS a, h.h.level AS b FROM (SELECT unnest(rec.headings) AS h, generate_subscripts(rec.headings, 1) AS pos) h) z WHERE b - a > 1)",
    "missing_alt": "missing_alt || CASE WHEN missing_alt = 1 THEN ' image' ELSE ' images' END", "no_dimensions": "no_dimensions", "img_total": "img_total", "internal": "internal", "generic": "'0'", "empty": "'0'", "invalid": "'0'", "dom_nodes": "'0'", "slug": _slug,
    "types": "coalesce((SELECT string_agg(type, ', ' ORDER BY first) FROM (SELECT type, min(at) AS first FROM types WHERE types.page_id = rec.page_id GROUP BY 1 ORDER BY 2 LIMIT 4)), '')",
}


def told(template: str) -> str:
    """A text with its values, as SQL."""
    parts = audit_text.WORD.split(template)
    return " || ".join(f"CAST({_texts[x]} AS VARCHAR)" if i % 2 else D.q(x) for i, x in enumerate(parts) if i % 2 or x)


def detail(rule_id: str) -> str:
    said = audit_text.TEXTS[rule_id][1]
    if isinstance(said, str):
        return told(said)
    return f"CASE WHEN length({_t if rule_id == 'title-length' else _d}) < {30 if rule_id == 'title-length' else 70} THEN {D.q(said[0])} ELSE {D.q(said[1])} END"


_h1s = "substr(array_to_string(list_transform(list_filter(headings, lambda h: h.level = 1), lambda h: h.text), ' | '), 1, 200)"
_value = {"title-length": _t, "description-length": _d, "h1-multiple": _h1s}
_no_types = {i for i in audit_text.TEXTS if "{types}" in "".join(map(str, audit_text.TEXTS[i]))}
_rows = ", ".join(
    f"CASE WHEN {ap} THEN struct_pack(no := {i}, id := '{rid}', category := '{cat}', severity := {sev}, failed := {fails}, title := {told(audit_text.TEXTS[rid][0])}, detail := {detail(rid)}, fix := {D.q(audit_text.TEXTS[rid][2])}, passed := {D.q('') if rid in _no_types else told(audit_text.TEXTS[rid][3])}, value := {_value.get(rid, 'CAST(NULL AS VARCHAR)')}) END"
    for i, (rid, cat, sev, fails, ap) in enumerate(RULES_SQL, 1)
)
TOLD = f"{TYPED}, t0 AS (SELECT page_id, unnest([{_rows}]) AS r FROM rec), t AS (SELECT page_id, r.* FROM t0 WHERE r IS NOT NULL)"
_rank = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
add("r32_finding_texts", lambda s, sf: audit.findings(audit.outcomes(records(s, sf), texts=True)), f"WITH {D.RECORD}, {TOLD} SELECT page_id, id AS rule_id, category, severity, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {_rank}, no) AS INTEGER) AS position, title, detail, fix, value FROM t WHERE failed")
add("r32_passed", lambda s, sf: audit.passes(audit.outcomes(records(s, sf), texts=True)).where("rule_id <> 'schema-missing'").select("page_id", "rule_id", "category", "label"), f"WITH {D.RECORD}, {TOLD} SELECT page_id, id AS rule_id, category, passed AS label FROM t WHERE NOT failed AND id <> 'schema-missing'")
add("r33_grade", lambda s, sf: _score(s, sf).select("page_id", "score", "grade"), f"WITH {D.RECORD}, {SCORES} SELECT page_id, score, {GRADE} AS grade FROM s")
_cat = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in audit.CATEGORIES.items()) + ") t(category, label)"
add("r34_categories", lambda s, sf: outcomes(s, sf).groupBy("category").agg(F.count_if("failed").alias("failed"), F.count("*").alias("n")).join(F.broadcast(s.createDataFrame(list(audit.CATEGORIES.items()), "category string, label string")), "category", "left"),
    f"WITH {D.RECORD}, {OUTCOMES} SELECT o.category, label, count(*) FILTER (failed) AS failed, count(*) AS n FROM o LEFT JOIN {_cat} ON o.category = t.category GROUP BY ALL")
add("g10_count_per_severity", lambda s, sf: outcomes(s, sf).where("failed").groupBy("severity").count().withColumnRenamed("count", "n"), f"WITH {D.RECORD}, {OUTCOMES} SELECT severity, count(*) AS n FROM o WHERE failed GROUP BY 1")
add("s13_report_findings", lambda s, sf: audit.findings(outcomes(s, sf)).where("position <= 8").select("page_id", "position", "rule_id"), f"WITH {D.RECORD}, {OUTCOMES}, f AS (SELECT page_id, rule_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, rule_no) AS INTEGER) AS position FROM o WHERE failed) SELECT page_id, position, rule_id FROM f WHERE position <= 8")

# ---- addresses -------------------------------------------------------------------------------
_ADDR = X.values(list(enumerate(X.ADDRESSES)), "a0", ["pos", "raw"]) + ", a AS (SELECT * FROM a0 UNION ALL SELECT 1000 + page_id, url FROM pages)"
_trim = D.replace("coalesce(raw, '')", f"^{L.BLANK}+|{L.BLANK}+$", "")
_full = f"(CASE WHEN regexp_matches({_trim}, '(?i)^https?://') THEN {_trim} ELSE 'https://' || {_trim} END)"
_PRIVATE = D.q(U.PRIVATE)


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.read.parquet(f"{sf_dir}/pages.parquet").select((c("page_id") + 1000).alias("pos"), c("url").alias("raw"))
    return X.addresses(spark).union(more)


def address(name: str, make, select: str) -> None:
    add(name, lambda s, sf: addresses(s, sf).select("pos", make(c("raw")).alias("value")), f"WITH {_ADDR}, u AS (SELECT *, {_full} AS u FROM a) SELECT pos, {select} AS value FROM u")


address("u1_normalize", U.normalized, f"CASE WHEN {_trim} <> '' AND contains({D.host('u')}, '.') AND NOT regexp_matches({D.host('u')}, '\\s') THEN {D.origin('u')} || {D.pathname('u')} || regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1) END")
address("u2_normalize_strict", U.normalized_strict, f"CASE WHEN {_trim} <> '' AND {D.host('u')} <> '' AND NOT regexp_matches(u, '(?i)^https?://[^/?#]*@') AND NOT regexp_matches({D.host('u')}, {_PRIVATE}) THEN {D.origin('u')} || {D.pathname('u')} || regexp_extract(u, '^[^?#]*([?#].*)', 1) END")
address("u3_private_host", lambda r: U.is_private_host(U.hostname(U.with_scheme(r))), f"regexp_matches({D.host('u')}, {_PRIVATE})")
address("u4_display", U.display, f"CASE WHEN {D.host('raw')} = '' THEN raw ELSE regexp_replace({D.host('raw')} || {D.port('raw')}, '^www\\.', '') || CASE WHEN {D.pathname('raw')} = '/' THEN '' ELSE {D.pathname('raw')} END END")
address("u5_protocol", U.protocol, D.protocol("raw"))
address("u5_hostname", U.hostname, D.host("raw"))
address("u5_pathname", U.pathname, D.pathname("raw"))
address("u5_origin", U.origin, D.origin("raw"))
HREFS = [
    ("http://base.org/dir/page?q", "", "http://base.org/dir/page"), ("http://base.org/dir/page?q", "?b=1", "http://base.org/dir/page?b=1"), ("http://base.org/dir/page", "#x", "http://base.org/dir/page#x"),
    ("http://base.org/dir/page", "./y", "http://base.org/dir/y"), ("http://base.org/dir/page", "../x/y", "http://base.org/x/y"), ("http://base.org/dir/page", "../../../z?a=../b", "http://base.org/z?a=../b"),
    ("http://base.org/dir/page", "/a/./b/../c/..", "http://base.org/a/"), ("http://base.org/dir/page", "a/%2E%2e/b/.", "http://base.org/dir/b/"), ("https://base.org:8443/dir/", "//cdn.org/./x", "https://cdn.org/x"),
    ("http://base.org", "page", "http://base.org/page"), ("http://base.org/a", "mailto:x@y.z", None), ("http://base.org/a", "HTTPS://o.org/b/../c", "https://o.org/c"),
]
add("u6_resolve", lambda s, sf: s.createDataFrame([(i, b, h) for i, (b, h, _) in enumerate(HREFS)], "pos int, base string, href string").select("pos", U.resolved(c("href"), c("base")).alias("value")),
    f"WITH {X.values([(i, v) for i, (_, _, v) in enumerate(HREFS)], 'h', ['pos', 'value'])} SELECT pos, value FROM h")
#: address, public form, public and strict form, whether it is private; what a browser's parser gives, stated as values.
FORMS = [
    ("http://[::1]/x", None, None, True), ("http://[0:0:0:0:0:0:0:1]/", None, None, True), ("http://2130706433/", "http://127.0.0.1/", None, True), ("http://0x7f.1/a", "http://127.0.0.1/a", None, True),
    ("http://017700000001/", "http://127.0.0.1/", None, True), ("192.168.257", "https://192.168.1.1/", None, True), ("http://8.8.8.8/", "http://8.8.8.8/", "http://8.8.8.8/", False), ("http://134744072/?q", "http://8.8.8.8/?q", "http://8.8.8.8/?q", False),
    ("http://1.2.3.4.5/", None, None, False), ("http://256.1.1.1/", None, None, False), ("http://1.2.3.08/", None, None, False), ("http://[2001:db8::1]:8080/a", None, "http://[2001:db8::1]:8080/a", False), ("http://a.org/b/../c#d", "http://a.org/c", "http://a.org/c#d", False),
    ("http://172.16.0.1", "http://172.16.0.1/", None, True), ("http://172.32.0.1", "http://172.32.0.1/", "http://172.32.0.1/", False), ("http://printer.local/", "http://printer.local/", None, True),
]
add("u3_address_forms", lambda s, sf: s.createDataFrame([(i, f[0]) for i, f in enumerate(FORMS)], "pos int, raw string").select("pos", U.normalized(c("raw")).alias("public"), U.normalized_strict(c("raw")).alias("strict"), U.is_private_host(U.hostname(U.with_scheme(c("raw")))).alias("private")),
    f"WITH {X.values([(i, *f[1:]) for i, f in enumerate(FORMS)], 'f', ['pos', 'public', 'strict', 'private'])} SELECT pos, public, strict, private FROM f")
CANONICALS = [("https://a.org/x/y", "./y", True), ("https://a.org/x/y/", "../y", True), ("https://a.org/y", "?b=1", True), ("https://a.org/y", "/z/../y/", True), ("https://a.org/y", "../x/y", False), ("https://a.org/y", "https://A.org:443/y", True), ("https://a.org/y", "http://a.org/y", False)]
add("u8_canonical_forms", lambda s, sf: s.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(CANONICALS)], "pos int, url string, href string").select("pos", (U.without_slash(U.resolved(c("href"), c("url"))) == U.without_slash(c("url"))).alias("same")),
    f"WITH {X.values([(i, same) for i, (_, _, same) in enumerate(CANONICALS)], 'k', ['pos', 'same'])} SELECT pos, same FROM k")
address("u7_slug", lambda r: U.slug(U.pathname(r)), f"coalesce(list_filter(str_split({D.pathname('raw')}, '/'), lambda x: x <> '')[-1], '')")
record("u8_canonical_compare", lambda: {"same": U.without_slash(U.resolved(c("canonical"), c("url"))) == U.without_slash(c("url"))}, f"{_slash(_canon)} = {_slash('url')} AS same")
address("u9_scannable", lambda r: F.rlike(r, F.lit("^https?://")), "regexp_matches(raw, '^https?://')")
# Fixed pattern of hosts that are no competitors.
IGNORED = r"(?i)(google|facebook|twitter|x\.com|instagram|linkedin|youtube|tiktok|pinterest|reddit|github|gstatic|googleapis|cloudflare|amazonaws|cdn|fonts|wp\.com|gravatar|doubleclick|shopify|wixstatic|squarespace|vimeo|apple\.com|microsoft\.com|adobe\.com|paypal|stripe)"
address("u10_ignored_host", lambda r: F.rlike(r, F.lit(IGNORED)), f"regexp_matches(raw, {D.q(IGNORED)})")


def loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses matched to pages by url, else by host and path (the smallest page id of several)."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", U.hostname(c("url")).alias("h"), U.pathname(c("url")).alias("p"))
    a = addresses(spark, sf_dir).select("pos", F.regexp_replace("raw", "[?#].*$", "").alias("raw"))
    exact = p.groupBy("url").agg(F.min("page_id").alias("exact")).withColumnRenamed("url", "raw")
    near = p.where("h <> ''").groupBy("h", "p").agg(F.min("page_id").alias("near"))
    a = a.withColumns({"h": U.hostname(c("raw")), "p": U.pathname(c("raw"))})
    return a.join(exact, "raw", "left").join(near, ["h", "p"], "left").select("pos", F.coalesce("exact", "near", F.lit(-1)).alias("page_id"))


_LOOSE = f"WITH {_ADDR}, x AS (SELECT pos, regexp_replace(raw, '[?#].*$', '') AS raw FROM a), p AS (SELECT page_id, url, {D.host('url')} AS h, {D.pathname('url')} AS p FROM pages), e AS (SELECT url, min(page_id) AS exact FROM p GROUP BY 1), n AS (SELECT h, p, min(page_id) AS near FROM p WHERE h <> '' GROUP BY 1, 2) SELECT pos, coalesce(exact, near, -1) AS page_id FROM x LEFT JOIN e ON x.raw = e.url LEFT JOIN n ON n.h = {D.host('x.raw')} AND n.p = {D.pathname('x.raw')}"
add("u11_find_loose", loose, _LOOSE)
add("j12_equi_join_with_fallback", loose, _LOOSE)
add("j15_shared_words", lambda s, sf: records(s, sf).select("page_id", audit.shared_word(c("fields.h1"), c("title")).alias("shared")), D.from_rec(f"page_id, list_has_any({_words('f_h1')}, {_words('title')}) AS shared"))
QUERIES["u_2_intersect"], ORACLES["u_2_intersect"] = QUERIES["j15_shared_words"], ORACLES["j15_shared_words"]


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six hosts that a page links to and that are neither ignored, known, nor its own."""
    r = records(spark, sf_dir).select("page_id", "hostname", F.posexplode("links.external_hosts").alias("pos", "x")).select("page_id", "hostname", "pos", "x.host")
    known = addresses(spark, sf_dir).where("pos < 20").select(U.hostname(c("raw")).alias("host")).where("host <> ''").distinct()
    r = r.where(~F.rlike("host", F.lit(IGNORED)) & (c("host") != c("hostname"))).join(F.broadcast(known), "host", "left_anti")
    from pyspark.sql import Window

    return r.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("rank <= 6").select("page_id", "rank", "host")


_SUGGEST = f"WITH {D.RECORD}, {EXTERNAL}, {_ADDR}, kn AS (SELECT DISTINCT {D.host('raw')} AS host FROM a WHERE pos < 20), f AS (SELECT page_id, rank, host FROM r WHERE rank <= 40 AND NOT regexp_matches(host, {D.q(IGNORED)}) AND host NOT IN (SELECT host FROM kn)), z AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rank) AS INTEGER) AS rank, host FROM f) SELECT * FROM z WHERE rank <= 6"
for _name in ("p5_suggestions", "j13_anti_join", "u_3_except"):
    add(_name, suggestions, _SUGGEST)
