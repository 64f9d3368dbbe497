"""Queries over small literal tables (fetch logs, caches, replies, scores) and whole test tables, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import urls as U
from pagelens.operators import audit, enrich, present
from pagelens.plans import duck as D
from pagelens.plans import fixtures as X
from pagelens.plans.page_queries import addresses
from pagelens.sources import cache, fetch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
c, q = F.col, D.q


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# ---- fetching and the page cache --------------------------------------------------------------
LOG = [
    (0, "a.org", False, True, None, 200, "text/html", "T", 100), (1, "https://a.org/#x", True, True, None, None, None, "", 0), (2, "b.org", False, False, None, None, None, "", 0), (3, "c.org", False, True, "AbortError", None, None, "", 0),
    (4, "d.org", False, True, "TypeError", None, None, "", 0), (5, "e.org", False, True, None, 404, "text/html", "", 0), (6, "f.org", False, True, None, 200, "application/pdf", "", 0), (7, "g.org", False, True, None, 200, None, "", 19),
    (8, "h.org", False, True, None, 200, "application/xhtml+xml; x", "", 20), (9, "A.org", False, True, None, 299, "TEXT/HTML", "x", 1), (10, "nodot", False, True, None, 200, "text/html", "x", 1), (11, " b.org ", False, True, None, 301, "text/html", "x", 1),
]
_LOGC = ["pos", "raw_url", "cached", "has_permission", "error_name", "status", "content_type", "title", "word_count"]
_LOGS = "pos int, raw_url string, cached boolean, has_permission boolean, error_name string, status int, content_type string, title string, word_count int"
_LOG = X.values(LOG, "lg", _LOGC)
_log = lambda s: s.createDataFrame(LOG, _LOGS)
_full = f"(CASE WHEN regexp_matches(trim(raw_url), '(?i)^https?://') THEN trim(raw_url) ELSE 'https://' || trim(raw_url) END)"
_norm = f"CASE WHEN contains({D.host('u')}, '.') THEN {D.origin('u')} || {D.pathname('u')} || regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1) END"
add("s4_competitor_fetch_list", lambda s, sf: cache.to_fetch(_log(s)).select("pos", "url"), f"WITH {_LOG}, l AS (SELECT *, {_full} AS u FROM lg), n AS (SELECT pos, {_norm} AS url FROM l) SELECT pos, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS r FROM n WHERE url IS NOT NULL) WHERE r = 1")
add("s5_fetch_outcome", lambda s, sf: cache.outcome(_log(s)).select("pos", "code"), f"WITH {_LOG} SELECT pos, CASE WHEN cached THEN 'CACHED' WHEN NOT has_permission THEN 'PERMISSION' WHEN error_name = 'AbortError' THEN 'TIMEOUT' WHEN error_name IS NOT NULL THEN 'NETWORK' WHEN status NOT BETWEEN 200 AND 299 THEN 'HTTP' WHEN content_type <> '' AND NOT regexp_matches(content_type, '(?i)text/html|application/xhtml') THEN 'TYPE' WHEN title = '' AND word_count < 20 THEN 'EMPTY' ELSE 'OK' END AS code FROM lg")
RESPONSES = [(0, 200, "text/html; charset=utf-8", 100, 100), (1, 404, "text/html", 1, 1), (2, 200, "application/pdf", 1, 1), (3, 200, "text/html", 2_000_001, 1), (4, 200, "application/xhtml+xml", 0, 2_000_001), (5, 200, None, 0, 5), (6, 204, "text/html", 0, 2_000_000)]
add("s3_safe_fetch_checks", lambda s, sf: s.createDataFrame(RESPONSES, "pos int, status int, content_type string, declared long, bytes long").select("pos", fetch.verdict(c("status"), c("content_type"), c("declared"), c("bytes")).alias("verdict")), f"WITH {X.values(RESPONSES, 'rs', ['pos', 'status', 'content_type', 'declared', 'bytes'])} SELECT pos, CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'HTTP' WHEN NOT regexp_matches(coalesce(content_type, ''), 'text/html|application/xhtml\\+xml') THEN 'TYPE' WHEN declared > 2000000 OR bytes > 2000000 THEN 'SIZE' ELSE 'OK' END AS verdict FROM rs")
add("s6_read_capped", lambda s, sf: s.read.parquet(f"{sf}/pages.parquet").select("page_id", F.length(fetch.capped(c("html"))).cast("long").alias("n")), f"SELECT page_id, length(substr(html, 1, {fetch.CAP})) AS n FROM pages")
CACHE = [(f"https://{x}.org/", f"2024-01-01 {h}") for x, h in zip("abcdefg", ("00:00:00", "06:00:00", "05:59:59", "06:00:01", "11:00:00", "03:00:00", "12:00:00"), strict=True)]
_CACHE = X.values(CACHE, "ch0", ["url", "t"]) + ", ch AS (SELECT url, CAST(t AS TIMESTAMP) AS saved_at FROM ch0)"
_cache = lambda s: s.createDataFrame(CACHE, "url string, t string").select("url", F.to_timestamp_ntz("t").alias("saved_at"))
add("s7_fresh_cache", lambda s, sf: cache.fresh(_cache(s), F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))).select("url"), f"WITH {_CACHE} SELECT url FROM ch WHERE saved_at >= TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 6 HOUR")
add("s8_prune_cache", lambda s, sf: cache.pruned(_cache(s)).select("url"), f"WITH {_CACHE} SELECT url FROM (SELECT url, row_number() OVER (ORDER BY saved_at, url) AS r, count(*) OVER () AS n FROM ch) WHERE r > ceil(n / 2)")
add("s9_clear_cache", lambda s, sf: cache.cleared(_cache(s), "https://a").select("url"), f"WITH {_CACHE} SELECT url FROM ch WHERE url NOT LIKE 'https://a%'")
add("s10_last_scan", lambda s, sf: s.read.parquet(f"{sf}/pages.parquet").groupBy("url").agg(F.max("page_id").alias("page_id")), "SELECT url, max(page_id) AS page_id FROM pages GROUP BY 1")
INPUTS = [(0, "a.org\n b.org ,c.org,,\n"), (1, ""), (2, " , "), (3, "x.org")]
add("s14_split_inputs", lambda s, sf: s.createDataFrame(INPUTS, "pos int, raw string").select("pos", F.posexplode(cache.split_inputs(c("raw"))).alias("i", "url")), f"WITH {X.values(INPUTS, 'inp', ['pos', 'raw'])}, l AS (SELECT pos, list_filter(list_transform(regexp_split_to_array(raw, '[\\n,]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM inp) SELECT pos, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS i, unnest(l) AS url FROM l")

# ---- presentation -----------------------------------------------------------------------------
_scores = lambda s, sf: s.range(0, 101).select(c("id").cast("int").alias("score"))
_SC = "sc AS (SELECT CAST(unnest(range(0, 101)) AS INTEGER) AS score)"
_tone = "CASE WHEN score >= 80 THEN 'ok' WHEN score >= {0} THEN 'warning' ELSE 'critical' END"
add("p9_headline_and_tone", lambda s, sf: _scores(s, sf).select("score", present.headline(c("score")).alias("headline"), present.tone(c("score")).alias("ring"), present.tone(c("score"), 80, 55).alias("web"), audit.grade(c("score")).alias("grade")), f"WITH {_SC} SELECT score, CASE WHEN score >= 90 THEN 'Strong on-page SEO' WHEN score >= 75 THEN 'Solid, with room to improve' WHEN score >= 60 THEN 'Needs work' ELSE 'Significant issues' END AS headline, {_tone.format(60)} AS ring, {_tone.format(55)} AS web, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM sc")
AS_OF = "2024-06-01 00:00:00"
_secs = lambda: F.timestamp_diff("SECOND", c("ts"), F.to_timestamp_ntz(F.lit(AS_OF)))
add("p11_relative_time", lambda s, sf: s.read.parquet(f"{sf}/events.parquet").select("event_id", present.ago(_secs()).alias("ago")), f"WITH e AS (SELECT event_id, CAST(trunc(epoch_us(TIMESTAMP '{AS_OF}' - ts) / 1000000.0) AS BIGINT) AS s FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)) SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS ago FROM e")


def guard(s: SparkSession, sf_dir: str) -> DataFrame:
    """What happens when each address is added to a list of two on the site example.com."""
    n = U.normalized(c("raw"))
    known = ["https://www.site.org/", "https://nothing.org/"]
    out = F.when(U.trimmed(c("raw")) == "", "ignored").when(n.isNull(), "invalid").when(n.isin(known), "duplicate").when(n.startswith("https://example.com"), "own site").otherwise("added")
    return addresses(s, sf_dir).select("pos", out.alias("outcome"))


_A = X.values(list(enumerate(X.ADDRESSES)), "a0", ["pos", "raw"]) + ", a AS (SELECT * FROM a0 UNION ALL SELECT 1000 + page_id, url FROM pages)"
_an = f"(CASE WHEN regexp_matches(trim(raw), '(?i)^https?://') THEN trim(raw) ELSE 'https://' || trim(raw) END)"
add("p6_add_guard", guard, f"WITH {_A}, u AS (SELECT *, {_an} AS u FROM a), n AS (SELECT pos, raw, CASE WHEN contains({D.host('u')}, '.') AND NOT regexp_matches({D.host('u')}, '\\s') THEN {D.origin('u')} || {D.pathname('u')} || regexp_extract(u, '^[^?#]*(\\?[^#]*)', 1) END AS n FROM u) SELECT pos, CASE WHEN trim(raw) = '' THEN 'ignored' WHEN n IS NULL THEN 'invalid' WHEN n IN ('https://www.site.org/', 'https://nothing.org/') THEN 'duplicate' WHEN n LIKE 'https://example.com%' THEN 'own site' ELSE 'added' END AS outcome FROM n")
#: provider, status, thrown, code, detail, header; expected action, message, seconds. The values are stated, not computed.
CALLS = [
    (("managed", None, "NoKey", None, None, None), ("choose_provider", "OpenAI is not configured for this deployment.", 0.0)),
    (("openai", None, "NoKey", None, None, None), ("replace_key", "Enter an OpenAI API key.", 0.0)),
    (("managed", None, "TypeError", None, "fetch failed", None), ("choose_provider", "fetch failed", 0.0)),
    (("openai", None, "TypeError", None, "fetch failed", None), ("retry", "fetch failed", 0.0)),
    (("openai", 401, None, None, "x", None), ("replace_key", "That OpenAI API key is invalid. Check it and try again.", 0.0)),
    (("managed", 403, None, None, None, None), ("permissions", "This OpenAI key does not have permission to use the requested model.", 0.0)),
    (("openai", 429, None, None, None, "7"), ("wait", "OpenAI is rate limited. Wait a moment and try again.", 20.0)),
    (("openai", 500, None, None, None, None), ("retry", "OpenAI returned HTTP 500.", 0.0)),
    (("openai", 418, None, None, "teapot", None), ("retry", "teapot", 0.0)),
    (("groq", None, "TimeoutError", None, None, None), ("retry", "Groq took too long to respond. Wait a moment and try again.", 0.0)),
    (("groq", None, "TypeError", None, None, None), ("retry", "Groq could not be reached. Check your connection and try again.", 0.0)),
    (("groq", 401, None, None, None, None), ("replace_key", "That Groq API key is invalid. Check it and enter it again.", 0.0)),
    (("groq", 403, None, None, None, None), ("permissions", "This Groq key cannot use the selected model. Check the key’s project permissions.", 0.0)),
    (("groq", 429, None, None, None, None), ("wait", "Groq’s free limit is busy. Wait 10 seconds, then try again.", 10.0)),
    (("groq", 429, None, None, None, "90"), ("wait", "Groq’s free limit is busy. Wait 60 seconds, then try again.", 60.0)),
    (("groq", 429, None, None, None, "0"), ("wait", "Groq’s free limit is busy. Wait 1 seconds, then try again.", 1.0)),
    (("groq", 400, None, "blocked_api_access", None, None), ("billing", "Groq blocked API access because of an account or spending limit. Check Groq Billing and Limits.", 0.0)),
    (("groq", 400, None, "other", None, None), ("replace_key", "Groq rejected this request. Check the key and try again.", 0.0)),
    (("groq", 503, None, None, None, None), ("wait", "Groq is temporarily unavailable. Wait a minute and try again.", 60.0)),
    (("claude", None, "NoKey", None, None, None), ("replace_key", "Enter a valid Claude API key.", 0.0)),
    (("claude", 400, None, None, "Your credit balance is low", None), ("billing", "Claude needs available API credits. Check Billing in Claude Console.", 0.0)),
    (("claude", 400, None, None, "bad request", None), ("retry", "bad request", 0.0)),
    (("claude", 403, None, None, None, None), ("permissions", "This Claude key does not have permission to use Sonnet or web search.", 0.0)),
    (("claude", 429, None, None, None, None), ("wait", "Claude is rate limited. Wait a moment and try again.", 20.0)),
    (("claude", 529, None, None, None, None), ("retry", "Claude returned HTTP 529.", 0.0)),
    (("claude", 200, None, None, None, None), (None, None, 0.0)),
]
_CALL = "pos int, provider string, status int, error string, code string, detail string, retry_after_header string"
_calls = lambda s: enrich.failure(s.createDataFrame([(i, *x) for i, (x, _) in enumerate(CALLS)], _CALL))
_said = X.values([(i, *x) for i, (_, x) in enumerate(CALLS)], "w", ["pos", "action", "message", "retry_after"])
add("l7_error_class", lambda s, sf: _calls(s).select("pos", "action", "message", "retry_after"), f"WITH {_said} SELECT pos, action, message, CAST(retry_after AS DOUBLE) AS retry_after FROM w")
TOLD = [
    ("choose_provider", 0.0, "Built-in OpenAI is unavailable", "Choose OpenAI, Groq, or Claude and provide your own API key."), ("replace_key", 0.0, "Check your API key", "The provider rejected this key. Copy a valid key from its official console and try again."),
    ("permissions", 0.0, "Provider permission required", "Check that the key can use the selected model and web search, then retry."), ("billing", 0.0, "Check provider billing", "Restore API credits or raise the provider limit, then retry."),
    ("wait", 20.0, "Provider is rate limited", "Wait 20 seconds before trying again."), ("wait", 0.0, "Provider is rate limited", "Wait 10 seconds before trying again."), ("wait", None, "Provider is rate limited", "Wait 10 seconds before trying again."),
    ("retry", 0.0, "Temporary provider failure", "Wait a moment, check your connection, and try again."), ("unknown", 0.0, "Temporary provider failure", "Wait a moment, check your connection, and try again."), (None, None, "Temporary provider failure", "Wait a moment, check your connection, and try again."),
]
add("p14_action_lookup", lambda s, sf: s.createDataFrame([(i, *x[:2]) for i, x in enumerate(TOLD)], "pos int, action string, retry_after double").withColumn("a", enrich.advice(c("action"), c("retry_after"))).select("pos", "a.*"),
    f"WITH {X.values([(i, *x[2:]) for i, x in enumerate(TOLD)], 't', ['pos', 'heading', 'instruction'])} SELECT pos, heading, instruction FROM t")

# ---- replies of a model -----------------------------------------------------------------------
REPLIES = [(0, 'Sure! {"a": 1, "b": {"c": 2}} done'), (1, "none"), (2, "} {"), (3, '{"a": }'), (4, '{"k": "}"}'), (5, "")]
_part = "CASE WHEN strpos(reply, '{') > 0 AND strpos(reply, '}') > 0 AND length(reply) - strpos(reverse(reply), '}') + 1 > strpos(reply, '{') THEN substr(reply, strpos(reply, '{'), length(reply) - strpos(reverse(reply), '}') + 2 - strpos(reply, '{')) END"
add("l2_json_part", lambda s, sf: s.createDataFrame(REPLIES, "pos int, reply string").select("pos", enrich.json_part(c("reply")).alias("part")), f"WITH {X.values(REPLIES, 'rp', ['pos', 'reply'])} SELECT pos, CASE WHEN json_valid(p) THEN p END AS part FROM (SELECT pos, {_part} AS p FROM rp)")
_page = lambda sf_cols: F.struct(c("source").alias("url"), c("lang").alias("title"), F.lit(None).cast("string").alias("meta_description"), F.lit("One").alias("h1"), F.lit("Two. Three").alias("h2"), c("text").alias("body"))
_told = lambda most: f"'Target URL: ' || coalesce(source, '') || chr(10) || 'Title: ' || coalesce(lang, '') || chr(10) || 'Meta description: ' || chr(10) || 'H1: One' || chr(10) || 'H2s: Two. Three' || chr(10) || 'Page text: ' || substr(coalesce(text, ''), 1, {most}) || chr(10) || 'Algorithmic keyword candidates: x, y' || chr(10) || 'Manual competitor URLs: '"
for _name, _most, _rivals in (("l1_prompt", 7000, []), ("l1_prompt_long", 20_000, ["https://a.org/", "https://b.org/"])):
    add(_name, lambda s, sf, m=_most, r=_rivals: s.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(enrich.prompt(_page(sf), F.array(F.lit("x"), F.lit("y")), F.array(*map(F.lit, r)).cast("array<string>"), m).cast("binary")).alias("h")),
        f"SELECT doc_id, md5({_told(_most)} || {q(', '.join(_rivals) or 'none')}) AS h FROM documents")
add("l3_reply_text", lambda s, sf: s.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", c("role").alias("type"), "text"))).alias("p")).select("conv_id", F.md5(enrich.reply_text(F.lit(None).cast("string"), c("p"), "assistant").cast("binary")).alias("h")),
    "SELECT conv_id, md5(coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS h FROM conversations GROUP BY 1")
COMP = [("https://own.org/", i, u) for i, u in enumerate(["https://a.org", "own.org/x", "http://localhost/", "b.org/", "https://A.org/2", "c.org", "d.org", "https://u:p@e.org", "f.org", "g.org"])]
_COMP = X.values(COMP, "cm", ["page_url", "pos", "url"])
_cu = "(CASE WHEN regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) ELSE 'https://' || trim(url) END)"
_cn = f"cn AS (SELECT page_url, pos, u, {D.host('u')} AS host, {D.host('u')} <> '' AND NOT regexp_matches(u, '(?i)^https?://[^/?#]*@') AND NOT regexp_matches({D.host('u')}, {q(U.PRIVATE)}) AND {D.host('u')} <> {D.host('page_url')} AS fine, row_number() OVER (PARTITION BY page_url ORDER BY pos) AS r FROM (SELECT *, {_cu} AS u FROM cm))"
_out = f"page_url, pos, {D.origin('u')} || {D.pathname('u')} AS norm"
_comp = lambda s: s.createDataFrame(COMP, "page_url string, pos int, url string")
add("l4_valid_competitors", lambda s, sf: enrich.valid_competitors(_comp(s)).select("page_url", "pos", "norm"), f"WITH {_COMP}, {_cn} SELECT {_out} FROM cn WHERE r <= 5 AND fine")
add("l5_distinct_competitors", lambda s, sf: enrich.valid_competitors(_comp(s), slice_first=False).select("page_url", "pos", "norm"), f"WITH {_COMP}, {_cn}, d AS (SELECT *, row_number() OVER (PARTITION BY page_url, host ORDER BY pos) AS k FROM cn WHERE fine), z AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY pos) AS m FROM d WHERE k = 1) SELECT {_out} FROM z WHERE m <= 5")
TERMS = [("p", i, t) for i, t in enumerate([" Blue Widgets ", "blue widgets", "", "  ", None, "GREEN tea", "green\ttea", "Green Tea\n", *(f"t{k}" for k in range(14))])]
KEPT = [("p", 0, "blue widgets"), ("p", 5, "green tea"), ("p", 6, "green\ttea"), *(("p", 8 + k, f"t{k}") for k in range(9))]
add("l5_distinct_terms", lambda s, sf: enrich.first_terms(s.createDataFrame(TERMS, "page_url string, pos int, term string")).select("page_url", "pos", "term"), f"WITH {X.values(KEPT, 'k', ['page_url', 'pos', 'term'])} SELECT page_url, pos, term FROM k")
add("l5_distinct_terms_of_parts", lambda s, sf: enrich.first_terms(s.read.parquet(f"{sf}/part.parquet").select(c("p_brand").alias("page_url"), c("p_partkey").alias("pos"), c("p_type").alias("term"))).select("page_url", "pos", "term"),
    "SELECT page_url, pos, term FROM (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY pos) AS k FROM (SELECT p_brand AS page_url, lower(trim(p_type)) AS term, min(p_partkey) AS pos FROM part GROUP BY 1, 2)) WHERE k <= 12")
HEADERS = [("5", 5.0, 5.0), ("0", 1.0, 1.0), ("90", 15.0, 60.0), (None, 3.0, 10.0), ("", 3.0, 10.0), ("2.5", 2.5, 2.5), ("15", 15.0, 15.0)]
add("l6_retry_delay", lambda s, sf: s.createDataFrame([(i, h) for i, (h, _, _) in enumerate(HEADERS)], "pos int, header string").select("pos", enrich.retry_delay(c("header")).alias("delay"), enrich.seconds_to_wait(c("header"), 60, 10).alias("told")),
    f"WITH {X.values([(i, a, b) for i, (_, a, b) in enumerate(HEADERS)], 'h', ['pos', 'delay', 'told'])} SELECT pos, CAST(delay AS DOUBLE) AS delay, CAST(told AS DOUBLE) AS told FROM h")
WANTED = [("managed", "managed"), ("openai", "openai"), ("groq", "groq"), ("claude", "claude"), ("gemini", "managed"), (None, "managed"), ("", "managed"), ("OpenAI", "managed")]
add("l8_provider", lambda s, sf: s.createDataFrame([(i, w) for i, (w, _) in enumerate(WANTED)], "pos int, wanted string").select("pos", enrich.provider(c("wanted")).alias("provider")),
    f"WITH {X.values([(i, p) for i, (_, p) in enumerate(WANTED)], 'v', ['pos', 'provider'])} SELECT pos, provider FROM v")
def shouted(prompt: str) -> str:
    if not prompt:
        raise ValueError("no prompt")
    return prompt.upper()


add("s15_enrichment_callback", lambda s, sf: enrich.enriched(s.createDataFrame(REPLIES, "pos int, prompt string"), shouted).select("pos", "reply", "error"), f"WITH {X.values(REPLIES, 'rp', ['pos', 'prompt'])} SELECT pos, CASE WHEN prompt <> '' THEN upper(prompt) END AS reply, CASE WHEN prompt = '' THEN 'ValueError: no prompt' END AS error FROM rp")
