"""HTML to page records, row by row in native expressions.

Elements are found by regular expressions in document order; nothing explodes, so a page never
leaves its row and the raw html is dropped by the last projection. mode="dom" adds the counters
that a live document would give (empty and generic anchors, invalid JSON-LD, element count,
microdata types), approximated from the source, and follows its rules: no limits on headings and
links, named meta tags before those with a property, schemes compared as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens import lexicon as L
from pagelens.functions import text as T
from pagelens.functions import urls as U

LD_JSON = f"""(?is)<script{T.EDGE}[^>]*type{L.BLANK}*={L.BLANK}*["']application/ld\\+json["'][^>]*>(.*?)</script{L.BLANK}*>"""


def every(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def title(clean: Column) -> Column:
    closed, loose = f"(?is)<title[^>]*>(.*?)</title{L.BLANK}*>", "(?is)<title[^>]*>([^<]*)"
    return T.strip_tags(F.when(F.rlike(clean, F.lit(closed)), F.regexp_extract(clean, closed, 1)).otherwise(F.regexp_extract(clean, loose, 1)))


def bags(clean: Column, tag: str) -> Column:
    """Attributes of each such tag, in document order."""
    return F.transform(every(clean, f"(?is)<{tag}{T.EDGE}([^>]*)>"), T.attributes)


def meta(metas: Column, key: str, dom: bool = False) -> Column:
    """Content of the first tag of that name or property; in a live document names come before properties."""
    named = lambda b, a: F.coalesce(F.lower(T.attribute(b, a)) == key, F.lit(False))
    first = lambda test: F.get(F.filter(metas, test), F.lit(0))
    hit = F.coalesce(first(lambda b: named(b, "name")), first(lambda b: named(b, "property"))) if dom else first(lambda b: named(b, "name") | named(b, "property"))
    return F.coalesce(T.attribute(hit, "content"), F.lit(""))


def link_rel(links: Column, rel: str) -> Column:
    has = lambda b: F.array_contains(F.split(F.lower(F.coalesce(T.attribute(b, "rel"), F.lit(""))), L.BLANK + "+"), rel)
    return F.coalesce(T.attribute(F.get(F.filter(links, has), F.lit(0)), "href"), F.lit(""))


def headings(clean: Column, dom: bool = False) -> Column:
    """(level, text), of headings with text, up to a fixed number unless the document is a live one."""
    pattern = f"(?is)<h([1-6]){T.EDGE}[^>]*>(.*?)</h\\1{L.BLANK}*>"
    levels, inner = every(clean, pattern, 1), every(clean, pattern, 2)
    found = F.transform(levels, lambda lv, i: F.struct(lv.cast("int").alias("level"), F.left(T.strip_tags(F.get(inner, i)), F.lit(L.MAX_HEADING)).alias("text")))
    found = F.filter(found, lambda h: h["text"] != "")
    return found if dom else F.slice(found, 1, L.MAX_HEADINGS)


def images(bag: Column) -> Column:
    count = lambda f: F.size(F.filter(bag, f))
    empty = lambda b, a: F.coalesce(T.attribute(b, a), F.lit("")) == ""
    return F.struct(
        F.size(bag).alias("total"), count(lambda b: T.attribute(b, "alt").isNull()).alias("missing_alt"), count(lambda b: T.attribute(b, "alt") == "").alias("empty_alt"),
        count(lambda b: empty(b, "width") | empty(b, "height")).alias("no_dimensions"), count(lambda b: F.lower(F.coalesce(T.attribute(b, "loading"), F.lit(""))) != "lazy").alias("no_lazy"),
    )


def base_of(url: Column) -> Column:
    """What relative addresses on a page resolve against: computed once for each page."""
    return F.struct(U.protocol(url).alias("protocol"), U.origin(url).alias("origin"), U.hostname(url).alias("hostname"), U.pathname(url).alias("path"), F.regexp_replace(U.pathname(url), "[^/]*$", "").alias("folder"))


def anchors(clean: Column, base: Column, dom: bool = False) -> Column:
    """(label, host, internal, nofollow, image) of each http(s) link, in order, up to the label limit."""
    pattern = f"(?is)<a{T.EDGE}([^>]*)>(.*?)</a{L.BLANK}*>"
    tags, inner = every(clean, pattern, 1), every(clean, pattern, 2)

    def one(tag: Column, i: Column) -> Column:
        return F.struct(T.attributes(tag).alias("b"), F.get(inner, i).alias("inner"))

    def described(x: Column) -> Column:
        href = F.coalesce(T.attribute(x["b"], "href"), F.lit(""))
        host = F.when(~((href == "") | href.startswith("#") | href.rlike(("" if dom else "(?i)") + "^(javascript|mailto|tel):")), F.nullif(U.hostname(U.resolved_at(href, base)), F.lit("")))
        return F.struct(
            T.strip_tags(x["inner"]).alias("label"), host.alias("host"), (host == base["hostname"]).alias("internal"),
            F.contains(F.lower(F.coalesce(T.attribute(x["b"], "rel"), F.lit(""))), F.lit("nofollow")).alias("nofollow"), F.rlike(x["inner"], F.lit(r"(?is)<img\b[^>]*\balt\s*=")).alias("image"),
        )

    return F.filter(F.transform(F.transform(tags, one), described), lambda a: a["host"].isNotNull())


def json_ld_types(raw: Column) -> Column:
    """Distinct @type values of JSON-LD blocks: arrays are entered, and @graph two levels deep."""
    nodes = F.transform(every(raw, LD_JSON), lambda b: F.try_parse_json(F.regexp_replace(b, f"^{L.BLANK}+|{L.BLANK}+$", "")))
    items = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    spread = lambda a: F.flatten(F.transform(a, items))
    graph = lambda a: spread(F.filter(F.transform(a, lambda v: F.try_variant_get(v, "$['@graph']", "variant")), lambda v: v.isNotNull()))
    top = spread(spread(F.filter(nodes, lambda v: v.isNotNull())))
    first = graph(top)
    types = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    return F.array_distinct(F.filter(F.flatten(F.transform(F.concat(top, first, graph(first)), types)), lambda t: t.isNotNull()))


def body_text(clean: Column) -> Column:
    """Copy of the body without chrome; without a closed body the whole document counts."""
    pattern = f"(?is)<body{T.EDGE}[^>]*>(.*)</body{L.BLANK}*>"
    inner = F.when(F.rlike(clean, F.lit(pattern)), F.regexp_extract(clean, pattern, 1)).otherwise(clean)
    return F.left(T.strip_tags(T.strip_chrome(inner)), F.lit(L.MAX_BODY))


def word_count(body: Column) -> Column:
    return F.size(F.filter(F.split(body, L.BLANK + "+"), lambda w: w.rlike("[a-zA-Z]")))


def external_hosts(found: Column) -> Column:
    """(host, count) of links to other hosts, most first, ties by first appearance."""
    hosts = F.transform(F.filter(found, lambda a: ~a["internal"]), lambda a: a["host"])
    names = F.array_distinct(hosts)
    counted = F.transform(names, lambda h, i: F.struct((-F.size(F.filter(hosts, lambda x: x == h))).alias("c"), i.alias("i"), h.alias("h")))
    return F.slice(F.transform(F.array_sort(counted), lambda x: F.struct(x["h"].alias("host"), (-x["c"]).alias("count"))), 1, L.MAX_HOSTS)


def extract(pages: DataFrame, mode: str = "html", *keep: str) -> DataFrame:
    """pages (page_id, url, html) to page records; one row each, with the columns to keep."""
    dom = mode == "dom"
    df = pages.select(*keep, "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumns({"clean": T.strip_non_content(F.col("html")), "base": base_of(F.col("url"))})
    df = df.select(
        "*", bags(F.col("clean"), "meta").alias("metas"), bags(F.col("clean"), "link").alias("rels"), bags(F.col("clean"), "img").alias("imgs"), anchors(F.col("clean"), F.col("base"), dom).alias("anchors"),
        headings(F.col("clean"), dom).alias("headings"), title(F.col("clean")).alias("title"), body_text(F.col("clean")).alias("body"), json_ld_types(F.col("html")).alias("schema_types"),
    )
    at = F.filter(F.transform("anchors", lambda a, i: F.when(a["label"] != "", i)), lambda i: i.isNotNull())  # links after the last label that counts are not read
    if not dom:
        df = df.withColumn("anchors", F.slice("anchors", 1, F.coalesce(F.get(at, F.lit(L.MAX_LABELS - 1)) + 1, F.size("anchors"))))
    labels = F.filter(F.transform("anchors", lambda a: a["label"]), lambda x: x != "")
    at_level = lambda k: F.transform(F.filter("headings", lambda h: h["level"] == k), lambda h: h["text"])
    by_level = lambda *lv: F.flatten(F.array(*map(at_level, lv)))
    metas, count = F.col("metas"), lambda f: F.size(F.filter("anchors", f))
    zero = F.lit(0)
    blocks = every(F.col("html"), LD_JSON)
    alts = F.filter(F.transform("imgs", lambda b: T.attribute(b, "alt")), lambda x: x.isNotNull() & (x != ""))
    og = F.struct(*(meta(metas, f"og:{k}", dom).alias(k) for k in ("title", "description", "image", "type", "url")))
    types = F.col("schema_types")
    if dom:
        micro = F.transform(every(F.col("clean"), r"""(?is)itemtype\s*=\s*["']([^"']+)["']"""), lambda t: F.try_element_at(F.filter(F.split(t, "/"), lambda x: x != ""), F.lit(-1)))
        types = F.array_distinct(F.concat(types, F.filter(micro, lambda t: t.isNotNull())))
    return df.select(
        *keep, "page_id", "url", "base.origin", "base.hostname", U.pathname(F.col("url")).alias("pathname"), "base.protocol",
        "title", meta(metas, "description", dom).alias("meta_description"), meta(metas, "robots", dom).alias("meta_robots"), link_rel(F.col("rels"), "canonical").alias("canonical"),
        F.coalesce(T.attribute(T.attributes(F.regexp_extract("clean", f"(?is)<html{T.EDGE}([^>]*)>", 1)), "lang"), F.lit("")).alias("lang"), meta(metas, "viewport", dom).alias("viewport"),
        F.filter(F.transform("rels", lambda b: T.attribute(b, "hreflang")), lambda x: x.isNotNull() & (x != "")).alias("hreflang"),
        og.alias("og"), F.struct(*(meta(metas, f"twitter:{k}", dom).alias(k) for k in ("card", "title", "image"))).alias("twitter"), "headings",
        F.size(F.filter("headings", lambda h: h["level"] == 1)).alias("h1_count"), images(F.col("imgs")).alias("images"),
        F.struct(
            count(lambda a: a["internal"]).alias("internal"), count(lambda a: ~a["internal"]).alias("external"), count(lambda a: a["nofollow"]).alias("nofollow"),
            (count(lambda a: (a["label"] == "") & ~a["image"]) if dom else zero).alias("empty_anchor"), (count(lambda a: F.lower(a["label"]).isin(*L.GENERIC_LABELS)) if dom else zero).alias("generic_anchor"),
            external_hosts(F.col("anchors")).alias("external_hosts"),
        ).alias("links"),
        types.alias("schema_types"), (F.size(F.filter(blocks, lambda b: F.try_parse_json(b).isNull())) if dom else zero).alias("invalid_json_ld"), word_count(F.col("body")).alias("word_count"),
        (F.size(every(F.col("html"), "<([a-zA-Z])")) if dom else zero).alias("dom_nodes"), T.js_length(F.col("html")).alias("html_bytes"),
        F.struct(
            F.col("title").alias("title"), F.concat_ws(" ", meta(metas, "description", dom), meta(metas, "og:description", dom)).alias("description"), F.array_join(by_level(1), ". ").alias("h1"),
            F.array_join(by_level(2), ". ").alias("h2"), F.array_join(by_level(3, 4), ". ").alias("h3"), F.array_join(F.transform(F.slice(labels, 1, 400), lambda x: F.left(x, F.lit(L.MAX_LABEL))), ". ").alias("anchor"),
            F.array_join(F.slice(alts, 1, 200), ". ").alias("alt"), F.col("body").alias("body"),
        ).alias("fields"),
    )
