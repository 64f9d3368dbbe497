"""Text functions over Columns: markup removal, entities, segments and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens import lexicon as L

EDGE = "(?![A-Za-z0-9_])"


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, L.BLANK + "+", " "))


def code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def decode_entities(s: Column) -> Column:
    """One pass over the pieces after each ampersand, so nothing is decoded twice."""
    names = F.create_map(*(F.lit(x) for pair in L.ENTITIES.items() for x in pair))

    def piece(p: Column) -> Column:
        body = F.regexp_extract(p, r"^(#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});", 1)
        digits, hexes = F.regexp_extract(body, "^#([0-9]+)", 1), F.regexp_extract(body, "^#x([0-9a-fA-F]+)$", 1)
        number = F.when(hexes != "", F.conv(F.right(hexes, F.lit(12)), 16, 10).cast("bigint")).when(digits != "", F.left(digits, F.lit(15)).cast("bigint"))
        value = F.when(body.startswith("#"), F.when(number <= 0x10FFFF, code_point(number))).otherwise(F.try_element_at(names, F.lower(body)))
        return F.when((body == "") | value.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(value, F.substr(p, F.length(body) + 2)))

    parts = F.split(s, "&")
    return F.when(F.contains(s, F.lit("&")), F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)), "")).otherwise(s)


def strip_tags(html: Column) -> Column:
    return collapse(decode_entities(F.regexp_replace(html, "<[^>]*>", " ")))


def without(html: Column, *names: str) -> Column:
    for name in names:
        html = F.regexp_replace(html, f"(?is)<{name}{EDGE}.*?</{name}{L.BLANK}*>", " ")
    return html


def strip_non_content(html: Column) -> Column:
    return without(F.regexp_replace(html, "(?s)<!--.*?-->", " "), *L.CONTENTLESS)


def strip_chrome(html: Column) -> Column:
    return without(html, *L.CHROME)


ATTRIBUTE = r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)""" + L.BLANK + "*=" + L.BLANK + r"""*(?:"([^"]*)"|'([^']*)'|([^""" + L.BLANKS + r""""'=<>`]+))"""


def attributes(tag: Column) -> Column:
    """Quoted and bare attributes of a tag's inside, in order: array of (key in lower case, value)."""
    groups = [F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(i)) for i in range(1, 5)]
    value = lambda i: F.concat(*(F.get(g, i) for g in groups[1:]))  # noqa: E731  one of them is not empty
    return F.transform(groups[0], lambda k, i: F.struct(F.lower(k).alias("key"), F.regexp_replace(decode_entities(value(i)), f"^{L.BLANK}+|{L.BLANK}+$", "").alias("value")))


def attribute(bag: Column, name: str) -> Column:
    """The value of an attribute, of which the last duplicate wins; null where it is absent."""
    return F.try_element_at(F.filter(bag, lambda a: a["key"] == name), F.lit(-1))["value"]


def segments(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), L.SEGMENT_BREAKS)


def tokens(segment: Column) -> Column:
    """Clean tokens of a lower-case segment."""
    bare = F.transform(F.split(segment, L.TOKEN_BREAKS), lambda t: F.regexp_replace(t, "^['’-]+|['’-]+$", ""))
    return F.filter(bare, lambda t: F.length(t).between(2, 28) & ~t.isin(*L.JUNK) & t.rlike("[a-z]"))


def grams(toks: Column, n: int) -> Column:
    """(pos, term) of the n-grams without a stopword, over cleaned tokens."""
    starts = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.slice(toks, i, n).alias("g")))
    fine = F.filter(each, lambda x: ~F.exists(x["g"], lambda t: t.isin(*L.STOPWORDS)) & ((F.length(F.get(x["g"], F.lit(0))) >= 3) if n == 1 else F.lit(True)))
    return F.transform(fine, lambda x: F.struct(F.lit(n).alias("n"), x["pos"].alias("pos"), F.array_join(x["g"], " ").alias("term")))


def js_length(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def title_case(s: Column) -> Column:
    """A capital after every non-word character."""
    parts = F.regexp_extract_all(s, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")
