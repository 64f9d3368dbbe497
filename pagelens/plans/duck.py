"""DuckDB SQL that states the operators' results independently of the Spark plans."""

from __future__ import annotations

from pagelens import lexicon as L
from pagelens.plans import fixtures as X

q, B = X.quoted, L.BLANK


def replace(x: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def collapse(x: str) -> str:
    return f"trim({replace(x, B + '+')})"


_NAMES = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in L.ENTITIES.items()) + "}"


def decode(x: str) -> str:
    body = "regexp_extract(p, '^(#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});', 1)"
    hexes, digits = f"regexp_extract({body}, '^#x([0-9a-fA-F]{{1,7}})$', 1)", f"regexp_extract({body}, '^#([0-9]{{1,9}})', 1)"
    number = f"(CASE WHEN {hexes} <> '' THEN CAST(('0x' || {hexes}) AS BIGINT) WHEN {digits} <> '' THEN CAST({digits} AS BIGINT) END)"
    value = f"(CASE WHEN {body} LIKE '#%' THEN CASE WHEN {number} <= 1114111 THEN chr(CAST({number} AS INTEGER)) END ELSE {_NAMES}[lower({body})] END)"
    piece = f"CASE WHEN {body} = '' OR {value} IS NULL THEN '&' || p ELSE {value} || substr(p, length({body}) + 2) END"
    return f"(str_split({x}, '&')[1] || coalesce(array_to_string(list_transform(str_split({x}, '&')[2:], lambda p: {piece}), ''), ''))"


def strip_tags(x: str) -> str:
    return collapse(decode(replace(x, "<[^>]*>")))


def without(x: str, names) -> str:
    for n in names:
        x = replace(x, rf"(?is)<{n}\b.*?</{n}{B}*>")
    return x


ATTR = r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)""" + B + "*=" + B + r"""*(?:"([^"]*)"|'([^']*)'|([^""" + L.BLANKS + r""""'=<>`]+))"""


def bag(tag: str) -> str:
    g = [f"regexp_extract_all({tag}, {q(ATTR)}, {i})" for i in (1, 2, 3, 4)]
    value = replace(decode(f"concat({g[1]}[i], {g[2]}[i], {g[3]}[i])"), f"^{B}+|{B}+$", "")
    return f"struct_pack(k := list_transform({g[0]}, lambda x: lower(x)), v := list_transform(range(1, len({g[0]}) + 1), lambda i: {value}))"


def attr(b: str, name: str) -> str:
    return f"(CASE WHEN list_contains({b}.k, {q(name)}) THEN {b}.v[len({b}.k) - list_position(list_reverse({b}.k), {q(name)}) + 1] END)"


def bags(tag: str) -> str:
    return f"list_transform(regexp_extract_all(clean, {q(rf'(?is)<{tag}' + chr(92) + 'b([^>]*)>')}, 1), lambda t: {bag('t')})"


def meta(key: str) -> str:
    hit = f"list_filter(metas, lambda b: coalesce(lower({attr('b', 'name')}) = {q(key)}, false) OR coalesce(lower({attr('b', 'property')}) = {q(key)}, false))[1]"
    return f"coalesce({attr('(' + hit + ')', 'content')}, '')"


def link_rel(rel: str) -> str:
    hit = f"list_filter(rels, lambda b: list_contains(regexp_split_to_array(lower(coalesce({attr('b', 'rel')}, '')), {q(B + '+')}), {q(rel)}))[1]"
    return f"coalesce({attr('(' + hit + ')', 'href')}, '')"


HTTP = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)(:[0-9]+)?([^?#]*)"


def part(u: str, i: int) -> str:
    return f"regexp_extract({u}, {q(HTTP)}, {i})"


def protocol(u: str) -> str:
    return f"(CASE WHEN {part(u, 1)} <> '' THEN lower({part(u, 1)}) || ':' ELSE '' END)"


def host(u: str) -> str:
    return f"lower({part(u, 2)})"


def port(u: str) -> str:
    return f"(CASE WHEN lower({part(u, 1)}) || {part(u, 3)} IN ('http:80', 'https:443') THEN '' ELSE {part(u, 3)} END)"


def dotless(p: str) -> str:
    """The path with its dot segments carried out, segment by segment from the left."""
    dot, up = "regexp_matches({0}, '(?i)^(\\.|%2e)$')", "regexp_matches({0}, '(?i)^(\\.|%2e){{2}}$')"
    step = f"CASE WHEN {up.format('x')} THEN regexp_replace(a, '/[^/]*$', '') WHEN {dot.format('x')} THEN a ELSE a || '/' || x END"
    last = f"str_split({p}, '/')[-1]"
    return f"(CASE WHEN regexp_matches({p}, '(?i)/(\\.|%2e){{1,2}}(/|$)') THEN list_reduce(str_split({p}, '/'), lambda a, x: {step}) || CASE WHEN {dot.format(last)} OR {up.format(last)} THEN '/' ELSE '' END ELSE {p} END)"


def pathname(u: str) -> str:
    return f"(CASE WHEN {part(u, 2)} = '' THEN '' WHEN {part(u, 4)} = '' THEN '/' ELSE {dotless(part(u, 4))} END)"


def origin(u: str) -> str:
    return f"(CASE WHEN {part(u, 2)} = '' THEN '' ELSE {protocol(u)} || '//' || {host(u)} || {port(u)} END)"


def resolved(h: str, u: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({h}, '(?i)^https?://') THEN {h} WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN {h} LIKE '//%' THEN {protocol(u)} || {h} "
        f"WHEN {h} LIKE '/%' THEN {origin(u)} || {h} WHEN {h} = '' OR {h} LIKE '?%' OR {h} LIKE '#%' THEN {origin(u)} || {pathname(u)} || {h} ELSE {origin(u)} || regexp_replace({pathname(u)}, '[^/]*$', '') || {h} END)"
    )


def _record() -> str:
    """Common table expressions raw .. rec: page records of pages and of the literal pages."""
    head = "|".join(rf"<h{i}\b[^>]*>.*?</h{i}{B}*>" for i in range(1, 7))
    clean = without(replace("html", "(?s)<!--.*?-->"), L.CONTENTLESS)
    closed, loose = f"(?is)<title[^>]*>(.*?)</title{B}*>", "(?is)<title[^>]*>([^<]*)"
    body = rf"(?is)<body\b[^>]*>(.*)</body{B}*>"
    a_re = rf"(?is)<a\b([^>]*)>(.*?)</a{B}*>"
    href = f"coalesce({attr('t.b', 'href')}, '')"
    target = resolved(href, "url")
    a_host = f"(CASE WHEN NOT ({href} = '' OR {href} LIKE '#%' OR regexp_matches({href}, '(?i)^(javascript|mailto|tel):')) THEN nullif({host(f"coalesce({target}, '')")}, '') END)"
    inner_h = rf"regexp_replace(regexp_replace(x, '(?is)^<h[1-6]\b[^>]*>', ''), '(?is)</h[1-6]{B}*>$', '')"
    levels = lambda *lv: "array_to_string(list_concat(" + ", ".join(f"list_transform(list_filter(headings, lambda h: h.level = {k}), lambda h: h.text)" for k in lv) + (", [])" if len(lv) == 1 else ")") + ", '. ')"
    count = lambda f: f"CAST(len(list_filter({f})) AS BIGINT)"
    empty = lambda a: f"coalesce({attr('b', a)}, '') = ''"
    ld = rf"""(?is)<script\b[^>]*type{B}*={B}*["']application/ld\+json["'][^>]*>(.*?)</script{B}*>"""
    return f"""
fix_html AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in X.HTML)}) t(page_id, url, html)),
raw AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM fix_html)),
c1 AS (SELECT *, {clean} AS clean FROM raw),
c2 AS (SELECT *, {bags('meta')} AS metas, {bags('link')} AS rels, {bags('img')} AS imgs,
  list_filter(list_transform(regexp_extract_all(clean, {q('(?is)' + head)}), lambda x: struct_pack(level := CAST(substr(x, 3, 1) AS INTEGER), text := substr({strip_tags(inner_h)}, 1, 300))), lambda h: h.text <> '') AS headings,
  CASE WHEN regexp_matches(clean, {q(closed)}) THEN {strip_tags(f"regexp_extract(clean, {q(closed)}, 1)")} ELSE {strip_tags(f"regexp_extract(clean, {q(loose)}, 1)")} END AS title,
  substr({strip_tags(without(f"CASE WHEN regexp_matches(clean, {q(body)}) THEN regexp_extract(clean, {q(body)}, 1) ELSE clean END", L.CHROME))}, 1, {L.MAX_BODY}) AS body,
  list_transform(regexp_extract_all(clean, {q(a_re)}, 1), lambda t, i: struct_pack(b := {bag('t')}, x := regexp_extract_all(clean, {q(a_re)}, 2)[i])) AS links0
  FROM c1),
c3 AS (SELECT *, list_filter(list_transform(links0, lambda t: struct_pack(label := {strip_tags('t.x')}, host := {a_host}, nofollow := contains(lower(coalesce({attr('t.b', 'rel')}, '')), 'nofollow'), image := regexp_matches(t.x, '(?is)<img\\b[^>]*\\balt\\s*='))), lambda a: a.host IS NOT NULL) AS links FROM c2),
rec AS (SELECT page_id, url, html, clean, {origin('url')} AS origin, {host('url')} AS hostname, {pathname('url')} AS pathname, {protocol('url')} AS protocol, title, headings,
  {meta('description')} AS meta_description, {meta('robots')} AS meta_robots, {meta('viewport')} AS viewport, {link_rel('canonical')} AS canonical,
  coalesce({attr('(' + bag(rf"regexp_extract(clean, '(?is)<html\b([^>]*)>', 1)") + ')', 'lang')}, '') AS lang,
  list_filter(list_transform(rels, lambda b: {attr('b', 'hreflang')}), lambda x: x <> '') AS hreflang,
  {', '.join(f"{meta('og:' + k)} AS og_{k}" for k in ('title', 'description', 'image', 'type', 'url'))}, {', '.join(f"{meta('twitter:' + k)} AS twitter_{k}" for k in ('card', 'title', 'image'))},
  {count('headings, lambda h: h.level = 1')} AS h1_count, CAST(len(imgs) AS BIGINT) AS img_total, {count(f"imgs, lambda b: {attr('b', 'alt')} IS NULL")} AS missing_alt, {count(f"imgs, lambda b: {attr('b', 'alt')} = ''")} AS empty_alt,
  {count(f"imgs, lambda b: {empty('width')} OR {empty('height')}")} AS no_dimensions, {count(f"imgs, lambda b: lower(coalesce({attr('b', 'loading')}, '')) <> 'lazy'")} AS no_lazy,
  links, {count(f"links, lambda a: a.host = {host('url')}")} AS internal, {count(f"links, lambda a: a.host <> {host('url')}")} AS external, {count('links, lambda a: a.nofollow')} AS nofollow,
  regexp_extract_all(html, {q(ld)}, 1) AS blocks, body, {count(f"regexp_split_to_array(body, {q(B + '+')}), lambda w: regexp_matches(w, '[a-zA-Z]')")} AS word_count,
  {meta('description')} || ' ' || {meta('og:description')} AS f_description, {levels(1)} AS f_h1, {levels(2)} AS f_h2, {levels(3, 4)} AS f_h3,
  array_to_string(list_transform(list_filter(links, lambda a: a.label <> '')[1:400], lambda a: substr(a.label, 1, 120)), '. ') AS f_anchor,
  array_to_string(list_filter(list_transform(imgs, lambda b: {attr('b', 'alt')}), lambda x: x <> '')[1:200], '. ') AS f_alt
  FROM c3)"""


RECORD = _record()


def from_rec(select: str, rest: str = "rec") -> str:
    return f"WITH {RECORD} SELECT {select} FROM {rest}"
