"""URL functions over Columns, for http and https forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens import lexicon as L

HTTP = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)(:[0-9]+)?([^?#]*)"
DOTS = r"(?i)/(\.|%2e){1,2}(/|$)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f may use it many times: it is computed, and planned, once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), HTTP, group)


def protocol(url: Column) -> Column:
    p = F.lower(part(url, 1))
    return F.when(p != "", F.concat(p, F.lit(":"))).otherwise(F.lit(""))


def hostname(url: Column) -> Column:
    return F.lower(part(url, 2))


def port(url: Column) -> Column:
    """With its colon; empty where it is the protocol's own."""
    p = part(url, 3)
    own = ((protocol(url) == "http:") & (p == ":80")) | ((protocol(url) == "https:") & (p == ":443"))
    return F.when(own, F.lit("")).otherwise(p)


def without_dots(path: Column) -> Column:
    """A path from the root with its `.` and `..` segments carried out; these may be written as %2e."""
    one, two = (lambda x: x.rlike(r"(?i)^(\.|%2e)$")), (lambda x: x.rlike(r"(?i)^(\.|%2e){2}$"))
    step = lambda out, x: F.when(two(x), F.regexp_replace(out, "/[^/]*$", "")).when(one(x), out).otherwise(F.concat(out, F.lit("/"), x))

    def whole(parts: Column) -> Column:
        end = F.when(F.try_element_at(parts, F.lit(-1)).rlike(r"(?i)^(\.|%2e){1,2}$"), "/").otherwise("")
        return F.concat(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), step), end)

    return let(path, lambda p: F.when(p.rlike(DOTS), let(F.split(p, "/"), whole)).otherwise(p))


def pathname(url: Column) -> Column:
    return F.when(part(url, 2) == "", F.lit("")).otherwise(let(part(url, 4), lambda p: F.when(p == "", "/").otherwise(without_dots(p))))


def numeric(host: Column) -> Column:
    """A host that ends in a number as the dotted address it means, null where it means none; other hosts as they are.

    Parts may be decimal, octal (0...) or hexadecimal (0x...); the last fills what the others leave.
    The loopback address of version 6 is given in its short form.
    """
    power = lambda k: F.pow(F.lit(256.0), k).cast("bigint")
    number = lambda p: (
        F.when(p.rlike("^0x[0-9a-f]{0,12}$"), F.conv(F.concat(F.lit("0"), F.substr(p, F.lit(3))), 16, 10).cast("bigint")).when(p.rlike("^0[0-7]{0,16}$"), F.conv(p, 8, 10).cast("bigint"))
        .when(p.rlike("^[1-9][0-9]{0,14}$"), p.cast("bigint"))
    )

    def address(values: Column) -> Column:
        n = F.size(values)
        fine = (n <= 4) & F.forall(values, lambda x: x.isNotNull()) & F.forall(F.slice(values, F.lit(1), n - 1), lambda x: x < 256) & (F.get(values, n - 1) < power(5 - n))
        sum_of = F.aggregate(F.transform(values, lambda x, i: F.when(i < n - 1, x * power(3 - i)).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(fine, let(sum_of, lambda a: F.concat_ws(".", *(F.pmod(F.floor(a / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)))))

    def known(h: Column) -> Column:
        return (
            F.when(h.rlike(r"(?i)(^|\.)([0-9]+|0x[0-9a-f]*)\.?$"), address(F.transform(F.split(F.regexp_replace(h, r"\.$", ""), r"\."), number)))
            .when(h.rlike(r"^\[(0{1,4}:)*:?(0{1,4}:)*0{0,3}1\]$"), "[::1]").otherwise(h)
        )

    return let(host, known)


def known_host(url: Column) -> Column:
    """The host of an address as a browser names it; empty where there is none."""
    return F.coalesce(numeric(hostname(url)), F.lit(""))


def origin(url: Column) -> Column:
    return F.when(hostname(url) == "", F.lit("")).otherwise(F.concat(protocol(url), F.lit("//"), hostname(url), port(url)))


def resolved_at(href: Column, base: Column) -> Column:
    """href against a base of protocol, origin and folder, as far as protocol, host and path go; null for other schemes."""
    return (
        F.when(href.rlike("(?i)^https?://"), href).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(href.startswith("//"), F.concat(base["protocol"], href))
        .when(href.startswith("/"), F.concat(base["origin"], href)).when((href == "") | href.startswith("?") | href.startswith("#"), F.concat(base["origin"], base["path"], href))
        .otherwise(F.concat(base["origin"], base["folder"], href))
    )


def resolved(href: Column, base: Column) -> Column:
    at = {"protocol": protocol(base), "origin": origin(base), "path": pathname(base), "folder": F.regexp_replace(pathname(base), "[^/]*$", "")}
    rest = lambda u: F.regexp_extract(u, r"(?s)^[^?#]*(.*)$", 1)
    return let(resolved_at(href, at), lambda u: F.when(u.rlike(r"(?i)^[^?#]*/(\.|%2e){1,2}([/?#]|$)"), F.concat(origin(u), pathname(u), rest(u))).otherwise(u))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), f"^{L.BLANK}+|{L.BLANK}+$", "")


# Fixed pattern of hosts that are not public.
PRIVATE = r"^(localhost|.*\.local|\[::1\]|::1|127\..*|10\..*|0\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*)$"


def is_private_host(host: Column) -> Column:
    return F.coalesce(numeric(F.lower(host)), F.lit("")).rlike(PRIVATE)


def with_scheme(raw: Column) -> Column:
    t = trimmed(raw)
    return F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))


def named(url: Column) -> Column:
    """Protocol, host and port, with the host as known_host() gives it."""
    return F.concat(protocol(url), F.lit("//"), known_host(url), port(url))


def normalized(raw: Column) -> Column:
    """origin, path and query without fragment, or null for what is no public-looking http(s) address."""

    def of(u: Column) -> Column:
        fine = (trimmed(raw) != "") & known_host(u).contains(".") & ~hostname(u).rlike(r"\s")
        return F.when(fine, F.concat(named(u), pathname(u), F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)))

    return let(with_scheme(raw), of)


def normalized_strict(raw: Column) -> Column:
    """As normalized(), with the fragment kept; null also for credentials and private hosts."""

    def of(u: Column) -> Column:
        fine = (trimmed(raw) != "") & (known_host(u) != "") & ~u.rlike(r"(?i)^https?://[^/?#]*@") & ~is_private_host(hostname(u))
        return F.when(fine, F.concat(named(u), pathname(u), F.regexp_extract(u, r"^[^?#]*([?#].*)", 1)))

    return let(with_scheme(raw), of)


def display(url: Column) -> Column:
    """Host and path without a leading www. and a bare slash; the input where it is no address."""
    path = F.when(pathname(url) == "/", F.lit("")).otherwise(pathname(url))
    return F.when(hostname(url) == "", url).otherwise(F.concat(F.regexp_replace(F.concat(hostname(url), port(url)), r"^www\.", ""), path))


def slug(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def slug_unclean(path: Column) -> Column:
    s = slug(path)
    return (F.length(s) > 60) | s.rlike("[_A-Z]") | s.rlike("(?i)%[0-9a-f]{2}")


def without_slash(url: Column) -> Column:
    return let(url, lambda u: F.concat(origin(u), F.regexp_replace(pathname(u), "/$", "")))
