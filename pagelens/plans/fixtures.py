"""Small literal tables, the same in Spark and in SQL, for branches that the test tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: page_id, url, html. Ids are negative so that they never meet those of pages.
HTML = [
    (-1, "https://www.Shop.example.com/Blue_Widgets?x=1#f", """<!DOCTYPE html><html lang="en"><head><title>Blue widgets &amp; gadgets for every home and office | Shop</title>
<meta name="description" content="Buy blue widgets and gadgets online. Fast shipping, fair prices and friendly support for every widget you need."><meta name=viewport content="width=device-width">
<meta property="og:title" content="Blue widgets"><meta property="og:description" content='All "blue" things'><meta property="og:image" content="/i.png"><meta property="og:type" content="website"><meta property="og:url" content="https://x.y/">
<meta name="twitter:card" content="summary"><meta name="twitter:title" content="T"><meta name="twitter:image" content="t.png"><link rel="canonical" href="https://www.shop.example.com/Blue_Widgets/"><link rel="alternate" hreflang="de" href="/de/"><link rel="ALTERNATE nofollow" hreflang="fr" href="/fr/">
<script type="application/ld+json">{"@type":"Product","name":"w"}</script><script type="application/ld+json">[{"@type":["Article","Thing"]},{"@graph":[{"@type":"Person"},{"@type":"Product"}]}]</script></head>
<body><nav><a href="/">Home</a></nav><h1>Blue widgets</h1><h2>Why blue widgets</h2><p>Blue widgets are great. Our blue widgets last long; blue widgets rarely break.</p><h4>Deep</h4><h2></h2>
<img src=a.png alt="Blue widget" width=1 height=2 loading=lazy><img src=b.png alt=""><img src="c.png"><a href="//cdn.other.org/x" rel="nofollow ugc">CDN</a><a href="http://other.org/">Other &copy;</a><a href="http://OTHER.org:80/b"><img src=x alt=y></a>
<a href="mailto:a@b.c">Mail</a><a href="#top">Top</a><a href="rel/page">Read more</a><a href="ftp://f.example/">F</a><a name=x>none</a></body></html>"""),
    (-2, "http://bad.example.net/path/My%20Page/", """<html><head><title>Home<meta name="robots" content="NOINDEX, nofollow"><link rel=canonical href="/elsewhere"></head><h1>One</h1><h3>Skip</h3><h1>Two</h1>
<img><img><img><img src=1><img><img><img><img><img src=9 width=3><p>caf&eacute; &#38;lt; &#x41;&#66; &unknown; &#xFFFFFFF; a&nbsp;b \u2003 c &AMP; d"""),
    (-3, "not a url", """<title></title><title>Second</title><body><p data-x="a>b">text</p><div class='q'>more <b>bold</b> words</div><!-- <h2>gone</h2> --><style>p{}</style><noscript>no</noscript><svg><title>s</title></svg><template>t</template>
<header>h</header><aside>s</aside><form>f</form><pre>p</pre><code>c</code><kbd>k</kbd><samp>s</samp><footer>f</footer></body>"""),
    (-4, "https://x.example.org", ""),
    (-5, "https://long.example.org/a/b-c", "<html lang='fr'><title>A title of a good length for a page like this</title><meta name=description content='short one'><body><h1>Title words here</h1><a href='/a'>a</a><a href='/b'>b</a><a href='https://long.example.org/c'>c</a><p>" + "Solar panel costs vary. " * 150 + "</p></body></html>"),
    (-6, "https://dup.example.org/x", '<meta name="description" content="first" content="last"><meta name="description" content="no"><meta content="x"><img alt width="5" height="6"><h2>A</h2><h3>B</h3><h5>C</h5><a href="https://q.org">q</a><a href="https://r.org/1">r</a><a href="https://r.org/2">r2</a><body>x</body> y </body>'),
]
_FIELDS = ("title", "description", "h1", "h2", "h3", "anchor", "alt", "body")
#: group_id, doc_idx, fields that are not empty.
PAGES = [
    ("f", 0, {"title": "Solar panel guide", "h1": "Welcome", "body": "Solar panels cut bills. Solar panel cost varies. Read more."}),
    ("f", 1, {"title": "Solar panel cost calculator", "h1": "Solar panel cost", "h2": "Battery storage", "body": "Battery storage keeps power. Panel cost drops 20% yearly. Battery storage pays."}),
    ("f", 2, {"title": "Home battery storage", "h1": "Battery storage and solar", "body": "Battery storage lasts ten years. Solar panel cost matters."}),
    ("f", 3, {"title": "Heat pump guide", "body": "Heat pumps and battery storage. Solar panel cost."}),
    ("g", 0, {"title": "Welcome", "h1": "Green tea", "body": "Green tea leaves. Green tea tastes fresh; green tea brewing."}),
]

ADDRESSES = [" example.com ", "HTTP://Example.com:80/a?b#c", "https://u:p@host.org/", "http://localhost/x", "192.168.0.1", "172.20.1.1/", "172.40.1.1", "10.1.2.3", "foo.local", "nodot", "", "https://www.site.org/", "https://www.site.org/path/", "example.com", "https://example.com:8443/q?r#s", "::1", "0.0.0.0", "169.254.1.1", "https://google-cdn.net/x", "ftp://x.org"]


def quoted(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows: list[tuple], name: str, columns: list[str]) -> str:
    """The rows as a named common table expression."""
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def html(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HTML, "page_id long, url string, html string")


def page_rows() -> list[tuple]:
    return [(g, i, *(f.get(k, "") for k in _FIELDS)) for g, i, f in PAGES]


def pages(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    df = spark.createDataFrame(page_rows(), "group_id string, doc_idx int, " + ", ".join(f"{k} string" for k in _FIELDS))
    fields = F.struct(*(F.col(k) for k in _FIELDS))
    return df.select("group_id", "doc_idx", "title", F.col("description").alias("meta_description"), F.lit("www.solar-now.example").alias("hostname"), fields.alias("fields"))


def addresses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ADDRESSES)), "pos int, raw string")
