"""Weighted phrase profiles, tf-idf, and the comparison of a target page with its competitors.

All tables are long: (group_id, doc_idx, term, ...), doc_idx 0 being the target of its group, so
one job analyses any number of groups. Field weights are summed as integer tenths, which no order
of summation can change; ratios are rounded to nine digits before they are ranked.

Every step works within a group, and none joins a long table with itself: pages that are dealt out
by group_id stay where they are from then on, so nothing of a profile, which is many times the size
of its pages, is shuffled or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens import lexicon as L
from pagelens.functions import text as T

KEY = ["group_id", "doc_idx"]


def _language() -> Column:
    return F.regexp_extract(F.col("url"), r"^[^:]*://[^/?#]*/([a-z]{2})/", 1)


def _block(block: int) -> Column:
    return F.floor(F.col("page_id") / block).cast("long")


def _place(n: Column, size: int, block: int) -> dict[str, Column]:
    """group_id and doc_idx of the n-th page of its language and block."""
    return {"group_id": F.concat_ws("-", _language(), _block(block), F.floor(n / size).cast("long")), "doc_idx": (n % size).cast("int")}


def grouped(records: DataFrame, size: int = 6, block: int = 600) -> DataFrame:
    """Adds group_id and doc_idx: pages of one language (first path segment), `size` at a time by page_id.

    Numbering runs within blocks of page ids, so no window holds more than `block` ids.
    """
    n = F.row_number().over(Window.partitionBy(_language(), _block(block)).orderBy("page_id")) - 1
    return records.withColumns(_place(n, size, block))


def grouped_in_place(pages: DataFrame, size: int = 6, block: int = 600) -> DataFrame:
    """As grouped(), but only ids and addresses are shuffled: the numbers of a block's pages come back as one broadcast row, 4 bytes a page.

    Blocks in which an id occurs twice go through grouped(). page_id is 0 or more.
    """
    at = (F.col("page_id") % block).cast("short")
    n = (F.row_number().over(Window.partitionBy(_language(), _block(block)).orderBy("page_id")) - 1).cast("short")
    numbers = pages.select(_block(block).alias("__block"), F.struct(at.alias("at"), n.alias("n")).alias("x")).groupBy("__block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    numbers = numbers.select("__block", F.col("x.at").alias("__at"), F.col("x.n").alias("__n")).withColumn("__twice", F.size(F.array_distinct("__at")) < F.size("__at"))
    df = pages.withColumn("__block", _block(block)).join(F.broadcast(numbers), "__block")
    once = df.where("not __twice").withColumns(_place(F.get("__n", (F.array_position("__at", at) - 1).cast("int")), size, block))
    return once.select(*pages.columns, "group_id", "doc_idx").unionByName(grouped(df.where("__twice").select(*pages.columns), size, block))


def field_rows(docs: DataFrame) -> DataFrame:
    """docs with a struct `fields`: one row for each field, with its place and weight in tenths."""
    each = F.array(*(F.struct(F.lit(i).alias("field_ord"), F.lit(name).alias("field"), F.lit(w).alias("weight"), F.coalesce(F.col(f"fields.{name}"), F.lit("")).alias("text")) for i, (name, w) in enumerate(L.FIELDS.items())))
    return docs.select(*KEY, F.explode(each).alias("f")).select(*KEY, "f.*").where("text <> ''")


def phrases(df: DataFrame, keep: list[str], max_n: int = 3) -> DataFrame:
    """One row for each n-gram of `text`: its segment, length, position and term."""
    toks = F.transform(T.segments(F.col("text")), T.tokens)
    df = df.select(*keep, toks.alias("__toks"))
    found = F.flatten(F.transform("__toks", lambda t, i: F.transform(F.concat(*(T.grams(t, n) for n in range(1, max_n + 1))), lambda g: F.struct(i.alias("seg"), g["n"].alias("n"), g["pos"].alias("pos"), g["term"].alias("term")))))
    return df.select(*keep, F.explode(found).alias("g")).select(*keep, "g.*")


def profile(docs: DataFrame) -> DataFrame:
    """group_id, doc_idx, term, n, weight10 and first_seen (place of the first occurrence).

    A place is field, segment, length and position in one number of the same order, which unlike a struct can be hash-aggregated.
    """
    rows = phrases(field_rows(docs), [*KEY, "field_ord", "weight"])
    place = F.shiftleft(F.col("field_ord").cast("long"), 59).bitwiseOR(F.shiftleft(F.col("seg").cast("long"), 30)).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 28)).bitwiseOR(F.col("pos").cast("long"))
    return rows.groupBy(*KEY, "term").agg(F.count("*").alias("n"), F.sum("weight").alias("weight10"), F.min(place).alias("first_seen"))


def normalized(prof: DataFrame) -> DataFrame:
    return prof.withColumn("norm", F.col("weight10") / F.max("weight10").over(Window.partitionBy(*KEY)))


def candidates(prof: DataFrame) -> DataFrame:
    """One conditional aggregation in the place of a full outer join of target and competitors. weights: doc_idx and weight10 of each page with the term."""
    heard = (F.col("doc_idx") > 0) & (F.col("norm") >= L.NOISE)
    seen = F.when((F.col("doc_idx") == 0) | heard, F.col("doc_idx"))
    df = normalized(prof).groupBy("group_id", "term").agg(
        F.coalesce(F.max(F.when(F.col("doc_idx") == 0, F.col("norm"))), F.lit(0.0)).alias("target_w"), F.count_if(heard).alias("comp_df"),
        F.coalesce(F.sum(F.when(heard, F.col("norm"))), F.lit(0.0)).alias("comp_sum"), F.sum("n").alias("corpus_count"),
        F.when(F.min(seen).isNotNull(), F.struct(F.min(seen).alias("doc_idx"), F.min_by("first_seen", seen).alias("first_seen"))).alias("first_seen"), F.count("*").alias("df"),
        F.sort_array(F.collect_list(F.struct("doc_idx", "weight10"))).alias("weights"),
    )
    return df


def rated(counts: DataFrame) -> DataFrame:
    """Adds phraseness to counts (group_id, term, corpus_count, ...), which hold every single word: null for single words.

    Words of phrases meet the single words in a window, so counts are read once.
    """
    df = counts.select("*", F.posexplode(F.split("term", " ")).alias("__pos", "__token"))
    df = df.withColumn("__c", F.max(F.when(F.col("term") == F.col("__token"), F.col("corpus_count"))).over(Window.partitionBy("group_id", "__token")))
    df = df.withColumn("__c", F.min("__c").over(Window.partitionBy("group_id", "term"))).where("__pos = 0")
    value = F.when(F.col("__c").isNull(), F.lit(1.0)).otherwise(F.col("corpus_count") / F.col("__c"))
    return df.withColumn("phraseness", F.when(F.contains("term", F.lit(" ")), value)).drop("__pos", "__token", "__c")


def phraseness(counts: DataFrame) -> DataFrame:
    """group_id, term, phraseness of each phrase; counts: group_id, term, corpus_count."""
    return rated(counts.select("group_id", "term", "corpus_count")).where("phraseness is not null").select("group_id", "term", "phraseness")


def group_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("group_id").agg((F.count("*") - 1).alias("comp_count"))


def salience() -> Column:
    c = F.col("comp_count")
    return F.round(0.8 * F.col("target_w") + F.when(c > 0, 1.2 * F.col("comp_sum") / c + 0.6 * F.col("comp_df") / c).otherwise(0.0), 9)


def vocabulary(cand: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates that are worth scoring, at most MAX_VOCAB for each group, by salience."""
    useful = (F.col("target_w") >= 0.06) | (F.col("comp_df") >= F.when(F.col("comp_count") >= 3, 2).otherwise(1))
    phrase = F.contains("term", F.lit(" "))
    fine = F.col("first_seen").isNotNull() & useful & (~phrase | (F.col("corpus_count") >= L.MIN_PHRASE_COUNT))
    # All single words stay until phrases are rated by them; of phrases only those that can pass.
    df = rated(cand.join(sizes, "group_id").withColumn("__fine", fine).where(F.col("__fine") | ~phrase))
    df = df.where(F.col("__fine") & (F.col("phraseness").isNull() | (F.col("phraseness") >= L.MIN_PHRASENESS))).drop("__fine").withColumn("salience", salience())
    df = df.withColumn("salience_rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("salience"), "first_seen")))
    return df.where(F.col("salience_rank") <= L.MAX_VOCAB).withColumn("phraseness", F.coalesce("phraseness", F.lit(1.0)))


def tfidf(vocab: DataFrame, *keep: str) -> DataFrame:
    """group_id, doc_idx, term, df, idf, tfidf over the terms of vocab, and columns of vocab to keep."""
    idf = (F.ln((F.col("comp_count") + 2) / (F.col("df") + 1)) + 1).alias("idf")
    df = vocab.select("group_id", "term", "df", idf, *keep, F.explode("weights").alias("w")).withColumns({"doc_idx": F.col("w.doc_idx"), "weight10": F.col("w.weight10")})
    return df.select(*KEY, "term", "df", "idf", *keep, (F.col("weight10") / F.max("weight10").over(Window.partitionBy(*KEY)) * F.col("idf")).alias("tfidf"))


def status() -> Column:
    t, s, cov = F.col("target_strength"), F.col("comp_strength"), F.col("coverage")
    return (
        F.when(F.col("comp_count") == 0, F.when(t > 0.35, "primary").otherwise("secondary")).when((t == 0) & (cov >= 0.5), "missing").when((t == 0) & (cov > 0), "absent")
        .when(cov == 0, "unique").when(t < s * 0.55, "underused").when(t >= s, "defend").otherwise("competitive")
    )


# Labels and tones of a keyword's status.
STATUS = {
    "missing": ("Missing", "critical"), "absent": ("Not used", "warning"), "underused": ("Underused", "warning"), "competitive": ("Competitive", "ok"),
    "defend": ("Your strength", "good"), "unique": ("Unique to you", "info"), "primary": ("Primary", "good"), "secondary": ("Secondary", "info"),
}


def scored(vocab: DataFrame) -> DataFrame:
    """Coverage, strengths, demand, gap, score, status and rank of each vocabulary term."""
    c, words = F.col("comp_count"), F.size(F.split("term", " "))
    df = vocab.withColumns({
        "words": words, "coverage": F.when(c > 0, F.col("comp_df") / c).otherwise(0.0), "comp_strength": F.when(F.col("comp_df") > 0, F.col("comp_sum") / F.col("comp_df")).otherwise(0.0), "target_strength": F.col("target_w"),
    })
    df = df.withColumn("demand", F.when(c > 0, 0.6 * F.col("coverage") + 0.4 * F.col("comp_strength")).otherwise(F.col("target_strength")))
    df = df.withColumn("gap", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("demand") - F.col("target_strength"))))
    special = F.when(words == 1, 0.82).when(words == 2, 1.0).otherwise(0.94)
    df = df.withColumn("score", F.floor(F.round((0.55 * F.col("demand") + 0.45 * F.col("gap")) * special * 100, 9) + 0.5).cast("int"))
    df = df.withColumns({"status": status(), "boilerplate": F.col("term").isin(*L.BOILERPLATE)})
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("score"), "salience_rank")))


def placements(term: Column, target: Column) -> Column:
    """Where the target page lacks the term; target: struct of title, h1, meta_description, h2."""
    lacks = lambda k: ~F.contains(F.lower(F.coalesce(target[k], F.lit(""))), term)
    each = [("title", "title"), ("h1", "h1"), ("meta_description", "meta description"), ("h2", "a subheading")]
    return F.filter(F.array(*(F.when(lacks(k), F.lit(v)) for k, v in each)), lambda x: x.isNotNull())


def targets(docs: DataFrame) -> DataFrame:
    """What later steps need of each group's target page."""
    parts = F.struct("title", F.col("fields.h1").alias("h1"), "meta_description", F.col("fields.h2").alias("h2"), "hostname")
    df = docs.groupBy("group_id").agg(F.max(F.when(F.col("doc_idx") == 0, parts)).alias("target"), (F.count("*") - 1).alias("rivals"))
    return df.where("target is not null")


def keywords(docs: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    """The keyword table of every group. docs: group_id, doc_idx, title, meta_description, hostname, fields."""
    prof = profile(docs) if prof is None else prof
    vocab = vocabulary(candidates(prof), group_sizes(docs))
    rest = [c for c in vocab.columns if c not in ("group_id", "term", "weights")]
    df = tfidf(vocab.withColumn("row", F.struct(*rest)), "row").groupBy("group_id", "term").agg(F.first("row").alias("row"), F.max("idf").alias("idf"), F.coalesce(F.max(F.when(F.col("doc_idx") == 0, F.col("tfidf"))), F.lit(0.0)).alias("tfidf"),
        F.sort_array(F.collect_list(F.when(F.col("doc_idx") > 0, F.struct("doc_idx", "tfidf")))).alias("others"))
    df = scored(df.select("group_id", "term", "row.*", "idf", "tfidf", "others")).join(targets(docs).drop("rivals"), "group_id", "left")
    of = lambda i: F.coalesce(F.get(F.filter("others", lambda o: o["doc_idx"] == i), F.lit(0))["tfidf"], F.lit(0.0))
    others = F.when(F.col("comp_count") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("comp_count"))), of)).otherwise(F.array().cast("array<double>"))
    return df.withColumns({"placements": placements(F.col("term"), F.col("target")), "competitor_tfidf": others}).drop("target", "others")
