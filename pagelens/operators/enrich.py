"""Deterministic part of model enrichment: prompts, reply parsing, validation and error classes.

The call itself is a function that the caller supplies; nothing here reaches the network.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls as U

# Characters of a page's text, terms and characters of a summary; the providers, of which the first is the default.
SHORT_BODY, LONG_BODY, TERMS, MAX_SUMMARY = 7000, 20_000, 35, 600
PROVIDERS = ("managed", "openai", "groq", "claude")
# Heading and instruction by action.
ACTIONS = {
    "choose_provider": ("Built-in OpenAI is unavailable", "Choose OpenAI, Groq, or Claude and provide your own API key."),
    "replace_key": ("Check your API key", "The provider rejected this key. Copy a valid key from its official console and try again."),
    "permissions": ("Provider permission required", "Check that the key can use the selected model and web search, then retry."),
    "billing": ("Check provider billing", "Restore API credits or raise the provider limit, then retry."),
    "wait": ("Provider is rate limited", "Wait {} seconds before trying again."),
    "retry": ("Temporary provider failure", "Wait a moment, check your connection, and try again."),
}


def prompt(page: Column, terms: Column, rivals: Column, body: int = LONG_BODY) -> Column:
    """What a model is told about a page (struct of url, title, meta_description, h1, h2, body); the body is cut at SHORT_BODY or LONG_BODY."""
    lines = [
        ("Target URL: ", page["url"]), ("Title: ", page["title"]), ("Meta description: ", page["meta_description"]), ("H1: ", page["h1"]), ("H2s: ", page["h2"]), ("Page text: ", F.left(page["body"], F.lit(body))),
        ("Algorithmic keyword candidates: ", F.array_join(F.slice(terms, 1, TERMS), ", ")), ("Manual competitor URLs: ", F.coalesce(F.nullif(F.array_join(rivals, ", "), F.lit("")), F.lit("none"))),
    ]
    return F.concat_ws("\n", *(F.concat(F.lit(name), F.coalesce(value, F.lit(""))) for name, value in lines))


def json_part(reply: Column) -> Column:
    """From the first brace to the last, if that is JSON; else null."""
    a, b = F.instr(reply, "{"), F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    part = F.when((a > 0) & (F.instr(reply, "}") > 0) & (b > a), F.substr(reply, a, b - a + 1))
    return F.when(F.try_parse_json(part).isNotNull(), part)


def reply_text(direct: Column, parts: Column, kind: str = "output_text") -> Column:
    """The direct text if there is one, else the texts of the parts of that type joined by lines."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == kind), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.when(F.coalesce(direct, F.lit("")) != "", direct).otherwise(F.coalesce(F.array_join(texts, "\n"), F.lit("")))


def summary(text: Column, provider: Column) -> Column:
    """The summary of a reply; two providers' are cut."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(provider.isin("groq", "claude"), F.left(whole, F.lit(MAX_SUMMARY))).otherwise(whole)


def valid_competitors(raw: DataFrame, most: int = 5, slice_first: bool = True) -> DataFrame:
    """raw: page_url, pos, url (as the model gave it). Strictly normalised, without the page's own host.

    slice_first takes the first `most` before filtering; else hosts are deduplicated and cut after it.
    """
    df = raw.withColumn("norm", U.normalized_strict(F.col("url")))
    fine = F.col("norm").isNotNull() & (U.hostname(F.col("norm")) != U.hostname(F.col("page_url")))
    at = Window.partitionBy("page_url").orderBy("pos")
    if slice_first:
        return df.withColumn("r", F.row_number().over(at)).where((F.col("r") <= most) & fine).drop("r")
    df = df.where(fine).withColumn("host", U.hostname(F.col("norm")))
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("page_url", "host").orderBy("pos"))).where("r = 1")
    return df.withColumn("r", F.row_number().over(at)).where(F.col("r") <= most).drop("r", "host")


def first_terms(raw: DataFrame, most: int = 12) -> DataFrame:
    """raw: page_url, pos, term. Trimmed and in lower case, without empty ones; the first of equal ones, at most `most`."""
    df = raw.withColumn("term", F.lower(U.trimmed(F.col("term")))).where("term <> ''")
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("page_url", "term").orderBy("pos"))).where("r = 1")
    return df.withColumn("r", F.row_number().over(Window.partitionBy("page_url").orderBy("pos"))).where(F.col("r") <= most).drop("r")


def seconds_to_wait(header: Column, most: int, default: int) -> Column:
    """The seconds of a retry-after header, or the default, between 1 and `most`."""
    return F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.coalesce(F.nullif(F.trim(header), F.lit("")).cast("double"), F.lit(float(default)))))


def retry_delay(header: Column) -> Column:
    """Before the next attempt of a call that was told to come back later."""
    return seconds_to_wait(header, 15, 3)


def retried(provider: Column, status: Column, attempt: Column) -> Column:
    """Whether a call is made again; attempts count from 0."""
    return (provider == "groq") & (status == 429) & (attempt < 2)


def provider(wanted: Column) -> Column:
    return F.when(wanted.isin(*PROVIDERS), wanted).otherwise(PROVIDERS[0])


def failure(call: DataFrame) -> DataFrame:
    """Adds action, message and retry_after of a failed call; action is null where the call did not fail.

    call: provider, status (null if there was no response), error (name of what was thrown, else null),
    code and detail (of the response's error), retry_after_header.
    """
    c = F.col
    own, status, detail = F.when(c("provider") == "groq", "Groq").when(c("provider") == "claude", "Claude").otherwise("OpenAI"), c("status"), F.coalesce("detail", F.lit(""))
    openai, groq, claude = (c("provider").isin("managed", "openai")), c("provider") == "groq", c("provider") == "claude"
    wait = seconds_to_wait(c("retry_after_header"), 60, 10)
    unnamed = F.when(c("provider") == "managed", "choose_provider").otherwise("retry")
    as_said = F.when(detail != "", detail).otherwise(F.concat(own, F.lit(" returned HTTP "), status.cast("string"), F.lit(".")))
    keyless = {"managed": "OpenAI is not configured for this deployment.", "openai": "Enter an OpenAI API key.", "groq": "Enter a valid Groq API key.", "claude": "Enter a valid Claude API key."}
    # (test, action, message, seconds); the first that holds. Messages and actions.
    cases = [((c("provider") == k) & (c("error") == "NoKey"), F.lit("choose_provider" if k == "managed" else "replace_key"), F.lit(text), 0) for k, text in keyless.items()]
    cases += [
        (~openai & (c("error") == "TimeoutError"), F.lit("retry"), F.concat(own, F.lit(" took too long to respond. Wait a moment and try again.")), 0),
        (~openai & c("error").isNotNull(), F.lit("retry"), F.concat(own, F.lit(" could not be reached. Check your connection and try again.")), 0),
        (c("error").isNotNull(), unnamed, F.coalesce(F.nullif(c("detail"), F.lit("")), F.lit("AI analysis failed.")), 0),
        (status.between(200, 299), F.lit(None).cast("string"), F.lit(None).cast("string"), 0),
        (groq & (status == 401), F.lit("replace_key"), F.lit("That Groq API key is invalid. Check it and enter it again."), 0),
        (status == 401, F.lit("replace_key"), F.concat(F.lit("That "), own, F.lit(" API key is invalid. Check it and try again.")), 0),
        (groq & (status == 403), F.lit("permissions"), F.lit("This Groq key cannot use the selected model. Check the key’s project permissions."), 0),
        (claude & (status == 403), F.lit("permissions"), F.lit("This Claude key does not have permission to use Sonnet or web search."), 0),
        (status == 403, F.lit("permissions"), F.lit("This OpenAI key does not have permission to use the requested model."), 0),
        (groq & (status == 429), F.lit("wait"), F.concat(F.lit("Groq’s free limit is busy. Wait "), wait.cast("int").cast("string"), F.lit(" seconds, then try again.")), wait),
        (status == 429, F.lit("wait"), F.concat(own, F.lit(" is rate limited. Wait a moment and try again.")), 20),
        (groq & (status == 400) & (c("code") == "blocked_api_access"), F.lit("billing"), F.lit("Groq blocked API access because of an account or spending limit. Check Groq Billing and Limits."), 0),
        (groq & (status >= 500), F.lit("wait"), F.lit("Groq is temporarily unavailable. Wait a minute and try again."), 60),
        (groq, F.lit("replace_key"), F.lit("Groq rejected this request. Check the key and try again."), 0),
        (claude & (status == 400) & detail.rlike("(?i)credit|billing"), F.lit("billing"), F.lit("Claude needs available API credits. Check Billing in Claude Console."), 0),
    ]
    out = F.struct(F.lit("retry").alias("action"), as_said.alias("message"), F.lit(0.0).alias("retry_after"))
    for test, action, message, seconds in reversed(cases):
        seconds = seconds.cast("double") if isinstance(seconds, Column) else F.lit(float(seconds))
        out = F.when(F.coalesce(test, F.lit(False)), F.struct(action.alias("action"), message.alias("message"), seconds.alias("retry_after"))).otherwise(out)
    return call.withColumn("__f", out).select("*", "__f.*").drop("__f")


def advice(action: Column, retry_after: Column) -> Column:
    """Heading and instruction for the user; an unknown action is one to retry."""
    seconds = F.when(F.coalesce(retry_after, F.lit(0.0)) == 0, "10").otherwise(retry_after.cast("int").cast("string"))
    text = lambda pair: F.struct(F.lit(pair[0]).alias("heading"), F.concat(*(seconds if x == "{}" else F.lit(x) for x in re.split(r"(\{\})", pair[1]))).alias("instruction"))
    out = text(ACTIONS["retry"])
    for name, pair in ACTIONS.items():
        out = F.when(action == name, text(pair)).otherwise(out)
    return out


def shown(page: DataFrame) -> DataFrame:
    """What the web page shows: a model's keywords and competitors where it gave any, else the page's own.

    page: ai (null, or a struct of error, provider, keywords (term, intent) and competitors (name, url)),
    keywords (term, status), rivals (addresses given by hand). Adds source, keyword_rows, competitor_rows.
    """
    ai = F.when(F.coalesce(F.col("ai.error"), F.lit("")) == "", F.col("ai"))
    named = F.when(ai["provider"] == "groq", "Groq").when(ai["provider"] == "claude", "Claude").otherwise("OpenAI")
    theirs = F.transform(ai["keywords"], lambda k: F.struct(k["term"].alias("term"), F.coalesce(k["intent"], F.lit("")).alias("note")))
    own = F.transform("keywords", lambda k: F.struct(k["term"].alias("term"), F.coalesce(k["status"], F.lit("")).alias("note")))
    by_hand = F.transform("rivals", lambda u: F.struct(u.alias("name"), u.alias("url"), F.lit("Added manually").alias("reason")))
    found = F.transform(ai["competitors"], lambda r: F.struct(F.coalesce(r["name"], r["url"]).alias("name"), r["url"].alias("url"), F.coalesce(r["reason"], F.lit("")).alias("reason")))
    return page.withColumns({
        "source": F.when(ai.isNotNull(), F.concat(named, F.lit(" enhanced"))).otherwise("Page analysis"),
        "keyword_rows": F.when(F.size(F.coalesce(theirs, F.array())) > 0, theirs).otherwise(own), "competitor_rows": F.coalesce(found, by_hand),
    })


def enriched(prompts: DataFrame, call: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """prompts with `reply`, from the caller's function, run in batches on the executors, and `error`, the name and text of what it raised."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch:
                try:
                    out.append((call(p), None))
                except Exception as e:  # noqa: BLE001  the caller's function may raise anything; it is told in the row
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["reply", "error"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    df = prompts.withColumn("__r", F.pandas_udf(run, "reply string, error string")(column))
    return df.withColumns({"reply": F.col("__r.reply"), "error": F.col("__r.error")}).drop("__r")
