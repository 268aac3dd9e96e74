"""Context packing, citations, snippets, prices and replies of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET = 60_000
# Fixed value: what stands between the entries of a context.
BETWEEN = "\n\n---\n\n"


def pack_context(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Hits ``(query_id, rank, source, content)`` that fit the budget of characters, with ``marker`` and ``entry``.

    The first entry always stays; the list ends at the first that does not fit.
    An entry's length includes its header; what separates entries is free.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    entry = F.concat(F.lit("["), F.row_number().over(order).cast("string"), F.lit("] "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = hits.withColumn("marker", F.row_number().over(order)).withColumn("entry", entry)
    used = F.sum(F.length("entry")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used_chars", used).where((F.col("used_chars") <= budget) | (F.col("marker") == 1))


def context_text(packed: DataFrame) -> DataFrame:
    """The joined context of each query and its estimated tokens (1 at least)."""
    joined = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "entry"))).alias("entries"))
    text = F.array_join("entries.entry", BETWEEN)
    return joined.select("query_id", text.alias("context"), F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long").alias("tokens"))


def source_line(heading: Column, title: Column, page: Column) -> Column:
    """What an entry's header says of its source: the heading, or else the title, and the page (if it has one)."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(" · ", F.coalesce(some(heading), some(title)), F.when(page != 0, F.concat(F.lit("p."), page.cast("string"))))


#: What a model is told of its answer, whatever a tenant's own words; the one before the last holds unless the search is strict, the last one if it is.
RULES = (
    "Base every statement on the numbered passages of the message.",
    "End each sentence with the marker of the passage it rests on, such as [2]; each fact needs one.",
    "Use no marker that the passages do not have.",
    "Put the passages into your own words instead of repeating them.",
    "Where the passages tell only a part, answer that part and name what they leave open.",
    "Where the passages do not tell, say so, name what is missing, and add nothing from elsewhere.",
)


def system_text(own: Column, strict: Column, rules: Sequence[str] = RULES) -> Column:
    """A tenant's own words and the rules for an answer, one a line; ``strict`` chooses between the last two."""
    *always, partly, strictly = (f"- {r}" for r in rules)
    return F.concat(F.trim(own), F.lit("\n\nRules:\n"), F.concat_ws("\n", *map(F.lit, always), F.when(strict, strictly).otherwise(partly)))


def prompts(questions: DataFrame, packed: DataFrame) -> DataFrame:
    """``questions(query_id, text)`` with their contexts -> ``(query_id, prompt, tokens)``; a question without passages has an empty context."""
    asked = questions.join(context_text(packed), "query_id", "left")
    text = F.concat(F.lit("Context passages:\n\n"), F.coalesce("context", F.lit("")), F.lit(f"{BETWEEN}Question: "), F.coalesce("text", F.lit("")))
    return asked.select("query_id", text.alias("prompt"), F.coalesce("tokens", F.lit(1)).cast("long").alias("tokens"))


def citations(answer: Column, n: Column) -> Column:
    """Sorted distinct markers ``[1]`` .. ``[n]`` of an answer."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n))))


def lead(content: Column, limit: int = 240) -> Column:
    """The first sentence, or two if it is short, cut at a word."""
    flat = F.trim(F.regexp_replace(content, r"\s+", " "))
    parts = F.split(flat, r"(?<=[.!?])\s+")
    first = F.get(parts, F.lit(0))
    out = F.when((F.length(first) < 90) & (F.size(parts) > 1), F.concat_ws(" ", first, F.get(parts, F.lit(1)))).otherwise(first)
    return F.when(F.length(out) > limit, F.concat(F.regexp_replace(F.substring(out, 1, limit), r"\s+\S*$", ""), F.lit("…"))).otherwise(out)


def cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls(model, input_tokens, cached_tokens, output_tokens)`` with ``cost_usd`` by ``prices(model, input_rate, output_rate)`` a million tokens.

    Cached input costs a tenth. An unknown model has no cost and is marked.
    """
    joined = calls.join(prices, "model", "left")
    paid = F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_tokens"))
    usd = (paid * F.col("input_rate") + F.col("cached_tokens") * F.col("input_rate") * 0.1 + F.col("output_tokens") * F.col("output_rate")) / 1e6
    return joined.withColumn("cost_usd", usd).withColumn("unknown_model", F.col("input_rate").isNull())


def json_reply(text: Column) -> Column:
    """The JSON value in a model's reply, with or without a fence; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.try_parse_json(F.when(fenced != "", F.trim(fenced)).otherwise(bare))
