"""Chat and mail texts: mark-up, mentions, banners, tagged blocks and ids inside JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_blocks(text: Column, tags: list[str]) -> Column:
    """The text without the named tagged blocks and what they hold."""
    for tag in tags:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def chat_text(messages: DataFrame, users: DataFrame) -> DataFrame:
    """id, text of (id, text) chat messages: links as their labels or addresses, mentions as names of (user, name)."""
    plain = F.regexp_replace(F.regexp_replace("text", r"<(https?://[^|>]+)\|([^>]+)>", "$2"), r"<(https?://[^>]+)>", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"<#\w+\|([^>]+)>", "#$1"), r"<!(here|channel|everyone)[^>]*>", "@$1")
    rows = messages.select("id", plain.alias("text"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"<@(\w+)(?:\|[^>]*)?>"), F.lit(1))).alias("mentioned"))
    named = rows.select("id", F.explode("mentioned").alias("user")).join(users, "user").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("user", "name"))).alias("names"))
    joined = rows.join(named, "id", "left")
    put = F.aggregate("mentioned", F.col("text"), lambda t, u: F.regexp_replace(t, F.concat(F.lit("<@"), u, F.lit(r"(?:\|[^>]*)?>")), F.concat(F.lit("@"), F.coalesce(F.try_element_at("names", u), u))))
    return joined.select("id", F.replace(F.replace(F.replace(put, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")).alias("text"))


def mail_body(text: Column) -> Column:
    """A mail's own words: the banner for outside senders, the quoted mails below and the signature dropped."""
    own = F.regexp_replace(text, r"(?im)^\s*(?:caution|warning)?:?\s*this (?:e-?mail|message) (?:originated|came) from outside.*$", "")
    own = F.element_at(F.split(own, r"(?m)^(?:-{2,}\s*Original Message\s*-{2,}|From: .+|On .+ wrote:)\s*$", 2), 1)
    return F.regexp_replace(F.element_at(F.split(own, r"(?m)^-- ?$", 2), 1), r"^\s+|\s+$", "")


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts).cast("binary")), 1, 12)


def stored_quotes(items: Column, verdicts: Column) -> Column:
    """Items (text, quote) whose quote was not found lose it; verdicts stand in the same order."""
    return F.zip_with(items, verdicts, lambda i, v: F.struct(i["text"].alias("text"), F.when(v.isNotNull(), i["quote"]).alias("quote")))


def remap_ids(value, mapping: dict[str, str]):
    """JSON with each string, key or value, that is an id replaced by what it maps to; parts of strings stay."""
    if isinstance(value, dict):
        return {mapping.get(k, k): remap_ids(v, mapping) for k, v in value.items()}
    if isinstance(value, list):
        return [remap_ids(v, mapping) for v in value]
    return mapping.get(value, value) if isinstance(value, str) else value


def remapped(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Rows with the ids in a column of JSON text replaced by (id, survivor); each row meets only the ids it holds."""
    found = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r'"([^"\\]+)"'), F.lit(1)))).alias("_held"))
    own = found.join(mapping.select(F.col("id").alias("_held"), "survivor"), "_held").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("_held", "survivor"))).alias("_map"))

    @F.pandas_udf("string")
    def replace(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([t if not m else json.dumps(remap_ids(json.loads(t), dict(m)), separators=(", ", ": ")) for t, m in zip(texts, maps, strict=True)], dtype=object)

    return rows.join(own, "id", "left").withColumn(column, F.when(F.col("_map").isNull(), F.col(column)).otherwise(replace(column, "_map"))).drop("_map")
