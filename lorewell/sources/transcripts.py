"""Conversations: turns in order, the gate that decides whether one is worth keeping, and markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A conversation needs so many questions, characters, and words in one paragraph of a reply.
ASKED, CHARACTERS, PARAGRAPH = 2, 200, 50


def gate(turns: DataFrame) -> DataFrame:
    """conv_id, asked, characters, worth, from (conv_id, turn, role, text)."""
    spoken = F.when(F.col("role").isin("user", "assistant"), F.length("text"))
    reply = (F.col("role") == "assistant") & F.exists(F.split("text", "\n\n"), lambda p: F.regexp_count(p, F.lit(r"[^\s]+")) >= PARAGRAPH)
    sums = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.sum(spoken).alias("characters"), F.bool_or(reply).alias("deep"))
    worth = (F.col("asked") >= ASKED) & (F.coalesce("characters", F.lit(0)) >= CHARACTERS) & F.coalesce("deep", F.lit(False))
    return sums.select("conv_id", "asked", "characters", worth.alias("worth"))


def automated(turns: DataFrame) -> DataFrame:
    """conv_ids whose first question is a machine's: a JSON object, or none at all."""
    first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    everyone = turns.select("conv_id").distinct().join(first, "conv_id", "left")
    return everyone.where(F.col("first").isNull() | F.ltrim("first").startswith("{")).select("conv_id")


def markdown(turns: DataFrame) -> DataFrame:
    """conv_id, markdown: what was asked and answered, in order."""
    said = turns.where(F.col("role").isin("user", "assistant"))
    line = F.concat(F.lit("**"), F.col("role"), F.lit(":** "), F.trim("text"))
    ordered = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return ordered.select("conv_id", F.array_join(F.transform("lines", lambda s: s["line"]), "\n\n").alias("markdown"))


LINE = "kind string, data struct<meta: struct<timestamp: double>, content: array<struct<kind: string, data: string>>>"


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """session, turn, role, text, started_at of JSONL transcripts: prompts are the user's, messages the assistant's.

    Lines of tools and lines that aren't JSON are passed over. A session is a file; its start is the first time that
    any of its lines has.
    """
    rows = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    parsed = rows.select("file", "at", F.from_json("value", LINE).alias("j"))
    parts = F.filter(F.transform(F.filter(F.col("j.data.content"), lambda c: c["kind"] == "text"), lambda c: F.trim(c["data"])), lambda t: t != "")
    role = F.when(F.col("j.kind") == "Prompt", "user").when(F.col("j.kind") == "AssistantMessage", "assistant")
    start = parsed.where("j.data.meta.timestamp IS NOT NULL").groupBy("file").agg(F.min_by(F.col("j.data.meta.timestamp"), "at").alias("started_at"))
    turns = parsed.select("file", "at", role.alias("role"), F.array_join(parts, "\n\n").alias("text")).where("role IS NOT NULL AND text <> ''")
    name = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1)
    return turns.join(start, "file", "left").select(name.alias("session"), F.col("at").alias("turn"), "role", "text", "started_at")
