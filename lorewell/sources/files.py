"""Readers of event feeds, markdown stores, crawler logs, subtitles, office packages and databases."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import header

EVENT = "id string, timestamp string, event_type string, source string, summary string, details struct<full_message: string, context: map<string, string>, importance: string, choices: array<struct<label: string>>>"
INTERACTION = "feed_event_id string, interaction_type string, timestamp string"


def feed_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSONL feed, one object a line; lines that aren't objects are left out. Times that can't be read are null."""
    rows = spark.read.schema(EVENT).json(path).where("id IS NOT NULL")
    return rows.withColumn("at", F.try_to_timestamp("timestamp"))


def feed_interactions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(INTERACTION).json(path).where("feed_event_id IS NOT NULL")
    return rows.withColumn("at", F.try_to_timestamp("timestamp"))


def event_markdown(events: DataFrame) -> DataFrame:
    """id, markdown, tags: an event as text, the same for the same event."""
    choices = F.array_join(F.transform("details.choices", lambda c: F.concat(F.lit("- "), c["label"])), "\n")
    parts = F.array_compact(F.array(F.concat(F.lit("# "), F.col("summary")), F.col("details.full_message"), F.when(choices != "", F.concat(F.lit("## Choices\n"), choices))))
    tags = F.array_compact(F.array("event_type", "source", F.concat(F.lit("importance-"), F.col("details.importance"))))
    return events.select("id", F.array_join(parts, "\n\n").alias("markdown"), tags.alias("tags"))


def engagement(events: DataFrame, interactions: DataFrame) -> DataFrame:
    """Events with how they were met; those without an interaction have none."""
    met = interactions.groupBy("feed_event_id").agg(F.count("*").alias("interactions"), F.array_sort(F.collect_set("interaction_type")).alias("types"), F.max("at").alias("last_at"))
    return events.join(met, events.id == met.feed_event_id, "left").drop("feed_event_id")


def markdown_index(spark: SparkSession, path: str) -> DataFrame:
    """url, title, line of a table in markdown: the first http address of each row; of an address that comes twice, the first row."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value"))
    rows = lines.where(F.ltrim("value").startswith("|")).select("line", F.regexp_extract("value", r"(https?://[^\s)|>\]]+)", 1).alias("url"), F.trim(F.regexp_extract("value", r"^\s*\|\s*\[?([^|\]]*)", 1)).alias("title"))
    first = Window.partitionBy("url").orderBy("line")
    return rows.where("url <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def markdown_store(spark: SparkSession, path: str) -> DataFrame:
    """file, url, title, fields, content of markdown documents by their headers; of an address, the first file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    rows = whole.select("file", header(F.col("content")).alias("fields"), "content").withColumn("url", F.coalesce(F.col("fields")["source_url"], F.col("fields")["source"]))
    first = Window.partitionBy("url").orderBy("file")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("file", "url", F.col("fields")["title"].alias("title"), "fields", "content")


def unprocessed(store: DataFrame, index: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """Documents that are not done: all that the index names, and at most so many others, in the order of their files."""
    left = store.join(done.select("url"), "url", "left_anti")
    named = left.join(index.select("url"), "url", "left_semi")
    others = left.join(index.select("url"), "url", "left_anti").orderBy("file").limit(most)
    return named.withColumn("indexed", F.lit(True)).unionByName(others.withColumn("indexed", F.lit(False)))


def crawl_failures(spark: SparkSession, path: str) -> DataFrame:
    """url, kind (auth, timeout or error, the first that holds) from a crawler's log.

    A record begins with its level; the lines behind it are its own, among them a JSON object with the address.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\x1b\[[0-9;]*m", ""), "\n")).alias("n", "line"))
    begins = F.col("line").rlike(r"^\s*(?:WARN|ERROR|INFO)\b")
    numbered = lines.withColumn("record", F.sum(begins.cast("int")).over(Window.partitionBy("file").orderBy("n")))
    records = numbered.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("text")).where(F.col("text").rlike(r"^\s*(?:WARN|ERROR)\b"))
    kind = F.when(F.col("text").rlike(r"(?i)\b(?:401|403|unauthori[sz]ed|forbidden|sign.?in)\b"), 0).when(F.col("text").rlike(r"(?i)tim(?:ed )?.?out"), 1).otherwise(2)
    found = records.select(F.regexp_extract("text", r'"url"\s*:\s*"([^"]+)"', 1).alias("url"), kind.alias("k")).where("url <> ''")
    names = F.array(*map(F.lit, ("auth", "timeout", "error")))
    return found.groupBy("url").agg(F.min("k").alias("k")).select("url", F.element_at(names, F.col("k") + 1).alias("kind"))


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """file, text of WEBVTT files: cues and tags dropped, a line that repeats the one before it once."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "raw"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]+>", ""), r"\s+", " "))
    cue = F.col("raw").contains("-->") | F.trim("raw").rlike(r"^(?:WEBVTT|Kind:|Language:|NOTE|STYLE)")
    kept = lines.where(~cue).select("file", "n", plain.alias("line")).where("line <> ''")
    fresh = kept.withColumn("before", F.lag("line").over(Window.partitionBy("file").orderBy("n"))).where(~F.col("line").eqNullSafe(F.col("before")))
    return fresh.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("text"))


def job_statuses(spark: SparkSession, path: str) -> DataFrame:
    """file, job, state, exit_code, consecutive_failures, readable of job status files."""
    kind = "job string, state string, exit_code int, consecutive_failures int, _corrupt_record string"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select("*", F.input_file_name().alias("file"))
    return rows.select("file", "job", "state", "exit_code", "consecutive_failures", F.col("_corrupt_record").isNull().alias("readable"))


def bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """url, name, folder of a browser's tree of bookmarks, whatever its depth."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["value"]:
                stack = [(node, "") for node in (json.loads(text).get("roots") or {}).values() if isinstance(node, dict)]
                while stack:
                    node, folder = stack.pop()
                    if node.get("url"):
                        found.append((node["url"], node.get("name"), folder))
                    stack += [(child, f"{folder}/{node.get('name', '')}") for child in node.get("children") or []]
            yield pd.DataFrame(found, columns=["url", "name", "folder"])

    return spark.read.text(path, wholetext=True).mapInPandas(walk, "url string, name string, folder string")


WORD, SHEET, SLIDE = ("{http://schemas.openxmlformats.org/" + s + "}" for s in ("wordprocessingml/2006/main", "spreadsheetml/2006/main", "drawingml/2006/main"))


def package_text(data: bytes) -> str:
    """Text of a docx, xlsx or pptx package: headings with #, table rows with bars, slides in their order."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        root = lambda name: ElementTree.fromstring(z.read(name))
        number = lambda name: int(re.sub(r"\D", "", name.rsplit("/", 1)[1]) or 0)
        if "word/document.xml" in names:
            body = root("word/document.xml").find(f"{WORD}body")
            text = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD}t"))
            for node in body if body is not None else ():
                if node.tag == f"{WORD}tbl":
                    out += ["| " + " | ".join(text(c) for c in row.iter(f"{WORD}tc")) + " |" for row in node.iter(f"{WORD}tr")]
                else:
                    style = node.find(f"{WORD}pPr/{WORD}pStyle")
                    level = re.match(r"Heading(\d)", style.get(f"{WORD}val", "") if style is not None else "")
                    out.append(("#" * int(level[1]) + " " if level else "") + text(node))
        elif "xl/workbook.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in root("xl/sharedStrings.xml").iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in names else []
            for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
                for row in root(name).iter(f"{SHEET}row"):
                    cells = []
                    for c in row.iter(f"{SHEET}c"):
                        value = c.find(f"{SHEET}v")
                        raw = (value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{SHEET}t"))) or ""
                        cells.append(shared[int(raw)] if c.get("t") == "s" and raw else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if c.get("t") == "b" else raw)
                    out.append("| " + " | ".join(cells) + " |")
        else:
            for name in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
                out.append(f"## Slide {number(name)}")
                out += ["".join(t.text or "" for t in p.iter(f"{SLIDE}t")) for p in root(name).iter(f"{SLIDE}p")]
    return "\n".join(line for line in out if line.strip())


def office_packages(spark: SparkSession, path: str) -> DataFrame:
    """file, text of office packages; a file that can't be read has no text."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        def one(data: bytes) -> str | None:
            try:
                return package_text(data)
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
                return None

        return contents.map(one)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), read("content").alias("text"))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """Rows of a table in SQLite files; each file is one task's work. Columns that a file lacks are null."""
    names = [f.split()[0] for f in schema.split(",")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(data)
                    f.flush()
                    with sqlite3.connect(f.name) as db:
                        have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
                        columns = ", ".join(f'"{n}"' if n in have else f'NULL AS "{n}"' for n in names)
                        if have:
                            yield from pd.read_sql_query(f'SELECT {columns} FROM "{table}"', db, chunksize=10_000)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)
