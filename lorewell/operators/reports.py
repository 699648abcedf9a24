"""Lines and rows of reports: attention, packets, lessons, rankings, and small keyed states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_sentence


def percent(column: str) -> Column:
    return F.concat(F.bround(F.col(column) * 100).cast("long").cast("string"), F.lit("%"))


def attention_lines(slices: DataFrame) -> DataFrame:
    """run_id, position, line of measured slices (ledger.slice_metrics, with name, strategy, origin)."""
    number = lambda c: F.col(c).cast("string")
    origin = F.when(F.coalesce("origin", F.lit("explorer")) != "explorer", F.concat(F.lit(" ["), "origin", F.lit("]"))).otherwise("")
    name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise("(unnamed)")
    line = F.concat(
        F.lit("- **"), name, F.lit("**"), origin, F.lit(" — "), F.coalesce("strategy", F.lit("?")), F.lit("; "), number("resolved"), F.lit("/"), number("requested"), F.lit(" memories, arrivals "), percent("arrival_share"),
        F.lit(", "), number("source_types"), F.lit(" source type(s) ("), "dominant_source", F.lit(" "), percent("concentration"), F.lit("), episodic "), percent("episodic_share"), F.lit(", parents "), number("distinct_parents"), F.lit(", revisit "), percent("revisit_share"),
    )
    return slices.select("run_id", "position", line.alias("line"))


def record_flags() -> Column:
    """`D2 Q1 C P3 !` of a skim (decisions, questions, contradiction, people, unverified): what applies, `-` for none."""
    count = lambda letter, c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.lit(letter), F.col(c).cast("string")))
    parts = F.array_compact(F.array(count("D", "decisions"), count("Q", "questions"), F.when(F.col("contradiction"), "C"), count("P", "people"), F.when(F.coalesce("unverified", F.lit(0)) > 0, "!")))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("-")


def inventory_lines(records: DataFrame) -> DataFrame:
    """id, line of skimmed rows, with the cluster where there is one."""
    cluster = F.when(F.coalesce("cluster_id", F.lit("")) != "", F.concat(F.lit(" ["), "cluster_id", F.lit("]"))).otherwise("")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    line = F.concat(F.col("id").cast("string"), F.lit(" | "), "channel", F.lit(" | S"), number("salience"), F.lit(" N"), number("novelty"), F.lit(" | "), record_flags(), F.lit(" | "), F.coalesce("summary", F.lit("")), cluster)
    return records.select("id", line.alias("line"))


def packet_entries(wanted: DataFrame, rows: DataFrame, cap: int = 4000) -> DataFrame:
    """run_id, id, title, type, content of the wanted rows (run_id, id) that there are: long texts are cut and marked so."""
    cut = F.length("content") > cap
    content = F.when(cut, F.concat(F.left("content", F.lit(cap)), F.lit(" …[truncated]"))).otherwise(F.coalesce("content", F.lit("")))
    return wanted.join(rows, "id").select("run_id", "id", "title", "type", content.alias("content"))


def lessons(rejections: DataFrame, per_cycle: int, characters: int) -> DataFrame:
    """run_id, section of the newest runs' rejections (run_id, at, position, strategy, reason): at most `per_cycle` of each run,
    each by its reason's first sentence; whole runs, newest first, as long as all are within so many characters.

    Sections are short; a row for each run goes through the window that adds up their lengths.
    """
    own = Window.partitionBy("run_id").orderBy("position", "strategy")
    kept = rejections.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_cycle)
    line = F.concat(F.lit("- "), "strategy", F.lit(": "), first_sentence(F.col("reason")))
    sections = kept.groupBy("run_id").agg(F.max("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda s: s["line"]), "\n").alias("section"))
    newest = Window.orderBy(F.desc("at"), F.desc("run_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sections.withColumn("_running", F.sum(F.length("section") + 1).over(newest)).where(F.col("_running") <= characters).select("run_id", "section")


def edited(items: DataFrame, answer: DataFrame, most: int = 5, headline: int = 120) -> DataFrame:
    """place, idx, headline of a ranking: of the editor's entries (position, idx, headline) those that name an item, each item
    once, in order; where none does, the items in their own order. items: (idx, title)."""
    first = answer.where("idx IS NOT NULL").groupBy("idx").agg(F.min("position").alias("position"), F.min_by("headline", "position").alias("headline"))
    told = items.join(first, "idx").select("idx", "position", F.left(F.trim(F.coalesce("headline", "title")), F.lit(headline)).alias("headline"))
    plain = items.select("idx", F.col("idx").alias("position"), F.left("title", F.lit(headline)).alias("headline"))
    none = told.agg((F.count("*") == 0).alias("_none"))
    both = told.withColumn("_plain", F.lit(False)).unionByName(plain.withColumn("_plain", F.lit(True))).join(F.broadcast(none)).where(F.col("_plain") == F.col("_none"))
    return both.withColumn("place", F.row_number().over(Window.orderBy("position", "idx"))).where(F.col("place") <= most).select("place", "idx", "headline")


def attempts(log: DataFrame, batches: DataFrame, bound: int = 3) -> DataFrame:
    """task, key, count, abandoned of each task's frozen batch (task, contract, cursor, last_turn): failed tries of exactly that
    batch count, those of an earlier one don't; at the bound it is given up. log: (task, key, failed)."""
    key = F.concat_ws("|", "contract", F.coalesce("cursor", F.lit("")), "last_turn")
    counts = log.where("failed").groupBy("task", "key").agg(F.count("*").alias("count"))
    own = batches.select("task", key.alias("key")).join(counts, ["task", "key"], "left")
    return own.select("task", "key", F.coalesce("count", F.lit(0).cast("long")).alias("count")).withColumn("abandoned", F.col("count") >= bound)


def playlist(lines: DataFrame, gone: tuple[str, ...] = ("[Deleted video]", "[Private video]", "[Unavailable video]")) -> DataFrame:
    """id, title, url, duration, channel of JSON lines (line): what is no JSON or has no id is left out, and placeholders."""
    of = lambda k: F.get_json_object("line", f"$.{k}")
    rows = lines.select(of("id").alias("id"), of("title").alias("title"), of("duration").cast("double").alias("duration"), of("channel").alias("channel"), of("uploader").alias("uploader"))
    some = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    named = rows.where("id IS NOT NULL AND id <> ''").withColumn("title", some("title", "id")).where(~F.col("title").isin(*gone))
    return named.select("id", "title", F.concat(F.lit("https://www.youtube.com/watch?v="), "id").alias("url"), "duration", F.coalesce(some("channel", "uploader"), F.lit("")).alias("channel"))


def new_items(candidates: DataFrame, stored: DataFrame, key: str, threshold: float = 0.88) -> DataFrame:
    """candidate_id, similarity of candidates (candidate_id, key, embedding) that neither a stored row of their key nor an
    earlier candidate of it resembles; a candidate that is itself left out still counts as earlier."""
    from .vectors import met_in_key

    met = candidates.select("candidate_id").distinct().join(met_in_key(candidates, stored, key, threshold), "candidate_id", "left")
    found = met.select("candidate_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("twin", F.lit(False)).alias("_twin"))
    return found.where((F.col("similarity") < threshold) & ~F.col("_twin")).drop("_twin")
