"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, WORD, cut

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, EPOCHS, SEED = 1.5, 2.0, "mix-1"
#: Bits of the 60-bit place by which a source is dealt out; each part is added up by itself.
BITS = 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Adds `target` to rows (source, source_size, weight).

    The amount share x (sum of sizes) is dealt out in proportion to the weights; what a source gets above
    epochs x its size goes to the others by weight, until nobody is above. The fixed point has a closed form: in
    the order of cap / weight, the level at source k is (amount - caps before k) / (weights from k on); every
    source before the first whose cap / weight is above its level stands at its cap, the others at that level x
    weight; if there is none, all stand at their caps.
    One row per source goes through the window, not the documents.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    filled = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    ranked = (
        sources.withColumn("_cap", cap)
        .withColumn("_before", F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.col("_before")) / F.col("_weights"))
        .withColumn("_at", F.when(F.col("_cap") > F.col("_level") * F.col("weight"), F.row_number().over(filled)))
        .withColumn("_water", F.min_by("_level", "_at").over(everyone))
    )
    return ranked.withColumn("target", F.least("_cap", F.col("_water") * F.col("weight"))).drop("_cap", "_before", "_weights", "_level", "_at", "_water")


def place(key: Column, seed: str) -> Column:
    """A whole number below 2^60 that follows from the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def shares(sized: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row for each source of rows (source, _place, _size): _source, _source_size, _target, _whole, _edge, _left, _words.

    A source repeats every document _whole times, and those with a place before _edge once more; documents at
    _edge share _left of their _words words. _whole and the extra words add up to the target.
    Sums of parts by place, at most 2^BITS a source, go through windows; of the documents only those of the one
    part in which a source's edge lies.
    """
    part = F.shiftright("_place", 60 - BITS)
    parts = cut(sized.groupBy("source", part.alias("_part")).agg(F.sum("_size").alias("_words")), "parts")
    sources = parts.groupBy("source").agg(F.sum("_words").alias("source_size"))
    number = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int")))
    filled = water_fill(sources, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("_whole", whole).withColumn("_room", (F.floor("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    filled = cut(filled.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_whole", "_room"), "targets")
    of_source = F.col("source").eqNullSafe(F.col("_source"))
    before = lambda over, *order: F.coalesce(F.sum("_words").over(over.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on_edge = (F.col("_before") <= F.col("_room")) & (F.col("_room") < F.col("_before") + F.col("_words"))
    edges = parts.withColumn("_before", before(Window.partitionBy("source"), "_part")).join(filled, of_source).where(on_edge)
    edges = edges.select("_source", F.col("_part").alias("_edge_part"), (F.col("_room") - F.col("_before")).alias("_room"))
    here = sized.join(edges, of_source & (part == F.col("_edge_part"))).groupBy("_source", "_place").agg(F.sum("_size").alias("_words"), F.first("_room").alias("_room"))
    at = here.withColumn("_before", before(Window.partitionBy("_source"), "_place")).where(on_edge)
    at = at.select(F.col("_source").alias("_edge_source"), F.col("_place").alias("_edge"), (F.col("_room") - F.col("_before")).alias("_left"), "_words")
    # written, so that Spark knows its size when it joins it with the documents
    return cut(filled.drop("_room").join(at, F.col("_source").eqNullSafe(F.col("_edge_source")), "left").drop("_edge_source"), "shares")


def _taken(size: Column) -> Column:
    """The words that a document gives: of a source without an edge nothing beyond the whole repetitions."""
    at_edge = F.floor(F.col("_left") * size / F.col("_words"))
    return (F.col("_whole") * size + F.when(F.col("_place") < F.col("_edge"), size).when(F.col("_place") == F.col("_edge"), at_edge).otherwise(0)).cast("long")


def mix_documents(documents: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    A source that repeats r = target / source_size times gives all its documents floor(r) times, and once more
    those that come first in a seeded order of ids, up to the words of the target; only the documents at that edge,
    in general one, give a part. So a source's words are less than one document group's rounding below its target,
    and no document gives more than epochs x its size. A null source is a source of its own, last in order. A
    null or empty text has size 0 and is never taken; a source without words has target 0. Repeated rows have the
    same place and share alike. The sources' table is joined as Spark sees fit: broadcast if it is small, else
    sorted with skewed parts split. Texts are read once.
    """
    sized = cut(documents.select("doc_id", "source", place(F.col("doc_id"), seed).alias("_place"), words(F.col("text")).alias("_size")), "sizes")
    both = sized.join(shares(sized, share, epochs, weights), F.col("source").eqNullSafe(F.col("_source")), "left")
    return both.select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), _taken(F.col("_size")).alias("taken"))


def take(documents: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of the input: each repetition of a document is a row with its whole text.

    It takes the words that mix_documents() tells. Only a document at the edge of its source is cut: the part is
    its beginning, with the white space of its text, and n_chars, if the column is there, is set to its length. Whole
    texts are not shuffled: a row for each source decides.
    """
    sized = cut(documents.select("source", place(F.col("doc_id"), seed).alias("_place"), words(F.col("text")).alias("_size")), "sizes")
    told = documents.select(F.struct(*documents.columns).alias("_row"), "source", place(F.col("doc_id"), seed).alias("_place"), F.col("text").rlike(WORD).alias("_some"))
    dealt = told.join(shares(sized, share, epochs, weights), F.col("source").eqNullSafe(F.col("_source")), "left")
    text = F.col("_row")["text"]
    size = F.when(F.col("_place") == F.col("_edge"), words(text))
    part = F.floor(F.col("_left") * size / F.col("_words"))
    full = F.col("_whole") + F.when(F.col("_place") < F.col("_edge"), 1).otherwise(0)
    copies = F.array_repeat(F.lit(0).cast("long"), F.when(F.col("_some"), full).otherwise(0).cast("int"))
    rows = dealt.withColumn("_rep", F.explode(F.concat(copies, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))))
    piece = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"((?:{SPACE})?{WORD})"), F.lit(1)), F.lit(1), F.col("_rep").cast("int")), "")
    changed = {"text": F.when(F.col("_rep") > 0, piece).otherwise(text)}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col("_rep") > 0, F.length(piece)).otherwise(F.col("_row")["n_chars"]).cast(documents.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in documents.columns])


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || COALESCE(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place FROM documents),
sources AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, [3.0, 1.0, 2.0][((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS weight FROM sources),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    COALESCE(SUM(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    SUM(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed),
levels AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cap / weight, source NULLS LAST) AS k, ((SELECT SUM(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE - before) / weights AS level FROM ranked),
water AS (SELECT ARG_MIN(level, k) AS w FROM levels WHERE cap > level * weight),
targets AS (SELECT source, source_size, LEAST(cap, (SELECT w FROM water) * weight) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
rooms AS (SELECT *, FLOOR(target)::BIGINT - whole * source_size AS room FROM rates),
places AS (SELECT source, place, SUM(size)::BIGINT AS words FROM sized GROUP BY source, place),
running AS (SELECT *, COALESCE(SUM(words) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM places)
SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
  (t.whole * d.size + CASE WHEN r.before + r.words <= t.room THEN d.size WHEN r.before <= t.room AND r.words > 0 THEN FLOOR((t.room - r.before) * d.size::DOUBLE / r.words) ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN rooms t ON d.source IS NOT DISTINCT FROM t.source
JOIN running r ON d.source IS NOT DISTINCT FROM r.source AND d.place = r.place
"""
