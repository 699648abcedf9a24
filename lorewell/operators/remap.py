"""References to merged rows: chains of merges are followed to their ends, then every column that holds ids is rewritten."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.messages import remap_ids
from ..sources.shared import cut, drop_table
from . import graph

#: Parts of a key that names several rows.
SEPARATOR = ":"


def survivors(merges: DataFrame) -> DataFrame:
    """id, survivor: the end of the chain of merges (old_id, new_id) that starts at each old id.

    Pointers jump: every round doubles how far each one reaches, so chains of n merges take about log2(n) rounds, each
    of which starts from a written table. Rows with a null and merges of a row into itself are passed over, repeated
    ones do no harm. An id that is merged into two others, and chains that run in a circle, raise ValueError.
    """
    own = merges.where("old_id <> new_id").select(F.col("old_id").alias("id"), F.col("new_id").alias("survivor")).distinct()
    now = cut(own, "pointers")
    n = now.count()
    if now.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id is merged into more than one other")
    reach = 1
    while True:
        ahead = now.select(F.col("id").alias("survivor"), F.col("survivor").alias("_next"))
        if not now.join(ahead, "survivor", "left_semi").limit(1).count():
            return now
        if reach > n:
            raise ValueError("merges run in a circle")
        before, now = now, cut(now.join(ahead, "survivor", "left").select("id", F.coalesce("_next", "survivor").alias("survivor")), "pointers")
        drop_table(before)
        reach *= 2


def _in_json(text: Column) -> Column:
    """All strings of a JSON text but those with escapes; with them go only escaped signs, so quotes pair up."""
    return F.regexp_extract_all(F.regexp_replace(text, r"(?s)\\.", ""), F.lit('"([^"]*)"'), F.lit(1))


@F.pandas_udf(StringType())
def _json_moved(texts: pd.Series, maps: pd.Series) -> pd.Series:
    def one(text, pairs):
        try:
            return json.dumps(remap_ids(json.loads(text), dict(pairs)), ensure_ascii=False)
        except ValueError:
            return text

    return pd.Series([one(t, m) if t is not None and m is not None else t for t, m in zip(texts, maps, strict=True)], dtype=object)


def moved(rows: DataFrame, to: DataFrame, ids: tuple[str, ...] = (), arrays: tuple[str, ...] = (), keys: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """The rows with every id that `to` (id, survivor) names replaced: columns of ids, arrays of ids, keys such as `a:b`
    whose parts are ids, and JSON texts, where only a whole string or a whole name of a field is an id.

    All columns are rewritten in one pass: rows meet the survivors of the ids that they hold, each kind of row once.
    Columns keep their types and rows their number; arrays keep repeats and nulls. Nulls stay null, texts that are not
    JSON stay as they are, and so do ids that JSON writes with escapes.
    """
    held = [*(F.array(F.col(c).cast("string")) for c in ids), *(F.col(c).cast("array<string>") for c in arrays), *(F.split(c, SEPARATOR) for c in keys), *(_in_json(F.col(c)) for c in texts)]
    # rows of one hash share a map; a map that names more ids than a row holds does no harm
    kind = F.xxhash64(*ids, *arrays, *keys, *texts)
    some = F.array_compact(F.array_distinct(F.flatten(F.array(*(F.coalesce(h, F.array().cast("array<string>")) for h in held)))))
    found = rows.select(kind.alias("_kind"), F.explode(some).alias("_held")).distinct()
    pairs = found.join(to.select(F.col("id").cast("string").alias("_held"), F.col("survivor").cast("string").alias("_to")), "_held")
    maps = pairs.groupBy("_kind").agg(F.map_from_entries(F.collect_list(F.struct("_held", "_to"))).alias("_map"))
    new = lambda c: F.coalesce(F.col("_map")[c], c)
    types = dict(rows.dtypes)
    changed = {c: new(F.col(c).cast("string")).cast(types[c]) for c in ids}
    changed |= {c: F.transform(F.col(c).cast("array<string>"), new).cast(types[c]) for c in arrays}
    changed |= {c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(F.split(c, SEPARATOR), new), SEPARATOR)) for c in keys}
    changed = {c: F.when(F.col("_map").isNull(), F.col(c)).otherwise(e) for c, e in changed.items()}
    changed |= {c: F.when(F.arrays_overlap(_in_json(F.col(c)), F.map_keys("_map")), _json_moved(c, "_map")).otherwise(F.col(c)) for c in texts}
    return rows.withColumn("_kind", kind).join(maps, "_kind", "left").withColumns(changed).select(*rows.columns)


def edges(rows: DataFrame, to: DataFrame) -> DataFrame:
    """Edges between survivors; those that coincide are one, as graph.merge has it."""
    return graph.remap(rows, to)


def skims(rows: DataFrame, to: DataFrame, by: tuple[str, ...] = ("model", "version")) -> DataFrame:
    """Skims (memory_id, *by, ...) at the survivors, with `old_id` and `archived`: one skim of each survivor and `by` stays.

    A survivor's own skim stays before those that were moved to it, of these the one of the smallest old id; the others
    are kept for the archive. Nulls in `by` are equal to each other.
    """
    known = rows.withColumn("old_id", F.col("memory_id"))
    at = moved(known, to, ids=("memory_id",)).withColumn("_order", F.struct(F.col("old_id") != F.col("memory_id"), "old_id"))
    names = ("memory_id", *by)
    first = at.groupBy(*(F.col(c).alias(f"_by_{c}") for c in names)).agg(F.min("_order").alias("_first"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return at.join(first, same).select(*rows.columns, "old_id", (F.col("_order") != F.col("_first")).alias("archived"))


def feedback(rows: DataFrame, to: DataFrame) -> DataFrame:
    """id, target_type, target_key, signal, weight, updated_at, merged, archived of feedback whose items may be merged rows.

    Of the rows of one key the one that named it before stays (else the smallest id) and takes signal, weight and date
    of the newest; of equally new ones, of that which stays. `archived` lists all rows of a conflict as they were, in
    the order of their ids; null without one. Only keys of type `item` hold ids.
    """
    item = F.col("target_type") == "item"
    asked = moved(rows.withColumn("_key", F.when(item, F.col("target_key"))), to, keys=("_key",)).withColumn("_key", F.coalesce("_key", "target_key"))
    new = ~F.col("_key").eqNullSafe(F.col("target_key"))
    age = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**62))
    was = F.struct("id", "target_key", "signal", "weight", "updated_at")
    one = asked.groupBy("target_type", "_key").agg(
        F.min_by("id", F.struct(new, "id")).alias("id"), F.min_by(F.struct("signal", "weight", "updated_at"), F.struct(age, new, "id")).alias("_newest"), F.count("*").alias("merged"), F.array_sort(F.collect_list(was)).alias("_all")
    )
    return one.select("id", "target_type", F.col("_key").alias("target_key"), "_newest.*", "merged", F.when(F.col("merged") > 1, F.col("_all")).alias("archived"))
