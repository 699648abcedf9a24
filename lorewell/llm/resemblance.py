"""Groups of documents that share four fifths of their five-word shingles: SimHash candidates by pigeonring filtering and
by MinHash bands, then an exact check.

Pigeonring filtering alone would need a distance of about 20 of 64 bits to find pairs at four fifths, at which no key
is selective any more; so it finds the close pairs, and bands the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import LOWER, cut, small_batches
from .simhash import DISTANCE, SEED, fold_rows, keep_least, majority
from .simhash import near_links as pigeonring_links

WIDTH, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, ROWS = 20, 5
#: Bits in which SimHash fingerprints of a candidate pair differ at most. At 0.8 about 9.7 differ, with a deviation of 2.9.
RADIUS = 20
#: Shingles that are permuted at a time, and sets and shingles of a block that is held against another.
CHUNK, BLOCK_SETS, BLOCK_SHINGLES = 1 << 12, 4096, 1 << 21
_rng = np.random.default_rng(SEED)
TURN, ADD = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different XXH64 of a whole text's shingles, ascending; a text shorter than one is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    last = min(width, len(words)) - 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - last if words else 0)), np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band, from the least of the shingles under each of its permutations."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(own), CHUNK):
        least = np.minimum(least, (own[k : k + CHUNK, None] * TURN + ADD).min(0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def described(texts: DataFrame) -> DataFrame:
    """The columns but text, with id (of the set of shingles), fp, bands and n (the set's size)."""

    @F.pandas_udf("id long, fp long, bands array<long>, n long")
    def describe(batch: pd.Series) -> pd.DataFrame:
        rows = [(xxhash.xxh64_intdigest(own.tobytes(), SEED), majority(own), bands(own).view(np.int64), len(own)) for own in map(shingles, batch)]
        out = pd.DataFrame(rows, columns=["id", "fp", "bands", "n"])
        return out.assign(id=out["id"].to_numpy(np.uint64).view(np.int64), fp=out["fp"].to_numpy(np.uint64).view(np.int64))

    return small_batches(texts).withColumn("_of", describe("text")).drop("text").select("*", "_of.*").drop("_of")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what all links between these fingerprints connect, at most about two for each.

    A fingerprint that is in no ball yet becomes a hub and takes in all within the distance; every hub has thus
    been held against all. What is left are links between members of balls that are still apart.
    """
    n = len(fps)
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b, held, hub = [], [], np.zeros(n, bool), np.zeros(n, bool)

    def join(x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            if (r := root(x)) != (s := root(y)):
                parent[max(r, s)] = min(r, s)
                a.append(x)
                b.append(y)

    for x in range(n):
        if not held[x]:
            ball = np.bitwise_count(fps ^ fps[x]) <= distance
            hub[x], held = True, held | ball
            join(x, np.flatnonzero(ball))
    rest = np.flatnonzero(~hub)
    group = np.array([root(x) for x in rest.tolist()], np.int64)
    if len(set(group.tolist())) > 1:
        values, sizes = np.unique(group, return_counts=True)
        for x in rest[group != values[sizes.argmax()]].tolist():
            join(x, rest[np.bitwise_count(fps[rest] ^ fps[x]) <= distance])
    return fps[np.array(a, np.int64)], fps[np.array(b, np.int64)]


def candidates(sets: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints that are within SimHash's DISTANCE, found by pigeonring filtering, or that share
    a band and are within RADIUS; of each band's key a spanning forest."""

    def meet(batches):
        for keys, columns in fold_rows(batches, 1):
            fps = np.unique(np.asarray(columns[0], np.int64).view(np.uint64))
            if len(fps) > 1:
                a, b = forest(fps, RADIUS)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys = sets.select(F.explode("bands").alias("key"), "fp").distinct()
    banded = keys.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")
    return banded.unionByName(pigeonring_links(sets.select("fp"), DISTANCE)).distinct()


def links(fps: np.ndarray, ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect exactly what all pairs of a left and a right set at SIMILARITY connect, by whole sets; pairs that
    are connected already aren't compared."""
    label, sizes, same = np.arange(len(ids)), np.array([len(s) for s in sets]), (left == right).all()
    right = np.flatnonzero(right)
    for x in np.flatnonzero(left).tolist():
        apart = right[label[right] != label[x]]
        apart = apart[apart > x] if same else apart
        apart = apart[np.bitwise_count(fps[apart] ^ fps[x]) <= RADIUS]
        apart = apart[np.minimum(sizes[apart], sizes[x]) >= SIMILARITY * np.maximum(sizes[apart], sizes[x])]
        while len(apart):
            y, apart = int(apart[0]), apart[1:]
            if similarity(sets[x], sets[y]) >= SIMILARITY:
                label[label == label[y]] = label[x]
                apart = apart[label[apart] != label[x]]
                yield int(ids[x]), int(ids[y])


def near_links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between ids of sets: enough to connect all candidates that an exact check finds similar.

    sets: (id, fp, bands, n, doc_id, text_hash), the last two of a text that has the set; texts: (doc_id, text_hash,
    text). Sets meet in the components of the candidates, and only those that meet another bring their text. A
    component with many sets or shingles is dealt out in blocks, of which each is held against each, so that no task
    needs a component whole.
    """
    roots = components(cut(candidates(sets), "candidates"))
    rooted = cut(sets.drop("bands").join(roots, sets.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node"), "rooted")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("_sets"), F.sum("n").alias("_n")).where("_sets > 1")
    blocks = F.greatest(F.ceil(F.col("_sets") / BLOCK_SETS), F.ceil(F.col("_n") / BLOCK_SHINGLES)).cast("int")
    meeting = rooted.join(sizes.select("root", blocks.alias("_blocks")), "root").withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    read = texts.join(meeting, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    dealt = read.dropDuplicates(["id"]).withColumn("_own", F.pmod("id", "_blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    cells = dealt.withColumn("_other", other).select("root", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "id", "fp", "text")

    def meet(batches):
        for (_, i, j), (own, ids, fps, texts) in fold_rows(batches, 3):
            own, ids = np.array(own), np.array(ids, np.int64)
            sets = [shingles(t) for t in texts]
            found = list(links(np.array(fps, np.int64).view(np.uint64), ids, sets, own == i, own == j))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(meet, "a long, b long")


def components_of(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, component (of the sets of shingles) of every document; texts without words are one set."""
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    told = cut(described(texts), "described")
    least = F.min(F.struct("doc_id", "text_hash")).alias("_least")
    sets = told.groupBy("id").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("n").alias("n"), least)
    sets = cut(sets.select("id", "fp", "bands", "n", "_least.*"), "sets")
    roots = components(cut(near_links(sets, texts), "links"))
    return told.select("doc_id", "text_hash", "id").join(roots, told.id == roots.node, "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("component"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """A document of smallest doc_id of each group that links at SIMILARITY connect, with all its columns.

    Pairs are similar by the Jaccard index of their whole sets of WIDTH-word shingles, checked exactly; a pair at
    the threshold is a candidate with a probability of about 0.999, a closer one with more. Groups, not ids,
    decide: texts under one repeated or null doc_id stay unless they are similar.
    """
    return keep_least(documents, components_of(documents))
