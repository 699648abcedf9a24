"""SimHash fingerprints and groups of near-duplicates, found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import LOWER, cut, free_name, small_batches

WIDTH, DISTANCE, SEED = 4, 4, 42
#: Shingles whose hashes are held at a time.
CHUNK = 1 << 16
#: Candidate pairs held at a time, rows of a key held at a time, and indexed fingerprints of a key that one task takes.
PAIRS, ROWS, BLOCK = 1 << 20, 1 << 17, 1 << 14


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit by bit the majority of the shingles' XXH64; 0 for a text without words (or null)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = min(width, len(words)) - 1
    starts, ends = starts[: len(words) - last].tolist(), ends[last:].tolist()
    ones, of = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), CHUNK):
        part = [of(joined[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(((2 * ones > len(starts)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit by bit the majority of hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fold_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of consecutive rows whose first `keys` columns agree."""
    at, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != at:
                if held:
                    yield at, [list(c) for c in zip(*held, strict=True)]
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, [list(c) for c in zip(*held, strict=True)]


def fingerprints(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns but text, with fp (the fingerprint's 64 bits as a long)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return small_batches(documents).select(*[c for c in documents.columns if c != "text"], of("text").alias("fp"))


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of distance + 1 segments that share 64 bits evenly."""
    m = distance + 1
    sizes = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(m)]


def keyed(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, is it a probe) for the index and the probes.

    By the pigeonring principle fingerprints at `distance` or fewer bits have, with m = distance + 1 segments on a
    ring, a segment from which every chain of l consecutive segments differs in at most l x distance / m bits:
    none in the first segment and one at most in the first two. So a key is a segment's place, its bits and those
    of the next segment; a probe also tries the next segment with one of its ones cleared. Of two that differ in one
    bit there, one has it set, and finds the other.
    """
    out, segs = [], segments(distance)
    for i, (shift, bits) in enumerate(segs):
        after, size = segs[(i + 1) % len(segs)]
        first = (fps >> np.uint64(shift)) & np.uint64(2**bits - 1)
        second = (fps >> np.uint64(after)) & np.uint64(2**size - 1)
        of = lambda first, second: (first << np.uint64(size) | second) * np.uint64(len(segs)) + np.uint64(i)  # noqa: B023, E731
        key = of(first, second)
        out += [(key, fps, np.zeros(len(fps), bool)), (key, fps, np.ones(len(fps), bool))]
        for b in range(size):
            one = (second >> np.uint64(b) & np.uint64(1)).astype(bool)
            out.append((of(first[one], second[one] ^ np.uint64(1 << b)), fps[one], np.ones(one.sum(), bool)))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def chained(difference: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether the chains that begin at segment `start` stay within their budgets, and with them the whole."""
    segs = segments(distance)
    m = len(segs)
    each = np.stack([np.bitwise_count((difference >> np.uint64(s)) & np.uint64(2**b - 1)).astype(np.int64) for s, b in segs])
    ok, total, columns = np.ones(len(difference), bool), np.zeros(len(difference), np.int64), np.arange(len(difference))
    for chain in range(1, m + 1):
        total += each[(start + chain - 1) % m, columns]
        ok &= total * m <= chain * distance
    return ok


def crowded(index: np.ndarray, probes: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what all links between indexed fingerprints and probes of one key connect, fewer than
    there are fingerprints. A probe is held against those that aren't connected with it yet, chain by chain.
    """
    every = np.unique(np.concatenate([index, probes]))
    label, own = np.arange(len(every)), np.searchsorted(every, index)
    shift, bits = segments(distance)[(start + 2) % (distance + 1)]
    third = 3 * distance // (distance + 1)
    a, b = [], []
    for x, at in zip(probes, np.searchsorted(every, probes).tolist(), strict=True):
        left = np.flatnonzero(label[own] != label[at])
        difference = index[left] ^ x
        left = left[np.bitwise_count(difference >> np.uint64(shift) & np.uint64(2**bits - 1)) <= third]
        difference = index[left] ^ x
        left = left[chained(difference, np.full(len(left), start), distance)]
        if len(left):
            old, one = np.unique(label[own[left]], return_index=True)
            a += [x] * len(old)
            b += index[left[one]].tolist()
            label[np.isin(label, old)] = label[at]
            if (label[own] == label[at]).all() and (label == label[at]).all():
                break
    return np.array(a, np.uint64), np.array(b, np.uint64)


def linked(key: np.ndarray, fps: np.ndarray, probe: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the rows of whole keys: all of a small key's, and of one with more pairs than are held at a time
    enough to connect the same."""
    if not len(key):
        return
    order = np.lexsort((probe, key))
    key, fps, probe = key[order], fps[order], probe[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[first[1:], len(key)]
    probes = np.add.reduceat(probe.astype(np.int64), first)
    split = last - probes
    work = (split - first) * probes
    start = (key[first] % np.uint64(distance + 1)).astype(np.int64)
    for k in np.flatnonzero(work > PAIRS).tolist():
        yield crowded(fps[first[k] : split[k]], fps[split[k] : last[k]], int(start[k]), distance)
    small = np.flatnonzero((work > 0) & (work <= PAIRS))
    bounds = np.r_[0, np.flatnonzero(np.diff(np.cumsum(work[small]) // PAIRS)) + 1, len(small)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        g = small[lo:hi]
        which = np.repeat(g, work[g])
        at = np.arange(len(which)) - np.repeat(np.cumsum(work[g]) - work[g], work[g])
        x, y = fps[first[which] + at // probes[which]], fps[split[which] + at % probes[which]]
        keep = x != y
        x, y, which = x[keep], y[keep], which[keep]
        ok = chained(x ^ y, start[which], distance)
        yield x[ok], y[ok]


def met(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows (place, fingerprint, is it a probe) in the order of place, indexed ones first.

    Whole places are taken together; of one with more than ROWS rows only the indexed ones, a block, stay in memory,
    while the probes go by. place: key and block in two columns of equal rows.
    """
    held: tuple[np.ndarray, ...] | None = None
    for part in rows:
        now = part if held is None else tuple(np.concatenate(c) for c in zip(held, part, strict=True))
        key, block, fps, probe = now
        same = (key == key[-1]) & (block == block[-1]) if len(key) else np.zeros(0, bool)
        at = len(key) - int(same[::-1].argmin()) if len(key) and not same.all() else 0
        yield from linked_places(*(c[:at] for c in now), distance)
        held = tuple(c[at:] for c in now)
        if len(held[0]) > ROWS and held[3][-1]:
            yield from linked_places(*held, distance)
            held = tuple(c[~held[3]] for c in held)
    if held is not None:
        yield from linked_places(*held, distance)


def linked_places(key, block, fps, probe, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """linked() of the rows of whole places: a key's blocks, of which it has rarely more than one, one after the other."""
    for n in np.unique(block).tolist():
        own = block == n
        yield from linked(key[own], fps[own], probe[own], distance)


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between different fingerprints of the column fp: enough to connect all that are within the
    distance of each other.

    A key that very many fingerprints share is dealt out: each task takes a block of the indexed ones and all the
    probes, which go by in batches.
    """

    def spread(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for j in range(0, len(fps), 1 << 14):
                key, fp, probe = keyed(fps[j : j + (1 << 14)], distance)
                for k in range(0, len(key), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(fp[part].view(np.int64)), pa.array(probe[part])], ["key", "fp", "probe"])

    def meet(batches):
        def rows():
            for b in batches:
                yield np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)), np.asarray(b.column(2)).view(np.uint64), b.column(3).to_numpy(zero_copy_only=False)

        for x, y in met(rows(), distance):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    keys = fps.select("fp").distinct().mapInArrow(spread, "key long, fp long, probe boolean")
    crowds = cut(keys.where("NOT probe").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "crowds")
    if crowds.isEmpty():
        placed = keys.withColumn("block", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")
        blocks = F.when(F.col("probe"), F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).otherwise(F.array(own))
        placed = keys.join(crowds, "key", "left").withColumn("block", F.explode(blocks))
    placed = placed.select("key", "block", "fp", "probe").repartition("key", "block").sortWithinPartitions("key", "block", "probe")
    return placed.mapInArrow(meet, "a long, b long")


def rooted_fingerprints(documents: DataFrame, width: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The columns but text with fp; and fp, first (its smallest doc_id), root (the fingerprint that links lead to)."""
    docs = cut(fingerprints(documents, width), "fingerprints")
    first = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    roots = components(cut(near_links(first, distance), "links"))
    return docs, first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Documents are linked if their fingerprints differ in `distance` or fewer bits; component_id is the smallest
    doc_id that links lead to. Documents without words, or with null text, have fingerprint zero and are linked
    like any other. Copies share a fingerprint, so each fingerprint is compared once. A text shorter than a
    shingle is one shingle. Repeated rows stay; a null doc_id is never a component_id unless the component has no
    other. Further columns are ignored.
    """
    docs, rooted = rooted_fingerprints(documents.select("doc_id", "text"), width, distance)
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    groups = cut(rooted.join(least, "root").select("fp", "component_id"), "groups")
    return docs.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_least(documents: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of each component of `grouped` (doc_id, text_hash, component), with all columns of the documents.

    It is one of smallest doc_id, null last, and then of smallest text_hash (xxhash64 of the text); of rows that
    repeat both, one.
    """
    id, text = free_name(documents, "kept"), free_name(documents, "kept_hash")
    least = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_least"))
    least = least.select(F.col("_least.doc_id").alias(id), F.col("_least.text_hash").alias(text))
    both = documents.join(least, F.col("doc_id").eqNullSafe(F.col(id)) & (F.xxhash64("text") == F.col(text)))
    return both.dropDuplicates([id, text]).drop(id, text)


def one_of_each(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One document of smallest doc_id of each group, with all its columns; the group decides, not the id, so that
    different texts under a repeated or null doc_id all stay."""
    hashed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    docs, roots = rooted_fingerprints(hashed, width, distance)
    return keep_least(documents, docs.join(roots.select("fp", F.col("root").alias("component")), "fp"))
