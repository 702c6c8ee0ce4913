"""Removal of repeated passages with a sampled, distributed suffix sort.

Every byte covered by a ``size``-byte string that also starts somewhere else is
removed. Not all suffixes are sorted, only those that can decide the answer:

1. Anchors. In each window of ``size`` bytes the ``GRAM``-byte gram with the
   smallest hash is its anchor. Windows that are equal have the same anchor at
   the same place, so a window can only repeat where its anchor repeats.
   Neighbouring windows share their anchor; such a run is a node of one or two
   sides, with a core that all its windows contain.
2. Nodes are sorted by two leading tokens: the hash of the core and the hash of
   all the bytes its windows cover. A core that occurs once ends the node; a
   node that repeats as a whole decides all its windows.
3. The windows of the remaining nodes, and of one node of each repeated kind
   with the same core, are the suffixes to sort, again by two leading tokens
   (each the hash of half a window).

Both sorts deal rows by sampled splitters (Spark's range partitioning) with the
row's place as last key, so a passage that a third of all documents share is
dealt over many tasks. A task sorts by multikey quicksort: on the first token,
then on the next one only where rows are still tied. Rows equal to a neighbour
repeat. The first and last row of each task are compared with those of the
other tasks.

Tokens are 64-bit polynomial hashes; rows count as equal if both agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probegrid.llm.common import documents_of, release, stored, strings

SIZE = 200
GRAM = 32
#: Bytes of a text that are worked on at a time.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


class Hasher:
    """Polynomial hashes of byte ranges modulo 2^64."""

    def __init__(self, longest: int):
        with np.errstate(over="ignore"):
            base = np.uint64(_BASE)
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, base)]), dtype=np.uint64)
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, inverse)]), dtype=np.uint64)
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[:len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.back[start]
        h ^= (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(hasher: Hasher, prefix: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: first start, last start, anchor."""
    grams = n - GRAM + 1
    key = mixed((prefix[GRAM:] - prefix[:grams]) * hasher.back[:grams])
    # the place in the low bits: of equal grams the leftmost is the anchor
    key = (key & ~np.uint64(2 * CHUNK - 1)) | np.arange(grams, dtype=np.uint64)
    width, span = size - GRAM + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[:len(key) - (width - span)], key[width - span:])
    at = (key & np.uint64(2 * CHUNK - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return new, np.concatenate([new[1:], [len(at)]]) - 1, at[new]


def nodes(text: bytes, hasher: Hasher, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, core token, whole token) of every node of a text."""
    out = []
    half = size // 2
    for base in range(0, max(1, len(text) - size + 1), CHUNK):
        data = np.frombuffer(text, dtype=np.uint8, offset=base, count=min(CHUNK + size - 1, len(text) - base))
        if len(data) < size:
            break
        prefix = hasher.prefix(data)
        low, high, at = anchors(hasher, prefix, len(data), size)
        split = at - half  # starts from here on have the anchor in their first half
        for near in (True, False):
            a = np.maximum(low, split) if near else low
            b = high if near else np.minimum(high, split - 1)
            ok = a <= b
            a, b, i = a[ok], b[ok], at[ok]
            core = hasher.ranges(prefix, i if near else i - half - 1, i + half if near else i + GRAM)
            whole = hasher.ranges(prefix, a, b + size)
            out.append((a + base, b + base, core, whole))
    if not out:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def window_tokens(text: bytes, ranges: list[tuple[int, int]], hasher: Hasher, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, first token, second token) of all windows that start in the ranges [a, b]."""
    starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in ranges]))
    first, second = [], []
    for base in range(0, len(text), CHUNK):
        own = starts[(starts >= base) & (starts < base + CHUNK)] - base
        if len(own):
            prefix = hasher.prefix(np.frombuffer(text, dtype=np.uint8, offset=base, count=min(CHUNK + size - 1, len(text) - base)))
            first.append(hasher.ranges(prefix, own, own + size // 2))
            second.append(hasher.ranges(prefix, own + size // 2, own + size))
    return starts, np.concatenate(first), np.concatenate(second)


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted order of rows of words, and for each depth where a new prefix begins.

    Multikey quicksort: rows are sorted on a word, and only runs of rows that are
    still tied go on to the next one.
    """
    order = np.argsort(words[0])
    sorted_word = words[0][order]
    new = np.concatenate([[True], sorted_word[1:] != sorted_word[:-1]]) if len(order) else np.empty(0, bool)
    depths = [new]
    for word in words[1:]:
        group = np.cumsum(new)
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]]))) if len(order) else order
        inner = np.lexsort((word[order[tied]], group[tied]))
        order[tied] = order[tied][inner]
        w = word[order]
        new = new | np.concatenate([[True], w[1:] != w[:-1]]) if len(order) else new
        depths.append(new)
    return order, depths


def _repeated(new: np.ndarray) -> np.ndarray:
    """Rows equal to a neighbour, from where new values begin."""
    return ~(new & np.concatenate([new[1:], [True]]))


_SORTED = "_id long, _h long, place long, first boolean, both boolean, witness boolean, t0 long, t1 long"


def _sorted_repeats(rows: DataFrame, name: str) -> DataFrame:
    """``_id, _h, place, both, witness``: the rows (t0, t1, _id, _h, place) whose first token repeats.

    both: the two tokens repeat. witness: the row stands for all rows with its two
    tokens against those that share the first token only.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        t0, t1, ids, h, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        order, (new0, new1) = multikey_order([t0, t1])
        first, both = _repeated(new0), _repeated(new1)
        edge = np.zeros(len(order), bool)
        edge[[0, -1]] = True
        group = np.cumsum(new0) - 1
        kinds = np.bincount(group, weights=new1)
        kinds[[0, -1]] = 2  # what shares these first tokens may be in other tasks
        witness = (both & new1 & (kinds[group] > 1)) | edge
        keep = first | edge
        order, edge = order[keep], edge[keep]
        columns = [pa.array(c[order]) for c in (ids, h, place)] + [pa.array(x[keep]) for x in (first, both, witness)]
        columns += [pa.array(t[order], mask=~edge) for t in (t0, t1)]
        table = pa.RecordBatch.from_arrays(columns, names=["_id", "_h", "place", "first", "both", "witness", "t0", "t1"])
        for at in range(0, table.num_rows, 50_000):
            yield table.slice(at, 50_000)

    # the whole row is the range key: equal tokens may go to several tasks
    dealt = rows.select("t0", "t1", "_id", "_h", "place").repartitionByRange("t0", "t1", "_id", "_h", "place")
    judged = stored(dealt.mapInArrow(judge, _SORTED), name)
    edges = judged.where("t0 is not null")
    # two rows for each task at most
    firsts = edges.groupBy(F.col("t0").alias("f0")).agg(F.count("*").alias("nf"))
    boths = edges.groupBy(F.col("t0").alias("b0"), F.col("t1").alias("b1")).agg(F.count("*").alias("nb"))
    settled = edges.join(firsts, F.col("t0") == F.col("f0")).join(boths, (F.col("t0") == F.col("b0")) & (F.col("t1") == F.col("b1"))).select(
        "_id", "_h", "place", (F.col("first") | (F.col("nf") > 1)).alias("first"), (F.col("both") | (F.col("nb") > 1)).alias("both"), "witness")
    inner = judged.where("t0 is null").select("_id", "_h", "place", "first", "both", "witness")
    return inner.union(settled).where("first").select("_id", "_h", "place", "both", "witness")


def _texts(docs: DataFrame) -> DataFrame:
    # the key only has to tell texts apart: what is removed from a text is the same wherever it stands
    return documents_of(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.xxhash64("text").alias("_h"), "text", "doc_id")


def removed_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, text, starts, ends``: the maximal byte ranges to remove, for every row of ``docs``. text is binary.

    Null counts as empty. Texts shorter than ``size`` bytes keep everything. A row
    repeated is a repetition like any other: both lose what they share.
    """
    spark = docs.sparkSession
    texts = _texts(docs)

    def find_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(CHUNK + size)
        for batch in batches:
            for ids, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2)), strict=True):
                a, b, core, whole = nodes(text, hasher, size)
                n = len(a)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.full(n, ids)), pa.array(np.full(n, h)), pa.array(a * 256 + (b - a))],
                        names=["t0", "t1", "_id", "_h", "place"])

    def find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(CHUNK + size)
        for batch in batches:
            for ids, h, text, open_nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                starts, t0, t1 = window_tokens(text, [(p >> 8, (p >> 8) + (p & 255)) for p in open_nodes], hasher, size)
                for at in range(0, len(starts), 50_000):
                    part = slice(at, at + 50_000)
                    n = len(starts[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t0[part].view(np.int64)), pa.array(t1[part].view(np.int64)), pa.array(np.full(n, ids)), pa.array(np.full(n, h)), pa.array(starts[part])],
                        names=["t0", "t1", "_id", "_h", "place"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for whole, single in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ranges = sorted([(p >> 8, (p >> 8) + (p & 255) + size) for p in whole or ()] + [(s, s + size) for s in single or ()])
                merged: list[list[int]] = []
                for a, b in ranges:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                starts.append([a for a, _ in merged])
                ends.append([b for _, b in merged])
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, many), pa.array(ends, many)], names=["_ki", "_kh", "starts", "ends"])

    token_rows = "t0 long, t1 long, _id long, _h long, place long"
    by_text = _sorted_repeats(texts.select("_id", "_h", "text").mapInArrow(find_nodes, token_rows), "nodes").groupBy("_id", "_h").agg(
        F.collect_set(F.when(~F.col("both") | F.col("witness"), F.col("place"))).alias("open"), F.collect_set(F.when(F.col("both"), F.col("place"))).alias("whole"))
    known = stored(by_text, "open-nodes")
    release(spark)
    todo = known.where(F.size("open") > 0).select(F.col("_id").alias("_ki"), F.col("_h").alias("_kh"), "open")
    windows = texts.join(todo, (F.col("_id") == F.col("_ki")) & (F.col("_h") == F.col("_kh"))).select("_id", "_h", "text", "open").mapInArrow(find_windows, token_rows)
    single = _sorted_repeats(windows, "windows").where("both").groupBy("_id", "_h").agg(F.collect_set("place").alias("single"))
    both = known.join(single, ["_id", "_h"], "left").select("_id", "_h", "whole", "single")
    spans = stored(both.mapInArrow(cover, "_ki long, _kh long, starts array<long>, ends array<long>"), "spans")
    release(spark)
    none = F.array().cast("array<long>")
    return texts.join(spans, (F.col("_id") == F.col("_ki")) & (F.col("_h") == F.col("_kh")), "left").select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"))


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes), one row per row of ``docs``.

    An empty table gives no rows; see ``removed_spans`` for the other cases.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, kept = 0, []
                for a, b in zip(starts, ends, strict=True):
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                out.append({"doc_id": ids, "n_bytes": len(text), "n_removed": len(text) - len(left), "n_spans": len(starts), "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    return removed_spans(docs, size).mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
