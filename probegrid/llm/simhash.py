"""Near duplicates from 64-bit SimHash fingerprints, by anchor-point covering.

A fingerprint bit is set if it is set in over half of the hashes of a text's
3-word shingles. Two fingerprints that differ in at most three bits differ in at
most one bit in one of their two halves. For each half the anchors are the words
of a covering code on 31 of its 32 bits: the perfect Hamming code, whose covering
radius is 1, so every fingerprint has one home anchor within one bit. It is
replicated to every anchor within covering radius plus the half's threshold, two
bits: 16 at most. A partner within one bit of a fingerprint lies within two bits
of that one's home, so they meet there. Per anchor, homes are compared with
replicas on all 64 bits, and what links gives a forest of edges, not all pairs.

One code for the whole fingerprint and threshold 3 would need 71 (23 bits, 4,096
anchors) to 340 replicas (46 bits) instead of 32 over 2 x 67 million anchors.

Anchors with many fingerprints are split into a grid of parts of homes and parts
of replicas. Equal fingerprints count as one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probegrid.llm.common import documents_of, release, stored, strings
from probegrid.llm.graph import components

SHINGLE_WORDS = 3
SEED = 42
THRESHOLD = 3
#: Homes and replicas of an anchor in one part of its grid, about.
HOMES, REPLICAS = 1024, 16384
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16
#: Cells of one comparison held at once.
CELLS = 1 << 22


def _code() -> tuple[np.ndarray, np.ndarray]:
    """(bit masks of the five parity checks, anchors around a word by its syndrome as masks to flip: the home first).

    Bit i - 1 of a word has the five-bit number i as its column of the check matrix.
    """
    numbers = np.arange(1, 32)
    checks = np.array([sum(1 << int(i - 1) for i in numbers if i >> b & 1) for b in range(5)], dtype=np.uint32)
    flips = np.zeros((32, 16), dtype=np.uint32)
    for s in range(1, 32):
        pairs = [(1 << i - 1) | (1 << (i ^ s) - 1) for i in range(1, 32) if i < i ^ s]
        flips[s] = [1 << s - 1, *pairs]
    return checks, flips


_CHECKS, _FLIPS = _code()


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(len(words), SHINGLE_WORDS)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.zeros(64, dtype=np.int64)
    m = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, m, CHUNK):
        upto = min(m, at + CHUNK)
        pieces = zip(starts[at:upto].tolist(), ends[at + width - 1:upto + width - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in pieces], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row as a signed long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in strings(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return documents_of(docs).mapInArrow(sign, "doc_id long, fp long")


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every replica of the given fingerprints; an anchor's top bit names its half."""
    rows, keys, homes = [], [], []
    for half in range(2):
        x = ((fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        syndrome = sum((np.bitwise_count(x & c) & 1).astype(np.int64) << b for b, c in enumerate(_CHECKS))
        near = (x[:, None] ^ _FLIPS[syndrome]).astype(np.int64) | (half << 31)
        used = np.ones(near.shape, dtype=bool)
        used[syndrome == 0, 1:] = False  # a code word has no other one within two bits
        first = np.zeros(near.shape, dtype=bool)
        first[:, 0] = True
        rows.append(np.broadcast_to(np.arange(len(fps))[:, None], near.shape)[used])
        keys.append(near[used])
        homes.append(first[used])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def replicas(distinct: DataFrame) -> DataFrame:
    """``anchor, fp, home``: each of the distinct fingerprints at every anchor it must be found at."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            rows, keys, homes = anchors_of(fps.view(np.uint64))
            for at in range(0, len(rows), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(fps[rows[part]]), pa.array(homes[part])], names=["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


class _Anchor:
    """One part of an anchor: its homes, met by batches of replicas. Holds the homes only."""

    def __init__(self):
        self.homes = np.empty(0, dtype=np.uint64)
        self.label = np.empty(0, dtype=np.int64)

    def add(self, homes: np.ndarray) -> None:
        self.homes = np.concatenate([self.homes, homes])
        self.label = np.arange(len(self.homes))

    def meet(self, replicas: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges from each linked replica to one home; homes linked by it are noted as one."""
        step = max(1, CELLS // max(1, len(self.homes)))
        far = len(self.homes)
        for at in range(0, len(replicas) if far else 0, step):
            some = replicas[at:at + step]
            match = _near(self.homes[:, None], some[None, :])
            linked = match.any(axis=0)
            match, some = match[:, linked], some[linked]
            if not len(some):
                continue
            yield some, self.homes[match.argmax(axis=0)]
            while True:
                lowest = np.where(match, self.label[:, None], far).min(axis=0)
                label = np.minimum(self.label, np.where(match, lowest[None, :], far).min(axis=1))
                np.minimum.at(label, self.label, label)
                label = label[label]
                if (label == self.label).all():
                    break
                self.label = label

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        return self.homes, self.homes[self.label]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition sorted by (part, role), homes before replicas. Small parts are compared many at a time."""

    def edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        differ = a != b
        if differ.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[differ].view(np.int64)), pa.array(b[differ].view(np.int64))], names=["a", "b"])

    anchor, key = _Anchor(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(i).to_numpy() for i in range(3)]
        role = batch.column(3).to_numpy()
        fps = batch.column(4).to_numpy().view(np.uint64)
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1
        bounds = [0, *new.tolist(), len(fps)]
        for lo, hi in zip(bounds, bounds[1:]):
            here = tuple(c[lo] for c in names)
            if here != key:
                yield from edges(*anchor.rest())
                anchor, key = _Anchor(), here
            mid = lo + int(np.searchsorted(role[lo:hi], 1))
            if mid > lo:
                anchor.add(fps[lo:mid])
            if hi > mid:
                for found in anchor.meet(fps[mid:hi]):
                    yield from edges(*found)
    yield from edges(*anchor.rest())


def links_of(distinct: DataFrame) -> DataFrame:
    """``a, b``: edges that connect the fingerprints (``fp``, distinct) as all pairs within the threshold would."""
    placed = replicas(distinct)
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("all"), F.count_if("home").alias("homes")).where(F.col("homes") > 0).where(F.col("all") > 1)
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    live = stored(sizes.select(F.col("anchor").alias("_anchor"), parts("homes", HOMES).alias("rows"), parts("all", REPLICAS).alias("columns")), "anchors")
    met = placed.join(live, F.col("anchor") == F.col("_anchor"))
    deal = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # role 0: a home, in its row of the grid; role 1: a replica (homes too), in its column
    as_home = F.transform(every("columns"), lambda c: F.struct(deal("rows").alias("row"), c.alias("column"), F.lit(0).alias("role")))
    as_replica = F.transform(every("rows"), lambda r: F.struct(r.alias("row"), deal("columns").alias("column"), F.lit(1).alias("role")))
    cells = met.select("anchor", "fp", F.inline(F.when(F.col("home"), F.concat(as_home, as_replica)).otherwise(as_replica)))
    dealt = cells.select("anchor", "row", "column", "role", "fp").repartition("anchor", "row", "column").sortWithinPartitions("anchor", "row", "column", "role")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def simhash_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other.
    A row without doc_id connects others but never names a component: its component
    is null if all rows in it have no doc_id. Rows that repeat a doc_id each have
    their own fingerprint and component. An empty table gives no rows.
    """
    signed = stored(fingerprints(docs), "fingerprints")
    classes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    links = stored(links_of(classes), "fingerprint-links")
    release(docs.sparkSession)
    labels = components(links)
    named = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy(F.col("label").alias("_label")).agg(F.min("least").alias("component_id"))
    known = stored(named.join(least, F.col("label") == F.col("_label")).select(F.col("fp").alias("_fp"), "component_id"), "fingerprint-components")
    rows = signed.join(known, F.col("fp") == F.col("_fp"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
