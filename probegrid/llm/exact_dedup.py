"""Exact duplicates by deterministic block naming.

A text's UTF-8 bytes are cut into fixed-size blocks. All blocks are sorted and
numbered by rank, so equal blocks, and only those, get equal integers. Then
adjacent pairs of integers are sorted and numbered in the same way, level by
level, until every document is a single integer. Level and integer together
identify the text: no hash takes part in the comparison, so nothing collides.

Scale: the text is shuffled once, by range. Blocks are ordered by their first
bytes, then by a hash, then by all their bytes, and last by document and
position. So a block that a third of all documents share is dealt over many
tasks; its integer is the same in each, as the first value of a task is
compared with the last one of the task before. The range borders are sampled
from the short keys, never from whole blocks. There are log2(blocks of the
longest text) levels; each handles half the rows of the one before and is
written to the shared folder, so a lost executor costs one level at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probegrid.llm.common import DOC_KEY, keyed, sorted_flags, stored, unused

BLOCK_BYTES = 16384
#: Bytes of a block that take part in its range key.
HEAD_BYTES = 16

_NAMED = "_id long, _h long, m long, pos long, part long, rank long, distinct long, first binary, last binary"


def _edge(values: tuple | None) -> bytes | None:
    return None if values is None else b":".join(v if isinstance(v, bytes) else str(v).encode() for v in values)


def sort_names(rows: DataFrame, value: list[str]) -> DataFrame:
    """``_id, _h, m, pos, name``: rows with equal values get equal integers, numbered in sorted order.

    ``value`` columns are not null. Repeated rows are kept.
    """
    place = ["_id", "_h", "pos"]
    short = ["_head", "_hash"] if value == ["block"] else value

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rank, first, last = TaskContext.get().partitionId(), -1, None, None
        for batch, new, last in sorted_flags(batches, value):
            if first is None:
                first = tuple(batch.column(batch.schema.get_field_index(v))[0].as_py() for v in value)
            ranks = rank + np.cumsum(new)
            rank = int(ranks[-1])
            n = batch.num_rows
            ids = [batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_h", "m", "pos")]
            empty = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(n, part, np.int64)), pa.array(ranks.astype(np.int64)), *empty], schema=schema)
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "distinct": rank + 1, "first": _edge(first), "last": _edge(last)}], schema=schema)

    longs = [pa.field(c, pa.int64()) for c in ("_id", "_h", "m", "pos", "part", "rank", "distinct")]
    schema = pa.schema([*longs, pa.field("first", pa.binary()), pa.field("last", pa.binary())])
    if value == ["block"]:
        rows = rows.withColumn("_head", F.substring("block", 1, HEAD_BYTES)).withColumn("_hash", F.xxhash64("block"))
    dealt = rows.repartitionByRange(*short, *place)
    ranked = dealt.sortWithinPartitions(*short, *[v for v in value if v not in short], *place).select("_id", "_h", "m", "pos", *value)
    numbered = stored(ranked.mapInArrow(number, _NAMED), "block-names")
    # one row per task: a task's numbers start after those of all tasks before it, less the values that cross a border
    by_part = Window.orderBy("part")
    edges = numbered.where("distinct is not null").select("part", "distinct", "first", "last")
    starts = edges.withColumn("shared", F.coalesce((F.col("first") == F.lag("last").over(by_part)).cast("long"), F.lit(0))).select(
        F.col("part").alias("_part"),
        (F.coalesce(F.sum("distinct").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         - F.sum("shared").over(by_part.rowsBetween(Window.unboundedPreceding, 0))).alias("start"),
    )
    body = numbered.where("distinct is null")
    return body.join(starts, body.part == starts._part).select("_id", "_h", "m", "pos", (F.col("start") + F.col("rank")).alias("name"))


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``_id, _h, m, pos, block``: every text in blocks; m is their number, 1 for an empty text."""
    size = F.greatest(F.octet_length("text"), F.lit(1))
    cut = keyed(docs).select(
        *DOC_KEY, F.col("text").cast("binary").alias("bytes"), F.ceil(size / F.lit(block_bytes)).cast("long").alias("m"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("m").cast("int") - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    return cut.select(*DOC_KEY, "m", F.posexplode(pieces).alias("pos", "block")).withColumn("pos", F.col("pos").cast("long"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``_id, _h, level, name``, one row per key: equal (level, name) means equal texts."""
    longest = docs.select(F.max(F.octet_length(F.col("text").cast("string"))).alias("n")).first().n or 1
    levels = math.ceil(math.log2(max(1, math.ceil(longest / block_bytes))))
    named = sort_names(blocks_of(docs, block_bytes), ["block"])
    done = [named.where("m = 1").select(*DOC_KEY, F.lit(0).alias("level"), "name")]
    for level in range(1, levels + 1):
        half = F.shiftright("pos", 1)
        pairs = named.where("m > 1").groupBy(*DOC_KEY, "m", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        ).withColumn("m", F.shiftright(F.col("m") + 1, 1))
        named = sort_names(pairs, ["left", "right"])
        done.append(named.where("m = 1").select(*DOC_KEY, F.lit(level).alias("level"), "name"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.groupBy(*DOC_KEY).agg(F.first("level").alias("level"), F.first("name").alias("name"))


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Texts are compared as they are; null counts as empty. Of equal texts the row
    with the largest doc_id stays. If that id occurs several times with this text,
    one of the rows stays. Rows without doc_id count in group_size, and one of
    them stays only if no row of the group has an id. An empty table gives no rows.
    """
    rows = keyed(docs).select(*DOC_KEY, F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    names = identities(docs, block_bytes).withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    copies = Window.partitionBy(*DOC_KEY).orderBy("text_sha256")
    known = rows.withColumn("_copy", F.row_number().over(copies)).join(
        names, rows._id.eqNullSafe(names._id2) & (rows._h == names._h2))
    groups = known.groupBy(F.col("level").alias("_level"), F.col("name").alias("_name")).agg(
        F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    return known.join(groups, (known.level == groups._level) & (known.name == groups._name)).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    fate = exact_duplicates(docs, block_bytes).where("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    sha, copy = unused(docs, "_row_sha"), unused(docs, "_row_copy")
    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    same = rows.doc_id.cast("long").eqNullSafe(fate._kept_id) & (rows[sha] == fate._kept_sha)
    one = Window.partitionBy("doc_id", sha).orderBy(F.lit(1))
    return rows.withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).join(fate, same, "left_semi").select(*docs.columns)
