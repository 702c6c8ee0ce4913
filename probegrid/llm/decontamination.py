"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Every item gives its windows of ``size`` consecutive words (one shorter window
if it has fewer words). The join asks for containment of the whole window, so
one word of it is a sufficient prefix: the one that is rarest over all
documents. A document word equal to a prefix word gives a candidate; the
word's position must leave room for the window before and after it, and the
words there must equal the window's.

Scale: documents are read twice (word counts, then the join) and never
shuffled. What goes to the executors is a block of at most ``block_windows``
windows, whatever the benchmark's size; more blocks mean more passes, whose
hits are then merged by document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probegrid.llm.common import DOC_KEY, documents_of, keyed, strings

WINDOW = 10
BLOCK_WINDOWS = 50_000
#: Fixed by the contract: ASCII letters, digits and every byte of a non-ASCII character.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text after lower-casing A-Z."""
    return _WORD.findall(text.lower())


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All windows of an item; fewer words than ``size`` make one, none make none."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``words, item_ids, w``: distinct windows, the items that hold them, and a number in order of the words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                out += [{"words": b" ".join(w).decode(), "item_id": item} for w in set(windows_of(words_of(text), size))]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("words", pa.string()), ("item_id", pa.int64())])
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    return plain.mapInArrow(cut, "words string, item_id long").groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary occurs in all documents. Its size bounds the answer."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                total.update(w for w in words_of(text) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = documents_of(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word.encode(): r.n for r in rows.toLocalIterator()}


def prefix_index(windows: list[tuple[tuple[bytes, ...], list[int]]], counts: dict[bytes, int]) -> dict[bytes, dict]:
    """Rarest word -> (place in the window, window length) -> window -> items."""
    index: dict[bytes, dict] = {}
    for words, items in windows:
        place = min(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
        index.setdefault(words[place], {}).setdefault((place, len(words)), {})[words] = items
    return index


def hits(words: list[bytes], index: dict[bytes, dict]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word ranges [from, to) inside occurrences, and the items found."""
    ranges: list[list[int]] = []
    items: set[int] = set()
    found = []
    n = len(words)
    for p, w in enumerate(words):
        if w in index:
            for (place, size), exact in index[w].items():
                start = p - place
                if start >= 0 and start + size <= n and (of := exact.get(tuple(words[start:start + size]))):
                    found.append((start, start + size))
                    items.update(of)
    for start, end in sorted(found):
        if ranges and start <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([start, end])
    return [(a, b) for a, b in ranges], items


_HITS = "_id long, _h long, n_words long, starts array<long>, ends array<long>, items array<long>"


def _hits_of_block(docs: DataFrame, index: dict[bytes, dict]) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, starts, ends, items = [], [], [], []
            for text in strings(batch.column(2)):
                words = words_of(text)
                ranges, of = hits(words, index)
                lengths.append(len(words))
                starts.append([a for a, _ in ranges])
                ends.append([b for _, b in ranges])
                items.append(sorted(of))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(starts, many), pa.array(ends, many), pa.array(items, many)],
                names=["_id", "_h", "n_words", "starts", "ends", "items"])

    return keyed(docs).mapInArrow(search, _HITS)


def find_leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``_id, _h, n_words, starts, ends, items``: per document the word ranges inside windows of items.

    ``_id`` is doc_id. Null texts have no words; items without id or words have no windows.
    """
    cut = item_windows(items, size)
    n = cut.count()
    blocks = max(1, -(-n // block_windows))
    found = None
    for b in range(blocks):
        # hash blocks hold about block_windows windows each, and are read one at a time
        rows = cut if blocks == 1 else cut.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b)
        windows = [(tuple(r.words.encode().split(b" ")), sorted(r.item_ids)) for r in rows.toLocalIterator()]
        counts = word_counts(docs, {w for words, _ in windows for w in words}) if windows else {}
        part = _hits_of_block(docs, prefix_index(windows, counts))
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found
    # every block has each document once (as often as it is repeated): merge its ranges over the blocks
    merged = found.groupBy(*DOC_KEY).agg(
        F.max("n_words").alias("n_words"), (F.count("*") / blocks).cast("int").alias("_copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))).alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr("""aggregate(r, cast(array() as array<struct<starts: bigint, ends: bigint>>),
        (acc, x) -> if(size(acc) > 0 and x.starts <= element_at(acc, -1).ends,
            concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).starts as starts, greatest(element_at(acc, -1).ends, x.ends) as ends))),
            concat(acc, array(x))))""")
    flat = merged.withColumn("r", joined).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return flat.select(*DOC_KEY, "n_words", F.col("r.starts").alias("starts"), F.col("r.ends").alias("ends"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per row of ``docs``.

    An empty benchmark leaves every document clean; a null or empty text has no
    words and is clean; repeated rows and rows without doc_id are judged each by
    its own text.
    """
    found = find_leaks(docs, items, size, block_windows)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda a, b: a - b), F.lit(0).cast("long"), lambda s, x: s + x)
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(named.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their columns as they are."""
    bad = find_leaks(docs, items, size).where(F.size("starts") > 0).select(F.col("_id").alias("_bad_id"), F.col("_h").alias("_bad_h")).distinct()
    text = F.coalesce(docs.text.cast("string"), F.lit(""))
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(bad._bad_id) & (F.xxhash64(text) == bad._bad_h), "left_anti")


def items_digest(ids: list[int]) -> str:
    """The digest of ``decontaminate`` for a list of items, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
