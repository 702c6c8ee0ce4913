"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.
Which lengths go together is decided on the histogram of lengths, which never
has more than ``capacity`` entries: for each length, longest first, the gap it
leaves is looked up among the single lengths, the sums of two and the sums of
three, and a combination that fills the gap exactly is used as often as the
counts allow. What is left is packed best-fit decreasing, again by counts. The
pieces then find their place by their rank among pieces of the same length.

Scale: only the histogram reaches the driver. Ranks are counted in
(length, bucket) groups with offsets, so one length may hold all rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probegrid.llm.common import DOC_KEY, keyed, stored

CAPACITY = 1024
END_ID = 2
#: Pieces of text a worker remembers the ids of, at most.
MEMO = 400_000

#: Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = "_id long, _h long, _copy long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE splits a text into words by a fixed pattern and merges
    within words only, and a blank before a character that is no white space
    always begins a word. So a text is split at its blanks, each part is encoded
    with its blank, and the ids of parts are remembered. A text with a blank
    before white space is encoded whole, as is one with an added token of the
    file (``<|endoftext|>``), which is one id wherever it stands.

    If the vocabulary numbers its tokens in the order of their merges, the file's
    tokens are also given to ``tiktoken``, which is several times faster on short
    parts. It only gets parts of Latin characters, whose classes are certain.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.parts: dict[str, bytes | None] = {}
        self.limit = memo
        self.latin = re.compile("[\t\n\r\x20-\x7E\u00A1-\u024F]*")
        step = spec.get("pre_tokenizer") or {}
        self.by_word = step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and not spec.get("normalizer")
        self.fast, self.lengths = (_ranked(spec) if self.by_word else None) or (None, None)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: set[str]) -> None:
        """Remember the ids of parts (each with the blank before it)."""
        short = []
        for x in missing:
            if not x or x[0].isspace():
                self.parts[x] = None
            elif self.fast is not None and self.latin.fullmatch(x):
                short.append(x)
            else:
                self.parts[x] = self.whole(" " + x)
        if not short:
            return
        # one call for all: the ids are dealt to the parts by the bytes they stand for
        ids = np.asarray(self.fast.encode_ordinary(" " + " ".join(short)), dtype="<u4")
        ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(x.encode()) + 1 for x in short])) + 1
        data, at = ids.tobytes(), 0
        for x, end in zip(short, (4 * cuts).tolist(), strict=True):
            self.parts[x] = data[at:end]
            at = end

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text, in order."""
        if not self.by_word:
            yield from map(self.whole, texts)
            return
        parts, at = self.parts, 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < 1 << 20:
                group.append(texts[at])
                size += len(texts[at])
                at += 1
            if len(parts) > self.limit:
                parts.clear()
            split = [[t] if any(x in t for x in self.added) else t.split(" ") for t in group]
            self._learn({x for words in split for x in words[1:]} - parts.keys())
            for text, (first, *rest) in zip(group, split, strict=True):
                found = [parts[x] for x in rest]
                yield self.whole(text) if None in found else self.whole(first) + b"".join(found)


def _ranked(spec: dict):
    """The vocabulary as merge ranks, or None if its ids do not follow the order of its merges."""
    import tiktoken

    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    # bytes that print stand for themselves, the others for characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}), lengths


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    head = n % capacity or capacity
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``_id, _h, _copy, piece, start, length, ids_crc32`` and, if asked for, ``ids``: the pieces of every document.

    An empty or null text is the end token alone. ``_copy`` numbers the rows of
    one partition, and tells repeated rows apart.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True))
            out: list[tuple] = []
            ids: list[np.ndarray] = []
            for key, ids_of in zip(keys, encoder.encode_all(batch.column(2).to_pylist()), strict=True):
                tokens = ids_of + end
                for k, (start, length) in enumerate(cut(len(tokens) // 4, capacity)):
                    part = tokens[4 * start:4 * (start + length)]
                    out.append((*key, k, start, length, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            columns = [list(c) for c in zip(*out, strict=True)] or [[] for _ in range(7)]
            arrays = [pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(columns)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_h", "_copy", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return keyed(docs).withColumn("_copy", F.monotonically_increasing_id()).mapInArrow(pieces, _PIECES + ", ids array<long>" * with_ids)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), covering the histogram exactly.

    Works on counts: its cost depends on ``capacity`` alone.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []

    def available(parts: tuple[int, ...]) -> int:
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        return min(int(counts[p]) // k for p, k in need.items())

    def use(parts: tuple[int, ...]) -> bool:
        n = available(parts)
        if n:
            plan.append((parts, n))
            for p in parts:
                counts[p] -= n
        return n > 0

    def pairs(total: int, most: int) -> Iterator[tuple[int, int]]:
        """Available lengths a >= b, a <= most, that sum to total, the largest a first."""
        low, high = (total + 1) // 2, min(most, total - 1)
        if high >= low:
            a = np.arange(high, low - 1, -1)
            for x in a[(counts[a] > 0) & (counts[total - a] > 0)]:
                yield int(x), int(total - x)

    use((capacity,))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if not counts[length]:
            continue
        use((length, gap))
        for a, b in pairs(gap, min(length, gap - 1)):
            if not counts[length]:
                break
            use((length, a, b))
        for a in range(min(length, gap - 2), 0, -1):
            if not counts[length]:
                break
            if counts[a]:
                for b, c in pairs(gap - a, a):
                    if not (counts[length] and counts[a]):
                        break
                    use((length, a, b, c))
    # best-fit decreasing: open sequences by the gap they leave
    gaps: list[int] = []
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(parts: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(parts)
        if gap == 0:
            plan.append((parts, n))
            return
        if gap not in opened:
            opened[gap] = []
            insort(gaps, gap)
        opened[gap].append((parts, n))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fit = capacity // length
                full, rest = divmod(left, fit)
                if full:
                    put((length,) * fit, full)
                if rest:
                    put((length,) * rest, 1)
                left = 0
                continue
            gap = gaps[at]
            parts, n = opened[gap].pop()
            if not opened[gap]:
                del opened[gap]
                gaps.pop(at)
            fit = gap // length
            whole = min(n, left // fit)
            if whole:
                put(parts + (length,) * fit, whole)
                left -= whole * fit
                n -= whole
            if n and 0 < left < fit:
                put(parts + (length,) * left, 1)
                left, n = 0, n - 1
            if n:
                if gap not in opened:
                    opened[gap] = []
                    insort(gaps, gap)
                opened[gap].append((parts, n))
    return plan + [x for of in opened.values() for x in of]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> first rank, first sequence and offset of each run of its pieces."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for parts, n in plan:
        offset = 0
        for p in parts:
            rows.setdefault(p, []).append((used.get(p, 0), sequence, offset))
            used[p] = used.get(p, 0) + n
            offset += p
        sequence += n
    return {p: tuple(np.asarray(c, dtype=np.int64) for c in zip(*r, strict=True)) for p, r in rows.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = 1024) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` must be a written table."""
    order = [*DOC_KEY, "_copy", "piece"]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    # at most capacity x buckets rows
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots_of = _slots(plan_sequences(histogram, capacity))
    within = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(
        bases, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))).select(
        *pieces.columns, (F.col("base") + F.col("_rank")).alias("_rank"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            ranks = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, number, place_of = slots_of[int(length)]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows] = number[k] + ranks[rows] - first[k]
                offset[rows] = place_of[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(find, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``), one row per piece.

    Null text counts as empty, an empty text is one piece of the end token; repeated
    rows and rows without doc_id are packed each. An empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    return place(pieces, capacity).select(
        F.col("_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
