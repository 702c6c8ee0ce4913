"""Near duplicates from bottom-k sketches of one hash function.

Each document's 5-word shingles are hashed once; its sketch is the k smallest
hashes. Documents with equal shingle sets form a class and go on as one.
Inverted lists over retained values give candidate pairs: two classes above the
threshold share most of their sketches, so it is enough to list each class
under its rarest few retained values (rarity is counted over all classes). The
k smallest values of both sketches together estimate the Jaccard similarity of
a candidate pair and filter it; what passes is verified on the full shingle
sets. Components of the verified links are the groups.

No list is paired. Members are compared with central members of their lists first,
and components are formed. Those that did not join are then compared with members
outside their own component that a prefix filter on the full sets leaves, a few drawn
partners each at first and in the end all, which is exact and finds few.

A pair above the threshold is missed only if its sketches share less than
``NEEDED`` of k = 64 values where about 58 are expected, 5 standard deviations;
sketches of documents with up to 54 shingles are complete and miss nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probegrid.llm.common import keyed, release, stored, strings
from probegrid.llm.graph import components

SHINGLE_WORDS = 5
THRESHOLD = 85
SKETCH = 64
#: Retained values that two sketches of SKETCH values share at least, for a pair above the threshold.
NEEDED = 40
#: Estimates below this share of the threshold are dropped: five standard deviations of the estimate.
SLACK = 0.72
#: Members of a list that are dealt to one task, about.
SPLIT = 1000
#: Turns of drawn partners end when one leaves more than this share of the components outside.
LAGGING = 0.85
#: Partners of a member in one turn, and the lists they are drawn from.
DRAWN, LISTS = 16, 4
#: Bits that the shingles of a set are folded onto, to bound how many two sets do not share.
MARKS = 512
#: Words a worker remembers the hash of, at most.
MEMO = 200_000
#: Bits of the bitmap of wanted texts: for each, at most, and in one row of it (a value of Spark's bitmap functions).
KEY_BITS, BITMAP_BITS, PAGE = 16, 1 << 27, 1 << 15

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_set(text: bytes, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text (A-Z lower-cased, words between white space)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    hashes = np.empty(n, dtype=np.uint64)
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w)
        hashes[i] = h
    width = min(n, SHINGLE_WORDS)
    mixed = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        mixed = mixed * _MIX[4] + hashes[i:n - width + 1 + i] * _MIX[i]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[1]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX[2]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _offsets(arrays: list[np.ndarray]) -> pa.Array:
    lengths = np.fromiter((len(a) for a in arrays), dtype=np.int32, count=len(arrays))
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def signatures(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """``_id, _h, n, digest, sketch``: set size, digest of the whole set, its k smallest hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_set(t, memo) for t in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                _offsets([s[:k] for s in sets]),
            ], names=["_id", "_h", "n", "digest", "sketch"])

    return keyed(docs).mapInArrow(sign, "_id long, _h long, n long, digest binary, sketch array<long>")


def classes_of(signed: DataFrame) -> DataFrame:
    """``k, c, ch, n, sketch, digest``: a numbered row per distinct shingle set, with its smallest (doc_id, text hash).

    Store it before use: the numbers are given when rows are made.
    """
    linked = signed.where("n > 0 and _id is not null")
    return linked.groupBy("digest").agg(F.min(F.struct("_id", "_h")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select(
        F.monotonically_increasing_id().alias("k"), F.col("rep._id").alias("c"), F.col("rep._h").alias("ch"), "n", "sketch", "digest")


def postings(classes: DataFrame, size: int = SKETCH) -> DataFrame:
    """``v, k, n, central``: each class under the rarest of its retained values that it must be found by."""
    values = classes.select("k", "n", F.explode("sketch").alias("v"))
    counts = values.groupBy(F.col("v").alias("_v")).agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(counts, F.col("v") == F.col("_v"))
    full = int(size * THRESHOLD / 100)
    kept = F.least("n", F.lit(size))
    needed = F.when(F.col("n") <= full, F.ceil(F.col("n") * THRESHOLD / 100)).otherwise(F.greatest(F.lit(1), F.floor(kept * NEEDED / size)))
    # values of one class come first and can link with nothing: they use up the front of the prefix
    front = F.greatest(F.lit(0), kept - needed + 1 - (kept - F.size("shared"))).cast("int")
    ranked = shared.groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
    return ranked.select("k", "n", F.size("shared").alias("central"), F.explode(F.slice("shared", F.lit(1), front)).alias("p")).select(
        F.col("p.v").alias("v"), "k", "n", "central")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _attach(pairs: DataFrame, table: DataFrame, side: str, value: str, name: str) -> DataFrame:
    other = table.select(F.col("k").alias("_k"), F.col(value).alias(name))
    return pairs.join(other, F.col(side) == F.col("_k")).drop("_k")


def _estimated(pairs: DataFrame, classes: DataFrame, size: int = SKETCH) -> DataFrame:
    """Pairs that the union sketch lets pass, with ``link`` true where complete sketches settle it, else null."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, link = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (s.values.to_numpy().view(np.uint64) for s in (x, y))
                union = np.union1d(x, y)
                if len(x) < size and len(y) < size:
                    same = len(x) + len(y) - len(union)
                    keep.append(100 * same >= THRESHOLD * len(union))
                    link.append(True)
                    continue
                low = union[:size]
                same = np.isin(low, x, assume_unique=True) & np.isin(low, y, assume_unique=True)
                keep.append(bool(same.mean() * 100 >= SLACK * THRESHOLD))
                link.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(link, pa.bool_())], names=["a", "b", "link"]).filter(pa.array(keep, pa.bool_()))

    both = _attach(_attach(pairs, classes, "a", "sketch", "sa"), classes, "b", "sketch", "sb")
    return both.select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long, link boolean")


def _shingle_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k, shingles``: the full sets of the classes in ``wanted`` (k), as sorted 64-bit hashes in binary.

    Each set is read from one text of its class. The keys are stored before the
    join, so that Spark knows their size: it broadcasts them or, beyond its
    threshold, shuffles by key the texts that a bitmap of the keys leaves.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, memo).tobytes() for t in strings(batch.column(1))], pa.binary())], names=["k", "shingles"])

    keys = stored(classes.select("k", "c", "ch").join(wanted.distinct(), "k", "left_semi"), "wanted-classes")
    texts = _marked_texts(keyed(docs), keys).join(keys, (F.col("_id") == F.col("c")) & (F.col("_h") == F.col("ch"))).select("k", "text")
    # a row may stand there twice with one id and text
    return stored(texts.mapInArrow(sets, "k long, shingles binary").dropDuplicates(["k"]), "shingle-sets")


def _marked_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose place in a bitmap is taken by a key: all that have a key, and about one in ``KEY_BITS`` others.

    The bitmap, two bytes a key and ``BITMAP_BITS`` at most, is broadcast where the keys themselves would not be.
    """
    bits = min(BITMAP_BITS, max(1, keys.count()) * KEY_BITS)
    place = F.pmod(F.xxhash64("_id", "_h"), F.lit(bits))
    taken = keys.select(F.col("c").alias("_id"), F.col("ch").alias("_h")).select(place.alias("at"))
    pages = taken.groupBy(F.shiftright("at", 15).alias("_page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(PAGE - 1))).alias("_taken"))
    within = F.col("_at").bitwiseAND(F.lit(PAGE - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_taken", F.shiftright(within, 3) + 1, F.lit(1))), 16, 10).cast("int")
    near = texts.withColumn("_at", place).join(F.broadcast(pages), F.shiftright("_at", 15) == F.col("_page"))
    return near.where(F.getbit(byte, within.bitwiseAND(F.lit(7))) == 1).select(*texts.columns)


def _reaching(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """``a, b`` of the pairs whose full shingle sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= THRESHOLD * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _attach(_attach(pairs, full, "a", "shingles", "sa"), full, "b", "shingles", "sb")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _verified(passed: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that are settled, or whose full sets reach the threshold."""
    sure = passed.where("link").select("a", "b")
    unsure = passed.where("link is null").select("a", "b")
    wanted = unsure.select(F.col("a").alias("k")).union(unsure.select("b"))
    return sure.union(_reaching(unsure, _shingle_sets(docs, classes, wanted)))


def _marked(full: DataFrame) -> DataFrame:
    """``k, marks``: for each of ``MARKS`` bits whether an odd number of the member's shingles falls on it, as longs."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(1))
            odd = [np.bincount((s & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1 for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), _offsets([np.packbits(x.astype(np.uint8)).view(np.uint64) for x in odd])], names=["k", "marks"])

    return full.mapInArrow(mark, "k long, marks array<long>")


def _may_reach(n: Column, n_b: Column, marks: Column, marks_b: Column) -> Column:
    """False only for pairs below the threshold: a bit in which the marks differ takes a shingle that only one of the sets has."""
    differ = F.lit(0)
    for i in range(MARKS // 64):
        differ = differ + F.bit_count(marks[i].bitwiseXOR(marks_b[i]))
    return differ <= n + n_b - 2 * _needed(n, n_b)


def _prefixes(full: DataFrame, sizes: DataFrame) -> DataFrame:
    """``s, k, n, marks, left``: members (k, n) under the shingles that a partner above the threshold may be found by.

    Shingles come from the rarest on, and each member stands under as many as its
    smallest partner can force it to share. ``left`` counts the member's shingles from
    this one on: that is all that is left to share.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, of in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                s = np.frombuffer(of, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(s)], names=["k", "s"])

    each = full.mapInArrow(spread, "k long, s long")
    counts = each.groupBy(F.col("s").alias("_s")).agg(F.count("*").alias("df"))
    # only shingles that two members share can link them; the others stand in front of them
    shared = each.join(counts.where("df > 1"), F.col("s") == F.col("_s")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"))
    known = shared.join(sizes.join(_marked(full), "k").select(F.col("k").alias("_k"), "n", "marks"), F.col("k") == F.col("_k"))
    room = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100) + 1 - (F.col("n") - F.size("shared"))).cast("int")
    posted = known.select("k", "n", "marks", (F.col("n") - F.size("shared")).alias("front"), F.posexplode(F.slice("shared", F.lit(1), room)).alias("at", "p"))
    return stored(posted.select(F.col("p.s").alias("s"), "k", "n", "marks", (F.col("n") - F.col("front") - F.col("at")).alias("left")), "prefixes")


def _with_state(posted: DataFrame, state: DataFrame) -> DataFrame:
    return posted.join(state.select(F.col("k").alias("_k"), "label", "rest"), F.col("k") == F.col("_k")).drop("_k")


def _needed(a: Column, b: Column) -> Column:
    """Shingles that sets of these sizes share at the threshold."""
    return F.ceil((a + b) * THRESHOLD / (100 + THRESHOLD))


def _partners(posted: DataFrame, state: DataFrame, turn: int) -> DataFrame:
    """``a, b``: for each member outside, up to ``DRAWN`` members of other components, drawn by hash from its prefix lists.

    Where a group hangs together by very many links, a few such turns join most of
    it, and its pairs are never formed: a list gives no more than ``DRAWN`` of its
    members away, and a member looks into a few of its lists. What a draw misses is
    left to a later turn or to the full comparison at the end.
    """
    placed = _with_state(posted, state)
    part = F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(DRAWN)).alias("part")
    drawn = placed.groupBy(F.col("s").alias("_s"), part).agg(F.max(F.struct(F.xxhash64("k", "s", F.lit(turn)).alias("h"), "k", "n", "label", "marks")).alias("p"))
    drawn = drawn.select("_s", F.col("p.k").alias("with"), F.col("p.n").alias("n_b"), F.col("p.label").alias("label_b"), F.col("p.marks").alias("marks_b"))
    # a member has as many rows here as its prefix has shingles
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("s", F.lit(turn)), "s"))
    probes = placed.where("rest").withColumn("nth", nth).where(F.col("nth") <= LISTS)
    near = _sizes_fit(F.col("n"), F.col("n_b")) & _may_reach(F.col("n"), F.col("n_b"), F.col("marks"), F.col("marks_b"))
    met = probes.join(drawn, (F.col("s") == F.col("_s")) & (F.col("label") != F.col("label_b")) & near).select("k", "with").distinct()
    few = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("with", F.lit(turn)), "with"))
    return _ordered(met.withColumn("nth", few).where(F.col("nth") <= DRAWN), "k", "with")


def _crossing(posted: DataFrame, state: DataFrame) -> DataFrame:
    """``a, b``: all pairs of a member outside and one of another component that the prefix filter and the marks leave.

    Neither drops a pair above the threshold. Partners of about one size share a bucket, so that the number to share is exact for them.
    """
    posted = _with_state(posted, state)
    step = float(np.log(1.05))
    bucket = F.floor(F.log("n") / step)
    targets = F.sequence(F.floor(F.log(F.col("n") * THRESHOLD / 100) / step), F.floor(F.log(F.col("n") * 100 / THRESHOLD) / step))
    probes = posted.where("rest").withColumn("bucket", F.explode(targets))
    smallest = F.greatest(F.ceil(F.col("n") * THRESHOLD / 100), F.floor(F.exp(F.col("bucket") * step)))
    probes = probes.where(F.col("left") >= _needed(F.col("n"), smallest))
    other = posted.select(F.col("s").alias("_s"), bucket.alias("_bucket"), *[F.col(x).alias(f"{x}_b") for x in ("k", "n", "label", "left", "marks")])
    met = probes.join(other, (F.col("s") == F.col("_s")) & (F.col("bucket") == F.col("_bucket")) & (F.col("label") != F.col("label_b")) & _sizes_fit(F.col("n"), F.col("n_b"))
                      & (F.least("left", "left_b") >= _needed(F.col("n"), F.col("n_b"))) & _may_reach(F.col("n"), F.col("n_b"), F.col("marks"), F.col("marks_b")))
    return _ordered(met, "k", "k_b")


def _lists(classes: DataFrame) -> DataFrame:
    """``v, k, n, pivot, pivot_n, members, salt, salts``: list members with the central member of their list.

    Members of a long list are dealt over ``salts`` groups.
    """
    lists = stored(postings(classes), "postings")
    heads = lists.groupBy("v").agg(F.count("*").alias("members"), F.max(F.struct("central", (-F.col("k")).alias("low"), "k", "n")).alias("p")).where("members > 1")
    heads = stored(heads.select("v", "members", F.col("p.k").alias("pivot"), F.col("p.n").alias("pivot_n"), F.ceil(F.col("members") / SPLIT).cast("int").alias("salts")), "list-heads")
    # as many rows as there are long lists, SPLIT times fewer than members
    long = stored(heads.where("salts > 1").select(F.col("v").alias("_v"), "salts"), "long-lists")
    salt = F.coalesce(F.pmod(F.xxhash64("k"), F.col("salts")).cast("int"), F.lit(0))
    dealt = lists.join(long, F.col("v") == F.col("_v"), "left").select("v", "k", "n", salt.alias("salt"))
    each = heads.select(F.col("v").alias("_v"), "members", "pivot", "pivot_n", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"))
    return stored(dealt.join(each, (F.col("v") == F.col("_v")) & (F.col("salt") == F.col("_salt"))).drop("_v", "_salt"), "lists")


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    return stored(_verified(stored(_estimated(pairs, classes), "candidates"), docs, classes), "links")


def _labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``lists`` with the component of each member (``label``) and of its list's central member (``main``)."""
    labels = components(links)
    label_of = lambda name: labels.select(F.col("node").alias(f"_{name}"), F.col("label").alias(f"{name}_label"))
    known = lists.join(label_of("k"), F.col("k") == F.col("_k"), "left").join(label_of("pivot"), F.col("pivot") == F.col("_pivot"), "left")
    return stored(known.select(*lists.columns, F.coalesce("k_label", "k").alias("label"), F.coalesce("pivot_label", "pivot").alias("main")), "labelled-lists")


def links_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: verified links between classes; their components are those of all pairs above the threshold.

    First each class meets the central member of the longest list it stands in:
    one pair a class, whatever the size of its group. Then only members that this left
    outside their list's component meet the central members of their other lists, then
    others drawn from lists of a prefix filter on the full sets, for as long as a turn
    merges a good part of the components, and last all that the filter leaves.
    """
    lists = _lists(classes)
    fit = (F.col("k") != F.col("pivot")) & _sizes_fit(F.col("n"), F.col("pivot_n"))
    longest = lists.where(fit).groupBy("k").agg(F.max(F.struct("members", "v", "pivot")).alias("first")).select("k", F.col("first.pivot").alias("pivot"))
    links = _linked(_ordered(longest, "k", "pivot"), docs, classes)
    apart = _labelled(lists, links).where("label <> main")
    links = stored(links.union(_linked(_ordered(apart.where(fit), "k", "pivot"), docs, classes)).distinct(), "links")
    release(docs.sparkSession)
    # of a list of two, the only pair is settled
    torn = _torn(_labelled(lists.where("members > 2"), links))
    if torn.isEmpty():
        return links
    members = stored(torn.select("k", "n").distinct(), "torn-members")
    full = _shingle_sets(docs, classes, members.select("k"))
    posted = _prefixes(full, members)
    state, left, turn = _state(torn), None, 0
    while True:
        before, left = left, state.where("rest").select("label").distinct().count()
        if not left:
            return links
        if before is not None and left > before * LAGGING:
            return stored(links.union(_reaching(_crossing(posted, state), full)).distinct(), "links")
        links = stored(links.union(_reaching(_partners(posted, state, turn), full)).distinct(), "links")
        torn, turn = _torn(_labelled(torn.drop("label", "main"), links)), turn + 1
        state = _state(torn)


def _state(torn: DataFrame) -> DataFrame:
    """``k, label, rest``: the component of each member of a torn list, and whether it is outside that of a central member."""
    return stored(torn.groupBy("k").agg(F.max("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("rest")), "member-states")


def _torn(known: DataFrame) -> DataFrame:
    """The lists of which some member is outside the component of the central one."""
    of = known.where("label <> main").groupBy(F.col("v").alias("_v")).agg(F.max("salts").alias("_salts"))
    of = of.select("_v", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return stored(known.join(of, (F.col("v") == F.col("_v")) & (F.col("salt") == F.col("_salt")), "left_semi"), "torn-lists")


def _numbered(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``_id, _h, k``: the class of each row that has one."""
    linked = signed.where("n > 0 and _id is not null").select("_id", "_h", F.col("digest").alias("_digest"))
    return linked.join(classes.select("digest", "k"), F.col("_digest") == F.col("digest")).select("_id", "_h", "k")


def _same_id(rows: DataFrame) -> DataFrame:
    """``a, b``: links between the classes of rows that repeat a doc_id."""
    repeated = stored(rows.groupBy(F.col("_id").alias("_rid")).agg(F.min("k").alias("a"), F.max("k").alias("high")).where("a < high"), "repeated-ids")
    return rows.join(repeated, F.col("_id") == F.col("_rid")).select("a", F.col("k").alias("b")).where("a < b").distinct()


def _representatives(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``k, rep``: for each class the smallest (doc_id, text hash) that it reaches over ``links``."""
    labels = components(links)
    named = classes.select("k", "c", "ch").join(labels, F.col("k") == F.col("node"), "left").select("k", F.coalesce("label", "k").alias("label"), F.struct("c", "ch").alias("own"))
    least = named.groupBy(F.col("label").alias("_label")).agg(F.min("own").alias("rep"))
    return named.join(least, F.col("label") == F.col("_label")).select("k", "rep")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Documents without words (null or empty text) and rows without doc_id are
    linked with nothing; the latter have no component and are kept. Rows that
    repeat a doc_id are one node of the link graph, with the links of each of their
    texts, and share its fate. An empty table gives no rows.
    """
    signed = stored(signatures(docs), "signatures")
    classes = stored(classes_of(signed), "classes")
    links = links_of(docs, classes).union(_same_id(_numbered(signed, classes)))
    found = _representatives(classes, links)
    known = stored(classes.select("digest", "k").join(found.select(F.col("k").alias("_k"), "rep"), F.col("k") == F.col("_k")).select(F.col("digest").alias("_d"), F.col("rep.c").alias("component")), "components-by-set")
    rows = signed.join(known, (F.col("digest") == F.col("_d")) & (F.col("n") > 0) & F.col("_id").isNotNull(), "left").select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are.

    Here texts are the nodes: of each group of texts that links connect, the one
    with the smallest doc_id stays, so that no text goes for sharing a doc_id
    with another. Rows without words or without doc_id stay.
    """
    signed = stored(signatures(docs), "signatures")
    classes = stored(classes_of(signed), "classes")
    found = _representatives(classes, links_of(docs, classes))
    rows = _numbered(signed, classes).join(found.select(F.col("k").alias("_k"), "rep"), F.col("k") == F.col("_k"))
    gone = stored(rows.where((F.col("_id") != F.col("rep.c")) | (F.col("_h") != F.col("rep.ch"))).select(F.col("_id").alias("_gone_id"), F.col("_h").alias("_gone_h")).distinct(), "dropped")
    text = F.coalesce(docs.text.cast("string"), F.lit(""))
    return docs.join(gone, (docs.doc_id.cast("long") == gone._gone_id) & (F.xxhash64(text) == gone._gone_h), "left_anti")
