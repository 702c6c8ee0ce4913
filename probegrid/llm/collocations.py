"""Phrase collocation mining on a weighted de Bruijn graph.

Nodes are two-word sequences, edges three-word sequences between overlapping
nodes, weighted by their occurrences within pieces. Tasks count edges, and the
words that end a piece; Spark adds them up. No shorter phrase is counted again:
a node occurs as often as its outgoing edges weigh together, plus the pieces
that end in it, and a word likewise. Of the graph, edges and nodes that reach the
minimum count go on. Unary paths (chains of nodes with one edge in and one out)
are compacted into one row, by pointer doubling over the edges; inside a path the
longer phrases around a node stand beside it, and only nodes at path ends meet
theirs by an aggregation.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probegrid.llm.common import changes, release, sorted_flags, stored, strings

LEAST = 10
TOP = 2000
#: A candidate goes when a longer one has this share of its occurrences, in hundredths.
COVERED = 50
#: Words a task counts at once, at most: about 150 MB. Three numbers of words must fit into 63 bits.
COUNTED = 1_000_000
#: Bytes of text that are taken for a word.
WORD_BYTES = 6
#: Rows of one node whose edges are held before they are summed.
FOLDED = 1000
#: Edges in one row of a compacted path, at most; longer paths go over several rows.
SEGMENT = 4096
_GRAPH = ["lang", "phrase", "words", "a"]
#: Lower case, and all piece separators as one.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between each start and end, as a binary column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def _counted(words: pa.Array, line: np.ndarray, here: int, head: bytes) -> pa.RecordBatch:
    """Rows of ``edge_counts`` for the sequences that the first ``here`` words start; ``line`` numbers the piece of each word.

    A sequence is one integer of three digits, the numbers of its words (0 for none),
    so that sorted integers bring equal sequences, and those of a node, together.
    """
    words = words.dictionary_encode()
    known, ids = words.dictionary, words.indices.to_numpy().astype(np.int64)
    base = len(known) + 1
    following = np.zeros((2, len(ids)), dtype=np.int64)
    for k in (1, 2):
        following[k - 1, :len(ids) - k] = np.where(line[k:] == line[:len(line) - k], ids[k:] + 1, 0)
    keys = np.sort((ids[:here] * base + following[0, :here]) * base + following[1, :here])
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(edge, len(keys)))
    node, third = np.divmod(keys[edge], base)
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    one, two = np.divmod(node[first], base)
    # third words by number, those with a count after all others
    often = np.flatnonzero((n > 1) & (third > 0))
    texts = pa.concat_arrays([known, pc.binary_join_element_wise(known.take(pa.array(third[often] - 1)), pa.array(n[often]).cast(pa.string()).cast(pa.binary()), b"\t")])
    third[often] = len(known) + 1 + np.arange(len(often))
    listed = np.concatenate([[0], np.cumsum(third > 0)])[np.append(first, len(third))]
    followers = pc.binary_join(pa.ListArray.from_arrays(pa.array(listed.astype(np.int32)), texts.take(pa.array(third[third > 0] - 1))), b"\n")
    seconds = pa.concat_arrays([pa.array([b""], pa.binary()), pc.binary_join_element_wise(b" ", known, b"")])
    names = pc.binary_join_element_wise(pc.binary_join_element_wise(head, known, b"").take(pa.array(one)), seconds.take(pa.array(two)), b"")
    return pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.add.reduceat(n, first)), followers.cast(pa.string())], names=["node", "through", "followers"])


def edge_counts(docs: DataFrame) -> DataFrame:
    """``node, through, followers``: what tasks have counted of the edges of each node, with its flow.

    ``node`` is the language, a line feed (no word holds one) and one or two words.
    ``followers`` lists the third words, a line each, with a tab (no word holds one
    either) and the count where it is not one. A node that ends a piece adds to its
    flow only. Every word of a text starts exactly one counted sequence. A task counts
    about ``COUNTED`` words of a language at a time, so a node may come in several rows.
    """

    def rows(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"\n".join(texts).translate(_FOLD), dtype=np.uint8)
        inside = np.concatenate([[False], (data != 32) & (data != 9) & (data != 10), [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        # a single text may be longer than a task should count at once; the last words of a part look two words ahead
        for at in range(0, len(starts), COUNTED):
            part = slice(at, at + COUNTED + 2)
            counted = _counted(_spans(data, starts[part], ends[part]), line[part], min(COUNTED, len(starts) - at), lang.encode() + b"\n")
            for k in range(0, counted.num_rows, 50_000):
                yield counted.slice(k, 50_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = defaultdict(list)
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                waiting[lang].append(text)
                size += len(text)
                if size > COUNTED * WORD_BYTES:
                    for of in waiting.items():
                        yield from rows(*of)
                    waiting.clear()
                    size = 0
        for of in waiting.items():
            yield from rows(*of)

    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(count, "node string, through long, followers string")


def _word_flows(nodes: pa.Array, through: np.ndarray) -> pa.RecordBatch:
    """A row for each run of nodes with the same first word: its language, the word and the flow of the run."""
    nodes = pa.concat_arrays([nodes.cast(pa.binary())])
    offsets = np.frombuffer(nodes.buffers()[1], dtype=np.int32)[nodes.offset:nodes.offset + len(nodes) + 1].astype(np.int64)
    data = np.frombuffer(nodes.buffers()[2], dtype=np.uint8)[:offsets[-1]]
    starts, ends = offsets[:-1], offsets[1:]
    # the last line feed ends the language; a blank after it ends the first word
    feeds, blanks = np.flatnonzero(data == 10), np.flatnonzero(data == 32)
    feed = feeds[np.searchsorted(feeds, ends) - 1]
    blank = np.append(blanks, -1)[np.searchsorted(blanks, ends) - 1]
    ends = np.where(blank > feed, blank, ends)
    first = np.concatenate([[0], np.flatnonzero(changes([_spans(data, starts, ends)])) + 1])
    langs, words = _spans(data, starts[first], feed[first]), _spans(data, feed[first] + 1, ends[first])
    return pa.RecordBatch.from_arrays([langs.cast(pa.string()), words.cast(pa.string()), pa.array(np.ones(len(first), np.int32)), pa.array(np.add.reduceat(through, first))], names=_GRAPH)


def weighted_graph(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, phrase, words, a``: edges (three words) and nodes (two) that reach ``least``, and flows of single words in parts.

    All rows of a node go to one task and come one after the other, so its flow and
    its edges are summed as they pass; what is rare is never written. Flows are summed
    by columns. Edges are looked at only where the node's own flow can hold a frequent
    one; a node that goes on in the next batch has its rows folded a bounded number at
    a time. The parts of a word's flow are to be added up.
    """

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, str, int, int]] = []
        edges: Counter = Counter()
        waiting: list[str] = []
        node, so_far = None, 0

        def fold():
            for lines in waiting:
                if "\t" not in lines:
                    if lines:
                        edges.update(lines.split("\n"))
                    continue
                for line in lines.split("\n"):
                    follower, _, n = line.partition("\t")
                    edges[follower] += int(n or 1)
            waiting.clear()

        def node_ends(name: str, n: int):
            if n >= least:
                fold()
                lang, phrase = name.rsplit("\n", 1)
                if " " in phrase:
                    found.append((lang, phrase, 2, n))
                found.extend((lang, f"{phrase} {f}", 3, n) for f, n in edges.items() if n >= least)
            edges.clear()
            waiting.clear()

        def rows() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*found, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=_GRAPH)

        for batch, new, _ in sorted_flags(batches, ["node"]):
            names, through, lines = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            yield _word_flows(names, through)
            starts = np.flatnonzero(new)
            before = starts[0] if len(starts) else len(new)
            so_far += int(through[:before].sum())
            waiting += lines.slice(0, before).to_pylist()
            if len(starts):
                if node is not None:
                    node_ends(node, so_far)
                sums = np.add.reduceat(through, starts)
                often = np.flatnonzero(sums[:-1] >= least)
                sizes = np.diff(starts)[often]
                inside = np.repeat(starts[often] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                of, at = lines.take(pa.array(inside)).to_pylist(), 0
                for name, n, size in zip(names.take(pa.array(starts[often])).to_pylist(), sums[often].tolist(), sizes.tolist(), strict=True):
                    waiting += of[at:at + size]
                    node_ends(name, n)
                    at += size
                node, so_far = names[int(starts[-1])].as_py(), int(sums[-1])
                waiting += lines.slice(int(starts[-1])).to_pylist()
            if len(waiting) >= FOLDED:
                fold()
            if len(found) > 20_000:
                yield rows()
        if node is not None:
            node_ends(node, so_far)
        if found:
            yield rows()

    dealt = edge_counts(docs).repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(flow, "lang string, phrase string, words int, a long")


def _first(phrase: Column, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def _rest(phrase: Column) -> Column:
    """The phrase without its first word."""
    return F.substring(phrase, F.length(_first(phrase, 1)) + 2, F.length(phrase))


def _heads(follows: DataFrame, edges: DataFrame) -> DataFrame:
    """``edge, head, hops``: the first edge of each edge's unary path, and the steps to it. ``follows`` is (edge, before).

    Pointers double in reach with each round, so a path of m edges takes log2(m)
    rounds. Edges on a closed ring of unary nodes have no first edge: once the
    reach passes the number of open edges they are known, and each is a path alone.
    """
    plain = edges.select("edge").join(follows, "edge", "left")
    now = stored(plain.select("edge", F.coalesce("before", "edge").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("hops"), F.col("before").isNull().alias("done")), "path-heads")
    reach = 1
    while True:
        open_edges = now.where("not done").count()
        if not open_edges:
            break
        if reach > open_edges:
            now = now.select("edge", F.when(F.col("done"), F.col("head")).otherwise(F.col("edge")).alias("head"), F.when(F.col("done"), F.col("hops")).otherwise(0).alias("hops"), "done")
            break
        ahead = now.select(F.col("edge").alias("_at"), F.col("head").alias("_head"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        moved = now.where("not done").join(ahead, F.col("head") == F.col("_at")).select("edge", F.col("_head").alias("head"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"))
        now = stored(now.where("done").unionByName(moved), "path-heads")
        reach *= 2
    return now.select("edge", "head", "hops")


def compact_paths(edges: DataFrame) -> DataFrame:
    """``lang, head, part, steps``: unary paths of (edge, lang, phrase, a), steps in order, ``SEGMENT`` edges a row at most."""
    source, target = _first(F.col("phrase"), 2), _rest(F.col("phrase"))
    into = edges.groupBy(F.col("lang").alias("_l"), target.alias("_t")).agg(F.count("*").alias("ins"), F.max("edge").alias("before")).where("ins = 1")
    out = edges.groupBy("lang", source.alias("source")).agg(F.count("*").alias("outs"), F.max("edge").alias("edge")).where("outs = 1")
    # an edge from a node to itself does not follow itself
    follows = out.join(into, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_t"))).where("edge <> before").select("edge", "before")
    placed = edges.join(_heads(follows, edges), "edge").withColumn("part", F.floor(F.col("hops") / SEGMENT))
    return placed.groupBy("lang", "head", "part").agg(F.array_sort(F.collect_list(F.struct("hops", "phrase", "a"))).alias("steps"))


def _uncovered(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lang, phrase, a``: the nodes that no edge beside them covers."""
    steps = F.col("steps")
    # inside a path the two edges of a node stand side by side; ends collect theirs from all paths
    inner = paths.select("lang", F.inline(F.slice(F.transform(steps, lambda s, i: F.struct(
        _rest(s["phrase"]).alias("phrase"), F.greatest(s["a"], F.get(steps, i + 1)["a"]).alias("longer"))), F.lit(1), F.size(steps) - 1)))
    first, last = F.element_at(steps, 1), F.element_at(steps, -1)
    ends = paths.select("lang", F.inline(F.array(
        F.struct(_first(first["phrase"], 2).alias("phrase"), first["a"].alias("longer")),
        F.struct(_rest(last["phrase"]).alias("phrase"), last["a"].alias("longer")))))
    beside = inner.unionByName(ends.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    beside = beside.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), "longer")
    joined = nodes.join(beside, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left")
    return joined.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * COVERED)).select("lang", "phrase", "a")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals of 38 digits."""
    a, left, right = (c.cast("decimal(18,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * a * a, left * right)


def _with(df: DataFrame, counts: DataFrame, phrase: Column, name: str) -> DataFrame:
    other = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("a").alias(name))
    return df.withColumn("_part", phrase).join(other, (F.col("lang") == F.col("_l")) & (F.col("_part") == F.col("_p"))).drop("_l", "_p", "_part")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two or three words of each language.

    ``docs`` needs ``text`` and ``lang``. Null text is empty, null lang is ``und``;
    an empty table, or one without a phrase of ``least`` occurrences, gives no rows.
    Repeated rows count as often as they stand there. Ties are ordered by phrase,
    so the result is one for all runs.
    """
    graph = stored(weighted_graph(docs, least), "phrase-graph")
    release(docs.sparkSession)
    flows = graph.where("words = 1").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    words = stored(flows.where(F.col("a") >= least), "word-flow")
    nodes = graph.where("words = 2").select("lang", "phrase", "a")
    edges = stored(graph.where("words = 3").select("lang", "phrase", "a", F.monotonically_increasing_id().alias("edge")), "edges")
    totals = graph.where("words = 1").groupBy(F.col("lang").alias("_lang")).agg(F.sum("a").alias("n"))
    phrase = F.col("phrase")
    full = _with(_with(_with(_with(edges, nodes, _rest(phrase), "node"), words, _first(phrase, 1), "l1"), nodes, _first(phrase, 2), "l2"), words, F.substring_index(phrase, " ", -1), "r2")
    full = stored(full, "edges-with-parts")
    paths = stored(compact_paths(edges), "unary-paths")
    s1, s2 = _score(F.col("a"), F.col("l1"), F.col("node")), _score(F.col("a"), F.col("l2"), F.col("r2"))
    second = F.col("s2") < F.col("s1")
    three = full.select("lang", "phrase", "a", "l1", "l2", "node", "r2", s1.alias("s1"), s2.alias("s2")).select(
        "lang", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("node")).alias("r"), F.least("s1", "s2").alias("score"))
    left = _uncovered(paths, nodes)
    two = _with(_with(left, words, _first(phrase, 1), "l"), words, _rest(phrase), "r").select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = three.unionByName(two).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrases_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same by plain counting, for DuckDB."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
        with pieces as (
            select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
            from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
        starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
        grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as a from starts, (values (1), (2), (3)) as size(k) where i + k - 1 <= len(w) group by all),
        totals as (select lang, sum(a)::bigint as n from grams where k = 1 group by lang),
        candidates as (select lang, k, phrase, a, string_split(phrase, ' ') as w from grams where k > 1 and a >= {least}),
        cuts as (select lang, phrase, a, k, w, unnest(range(1, k)) as cut from candidates),
        scored as (
            select c.lang, c.phrase, c.a, c.k, c.cut, x.a as l, y.a as r, (1000000::hugeint * c.a * c.a // (x.a::hugeint * y.a))::bigint as score
            from cuts c join grams x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.cut], ' ') join grams y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
        lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        longer as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a from candidates where k = 3),
        covers as (select lang, phrase, max(a) as a from longer group by all),
        best as (
            select s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() over (partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
            from lowest s left join covers c on c.lang = s.lang and c.phrase = s.phrase where c.a is null or 100 * c.a < {COVERED} * s.a)
        select lang, rank, phrase, a, l, r, n, score from best join totals using (lang) where rank <= {top}"""
