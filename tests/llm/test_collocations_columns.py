"""Collocations are counted by columns: the work in Python does not grow with the words, and nothing is lost."""

import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa

from probegrid.llm import collocations


def in_python(call):
    """What ``call`` returns, and the calls that Python made meanwhile."""
    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        return call(), calls
    finally:
        sys.setprofile(None)


def test_sequences_are_counted_by_columns():
    r = random.Random(4)
    words = [r.choice(["a", "b", "É", "x\x01", *map(str, range(300))]).encode() for _ in range(20_000)]
    line = np.sort(np.array([r.randrange(900) for _ in words]))
    here = 19_998
    column = pa.array(words, pa.binary())
    got, calls = in_python(lambda: collocations._counted(column, line, here, b"en\n"))
    assert calls < 1000
    want, ends = Counter(), Counter()
    for i in range(here):
        w = [words[j].decode() for j in range(i, min(i + 3, len(words))) if line[j] == line[i]]
        (want if len(w) == 3 else ends)[("en\n" + " ".join(w[:2]), *w[2:])] += 1
    edges, through = Counter(), Counter()
    for row in got.to_pylist():
        through[row["node"]] += row["through"]
        for x in row["followers"].split("\n") if row["followers"] else ():
            third, _, n = x.partition("\t")
            edges[row["node"], third] += int(n or 1)
    assert edges == want
    total = Counter()
    for c in (want, ends):
        for k, n in c.items():
            total[k[0]] += n
    assert through == total and len(through) == got.num_rows


def test_word_flows_are_summed_by_columns():
    """Languages may hold blanks and line feeds, words any other character."""
    r = random.Random(5)
    rows = sorted((f"{lang}\n{a}{b}".encode(), r.randrange(1, 9)) for lang in ("en", "", "a b", "c\nd e") for a in ("x", "xy", "É\x01") for b in ("", " u", " v") for _ in range(300))
    nodes = pa.array([k.decode() for k, _ in rows]).slice(7)
    through = np.array([n for _, n in rows[7:]])
    got, calls = in_python(lambda: collocations._word_flows(nodes, through))
    assert calls < 300
    want = Counter()
    for k, n in rows[7:]:
        lang, phrase = k.decode().rsplit("\n", 1)
        want[lang, phrase.split(" ")[0]] += n
    summed = Counter()
    for x in got.to_pylist():
        summed[x["lang"], x["phrase"]] += x["a"]
    assert summed == want
