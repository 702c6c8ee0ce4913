"""The last comparison of near duplicates forms few pairs below the threshold and loses none above it."""

import random

from pyspark.sql import functions as F

from probegrid.llm import near_dedup as nd


def test_crossing_pairs_are_nearly_all_links(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(300):
        words = list(base)
        for at in r.sample(range(200), r.randint(1, 9)):
            words[at] = f"x{r.randint(0, 3)}"
        texts.append(" ".join(words))
    docs = nd.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    classes = nd.stored(nd.classes_of(nd.signatures(docs)), "classes")
    full = nd._shingle_sets(docs, classes, classes.select("k"))
    state = classes.select("k", F.col("k").alias("label"), F.lit(True).alias("rest"))
    met = {(p.a, p.b) for p in nd._crossing(nd._prefixes(full, classes.select("k", "n")), state).collect()}
    sets = {x.k: {x.shingles[i:i + 8] for i in range(0, len(x.shingles), 8)} for x in full.collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= nd.THRESHOLD * len(sets[a] | sets[b])}
    assert links and links <= met
    assert len(met) <= 1.5 * len(links) and len(met) < len(sets) * (len(sets) - 1) / 10
