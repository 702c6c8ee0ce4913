"""Duplicate, leak, packing, licence and personal data operators against brute force on small frames."""

import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from probegrid.llm import decontamination, exact_dedup, licenses, near_dedup, packing, pii, suffix_dedup
from probegrid.llm.queries import LLM_ORACLE, tokenizer_path

DDL = "doc_id long, text string"


def words(r, n):
    return [r.choice(["ka", "lo", "mi", "ne", "po", "ru", "sa", "Ti"]) + str(r.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Exact and near copies, shared passages, nulls, empty and short texts, one long text, repeated rows."""
    r = random.Random(3)
    texts = [" ".join(words(r, r.choice([1, 3, 8, 60, 120]))) for _ in range(40)]
    base = words(r, 150)
    for i in range(45):
        near = list(base)
        for _ in range(i % 4):
            near[r.randrange(150)] = f"edit{r.randrange(30)}"
        texts.append(" ".join(near))
    passage = " ".join(words(r, 70))
    texts += [f"{' '.join(words(r, 40))}\n{passage}. {' '.join(words(r, 30))}" for _ in range(6)]
    texts += [texts[3], texts[50], "", None, "   ", " ".join(words(r, 9000)), "é" * 300, "é" * 300 + "x"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[3]), (None, None)]
    return rows, spark.createDataFrame([(i, t, "z", "z") for i, t in rows], DDL + ", _h string, n string").repartition(5)


def test_exact_dedup(corpus):
    rows, df = corpus
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(df, 64).collect())
    group = collections.defaultdict(list)
    for i, t in rows:
        group[t or ""].append(i)
    want = collections.Counter(
        (i, max((x for x in group[t or ""] if x is not None), default=None), len(group[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert got == want
    kept = exact_dedup.drop_exact_duplicates(df, 64)
    assert kept.columns == df.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(group)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("split", [1000, 3])
def test_near_dedup(corpus, monkeypatch, split):
    rows, df = corpus
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                root[max(top(a), top(b))] = min(top(a), top(b))
    for r in near_dedup.near_duplicates(df).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(df).collect() if r.doc_id is not None} == {top(i) for i in sets}


def test_near_dedup_with_repeated_ids(spark):
    """Ids of rows are drawn at random, so that most are given to several texts."""
    r = random.Random(11)
    bases = [words(r, 60) for _ in range(6)]
    rows = []
    for _ in range(70):
        w = list(r.choice(bases))
        if r.random() < 0.6:
            w[r.randrange(60)] = f"x{r.randrange(3)}"
        rows.append((r.choice([None, *range(40)]), " ".join(w)))
    rows += [(50, words_a := " ".join(words(r, 40))), (51, words_a), (51, words_b := " ".join(words(r, 40))), (52, words_b)]
    root = {i: i for i, _ in rows if i is not None}
    texts = {t: t for _, t in rows}

    def top(of, x):
        while of[x] != x:
            x = of[x]
        return x

    def linked(s, t):
        a, b = shingles(s), shingles(t)
        return 100 * len(a & b) >= 85 * len(a | b)

    for (i, s), (j, t) in itertools.combinations(rows, 2):
        if i is not None and j is not None and linked(s, t):
            a, b = top(root, i), top(root, j)
            root[max(a, b)] = min(a, b)
            a, b = top(texts, s), top(texts, t)
            texts[a] = b
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, k int, rep int").repartition(3)
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == collections.Counter((i, None, True) if i is None else (i, top(root, i), top(root, i) == i) for i, _ in rows)
    stay = [(r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(df).collect()]
    groups = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            groups[top(texts, t)].add((i, t))
    # one text of each group of texts stays, under the smallest id of the group
    for of in groups.values():
        mine = {x for x in of if x in stay}
        assert len({t for _, t in mine}) == 1 and {i for i, _ in mine} == {min(i for i, _ in of)}
    assert sum(i is None for i, _ in stay) == sum(i is None for i, _ in rows)


@pytest.mark.parametrize("block", [50_000, 40])
def test_decontamination(spark, corpus, block):
    rows, df = corpus
    r = random.Random(4)
    sources = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(n, " ".join(r.choice(sources).split()[5:5 + r.choice([4, 9, 10, 14])]).upper()) for n in range(8)] + [(90, None), (91, ""), (None, "ka1"), (92, "never seen words here"), (93, "sa1")]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, n_words string")
    windows = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            for w in decontamination.windows_of(decontamination.words_of((t or "").encode()), 10):
                windows[w].add(i)
    want = collections.Counter()
    for i, t in rows:
        w = decontamination.words_of((t or "").encode())
        hit, found = set(), set()
        for x, of in windows.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s:s + len(x)]) == x:
                    hit.update(range(s, s + len(x)))
                    found |= of
        want[(i, len(w), len(hit), len(found), decontamination.items_digest(list(found)), bool(hit))] += 1
    assert collections.Counter(map(tuple, decontamination.decontaminate(df, bench, block_windows=block).collect())) == want
    clean = decontamination.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])


def test_suffix_dedup(corpus):
    rows, df = corpus
    size = 200
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[x:x + size] for x in range(len(b) - size + 1))
    want = collections.Counter()
    for i, t in rows:
        b, gone, spans, at = (t or "").encode(), 0, 0, -1
        kept = bytearray()
        covered = bytearray(len(b))
        for x in range(len(b) - size + 1):
            if seen[b[x:x + size]] > 1:
                covered[x:x + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(covered)))
        kept = bytes(c for c, m in zip(b, covered) if not m)
        want[(i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter(map(tuple, suffix_dedup.remove_repeats(df, size).drop("kept").collect())) == want


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(1)
    words = [rng.integers(0, 4, 500), rng.integers(0, 4, 500), rng.integers(0, 4, 500)]
    order, depths = suffix_dedup.multikey_order(words)
    got = [tuple(int(w[i]) for w in words) for i in order]
    assert got == sorted(zip(*(w.tolist() for w in words)))
    assert [bool(x) for x in depths[-1]] == [i == 0 or got[i] != got[i - 1] for i in range(500)]


def test_packing(corpus):
    import numpy as np
    from tokenizers import Tokenizer

    rows, df = corpus
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    packed = packing.pack(df, tokenizer_path(), with_ids=True)
    got = packed.collect()
    whole = collections.Counter((i, *t.encode(x or "", add_special_tokens=False).ids, 2) for i, x in rows)
    pieces = collections.defaultdict(list)
    for p in got:
        assert p.length == len(p.ids) <= 1024 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        pieces[p.doc_id].append(p)
    assert {i for i, *_ in whole} == set(pieces)
    for (i, *ids), n in whole.items():
        if i is not None and n == 1:
            own = sorted(pieces[i], key=lambda p: p.piece)
            assert [x for p in own for x in p.ids] == ids and [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    by = collections.defaultdict(list)
    for p in got:
        by[p.sequence_id].append(p)
    for of in by.values():
        of.sort(key=lambda p: p.offset)
        assert [p.offset for p in of] == [sum(q.length for q in of[:k]) for k in range(len(of))] and sum(p.length for p in of) <= 1024
    assert {r.sequence_id: r.ids for r in packing.sequences(packed).collect()} == {k: [x for p in of for x in p.ids] for k, of in by.items()}


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram(seed):
    r = random.Random(seed)
    histogram = collections.Counter(min(64, int(r.expovariate(1 / 20)) + 1) for _ in range(3000))
    plan = packing.plan_sequences(histogram, 64)
    used = collections.Counter()
    for parts, n in plan:
        assert sum(parts) <= 64
        for p in parts:
            used[p] += n
    assert used == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for _, n in plan) <= -(-total // 64) * 1.01 + 1


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(tokenizer_path(), memo=3)
    texts = ["a  b", "a \nb", "a\n \nb", " x", "x ", "", "don't  we'll '", "a\n\n b", "日本 語", "x\x1c y", "½ ²a_b <|endoftext|> z", "é è ê"]
    assert list(e.encode_all(texts)) == [e.whole(t) for t in texts]


def test_licenses(spark, corpus):
    _, df = corpus
    wrapped = "\n".join("# " + licenses.SENTENCES[s].replace(", ", ",\n# ") + "." for s in ("mit-grant", "mit-keep", "mit-as-is"))
    more = spark.createDataFrame([(900, wrapped), (901, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (902, licenses.SENTENCES["mit-as-is"] + ". " + licenses.SENTENCES["mit-grant"])], DDL)
    got = {r.doc_id: r for r in licenses.license_scan(df.select("doc_id", "text").union(more)).collect()}
    assert (got[900].rules, got[900].licenses) == ("mit-text", "MIT")
    assert (got[901].licenses, got[901].license_class, got[901].n_licenses) == ("CC-BY-NC-4.0,MIT", "noncommercial", 2)
    assert got[902].rules == "" and got[902].sentence_ids == "mit-as-is,mit-grant"  # the order is not the rule's
    assert all(r.license_class == "none" for i, r in got.items() if i is None or i < 900)
    anchored = {name for s, name in licenses.KNOWN.items() if re.search(licenses._ANCHORS, s)}
    assert all(anchored & set(",".join(of).split(",")) for *_, of in licenses.RULES)
    plan = licenses.license_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan) and plan.count("Exchange") == 1  # the repartition of the fixture


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y z", "a  b<|endoftext|>", "a <|endoftext|", "plain text", "a <|endoftext|>", "日本 <|endoftext|> 語", " <|endoftext|>\n c"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert 50256 in want[0]
    encoder = packing.Encoder(tokenizer_path(), memo=3)
    for _ in range(2):
        assert [memoryview(x).cast("I").tolist() for x in encoder.encode_all(texts)] == want
    got = {p.doc_id: p.ids for p in packing.pack(spark.createDataFrame(list(enumerate(texts)), DDL), tokenizer_path(), with_ids=True).collect()}
    assert [got[i] for i in range(len(texts))] == [[*x, packing.END_ID] for x in want]


MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int x;
"""


def sentence(name):
    """A text that a sentence identifier stands for."""
    named = {licenses._slug(n): (n, texts[-1]) for n, _, texts in licenses.NOTICES}
    if name.endswith("-id"):
        return named[name[:-3]][0]
    if name.endswith("-notice"):
        return "This file is licensed under the " + named[name[:-7]][1]
    return licenses.SENTENCES[name]


def test_every_licence_rule_matches_its_own_sentences(spark):
    joined = [[sentence(s) for s in ",".join(of).split(",")] for *_, of in licenses.RULES]
    texts = [t for of in joined for t in (". ".join(of) + ".", ".\n".join(of), "\n\n".join(of))] + [MPL]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), DDL)).collect()}
    for i in range(len(texts) - 1):
        assert licenses.RULES[i // 3][0] in got[i].rules.split(","), (licenses.RULES[i // 3][0], texts[i])
    assert (got[len(texts) - 1].licenses, got[len(texts) - 1].license_class) == ("MPL-2.0", "copyleft")


def test_licence_lines_and_the_statement(spark):
    """Lines as projects write them, in both engines."""
    want = {
        "SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-3.0-or-later\nx": "GPL-3.0-or-later", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1", "MIT\nlicense": "", "Licensed under the Apache License 2.0.": "Apache-2.0", "This file is licensed under the MIT License.": "MIT",
        "It is distributed under the terms of the GNU Lesser General Public License, version 3 or later.": "LGPL-3.0-or-later", "This work is licensed under GPLv3.": "GPL-3.0",
        "Released under the MIT Licence.": "MIT", "The software is available under the Boost Software License, Version 1.0.": "BSL-1.0",
        "  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n": "GPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "Apache-2.0",
        "Copyright 2020 X. All rights reserved.": "LicenseRef-All-Rights-Reserved", "All rights reserved.\nLicensed under the BSD 3-Clause License.": "BSD-3-Clause,LicenseRef-All-Rights-Reserved",
        "Eclipse Public License - v 2.0": "EPL-2.0", "we licensed under protest": "", "SPDX-License-Identifier: MIT\n\nApache-2.0": "MIT",
        MPL: "MPL-2.0", "// " + MPL.replace("\n", "\n// "): "MPL-2.0", APACHE: "Apache-2.0", "": "", "x" * 100_000 + " license": "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)] + [(99, None)], DDL)
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [got[i].licenses for i in range(len(want))] == list(want.values())
    assert [got[i].license_class for i, t in enumerate(want) if "rights" in t.lower()] == ["reserved", "permissive"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [*enumerate(want), (99, None)])
    assert sorted(con.execute(licenses.license_sql()).fetchall()) == sorted(tuple(r) for r in got.values())


APACHE = """Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def header(*sentences):
    """A copyright line, an empty line, and wrapped sentences in paragraphs of their own."""
    return "Copyright (c) 2020 X\n\n" + "\n\n".join(textwrap.fill(licenses.SENTENCES[s] + ".", 60) for s in sentences)


@pytest.mark.parametrize("first, mark, last", [
    ("", "#", ""), ("", "//", ""), ("", "--", ""), ("", ";", ""), ("", ";;", ""), ("", "%", ""), ("", "!", ""), ("/*", " *", " */"), ("/**", "  *", "  */"), ("#" * 60, "#", "#" * 60), ("", "", ""),
])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_licence_headers_in_comments(spark, first, mark, last, end):
    plain = {
        "Apache-2.0": APACHE, "MIT": header("mit-grant", "mit-keep", "mit-as-is"), "ISC": header("isc-grant", "isc-as-is"),
        "BSD-2-Clause": header("bsd-grant", "bsd-source", "bsd-binary"), "MPL-2.0": header("mpl2-form").replace("v. 2", "v.\n2") + " " + licenses.SENTENCES["mpl2-copy"],
        "GPL-3.0-or-later": header("gpl-free", "gpl3-later", "gpl-hope"),
    }
    rows = [(i, end.join(["code();", first, *[f"{mark} {x}".rstrip() for x in text.split("\n")], last, "more();"])) for i, text in enumerate(plain.values())]
    got = {r.doc_id: r.licenses for r in licenses.license_scan(spark.createDataFrame(rows, DDL)).collect()}
    assert [got[i] for i in range(len(plain))] == list(plain)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    for _ in range(20_000):
        text = "".join(r.choice("a1.@+-( 29%é_") for _ in range(r.randint(1, 30)))
        assert sorted(pii.base_spans(text)) == plain_spans(text)


def test_field_on_held_out_sentences_and_long_runs(spark):
    field, r = pii.train(), random.Random(99)
    right = wrong = 0
    for _ in range(150):
        text, spans = pii.sentence(r)
        found = {s for tokens in pii.regions(text) for s in field.decode(text, tokens)}
        right += len(found & set(spans))
        wrong += len(found ^ set(spans))
    assert right > 100 and wrong <= 0.05 * right
    for text in ("1" * 20_000, "1 " * 10_000, "a@" * 10_000, "a" * 500_000):
        pii.find_spans(text, field)
    rows = [(1, 'x token = "' + "0af3" * 10 + '" mail a.b@c.example.com'), (None, None), (2, ""), (2, "")]
    got = pii.find_pii(spark.createDataFrame([(*x, 0) for x in rows], DDL + ", spans int"), field).collect()
    first = next(x for x in got if x.doc_id == 1)
    assert (first.n_email, first.spans) == (1, "secret:11:51,email:58:75,".strip(","))
    assert len(got) == 4 and all(x.spans == "" and x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in got if x.doc_id != 1)


def test_field_reads_whole_lines_and_cells(monkeypatch):
    field = pii.train()
    key = "9f8a0b7c6d5e4f3a2b1c" * 2
    for pad in range(0, 300, 7):
        text = "a" * pad + ';token="' + key + '";' + "b" * 300
        assert f"secret:{pad + 8}:{pad + 48}" in pii.joined(pii.find_spans(text, field)[1])
    assert pii.find_spans("\t".join(["abc12"] * 30), field)[1] == []
    assert pii.find_spans("a\t(555)-123-4567\tb", field)[1] == [(2, 16, "phone")]
    line = " x, ".join([f"mail b.c{i}@site{i}.org now" if i % 2 else f'key: "{key}"' for i in range(400)])
    want = [s for tokens in pii.regions(line) for s in field.decode(line, tokens)]
    assert len(want) > 300
    monkeypatch.setattr(pii, "SCORED", 3)
    assert [s for tokens in pii.regions(line) for s in field.decode(line, tokens)] == want


def test_field_on_documents(sf_dir):
    """Where the base patterns find data in the given documents, the field, which is fitted on made sentences, does so too."""
    field = pii.train()
    known = found = more = 0
    for (text,) in duckdb.sql(f"select text from '{sf_dir}/documents.parquet' where text is not null").fetchall():
        base = set(pii.base_spans(text))
        spans = {s for tokens in pii.regions(text) for s in field.decode(text, tokens)}
        known, found = known + len(base), found + len(base & spans)
        # those apart from base spans should be secrets behind their name
        more += sum(k != "secret" or "token" not in text[max(0, a - 12):a] for a, b, k in spans if all(b <= x or y <= a for x, y, _ in base))
    assert known and found >= 0.95 * known and more <= 0.05 * known


def test_personal_data_of_the_table_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = {k: i for i, k in enumerate(pii.KINDS)}
    rows = pii.find_pii(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = sorted(plain_spans(texts[r.doc_id]), key=lambda s: (s[0], order[s[2]]))
        kinds = [k for _, _, k in spans]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in pii.KINDS[:4]]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def test_helper_columns_do_not_clash(spark):
    rows = [(1, "a b c d e f", 7, "x", "y"), (2, "a b c d e f", 8, "x", "y"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_copy int, _row_sha string, _bad_id string").withColumn("_ROW_H", F.lit(5)).withColumn("_kept_id", F.lit("k"))
    items = spark.createDataFrame([(1, "q w e r t y")], "item_id long, text string")
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(*rows[1], 5, "k"), (*rows[2], 5, "k")], key=str)
    for same in (decontamination.drop_contaminated(docs, items), near_dedup.drop_near_duplicates(kept)):
        assert same.columns == docs.columns
    assert sorted(map(str, decontamination.drop_contaminated(docs, items).collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("run", [
    exact_dedup.exact_duplicates, near_dedup.near_duplicates, suffix_dedup.remove_repeats, licenses.license_scan, pii.find_pii,
    lambda df: packing.pack(df, tokenizer_path()), lambda df: decontamination.decontaminate(df, df.withColumnRenamed("doc_id", "item_id")),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_queries_equal_duckdb(spark, sf_dir, name):
    import duckdb

    from probegrid.llm.queries import llm_queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(LLM_ORACLE[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    got = llm_queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(rows)
