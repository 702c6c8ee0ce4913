"""Licence recognition by sentence rules, in DataFrame operations only.

A text is cut into sentences, each is normalised to lower-case words, and
sentences known from licences are replaced by their identifiers. The sequence
of identifiers is then matched against ordered rules: a rule names the
sentences a licence consists of, in their order. Texts are read twice, once
with line ends as sentence ends (notices on a line of their own) and once with
single line ends as blanks and without comment marks at line starts (wrapped
licence texts).

Scale: everything happens within a row, with no shuffle and no Python; the
sentence and rule tables are literals of fixed size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences as the licences and their usual notices have them
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-free": "This program is free software",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-long": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "lgpl-free": "This library is free software",
    "lgpl21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "apache-head": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-head": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-head": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-head": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "gpl2-version": "Version 2, June 1991",
    "lgpl21-version": "Version 2.1, February 1999",
    "gpl3-version": "Version 3, 29 June 2007",
    "agpl3-version": "Version 3, 19 November 2007",
    "mpl2-head": "Mozilla Public License Version 2.0",
    "epl2-head": "Eclipse Public License - v 2.0",
    "bsl-head": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "spdx-tag": "SPDX-License-Identifier",
    "all-rights": "All rights reserved",
}
#: (licence, class, names as they stand after "licensed under the").
NOTICES = [
    ("MIT", "permissive", ["MIT License", "MIT", "Expat License"]),
    ("ISC", "permissive", ["ISC License"]),
    ("Zlib", "permissive", ["zlib License"]),
    ("BSD-2-Clause", "permissive", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"]),
    ("BSD-3-Clause", "permissive", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"]),
    ("Apache-2.0", "permissive", ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0"]),
    ("BSL-1.0", "permissive", ["Boost Software License, Version 1.0", "Boost Software License 1.0"]),
    ("CC0-1.0", "permissive", ["CC0 1.0", "CC0 1.0 Universal"]),
    ("CC-BY-4.0", "permissive", ["CC BY 4.0"]),
    ("GPL-2.0", "copyleft", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL v2"]),
    ("GPL-2.0-or-later", "copyleft", ["GNU General Public License, version 2 or later", "GNU General Public License, version 2 or any later version", "GPL v2 or later"]),
    ("GPL-3.0", "copyleft", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL v3"]),
    ("GPL-3.0-or-later", "copyleft", ["GNU General Public License, version 3 or later", "GNU General Public License, version 3 or any later version", "GPL v3 or later"]),
    ("LGPL-2.1", "copyleft", ["GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPLv2.1"]),
    ("LGPL-2.1-or-later", "copyleft", ["GNU Lesser General Public License, version 2.1 or later"]),
    ("LGPL-3.0", "copyleft", ["GNU Lesser General Public License, version 3", "LGPL v3", "LGPLv3"]),
    ("LGPL-3.0-or-later", "copyleft", ["GNU Lesser General Public License, version 3 or later"]),
    ("AGPL-3.0", "copyleft", ["GNU Affero General Public License, version 3", "AGPL v3", "AGPLv3"]),
    ("AGPL-3.0-or-later", "copyleft", ["GNU Affero General Public License, version 3 or later"]),
    ("MPL-2.0", "copyleft", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"]),
    ("EPL-2.0", "copyleft", ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0"]),
    ("CC-BY-SA-4.0", "copyleft", ["CC BY-SA 4.0"]),
    ("CC-BY-NC-4.0", "noncommercial", ["CC BY-NC 4.0"]),
    ("Unlicense", "permissive", ["Unlicense"]),
]
#: (rule, licence, class, ordered sentences); later sentences may follow with other known sentences between them,
#: those joined by a comma right behind each other.
RULES = [
    ("mit-text", "MIT", "permissive", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("isc-text", "ISC", "permissive", ["isc-grant", "isc-as-is"]),
    ("bsd-2-text", "BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-3-text", "BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("apache-2-header", "Apache-2.0", "permissive", ["apache-grant", "apache-use", "apache-copy", "apache-as-is"]),
    ("gpl-2-header", "GPL-2.0-or-later", "copyleft", ["gpl-free", "gpl2-later", "gpl-hope"]),
    ("gpl-3-header", "GPL-3.0-or-later", "copyleft", ["gpl-free", "gpl3-later", "gpl-hope"]),
    ("mpl-2-header", "MPL-2.0", "copyleft", ["mpl2-form", "mpl2-copy"]),
    ("cc-by-long", "CC-BY-4.0", "permissive", ["cc-by-long"]),
    ("cc-by-sa-long", "CC-BY-SA-4.0", "copyleft", ["cc-by-sa-long"]),
    ("cc-by-nc-long", "CC-BY-NC-4.0", "noncommercial", ["cc-by-nc-long"]),
    ("cc0-long", "CC0-1.0", "permissive", ["cc0-long"]),
    ("unlicense-text", "Unlicense", "permissive", ["unlicense"]),
    ("apache-2-text", "Apache-2.0", "permissive", ["apache-head", "apache-version", "apache-terms"]),
    ("gpl-2-text", "GPL-2.0", "copyleft", ["gpl-head,gpl2-version"]),
    ("gpl-3-text", "GPL-3.0", "copyleft", ["gpl-head,gpl3-version"]),
    ("lgpl-21-text", "LGPL-2.1", "copyleft", ["lgpl-head,lgpl21-version"]),
    ("lgpl-3-text", "LGPL-3.0", "copyleft", ["lgpl-head,gpl3-version"]),
    ("agpl-3-text", "AGPL-3.0", "copyleft", ["agpl-head,agpl3-version"]),
    ("mpl-2-text", "MPL-2.0", "copyleft", ["mpl2-head"]),
    ("epl-2-text", "EPL-2.0", "copyleft", ["epl2-head"]),
    ("bsl-text", "BSL-1.0", "permissive", ["bsl-head"]),
    ("bsl-terms", "BSL-1.0", "permissive", ["bsl-grant"]),
    ("lgpl-21-header", "LGPL-2.1-or-later", "copyleft", ["lgpl-free", "lgpl21-later"]),
    ("lgpl-3-header", "LGPL-3.0-or-later", "copyleft", ["lgpl-free", "lgpl3-later"]),
    ("agpl-3-header", "AGPL-3.0-or-later", "copyleft", ["gpl-free", "agpl3-later"]),
    ("all-rights", "LicenseRef-All-Rights-Reserved", "reserved", ["all-rights"]),
]


def _slug(licence: str) -> str:
    return re.sub("[^a-z0-9]+", "-", licence.lower())


# A notice sentence and an identifier line for each licence of NOTICES; an identifier counts right behind its tag only.
RULES += [(f"{_slug(n)}-notice", n, kind, [f"{_slug(n)}-notice"]) for n, kind, _ in NOTICES]
RULES += [(f"{_slug(n)}-tag", n, kind, [f"spdx-tag,{_slug(n)}-id"]) for n, kind, _ in NOTICES]

#: Every rule has a sentence with one of these words, so a text with none of them matches no rule; it is not cut at all.
_ANCHORS = "licen[cs]|permission|redistribut|copyright|warrant|software|mozilla|rights"
_BREAK = r"[.;:!?]+([ \t\n\r]|\z)"
_PARAGRAPH = r"\n[ \t\r]*\n"
#: Comment marks that start a line; a line of nothing else is a line of blanks.
_MARKS = r"\n[ \t]*(?:<!--|-->|[#*/;%!-])[#*/;%! \t\r-]*"
#: The full stop of "v. 2.0" within a known sentence does not end it.
_VERSION = r"(^|[^a-z0-9])v\.[ \t\r]+([0-9])"
_OTHER = r"[^a-z0-9\x01]+"
_EDGE = r" *\x01[ \x01]*"
#: Ways to say that something is licensed, of a normalised sentence: all become "licensed under".
_NOTICE = r"^((this|the) (project|file|software|work|program|code|library|package|source code|documentation) is |it is )?(licensed|released|distributed|published|available) under (the terms of )?(the |a |an )?"


def normal(sentence: str) -> str:
    plain = re.sub("[^a-z0-9]+", " ", sentence.lower().replace("licence", "license")).strip()
    return re.sub(_NOTICE, "licensed under ", plain)


KNOWN = {normal(text): name for name, text in SENTENCES.items()}
for _name, _, _texts in NOTICES:
    KNOWN |= {normal(f"Licensed under the {t}"): f"{_slug(_name)}-notice" for t in _texts}
    KNOWN |= {normal(t): f"{_slug(_name)}-id" for t in (_name, f"{_name}-only") if normal(t) not in KNOWN}


def _known_ids(text: Column, wrapped: bool) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    t = F.replace(F.lower(text), F.lit("licence"), F.lit("license"))
    if wrapped:
        t = F.regexp_replace(t, _MARKS, "\n")
        t = F.regexp_replace(F.regexp_replace(t, _PARAGRAPH, "\x01"), "\n", " ")
    else:
        t = F.regexp_replace(t, "\n", "\x01")
    t = F.regexp_replace(t, _VERSION, "$1v $2")
    t = F.regexp_replace(F.regexp_replace(t, _BREAK, "\x01"), _OTHER, " ")
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    found = F.filter(F.transform(F.split(t, _EDGE), lambda s: F.regexp_replace(F.trim(s), _NOTICE, "licensed under ")), lambda s: s.isin(list(KNOWN)))
    return F.transform(found, lambda s: names[s])


def rule_pattern(sentences: list[str]) -> str:
    """Over identifiers that each end in a comma: the sentences in order, others between them."""
    return r"(^|,)" + r",([a-z0-9-]+,)*".join(sentences) + ","


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, sentence_ids, rules, licenses, license_class, n_licenses``, one row per row of ``docs``.

    The lists are comma-joined: identifiers in text order (of lines, then of
    wrapped paragraphs if those differ), matched rules in the order of RULES, licences
    sorted. license_class is the strictest of noncommercial, copyleft, permissive;
    without such a licence it is reserved where all rights are, else none. A null or empty text has none. Each row is judged by its own text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    promising = F.lower("_t").rlike(_ANCHORS)
    read = rows.select("doc_id", *[
        F.when(promising, F.array_join(_known_ids(F.col("_t"), wrapped), ",")).otherwise("").alias(name) for name, wrapped in (("_a", False), ("_b", True))])
    read = read.select("doc_id", "_a", "_b", F.concat("_a", F.lit(",")).alias("_x"), F.concat("_b", F.lit(",")).alias("_y"))
    some = (F.col("_a") != "") | (F.col("_b") != "")
    rules = F.when(~some, F.array().cast("array<int>")).otherwise(F.filter(F.array(*[
        F.when(F.col("_x").rlike(p) | F.col("_y").rlike(p), F.lit(i)) for i, p in enumerate(rule_pattern(s) for *_, s in RULES)]), lambda r: r.isNotNull()))

    def named(part: int) -> Column:
        return F.transform("_rules", lambda r: F.element_at(F.array(*[F.lit(x[part]) for x in RULES]), r + 1))

    found = read.select("doc_id", "_a", "_b", rules.alias("_rules"))
    found = found.select("doc_id", "_a", "_b", named(0).alias("_r"), F.array_sort(F.array_distinct(named(1))).alias("_l"), named(2).alias("_c"))
    kind = F.lit("none")
    for c in ("reserved", "permissive", "copyleft", "noncommercial"):
        kind = F.when(F.array_contains("_c", c), c).otherwise(kind)
    ids = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.array_join(F.filter(F.array("_a", "_b"), lambda x: x != ""), "|"))
    return found.select("doc_id", ids.alias("sentence_ids"), F.array_join("_r", ",").alias("rules"), F.array_join("_l", ",").alias("licenses"),
                        kind.alias("license_class"), F.size("_l").cast("long").alias("n_licenses"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """The DuckDB statement of ``license_scan`` over documents."""
    ids = f"map([{', '.join(map(_quoted, KNOWN))}], [{', '.join(map(_quoted, KNOWN.values()))}])"

    def known(text: str) -> str:
        t = f"regexp_replace({text}, '{_VERSION}', '\\1v \\2', 'g')"
        t = f"regexp_replace(regexp_replace({t}, '{_BREAK}', chr(1), 'g'), '{_OTHER}', ' ', 'g')"
        return f"list_filter(list_transform(string_split_regex({t}, '{_EDGE}'), lambda x: regexp_replace(trim(x), '{_NOTICE}', 'licensed under ')), lambda x: list_contains(map_keys(m), x))"

    lines = known("replace(t, chr(10), chr(1))")
    wraps = known(f"replace(regexp_replace(regexp_replace(t, '{_MARKS}', chr(10), 'g'), '{_PARAGRAPH}', chr(1), 'g'), chr(10), ' ')")
    tests = ", ".join(f"case when regexp_matches(a || ',', '{p}') or regexp_matches(b || ',', '{p}') then {i} end" for i, p in enumerate(rule_pattern(s) for *_, s in RULES))

    def named(part: int) -> str:
        return f"list_transform(r, lambda x: ([{', '.join(_quoted(x[part]) for x in RULES)}])[x + 1])"

    return f"""
        with plain as (select doc_id, replace(lower(coalesce(text, '')), 'licence', 'license') as t, {ids} as m from documents),
        cut as (select doc_id, m, case when regexp_matches(t, '{_ANCHORS}') then {lines} else [] end as la, case when regexp_matches(t, '{_ANCHORS}') then {wraps} else [] end as lb from plain),
        ids as (select doc_id, array_to_string(list_transform(la, lambda x: m[x]), ',') as a, array_to_string(list_transform(lb, lambda x: m[x]), ',') as b from cut),
        ruled as (select doc_id, a, b, list_filter([{tests}], lambda x: x is not null) as r from ids),
        named as (select doc_id, a, b, {named(0)} as rn, list_sort(list_distinct({named(1)})) as ln, {named(2)} as cn from ruled)
        select doc_id, case when a = b then a else array_to_string(list_filter([a, b], lambda x: x <> ''), '|') end as sentence_ids,
            array_to_string(rn, ',') as rules, array_to_string(ln, ',') as licenses,
            case when list_contains(cn, 'noncommercial') then 'noncommercial' when list_contains(cn, 'copyleft') then 'copyleft'
                 when list_contains(cn, 'permissive') then 'permissive' when list_contains(cn, 'reserved') then 'reserved' else 'none' end as license_class,
            len(ln)::bigint as n_licenses
        from named"""
