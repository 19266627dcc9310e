"""License scans by sentence rules. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-asf": "licenses this file to You under the Apache License, Version 2.0",
    "apache2-not-except": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "gpl3-notice": "licensed under the GNU General Public License version 3",
    "gpl2-notice": "licensed under the GNU General Public License version 2",
    "gpl3-this": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "gpl3-this-short": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl2-this": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License",
    "gpl2-this-short": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl3-free": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21-free": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "agpl3-free": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0",
    "ccby4-notice": "Licensed under CC BY 4.0",
    "ccbysa4-notice": "Licensed under CC BY-SA 4.0",
    "ccbynd4-notice": "Licensed under CC BY-ND 4.0",
    "ccbyncsa4-notice": "Licensed under CC BY-NC-SA 4.0",
    "ccbyncnd4-notice": "Licensed under CC BY-NC-ND 4.0",
    "ccbynd4-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "ccbyncsa4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "ccbyncnd4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "cc0-waived": "waived all copyright and related or neighboring rights",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbysa4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ccbync4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "zlib-as-is": "This software is provided as-is, without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0",
}

#: Titles that name a licence where they are a line of their own, not within a sentence.
TITLES = {
    "mit-heading": ("MIT", "The MIT License"),
    "mit-title-plain": ("MIT", "MIT License"),
    "mit-title-named": ("MIT", "The MIT License (MIT)"),
    "apache2-title": ("Apache-2.0", "Apache License, Version 2.0"),
    "apache2-title-dated": ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    "gpl2-title": ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "gpl3-title": ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "bsd2-title": ("BSD-2-Clause", "BSD 2-Clause License"),
    "bsd3-title": ("BSD-3-Clause", "BSD 3-Clause License"),
    "mpl2-title": ("MPL-2.0", "Mozilla Public License Version 2.0"),
    "epl2-title": ("EPL-2.0", "Eclipse Public License - v 2.0"),
    "isc-title": ("ISC", "ISC License"),
}

#: Licences whose SPDX tag is a rule of its own.
TAGGED = [
    *("Apache-2.0", "MIT", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Zlib", "Unlicense", "BSL-1.0", "EPL-2.0", "CC0-1.0"),
    *("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"),
]

#: Rules, each an ordered run of sentences, and the licence it shows.
RULES = {
    "apache2-header": ("Apache-2.0", ["apache2-notice", "apache2-not-except", "apache2-copy", "apache2-as-is", "apache2-see"]),
    "apache2-header-https": ("Apache-2.0", ["apache2-notice", "apache2-not-except", "apache2-copy-https", "apache2-as-is", "apache2-see"]),
    "apache2-header-asf": ("Apache-2.0", ["apache2-asf", "apache2-not-except", "apache2-copy", "apache2-as-is", "apache2-see"]),
    "apache2-line": ("Apache-2.0", ["apache2-notice"]),
    "mit-text": ("MIT", ["mit-grant", "mit-notice-kept", "mit-as-is", "mit-liable"]),
    "mit-short": ("MIT", ["mit-grant", "mit-notice-kept", "mit-as-is"]),
    "mit-line": ("MIT", ["mit-notice"]),
    "isc-text": ("ISC", ["isc-grant", "isc-as-is"]),
    "isc-text-old": ("ISC", ["isc-grant-old", "isc-as-is"]),
    "gpl3-header": ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope", "gpl-see", "gpl-copy"]),
    "gpl2-header": ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see", "gpl-copy"]),
    "lgpl3-header": ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-see"]),
    "lgpl21-header": ("LGPL-2.1-or-later", ["lgpl21-free", "gpl-hope", "lgpl-see"]),
    "agpl3-header": ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope", "agpl-see"]),
    "gpl3-line": ("GPL-3.0-only", ["gpl3-notice"]),
    "gpl2-line": ("GPL-2.0-only", ["gpl2-notice"]),
    "gpl3-only-header": ("GPL-3.0-only", ["gpl3-this"]),
    "gpl3-only-short": ("GPL-3.0-only", ["gpl3-this-short"]),
    "gpl2-only-header": ("GPL-2.0-only", ["gpl2-this"]),
    "gpl2-only-short": ("GPL-2.0-only", ["gpl2-this-short"]),
    "ccbynd4-line": ("CC-BY-ND-4.0", ["ccbynd4-notice"]),
    "ccbyncsa4-line": ("CC-BY-NC-SA-4.0", ["ccbyncsa4-notice"]),
    "ccbyncnd4-line": ("CC-BY-NC-ND-4.0", ["ccbyncnd4-notice"]),
    "ccbynd4-notice": ("CC-BY-ND-4.0", ["ccbynd4-work"]),
    "ccbyncsa4-notice": ("CC-BY-NC-SA-4.0", ["ccbyncsa4-work"]),
    "ccbyncnd4-notice": ("CC-BY-NC-ND-4.0", ["ccbyncnd4-work"]),
    "cc0-waiver": ("CC0-1.0", ["cc0-waived"]),
    "epl2-header": ("EPL-2.0", ["epl2-notice"]),
    "ccbync4-line": ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    "ccby4-line": ("CC-BY-4.0", ["ccby4-notice"]),
    "ccbysa4-line": ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    "ccby4-notice": ("CC-BY-4.0", ["ccby4-work"]),
    "ccbysa4-notice": ("CC-BY-SA-4.0", ["ccbysa4-work"]),
    "ccbync4-notice": ("CC-BY-NC-4.0", ["ccbync4-work"]),
    "bsd3-text": ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is"]),
    "bsd2-text": ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-as-is"]),
    "mpl2-header": ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    "mpl2-line": ("MPL-2.0", ["mpl2-notice"]),
    "zlib-text": ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    "unlicense-text": ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    "boost-line": ("BSL-1.0", ["boost-notice"]),
}

#: A title on a line of its own becomes a word that texts don't have.
TITLE_WORD = "zqlicensetitle{}qz"
for _k, (_name, (_license, _title)) in enumerate(TITLES.items()):
    SENTENCES[_name] = TITLE_WORD.format(_k)
    RULES[_name] = (_license, [_name])
for _license in TAGGED:
    SENTENCES[f"spdx-{_license}"] = f"SPDX-License-Identifier: {_license}"
    RULES[f"spdx-{_license}"] = (_license, [f"spdx-{_license}"])
#: One-sentence rules don't hold where the sentence is denied: these are known sentences without a rule.
for _name in [x for x in SENTENCES if x.endswith(("-notice", "-work"))]:
    SENTENCES[f"{_name}-denied"] = f"not {SENTENCES[_name]}"

#: A known sentence has one of these stems, so a text with none of them isn't looked at any further.
CUES = "licen|permission|permitted|warrant|redistribut|endorse|public domain|anyone|liable|mpl|waived"
MARKS = r"(?m)^[\x20\t]*(?:#+|//+|/\*+|\*+/?|;+|--+|%+|<!--+|(?:rem|dnl)[\x20\t])"  # of a comment, at the start of a line
JUNK = "[^a-z0-9]+"
GAP = 400  # characters of unknown text, so normalised, that may stand between a rule's sentences


def codes(sentences: dict[str, str]) -> dict[str, str]:
    """A character for each known sentence."""
    return {s: chr(0x4E00 + i) for i, s in enumerate(sentences)}


def words_of(sentence: str) -> str:
    """A sentence's words (runs of a-z and 0-9), each in spaces of its own."""
    return "".join(f" {w} " for w in re.sub(JUNK, " ", sentence.lower()).split())


def title_lines(titles: dict[str, tuple[str, str]]) -> list[tuple[str, str]]:
    """(pattern, word) for each title: a line, perhaps two, that holds the title's words and nothing else of letters or digits."""
    found = []
    for k, (_, title) in enumerate(titles.values()):
        words = re.sub(JUNK, " ", title.lower()).split()
        found.append(("(?im)^[^a-z0-9\\n]*" + "[^a-z0-9]+".join(words) + "[^a-z0-9\\n]*$", f" {TITLE_WORD.format(k)} "))
    return sorted(found, key=lambda x: -len(x[0]))


def ordered(sentences: dict[str, str], rules: dict) -> list[tuple[str, str, str]]:
    """(rule, licence, pattern) of each rule, those of most sentences first: its codes, with short unknown text between them or not."""
    code, at = codes(sentences), {s: i for i, s in enumerate(sentences)}
    found = sorted(rules.items(), key=lambda x: (-len(x[1][1]), at[x[1][1][0]], x[0]))
    return [(name, license_, "-?".join(code[s] for s in steps)) for name, (license_, steps) in found]


def coded(text: Column, sentences: dict[str, str]) -> Column:
    """A text as a character for each known sentence, "-" for short unknown text and "=" for long."""
    code = codes(sentences)
    bare = F.regexp_replace(text, MARKS, " ")
    for pattern, word in title_lines(TITLES):
        bare = F.regexp_replace(bare, pattern, word)
    plain = F.regexp_replace(F.lower(bare), JUNK, "  ")
    out = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for s, sentence in sorted(sentences.items(), key=lambda x: -len(words_of(x[1]))):
        out = F.replace(out, F.lit(words_of(sentence)), F.lit(code[s]))
    return F.regexp_replace(F.regexp_replace(out, f"[a-z0-9 ]{{{GAP + 1},}}", "="), "[a-z0-9 ]+", "-")


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: dict = RULES) -> DataFrame:
    """A row for each rule that a text matches: (doc_id, rule, license, matches, first_sentence).

    Comment marks at the start of lines go, a licence's title counts where it is a line of its own and no other rule
    shows that licence, what is not a-z or 0-9 (lower-cased) parts words, and known sentences are found as
    runs of words, so wrapping, case, quotes and brackets don't matter. They become one character each, in order, and unknown
    text between them becomes "-", if it is at most 400 characters long, or "=". A rule matches its sentences in order, with nothing
    or short unknown text between them. Longer rules claim their sentences first. matches counts a rule's matches, which don't
    overlap; first_sentence is the number (from 0) of the item, known or unknown, that starts the first. Null and empty texts
    match nothing; repeated rows give repeated results; other columns are not read; no rows give no rows.
    """
    missing = [s for s in sentences.values() if not re.search(CUES, s.lower())]
    if missing:
        raise ValueError(f"no cue is in {missing[0]!r}")
    text = docs.select(F.col("doc_id"), F.col("text").alias("t")).where(F.lower("t").rlike(CUES))
    left = text.select("doc_id", coded(F.col("t"), sentences).alias("left"))
    left = left.where(F.col("left").rlike("[^-=]"))
    found = []
    for name, license_, pattern in ordered(sentences, rules):
        n = F.size(F.regexp_extract_all("left", F.lit(pattern), F.lit(0))).cast("long")
        before = F.length(F.element_at(F.split("left", pattern, 2), 1)).cast("long")
        left = left.withColumn(f"m_{name}", F.struct(F.lit(name).alias("rule"), F.lit(license_).alias("license"), n.alias("matches"), before.alias("first_sentence")))
        left = left.withColumn("left", F.regexp_replace("left", pattern, "-" * len(pattern.replace("-?", ""))))
        found.append(f"m_{name}")
    of = {name: license_ for name, (license_, _) in rules.items()}
    for name in TITLES.keys() & of.keys():
        text_too = [F.col(f"`m_{x}`.matches") > 0 for x in of if of[x] == of[name] and x not in TITLES]
        if text_too:
            left = left.withColumn(f"m_{name}", F.col(f"`m_{name}`").withField("matches", F.when(F.array_contains(F.array(*text_too), True), F.lit(0).cast("long")).otherwise(F.col(f"`m_{name}`.matches"))))
    hits = left.select("doc_id", F.explode(F.array(*[F.col(f"`{x}`") for x in found])).alias("m")).select("doc_id", "m.*")
    return hits.where("matches > 0")


def oracle_sql(sentences: dict[str, str] = SENTENCES, rules: dict = RULES) -> str:
    """The same scan for DuckDB."""
    code = codes(sentences)
    bare = f"regexp_replace(text, '{MARKS}', ' ', 'g')"
    for pattern, word in title_lines(TITLES):
        bare = f"regexp_replace({bare}, '{pattern}', '{word}', 'g')"
    l = f"concat(' ', trim(regexp_replace(lower({bare}), '{JUNK}', '  ', 'g')), ' ')"  # noqa: E741
    for s, sentence in sorted(sentences.items(), key=lambda x: -len(words_of(x[1]))):
        l = f"replace({l}, '{words_of(sentence)}', '{code[s]}')"  # noqa: E741
    l = f"regexp_replace(regexp_replace({l}, '[a-z0-9 ]{{{GAP + 1},}}', '=', 'g'), '[a-z0-9 ]+', '-', 'g')"  # noqa: E741
    titles = ", ".join(f"'{x}'" for x in TITLES)
    steps, last, hits = [], "coded", []
    for i, (name, license_, pattern) in enumerate(ordered(sentences, rules)):
        hits.append(f"SELECT n, doc_id, '{name}' AS rule, '{license_}' AS license, CAST(len(regexp_extract_all(l, '{pattern}')) AS BIGINT) AS matches, CAST(length(string_split_regex(l, '{pattern}')[1]) AS BIGINT) AS first_sentence FROM {last} WHERE regexp_matches(l, '{pattern}')")
        steps.append(f"s{i} AS (SELECT n, doc_id, regexp_replace(l, '{pattern}', '{'-' * len(pattern.replace('-?', ''))}', 'g') AS l FROM {last})")
        last = f"s{i}"
    return f"""
WITH coded AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {l} AS l FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(text), '{CUES}')),
{", ".join(steps)},
hits AS ({" UNION ALL ".join(hits)})
SELECT doc_id, rule, license, matches, first_sentence FROM hits QUALIFY rule NOT IN ({titles}) OR count(*) FILTER (rule NOT IN ({titles})) OVER (PARTITION BY n, license) = 0
"""
