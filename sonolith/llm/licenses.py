"""Licence detection by sentence rules.

Texts are cut into sentences and known licence sentences are found among them, be they wrapped over several lines of a
paragraph, set one to a line, or cut by punctuation of their own; the sequence of known sentences of a document is matched against ordered licence rules: a rule matches where its sentence ids follow one
another, with at most ``gap`` unknown sentences between neighbours. A match inside a longer match of another rule is
dropped, so the most specific rule wins.

Defined results: null or empty texts have no sentences; a text that quotes a licence twice matches twice; rows that
repeat a doc_id each give one row from their own text; without rows the result is empty. Only the named id and text
columns are read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, lower_ascii

# Known licence sentences by id, as published in the licences and notices themselves; {} stands for a name of one to twelve words.
SENTENCES = {
    1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    2: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    3: "Released under the MIT License.",
    4: "Licensed under the MIT License.",
    6: "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    7: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    8: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    9: "This project is licensed under the MIT License.",
    10: "Licensed under the Apache License, Version 2.0.",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\");",
    12: "you may not use this file except in compliance with the License.",
    13: "You may obtain a copy of the License at",
    15: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    16: "See the License for the specific language governing permissions and limitations under the License.",
    17: "This project is licensed under the Apache License, Version 2.0.",
    18: "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\");",
    20: "This work is licensed under the GNU General Public License, version 3.",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    22: "You should have received a copy of the GNU General Public License along with this program.",
    25: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    26: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    27: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    28: "See the GNU General Public License for more details.",
    29: "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    30: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    31: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    32: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    33: "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    36: "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    37: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    38: "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    39: "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met:",
    40: "Licensed under CC BY-NC 4.0.",
    41: "Licensed under CC BY 4.0.",
    42: "Licensed under CC BY-SA 4.0.",
    43: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    44: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    45: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    46: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    47: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    48: "To the extent possible under law, {} has waived all copyright and related or neighboring rights to this work.",
    49: "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    52: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    53: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    60: "All rights reserved.",
    70: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    71: "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    72: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    73: "See the GNU Lesser General Public License for more details.",
    74: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    75: "See the GNU Affero General Public License for more details.",
    76: "You should have received a copy of the GNU Affero General Public License along with this program.",
    77: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    80: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    81: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    82: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    83: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    84: "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    90: "This software is provided 'as-is', without any express or implied warranty.",
    91: "In no event will the authors be held liable for any damages arising from the use of this software.",
    92: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    93: "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    94: "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    95: "This notice may not be removed or altered from any source distribution.",
    100: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    101: "Distributed under the Boost Software License, Version 1.0.",
    110: "This is free and unencumbered software released into the public domain.",
    111: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    120: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    121: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html.",
    130: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    131: "You just DO WHAT THE FUCK YOU WANT TO.",
    140: "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    141: "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    142: "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
}
# SPDX identifiers whose tags are known sentences, numbered from 200.
SPDX = "MIT MIT-0 Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause 0BSD ISC Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 CDDL-1.0 Artistic-2.0 WTFPL PostgreSQL NCSA OFL-1.1 PSF-2.0 Python-2.0 Ruby GPL-2.0 GPL-3.0 GPL-2.0+ GPL-3.0+ LGPL-2.1 LGPL-2.1+ LGPL-3.0 LGPL-3.0+ AGPL-3.0".split()
# What the older identifiers are called now.
RENAMED = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0+": "LGPL-3.0-or-later"}
SENTENCES |= {200 + i: f"SPDX-License-Identifier: {x.replace('+', ' plus')}" for i, x in enumerate(SPDX)}
# Fixed values: (rule, licence, the ids that must follow one another).
RULES = [
    ("mit-text", "MIT", [1, 2]),
    ("mit-text-x", "MIT", [1, 6]),
    ("mit-whole", "MIT", [1, 2, 7, 8]),
    ("mit-whole-x", "MIT", [1, 6, 7, 8]),
    ("mit-grant", "MIT", [1]),
    ("mit-released", "MIT", [3]),
    ("mit-licensed", "MIT", [4]),
    ("mit-project", "MIT", [9]),
    ("mit-style", "MIT", [142]),
    ("apache-notice", "Apache-2.0", [10]),
    ("apache-project", "Apache-2.0", [17]),
    ("apache-header", "Apache-2.0", [11, 12, 13]),
    ("apache-header-asf", "Apache-2.0", [18, 12, 13]),
    ("apache-terms", "Apache-2.0", [15, 16]),
    ("apache-header-short", "Apache-2.0", [11, 12]),
    ("gpl3-notice", "GPL-3.0-only", [20]),
    ("gpl3-header", "GPL-3.0-or-later", [21, 22]),
    ("gpl3-header-whole", "GPL-3.0-or-later", [21, 27, 28, 22]),
    ("gpl3-header-short", "GPL-3.0-or-later", [21]),
    ("gpl2-header", "GPL-2.0-or-later", [25]),
    ("gpl2-header-whole", "GPL-2.0-or-later", [25, 27, 28, 22]),
    ("gpl2-header-address", "GPL-2.0-or-later", [25, 27, 28, 29]),
    ("gpl2-only-header", "GPL-2.0-only", [26]),
    ("gpl2-only-header-whole", "GPL-2.0-only", [26, 27, 28]),
    ("lgpl21-header", "LGPL-2.1-or-later", [70]),
    ("lgpl21-header-whole", "LGPL-2.1-or-later", [70, 72, 73]),
    ("lgpl3-header", "LGPL-3.0-or-later", [71]),
    ("lgpl3-header-whole", "LGPL-3.0-or-later", [71, 72, 73]),
    ("lgpl3-header-program", "LGPL-3.0-or-later", [77]),
    ("agpl3-header", "AGPL-3.0-or-later", [74]),
    ("agpl3-header-whole", "AGPL-3.0-or-later", [74, 27, 75, 76]),
    ("bsd3-text", "BSD-3-Clause", [30, 31, 32, 33]),
    ("bsd3-whole", "BSD-3-Clause", [30, 31, 32, 33, 36]),
    ("bsd3-name", "BSD-3-Clause", [30, 31, 32, 38]),
    ("bsd3-clear", "BSD-3-Clause-Clear", [39, 31, 32, 33]),
    ("bsd4-text", "BSD-4-Clause", [30, 31, 32, 37, 33]),
    ("bsd2-text", "BSD-2-Clause", [30, 31, 32]),
    ("bsd2-whole", "BSD-2-Clause", [30, 31, 32, 36]),
    ("bsd-style", "BSD-3-Clause", [141]),
    ("isc-text", "ISC", [80]),
    ("isc-whole", "ISC", [80, 83, 84]),
    ("isc-text-old", "ISC", [81]),
    ("isc-whole-old", "ISC", [81, 83, 84]),
    ("0bsd-text", "0BSD", [82]),
    ("0bsd-whole", "0BSD", [82, 83, 84]),
    ("zlib-grant", "Zlib", [92]),
    ("zlib-text", "Zlib", [90, 91, 92, 93, 94, 95]),
    ("bsl-text", "BSL-1.0", [100]),
    ("bsl-notice", "BSL-1.0", [101]),
    ("unlicense-text", "Unlicense", [110, 111]),
    ("unlicense-notice", "Unlicense", [110]),
    ("cc0-notice", "CC0-1.0", [48]),
    ("cc0-deed", "CC0-1.0", [49]),
    ("epl2-header", "EPL-2.0", [120]),
    ("epl2-header-old", "EPL-2.0", [121]),
    ("wtfpl-text", "WTFPL", [130, 131]),
    ("artistic2-notice", "Artistic-2.0", [140]),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", [40]),
    ("cc-by-notice", "CC-BY-4.0", [41]),
    ("cc-by-text", "CC-BY-4.0", [43]),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", [42]),
    ("cc-by-sa-text", "CC-BY-SA-4.0", [44]),
    ("cc-by-nc-text", "CC-BY-NC-4.0", [45]),
    ("cc-by-nc-sa-text", "CC-BY-NC-SA-4.0", [46]),
    ("cc-by-nd-text", "CC-BY-ND-4.0", [47]),
    ("mpl2-header", "MPL-2.0", [50]),
    ("mpl2-header-whole", "MPL-2.0", [50, 52]),
    ("mpl2-header-https", "MPL-2.0", [50, 53]),
    ("reserved", "LicenseRef-reserved", [60]),
]
RULES += [(f"spdx-{x}", RENAMED.get(x, x), [200 + i]) for i, x in enumerate(SPDX)]
#: Terms of an SPDX expression that are told apart, beyond which the rest is left.
TERMS = 6
_TAG = "spdx license identifier"
#: Sentences end at closing punctuation followed by white space, and at a paragraph's end: a line without letters or digits.
CUTS = r"(?<=[.;:!?])\s+"
PARAGRAPHS = r"\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*"
ODD = r"[^a-z0-9]+"
#: In marked texts: a line break within a sentence, the end of a sentence, the end of a paragraph, and the bounds of a known sentence's id.
LINE, END, BREAK, ID = "\x01", "\x02", "\x03", "\x04"


NAME = "\x05"


def _pieces(sentence: str) -> list[list[str]]:
    """The words of each piece that CUTS makes of a known sentence, NAME for a name left open."""
    lower = "".join(c.lower() if c.isascii() else " " for c in sentence.replace("{}", f" {NAME} "))
    return [w for w in (re.sub(rf"[^a-z0-9{NAME}]+", " ", x).split() for x in re.split(CUTS, lower)) if w]


def _fixed(pieces: list[list[str]]) -> str:
    """The longest run of words of a known sentence without an open name."""
    return max((x.strip() for x in " ".join(w for p in pieces for w in p).split(NAME)), key=len)


def single_tags(text: Column) -> Column:
    """``text`` with the terms of SPDX expressions as tags of their own, and exceptions left out."""
    tag = r"SPDX-License-Identifier:[ \t]*"
    text = F.regexp_replace(text, rf"(?i)({tag})[( ]+", "$1")
    for _ in range(TERMS - 1):
        text = F.regexp_replace(text, rf"(?i)({tag})([a-z0-9.+-]+)[ \t)]+WITH[ \t]+[a-z0-9.+-]+", "$1$2")
        text = F.regexp_replace(text, rf"(?i)({tag})([a-z0-9.+-]+)[ \t)]+(?:OR|AND)[ \t(]+", "$1$2\n$1")
    text = F.regexp_replace(text, rf"(?i)({tag})([a-z0-9.+-]+)[ \t)]+WITH[ \t]+[a-z0-9.+-]+", "$1$2")
    return F.regexp_replace(text, rf"(?i)({tag}[a-z0-9.-]+)\+", "$1 plus\n")


def _marked(text: Column) -> Column:
    """``text`` as words of a-z and 0-9 between marks of where lines, sentences and paragraphs end."""
    t = F.translate(lower_ascii(text), LINE + END + BREAK + ID, "    ")
    for pattern, by in (
        (PARAGRAPHS, BREAK),
        (CUTS, END),
        (r"\n+", LINE),
        (rf"[^a-z0-9{LINE}{END}{BREAK}]+", " "),
        (rf" *([{LINE}{END}{BREAK}]) *", "$1"),
        (rf"[{LINE}{END}]*{BREAK}[{LINE}{END}{BREAK}]*", BREAK),
        (rf"{LINE}*{END}[{LINE}{END}]*", END),
    ):
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


def _with_ids(marked: Column, known: list[tuple[int, list[list[str]]]]) -> Column:
    """``marked`` with its known sentences, longest first, as their ids; one begins and ends where a line does or a sentence, and may be wrapped."""
    for sid, pieces in known:
        words = rf"[ {LINE}{END}]".join(rf"[ {LINE}]".join(p) for p in pieces)
        words = re.sub(rf"{NAME}\[[^\]]*\]", lambda _: rf"(?:[a-z0-9]+[ {LINE}{END}]){{1,12}}?", words)
        marked = F.regexp_replace(marked, rf"(?<![^{LINE}{END}{BREAK}]){words}(?![^{LINE}{END}{BREAK}])", f"{ID}{sid}{ID}")
    return marked


def detect_licenses(docs: DataFrame, sentences: dict[int, str] | None = None, rules: list | None = None, gap: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_known (known licence sentences), licenses (sorted, distinct) and matches (rule, license, first and last sentence)."""
    spark, rules = docs.sparkSession, RULES if rules is None else rules
    known = [(k, p) for k, v in (SENTENCES if sentences is None else sentences).items() if (p := _pieces(v))]
    known.sort(key=lambda x: -sum(map(len, x[1])))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_t"), F.col(text).alias("text"))
    # most texts hold the words of no known sentence at all
    words = F.array(F.regexp_replace(lower_ascii(F.col("text")), ODD, " "))  # an array, so that they are made once for all sentences
    some = F.exists(words, lambda w: reduce(or_, [w.contains(x) for x in sorted({_fixed(pieces) for _, pieces in known if not _fixed(pieces).startswith(_TAG)} | {_TAG})], F.lit(False)))
    held = cut(d.filter(some).distinct())
    found = F.regexp_replace(_with_ids(_marked(single_tags(F.col("text"))), known), rf"[{LINE}{END}{BREAK}]*({ID}\d+{ID})[{LINE}{END}{BREAK}]*", f"{END}$1{END}")
    parts = held.select("doc_id", "_t", F.split(F.trim(F.translate(found, END + BREAK, "\n\n")), r"\n+", -1).alias("parts"))
    at = F.transform("parts", lambda x, i: F.struct(i.alias("pos"), F.when(x.startswith(ID), F.translate(x, ID, "").cast("int")).alias("sid")))
    seen = cut(parts.select("doc_id", "_t", F.filter(at, lambda x: x["sid"].isNotNull()).alias("seq"))).filter(F.size("seq") > 0)
    table = F.broadcast(spark.createDataFrame([(n, lic, ids, ids[0], len(ids)) for n, lic, ids in rules], "rule string, license string, ids array<int>, sid int, len int"))
    starts = seen.select("doc_id", "_t", "seq", F.posexplode("seq").alias("i", "at")).select("doc_id", "_t", "seq", "i", F.col("at.sid").alias("sid")).join(table, "sid")
    own = starts.withColumn("own", F.slice("seq", F.col("i") + 1, F.col("len"))).filter(F.transform("own", lambda x: x["sid"]) == F.col("ids"))
    steps = F.zip_with(F.slice(F.col("own"), 2, F.col("len")), F.slice(F.col("own"), 1, F.col("len") - 1), lambda b, a: b["pos"] - a["pos"] - 1)
    near = own.filter((F.col("len") == 1) | F.forall(steps, lambda x: x <= gap))
    spans = near.select("doc_id", "_t", "rule", "license", F.element_at("own", 1)["pos"].alias("first"), F.element_at("own", -1)["pos"].alias("last"))
    # a match lies inside a longer one exactly if an earlier or equal start reaches at least as far
    by = Window.partitionBy("doc_id", "_t").orderBy("first", F.desc("last"), "rule")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    kept = spans.withColumn("reach", before).filter(F.col("reach").isNull() | (F.col("last") > F.col("reach")))
    result = kept.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.array_sort(F.collect_list(F.struct("first", "last", "rule", "license"))).alias("matches"))
    both = seen.select("doc_id", "_t", F.size("seq").cast("long").alias("n_known")).join(result.withColumnsRenamed({"doc_id": "r_id", "_t": "r_t"}), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("_t") == F.col("r_t")), "left").select(F.col("doc_id").alias("f_id"), F.col("_t").alias("f_t"), "n_known", "licenses", "matches")
    both = broadcast_if_small(cut(both))
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_t"))
    return ids.join(both, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("_t") == F.col("f_t")), "left").select(
        "doc_id",
        F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("matches", F.array().cast("array<struct<first:int,last:int,rule:string,license:string>>")).alias("matches"),
    )
