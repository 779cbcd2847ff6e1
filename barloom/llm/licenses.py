"""Licence scans by canonical digest lookup (native).

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation and white space), and the digest of
the entire text is joined by hash to the digests of known licences. Each line and each paragraph of several lines is a text too, so
that notices, headers and titles are found in longer documents. The table of known texts is a constant of this module, which bounds what is broadcast.

Defined results: a null or empty text matches nothing; repeated rows stay repeated; columns of the input that share a name with a
result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and the notices that name a licence.
_PERMIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_OPEN = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions "
    "of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_CLOSE = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
KNOWN: list[tuple[str, str]] = [
    ("MIT", _PERMIT),
    ("MIT", "MIT License " + _PERMIT),
    ("MIT", "The MIT License (MIT) " + _PERMIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
            "notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_OPEN + _BSD_CLOSE),
    ("BSD-3-Clause", _BSD_OPEN + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                                 "this software without specific prior written permission. " + _BSD_CLOSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
# Canonical digests of entire texts as published (/usr/share/common-licenses), with and without what follows the terms.
TEXTS: list[tuple[str, str]] = [
    ("Apache-2.0", "2f973fce6821968caa77d834b80cee7c"),
    ("Apache-2.0", "a90697331248535821cbca3716b02146"),
    ("Apache-2.0", "d03e86ac7a1ff3f8d928e1d6027bfd17"),
    ("Artistic-1.0", "01297679267ad921516667ccd889865e"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "52e0a7a295a9d54312c3bc7706f38185"),
    ("GFDL-1.3", "44771568e7355662712e7982d5c82165"),
    ("GPL-1.0", "78f3b35da3d393ee93ecfeb7d20907e6"),
    ("GPL-1.0", "9a6d41337fa0145d93e534071bfae3f8"),
    ("GPL-1.0", "f9bdbdf2be484ced90e5d8d884a7bed9"),
    ("GPL-2.0", "1fd12f39754123f61dc30956c432e777"),
    ("GPL-2.0", "42f2f51f3e726d001525877e3528c3d0"),
    ("GPL-2.0", "b73af68d56407814bb0960dcc4125f3d"),
    ("GPL-3.0", "6f7a704d5521abca765227f63e6f8173"),
    ("GPL-3.0", "7953c2a35c921fbf3e8a6c8e784329c4"),
    ("GPL-3.0", "c6e3371f21808ec12136735f091080c0"),
    ("LGPL-2.0", "6608c762a898a5214a0bdfe43ebccdf0"),
    ("LGPL-2.0", "97832943be1e344d51af5aee1b658e4f"),
    ("LGPL-2.0", "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-2.1", "61babd02f0832750d51cef545886b23e"),
    ("LGPL-2.1", "eaf6afb73fc860a002bfbccbe6f07ce7"),
    ("LGPL-3.0", "993aef82f34a705d491848394cf21cd6"),
    ("MPL-1.1", "9fa8ae3e869a929215034d82982372b5"),
    ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec"),
]
_FREE = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_GPL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
# Paragraphs of several lines that name a licence, as headers of files or titles of texts.
HEADERS: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((f"{short}-{version}", _FREE.format(what, name, major)) for what in ("This program", "This library", "This file", "This software") for short, name, version, major in (
        ("GPL", _GPL, "2.0", "2"), ("GPL", _GPL, "3.0", "3"), ("LGPL", _LESSER, "2.1", "2.1"), ("LGPL", _LESSER, "3.0", "3"), ("AGPL", _AFFERO, "3.0", "3"))),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Spellings that count as equal, after punctuation has gone.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("judgement", "judgment"),
             ("fulfil", "fulfill"), ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("creative commons attribution", "cc by"),
             ("the gnu gpl", "the gnu general public license"), ("https", "http")]
#: A line that opens with a copyright claim. "All rights reserved" on its own line is a notice and stays.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©)[ \t,:]*(\(c\)|©)?[ \t]*[0-9][^\n]*$"
ALLOWED = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "CC-BY-4.0", "CC0-1.0")
#: Between paragraphs: lines without letters and digits. Paragraphs of one line are lines already.
GAP = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(" " + old.replace(" ", "  ") + " "), F.lit(" " + new.replace(" ", "  ") + " "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """digest -> licence; of two known texts with one canonical form the first id by name counts."""
    return spark.createDataFrame(known, "license string, text string").select("license", F.md5(canonical(F.col("text")).cast("binary")).alias("digest")).groupBy(
        "digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", known: list[tuple[str, str]] | None = None, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of ``docs``: id, digest of the entire text, its licence (null if unknown), notices (ids of matching lines and paragraphs, sorted, joined by a
    space), n_notices (their number) and permitted (no licence found, or only allowed ones).

    Each text, line and paragraph is digested once and meets the broadcast digests; the lines of a row collapse before the shuffle.
    """
    digests = known_digests(docs.sparkSession, KNOWN + HEADERS if known is None else known)
    if known is None:
        digests = digests.union(docs.sparkSession.createDataFrame(TEXTS, "license string, digest string").select("digest", "license")).groupBy("digest").agg(F.min("license").alias("license"))
    t = F.coalesce(F.col(text), F.lit(""))
    units = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(t, F.lit(1)).alias("__h"), F.xxhash64(t, F.lit(2)).alias("__h2"),
                        F.posexplode(F.concat(F.array(t), F.split(t, "\n"), F.filter(F.split(F.concat(F.lit("\n"), t, F.lit("\n")), GAP), lambda x: F.contains(F.btrim(x, F.lit("\n")), F.lit("\n"))))).alias("__pos", "__unit"))
    units = units.filter((F.col("__pos") == 0) | (F.col("__unit") != "")).select("__id", "__h", "__h2", "__pos", F.md5(canonical(F.col("__unit")).cast("binary")).alias("digest"))
    found = units.join(F.broadcast(digests), "digest", "left")
    whole = F.col("__pos") == 0
    per = found.groupBy("__id", "__h", "__h2").agg(
        F.count_if(whole).alias("__times"), F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("license"))).alias("license"),
        F.collect_set(F.when(~whole, F.col("license"))).alias("__lines"), F.count_if(~whole & F.col("license").isNotNull()).alias("__n"))
    every = F.array_compact(F.concat("__lines", F.array("license")))
    return per.select(F.col("__id").alias(doc_id), "digest", "license", F.array_join(F.sort_array("__lines"), " ").alias("notices"), (F.col("__n") / F.col("__times")).cast("long").alias("n_notices"),
                      F.forall(every, lambda x: x.isin(*allowed)).alias("permitted"), F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))).alias("__k")).drop("__k")


def sql() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def digest(x: str) -> str:
        e = f"' ' || regexp_replace(regexp_replace(lower({x}), {q(COPYRIGHT_LINE)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
        for old, new in SPELLINGS:
            e = f"replace({e}, {q(' ' + old.replace(' ', '  ') + ' ')}, {q(' ' + new.replace(' ', '  ') + ' ')})"
        return f"md5(trim(replace({e}, '  ', ' ')))"

    texts = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (SELECT {digest('t')} AS digest, min(l) AS license FROM (VALUES {texts}) v(l, t) GROUP BY 1),
u AS (SELECT doc_id, 0 AS pos, coalesce(text, '') AS unit FROM documents UNION ALL SELECT doc_id, 1, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
k AS (SELECT doc_id, pos, {digest('unit')} AS digest FROM u WHERE pos = 0 OR unit <> ''),
f AS (SELECT k.doc_id, k.pos, k.digest, known.license FROM k LEFT JOIN known USING (digest))
SELECT doc_id, max(digest) FILTER (pos = 0) AS digest, max(license) FILTER (pos = 0) AS license,
  coalesce(string_agg(DISTINCT license, ' ' ORDER BY license) FILTER (pos = 1 AND license IS NOT NULL), '') AS notices,
  count(license) FILTER (pos = 1) AS n_notices, coalesce(bool_and(license IN ({', '.join(map(q, ALLOWED))})) FILTER (license IS NOT NULL), true) AS permitted
FROM f GROUP BY doc_id
"""
