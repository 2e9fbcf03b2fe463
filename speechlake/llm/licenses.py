"""Operator 7: licence scan by canonical digest lookup.

Each unit of a document (its whole text, its paragraphs and its lines) is brought to a canonical form: lower case, copyright
lines dropped, runs of anything but letters and digits to one space, equivalent spellings to one. Its digest is looked up
among those of known licence texts and notices by a hash join. The known table is a constant of this module, broadcast and so
without a shuffle of units, or the caller's, joined by shuffle.
"""

from __future__ import annotations

import hashlib
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

#: Known texts and notices by licence (fixed values).
KNOWN: list[tuple[str, str]] = [
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: Notices of licences whose whole texts are files of known_licenses, by name: the licence's own wording, and names for the common sentences.
GNU = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{comma} either version {v} of the License, or (at your option) any later version."""
NAMES = {
    "MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": "Apache License, Version 2.0",
    "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3", "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3", "AGPL-3.0": "GNU Affero General Public License, version 3", "MPL-1.1": "Mozilla Public License, version 1.1",
    "MPL-2.0": "Mozilla Public License, version 2.0", "Unlicense": "Unlicense", "Zlib": "zlib License", "CC0-1.0": "CC0 1.0 Universal",
}
SPDX = ["ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib", "CC0-1.0"] + [
    f"{x}-{how}" for x in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for how in ("only", "or-later") if (x, how) != ("GPL-3.0", "only")
]
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {url}."
#: Addresses of the Free Software Foundation, and links, that differ between editions of the same text.
_EDITIONS = [("51 franklin street fifth floor boston ma 02110 1301 usa", x) for x in ("59 temple place suite 330 boston ma 02111 1307 usa", "675 mass ave cambridge ma 02139 usa")] + [
    ("https fsf org", "http fsf org"), ("https www gnu org", "http www gnu org"), ("https unlicense org", "http unlicense org"),
]


def editions(text: str) -> list[str]:
    """A whole text's canonical forms: with other addresses and links, and cut after its terms, where an appendix follows them."""
    out = {canonical(text)}
    for a, b in _EDITIONS:
        out |= {x.replace(a, b) for x in out}
    for end in ("end of terms and conditions", "for more information please refer to"):
        cut = {x[: x.index(end) + (len(end) if end.startswith("end") else 0)].strip() for x in out if end in x}
        out |= cut | {x.removesuffix(" end of terms and conditions") for x in cut}
    return sorted(out | {x.replace(" copyright yyyy name of copyright holder ", " ") for x in out})


def more() -> list[tuple[str, str]]:
    """Whole texts of known_licenses and the notices above, by licence."""
    files = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in resources.files(__package__).joinpath("known_licenses").iterdir() if f.name.endswith(".txt")}
    out = [(name, form) for name, text in sorted(files.items()) for form in editions(text)]
    out += [("Zlib", x + files["Zlib"]) for x in ("zlib License\n", "The zlib License\n")] + [("Zlib", files["Zlib"].replace("authors", "author"))]
    apache = files["Apache-2.0"][files["Apache-2.0"].index("   Licensed under the Apache") :]
    out += [("Apache-2.0", apache), ("Apache-2.0", apache.split("\n\n")[0]), ("Apache-2.0", apache.replace("http:", "https:"))]
    for name, label, versions in (("GPL", "General", ("2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",))):
        out += [
            (f"{name}-{v if '.' in v else v + '.0'}-or-later", GNU.format(what=what, colon=":", comma=comma, name=f"GNU {label} Public License", v=v))
            for v in versions for what in ("program", "library", "software", "file") for comma in (",", ";")
        ]
    out += [("MPL-2.0", MPL_NOTICE.format(url=f"{http}://{www}mozilla.org/MPL/2.0/")) for http in ("http", "https") for www in ("", "www.")]
    out += [(x, f"SPDX-License-Identifier: {x}") for x in SPDX]
    how = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under")
    out += [(x, f"{h} the {n}.") for x, n in NAMES.items() for h in how]
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            out += [(f"CC-{kind}-{v}", f"{h} CC {kind} {v}.") for h in how] + [(f"CC-{kind}-{v}", f"SPDX-License-Identifier: CC-{kind}-{v}")]
    return out


#: Equivalent spellings, each to the first of its row (fixed values).
SPELLINGS: list[tuple[str, ...]] = [
    ("license", "licence"), ("licensed", "licenced"), ("sublicense", "sublicence", "sub license", "sub licence"), ("noninfringement", "non infringement"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("favor", "favour"), ("while", "whilst"), ("and or", "and/or"),
]
SALT = 16
#: Lines that name a holder and not the terms: copyright with a year, a sign, a placeholder or named authors, and what often stands below.
_COPYRIGHT = (
    r"(?m)^[^a-z0-9\n]*(?:copyright\b[^\n]*\d{4}[^\n]*|copyright[^\S\n]*(?:\(c\)|©|&copy;|<|\[|:)[^\n]*|copyright[^\S\n]+the\b[^\n]*\b(?:authors|contributors|developers)\b[^\n]*"
    r"|\(c\)[^\n]*\d{4}[^\n]*|(?:©|&copy;)[^\n]*|all rights reserved[^a-z0-9\n]*)$"
)
_SPELL = {w: row[0] for row in SPELLINGS for w in row[1:]}


def canonical(text: str) -> str:
    """The canonical form, in plain Python: for the known texts, and to test the other one."""
    text = re.sub(_COPYRIGHT, " ", text.translate({c: c + 32 for c in range(65, 91)}), flags=re.A)
    text = " " + re.sub("[^a-z0-9]+", " ", text).strip() + " "
    for other, one in _SPELL.items():
        text = text.replace(f" {other} ", f" {one} ")
    return text.strip()


def canonical_column(text: Column) -> Column:
    """The same as a column."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(lower, _COPYRIGHT, " "), "[^a-z0-9]+", " ")), F.lit(" "))
    for other, one in _SPELL.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(out)


KNOWN += more()


def known(spark: SparkSession) -> DataFrame:
    forms = {c: name for c, name in ((canonical(t), name) for name, t in reversed(KNOWN))}
    return spark.createDataFrame([(hashlib.sha256(c.encode()).hexdigest(), [name]) for c, name in forms.items()], "digest string, names array<string>")


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, whole string (licence that the entire text is, or null), licenses string (all found, sorted, comma-joined), n_units long (units that match).

    One row per row of documents. Null and empty texts match nothing. Units: the whole text, paragraphs (between blank lines) and
    lines, equal ones once each. A unit is digested only if its canonical form is no longer than the longest known one. ``texts``
    (license, text) takes the place of the constant table and may be of any size; licences of equal texts are all named.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.array_distinct(F.concat(F.array(text), F.filter(F.concat(F.split(text, "\\n[\\x20\\t\\r]*\\n"), F.split(text, "\\n")), lambda u: F.length(u) > 0)))
    forms = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform(units, canonical_column).alias("forms"))
    if texts is None:
        table, longest = known(docs.sparkSession), max(len(canonical(t)) for _, t in KNOWN)
    else:
        table = texts.select("license", canonical_column(F.col("text")).alias("form")).where("form != '' AND license IS NOT NULL")
        longest = table.agg(F.max(F.length("form"))).first()[0] or 0
        table = table.groupBy(F.sha2("form", 256).alias("digest")).agg(F.array_sort(F.collect_set("license")).alias("names"))
    digest = lambda c: F.when(F.length(c) <= longest, F.sha2(c, 256))
    rows = forms.select("row", "doc_id", digest(F.element_at("forms", 1)).alias("all"), F.transform(F.filter("forms", lambda c: F.length(c) <= longest), lambda c: F.sha2(c, 256)).alias("units"))
    pairs = rows.select("row", "doc_id", "all", F.explode_outer("units").alias("digest"))
    if texts is None:
        hit = pairs.join(F.broadcast(table), "digest", "left")  # a constant table
    else:  # by shuffle; a very common line is dealt over SALT tasks
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hit = pairs.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALT))).join(table.hint("merge"), ["digest", "salt"], "left")
    out = hit.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("digest") == F.col("all"), F.array_join("names", ","))).alias("whole"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("licenses"), F.count("names").alias("n_units"),
    )
    return out.drop("row")
