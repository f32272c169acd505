"""Licence scans by canonical digest lookup.

A text is made canonical: lower case, lines that state a copyright dropped, equivalent spellings made one,
everything but letters and digits a single space. Which lines state a copyright is told in two ways, and both forms
are looked up: a wide one drops every line that begins with the word or sign, a narrow one leaves lines in
which a licence only speaks of copyright, wherever its text was wrapped. The SHA-256 of the whole canonical text is then
joined to the digests of known licences, made the same way. A document is looked up as a whole, and so is
each of its lines, since notices stand as lines of their own; nothing but entire texts is compared.

Defined results: a null or empty text, and one that is empty once canonical, matches nothing; repeated rows
each give their matches; an empty table gives an empty result; other columns are not read. A document that
is one line gives its match as a whole only.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, in the order in which they are made one.
SPELLINGS = (
    ("licence", "license"), ("licensee s", "licensees"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("favour", "favor"), ("analyse", "analyze"), ("behaviour", "behavior"), ("centre", "center"), ("fulfil ", "fulfill "),
    ("judgement", "judgment"), ("labour", "labor"), ("owner holder", "holder"), ("programme", "program"), ("recognise", "recognize"), ("wilful", "willful"),
    ("and or", "or"), ("https", "http"), ("percent", "per cent"),
)

_DISCLAIM = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
# Entire texts of public licences and of their usual notices, as (licence, text).
KNOWN = (
    ("MIT", _MIT + _DISCLAIM),
    ("MIT", "MIT License\n" + _MIT + _DISCLAIM),
    ("MIT", "The MIT License (MIT)\n" + _MIT + _DISCLAIM),
    ("ISC", _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _AUTHOR),
    ("ISC", "ISC License\n" + _PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _AUTHOR),
    ("0BSD", _PERMIT + ".\n" + _AUTHOR),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\nAll rights reserved.\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


def _bare(name: str) -> str:
    return next(t for k, t in KNOWN if k == name)


#: Usual headings of texts that are known without one.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("0BSD", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', 'The BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', 'The BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}
#: Whole texts as published, shipped with the package; some stand with and without what follows their terms.
SHIPPED = tuple((f.name.removesuffix(".txt"), f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
_END = "END OF TERMS AND CONDITIONS"
WHOLE = (
    *[(k, f"{h}\n{t}") for k, heads in HEADINGS.items() for t in (_bare(k), re.sub(r"(?m)^\d\. ", "* ", _bare(k))) for h in ("", *heads)],
    *SHIPPED,
    *[(k, t[: t.index(_END) + n]) for k, t in SHIPPED if _END in t for n in (0, len(_END))],
)


#: One of these stands in every known text, so that others need no canonical form.
HINT = r"(?i)licen[cs]e|software"


#: Lines that state a copyright, in lower case: all that begin so; or without those that go on as a sentence or clause of a licence does.
WIDE = r"(?m)^[^\p{L}\n]{0,40}(?:copyright\b|\(c\)|©).*$"
_SPEAKS = "notices?|holders?|owners?|ownership|laws?|licen[cs]es?|licensed|statements?|interests?|and|or|in|on|is|are|as|to|for|of|treaty|treaties|protection|permissions?|status|disclaimers?|infringement|rights?|related|material"
NARROW = rf"(?m)^[^\p{{L}}\n]{{0,40}}(?:copyright\b(?![^\p{{L}}\n]*(?:{_SPEAKS})\b)|©|\(c\)(?=[^\n]*\b(?:19|20)\d\d\b|\s*copyright\b)).*$|^[^\p{{L}}\n]*all rights reserved[^\p{{L}}\n]*$"


def canonical(text: Column, stated: str = WIDE) -> Column:
    """The canonical form of a text, without the lines that match ``stated``."""
    x = F.regexp_replace(F.lower(text), stated, " ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}\p{N}]++", " "), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} " if " " in a.strip() else a), F.lit(f" {b} " if " " in a.strip() else b))
    return F.trim(F.regexp_replace(x, " ++", " "))


def digests_of(text: Column) -> Column:
    """The digests of both canonical forms."""
    return F.array(*[F.sha2(canonical(text, x), 256) for x in (WIDE, NARROW)])


def catalogue(spark, known=KNOWN + WHOLE) -> DataFrame:
    """license_id and digest of the known texts."""
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(known)], "n int, license_id string, text string")
    rows = rows.select("n", "license_id", F.explode(digests_of(F.col("text"))).alias("digest")).where(F.col("digest") != F.sha2(F.lit(""), 256))
    return rows.groupBy("digest").agg(F.min_by("license_id", "n").alias("license_id")).select("license_id", "digest")


def scan(docs: DataFrame, known=KNOWN + WHOLE) -> DataFrame:
    """Matches: doc_id, license_id, unit (``text`` or ``line``) and line (its number from 0; null for a text)."""
    digests = catalogue(docs.sparkSession, known)
    rows = docs.where("text is not null")
    if all(re.search(HINT, t) for _, t in known):
        rows = rows.where(F.col("text").rlike(HINT))
    lines = F.split(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\n"))
    rows = rows.select("doc_id", F.array(F.col("text")).alias("whole"), lines.alias("lines"))
    rows = rows.select("doc_id", F.posexplode(F.when(F.size("lines") > 1, F.concat("whole", "lines")).otherwise(F.col("whole"))).alias("n", "part"))
    if all(re.search(HINT, t) for _, t in known):
        rows = rows.where(F.col("part").rlike(HINT))
    keyed = rows.select("doc_id", "n", *[F.sha2(canonical(F.col("part"), x), 256).alias(c) for c, x in (("wide", WIDE), ("narrow", NARROW))])
    for c in ("wide", "narrow"):
        keyed = keyed.join(F.broadcast(digests.select(F.col("digest").alias(c), F.col("license_id").alias(f"{c}_id"))), c, "left")
    # The narrow form holds more of the text.
    found = keyed.select("doc_id", "n", F.coalesce("narrow_id", "wide_id").alias("license_id")).where("license_id is not null")
    return found.select("doc_id", "license_id", F.when(F.col("n") == 0, "text").otherwise("line").alias("unit"), F.when(F.col("n") > 0, F.col("n") - 1).alias("line"))
