"""Operator 7: licence scans by canonical digest lookup, with DataFrame functions only.

Entire texts are brought to a canonical form (case, punctuation, copyright
lines, equivalent spellings) and digested; a hash join finds the digests of
known licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.runtime import text_column

#: Known texts up to which their table is broadcast; beyond it Spark chooses the join.
BROADCAST_ROWS = 10_000

# Equivalent spellings, the second stands for both.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noninfringement", "non infringement"),
]

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Public licence texts and notices by their usual short names, without titles.
KNOWN = {
    "MIT": _MIT_GRANT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software.\n\n" + _AS_IS,
    "MIT-0": _MIT_GRANT + ".\n\n" + _AS_IS,
    "ISC": _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END,
    "0BSD": _ISC_GRANT + ".\n\n" + _ISC_END,
    "BSD-2-Clause": _BSD_TWO + "\n" + _BSD_END,
    "BSD-3-Clause": _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n\n" + _BSD_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and "
    "to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
}
# Titles that a text may carry; none is usual, too.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
}
# Digests of whole licence texts in canonical form, with their titles and appendices.
DIGESTS = {
    "Apache-2.0": "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "452eaadd998b06b62a51be424c021eea5228803a2773e147818b9cd429a60d64",
    "GFDL-1.3": "c6db6132e3f9cfc574a0348860b9e8a36b70ab711ca7ec85d9c61871c2d90e55",
    "GPL-1.0": "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def spelled() -> list[tuple[str, str]]:
    """(licence, text) of the known texts with each of their titles and with none."""
    return [(name, f"{title}\n\n{text}" if title else text) for name, text in KNOWN.items() for title in ["", *TITLES.get(name, [])]]


# A line is one of copyright if a year or a place for one follows the word or sign: a wrapped licence's line may begin with the word.
_COPYRIGHT = r"(^|\n)[ \t#*/;-]*((copyright|\(c\)|©)[^\n]*([12][0-9][0-9][0-9]|[<\[{(] *(yyyy|year)|\(c\) *[<\[{]|© *[<\[{])[^\n]*|all rights reserved[.]?[ \t\r]*)"
_SIGNS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """ASCII lower case, no copyright lines, punctuation and white space as one space, one spelling."""
    t = F.translate(text, _UPPER, _LOWER)
    t = F.regexp_replace(t, _COPYRIGHT, "\n")
    # two spaces between words, so that neighbours can both be replaced
    t = F.concat(F.lit(" "), F.regexp_replace(t, _SIGNS, "  "), F.lit(" "))
    for other, one in SPELLINGS:
        t = F.replace(t, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    t = f"regexp_replace({t}, {q(_COPYRIGHT)}, chr(10), 'g')"
    t = f"' ' || regexp_replace({t}, {q(_SIGNS)}, '  ', 'g') || ' '"
    for other, one in SPELLINGS:
        t = f"replace({t}, ' {other} ', ' {one} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'), ' ')"


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, canonical_sha256) of the built-in texts and digests, or of the texts given."""
    table = spark.createDataFrame(texts or spelled(), "licence string, text string")
    table = table.select("licence", F.sha2(canonical(text_column(table)), 256).alias("canonical_sha256"))
    return table if texts else table.unionByName(spark.createDataFrame([*DIGESTS.items()], "licence string, canonical_sha256 string"))


def scan(docs: DataFrame, licences: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, canonical_sha256 and licence (null if none is known) of every row.

    ``licences`` is a table as ``known`` gives it. Null texts count as empty and
    match nothing, like any text without words; null ids stay; repeated rows
    repeat; an empty table gives an empty one. If known texts share a digest,
    the first name in order stands for them.
    """
    licences = known(docs.sparkSession) if licences is None else licences
    table = licences.where(F.col("canonical_sha256") != F.sha2(F.lit(""), 256)).groupBy("canonical_sha256").agg(F.min("licence").alias("licence"))
    if licences.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    found = docs.select(docs[id_col].alias("hazeline_id"), F.sha2(canonical(text_column(docs, text_col)), 256).alias("canonical_sha256"))
    return found.join(table, "canonical_sha256", "left").select(F.col("hazeline_id").alias(id_col), "canonical_sha256", "licence")
