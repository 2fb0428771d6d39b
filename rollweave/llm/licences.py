"""Licence scan by canonical digests.

Texts are put into a canonical form (case, punctuation, copyright lines, equivalent spellings), hashed, and the digests of
entire texts are joined with those of known licences; each line of a text is looked up in the same way as a notice. The
known texts are few (KNOWN, the files of ``licence_texts``, what ``read_texts`` reads), so their table is broadcast after a check of its size; the documents are never shuffled: lines
are counted inside their own row.

Edge cases: null texts are empty; an empty canonical form matches nothing; repeated rows and lines count each; an empty
table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence-matching guidelines treat as equal, (found, replaced by).
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgment", "judgement"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("sublicence", "sublicense"),
    ("percent", "per cent"), ("https", "http"),
)

# Fixed values: (licence, text) of short public licences and of the notices that usually name a licence.
KNOWN = (
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain."),
)

#: A line that states whose work it is; prose of a wrapped licence may begin with the same word. Lines end at line feeds alone.
COPYRIGHT = (
    r"(?dm)^[^\S\n]*(?:©|\(c\)[^\S\n]*(?:[\d<\[{]|©|copyright\b)|copyright\b[^\S\n]*+(?:\(c\)|©|by\b|[\d<\[{]"
    r"|(?!(?:notices?|holders?|owners?|laws?|treat(?:y|ies))\b)[^\n]*\b(?:authors|contributors|developers|inc|llc|ltd|gmbh|corp|corporation|foundation|(?:19|20)\d\d)\b))[^\n]*$"
)
#: One of these is in every known text.
HINTS = ("licenc", "licens", "permission", "copyright", "software")
#: What separates words in the canonical form.
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©]+"


def _variants(licence: str, text: str) -> list[tuple[str, str]]:
    """A file's text, the same without what follows its terms (how to apply them), and a BSD text with its usual second line."""
    end = re.search(r"(?im)^[^\S\n]*end of (?:the )?terms and conditions[^\n]*$", text)
    out = [text] + ([text[: end.end()], text[: end.start()]] if end else []) + ["All rights reserved.\n" + text] * licence.startswith("BSD")
    return [(licence, t) for t in out]


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the whole licences that are shipped: files named by their SPDX identifiers."""
    files = (f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt"))
    return [v for f in sorted(files, key=lambda f: f.name) for v in _variants(f.name[:-4], f.read_text("utf-8"))]


def all_known() -> list[tuple[str, str]]:
    """KNOWN, variants of its BSD texts, and the shipped texts."""
    return [*KNOWN, *(v for n, t in KNOWN if n.startswith("BSD") for v in _variants(n, t)), *full_texts()]


def read_texts(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(licence, text) of a folder of ``<SPDX identifier>.txt`` files, such as SPDX publishes: more ``known`` for ``scan``."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1), "value")
    return [v for name, text in sorted(map(tuple, rows.collect())) for v in _variants(name, text)]


def canonical(text: Column) -> Column:
    """Canonical form: words in lower case and one spelling, one space apart; null for texts without words.

    Words are looked up one by one, so neighbours can't hide each other, and only in texts that have any word of SPELLINGS.
    """
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    stated = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    words = F.array_remove(F.split(F.when(stated, F.regexp_replace(low, COPYRIGHT, " ")).otherwise(low), MARKS), "")
    odd = F.array(*(F.lit(found) for found, _ in SPELLINGS))
    spelt = F.create_map(*(F.lit(w) for pair in SPELLINGS for w in pair))

    def joined(ws: Column) -> Column:
        same = F.when(F.arrays_overlap(ws, odd), F.transform(ws, lambda w: F.coalesce(F.try_element_at(spelt, w), w))).otherwise(ws)
        return F.array_join(same, " ")

    out = F.transform(F.array(words), joined)[0]  # a lambda's argument is computed once, however often it is used
    return F.nullif(out, F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, licence): each digest once."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "licence").where("digest IS NOT NULL").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known=None) -> DataFrame:
    """(doc_id, text_sha256 of the canonical form, licence of the entire text, notices: licences of its lines, sorted).

    ``known``: (licence, text) pairs, by default KNOWN and the shipped texts.
    """
    spark = docs.sparkSession
    known = all_known() if known is None else list(known)
    table = known_digests(spark, known)
    row = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_sha256", digest(F.col("text")))
    by_text = row.join(F.broadcast(table), F.col("text_sha256") == F.col("digest"), "left").drop("digest")
    # the same table as a map inside the plan: a few dozen fixed entries
    pairs = F.map_from_entries(F.array(*(F.struct(F.lit(d), F.lit(n)) for d, n in sorted(map(tuple, table.collect())))))
    likely = F.split("text", "\n")
    if all(re.search("|".join(HINTS), t.lower()) for _, t in known):  # then a text or a line without any of these words can't be one of them
        hinted = lambda x: reduce(Column.__or__, (F.lower(x).contains(h) for h in HINTS))
        likely = F.when(hinted(F.col("text")), F.filter(likely, hinted)).otherwise(F.array().cast("array<string>"))
    notices = F.filter(F.transform(likely, lambda x: F.try_element_at(pairs, digest(x))), lambda x: x.isNotNull())
    return by_text.select("doc_id", "text_sha256", "licence", F.array_sort(notices).alias("notices"))
