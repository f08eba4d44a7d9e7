"""Licence scan by canonical digests of entire texts.

A unit (a line, a paragraph or the whole document) is brought to a canonical
form: lower case, without copyright lines, punctuation as spaces, equivalent
spellings made equal. Its SHA-256 is joined to the digests of known licence
texts and notices. Units match in full or not at all.

Defined cases: null and empty texts match nothing; a unit that is only
copyright lines is empty and matches nothing; a text that is both a line and the
whole document counts once per scope; repeated rows stay repeated; a line end of
two characters parts paragraphs like an empty line; a digest known under two names
counts for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.sources.tables import stage

# Licence notices and full texts, by SPDX-style name.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
            + _ISC_TAIL),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted.\n\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TERMS + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TERMS + _BSD_NAMES + _BSD_TAIL),
    ("Unlicense", _UNLICENSE + "https://unlicense.org>"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
# Patterns on one lower-case line, then on words parted by one space.
# A copyright line has a year or a sign: body lines that begin with "copyright holders" or "(c) You must" stay.
COPYRIGHT_LINE = (r"^[^a-z0-9]*(copyright[ ,.:].*([0-9]{4}|\(c\)|©).*|copyright[ ,.:]+by .*|"
                  r"(\(c\)|©)[ ,.:]*([0-9]{4}|copyright).*|all rights reserved[^a-z0-9]*)$")
LINE_RULES = ((r"([0-9])\.0(\.?(?:[^0-9.]|$))", r"\1\2"), (r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
SPELLINGS = (
    ("licences?", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("organisation", "organization"), ("favour", "favor"), ("https", "http"),
    ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
    ("version ([0-9])", r"v\1"), ("v ([0-9])", r"v\1"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _java(replacement: str) -> str:
    return replacement.replace("\\", "$")


def folded_lines(paragraph: Column) -> Column:
    """The non-empty lines of a paragraph, folded all at once by the rules for one line."""
    c = F.translate(paragraph, _UPPER + "\r", _LOWER + "\n")
    # The rules hold within lines: line ends part them and are not punctuation.
    c = F.regexp_replace(c, "(?md)" + COPYRIGHT_LINE.replace("[^a-z0-9]", r"[^a-z0-9\n]"), "")
    for pattern, to in LINE_RULES:
        c = F.regexp_replace(c, pattern.replace(r"\x00-\x2F", r"\x00-\x09\x0B-\x2F"), _java(to))
    return F.filter(F.transform(F.split(c, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def canonical_words(words: Column) -> Column:
    c = F.concat(F.lit(" "), words, F.lit(" "))
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, f" {pattern} " if not pattern.endswith(")") else f" {pattern}", _java(
            f" {to} " if not pattern.endswith(")") else f" {to}"))
    return F.trim(c)


def paragraphs(text: Column) -> Column:
    """The folded lines of each paragraph of a text."""
    return F.transform(F.split(text, r"(?:\r?\n|\r)[\x20\t]*(?:\r?\n|\r)+", -1), folded_lines)


def _whole(parts: Column) -> Column:
    return F.array_join(F.flatten(parts), " ")


def first_words(canonical: list[str]) -> list[str]:
    """First words that a unit needs, before spellings, to become one of the canonical texts.

    A word that begins no spelling stays as it is; those that do may become any.
    """
    heads = [pattern.split(" ")[0] for pattern, _ in SPELLINGS]
    forms = [form for h in heads for form in ((h[:-2], h[:-1]) if h.endswith("?") else (h,))]
    return sorted({text.split(" ")[0] for text in canonical} | set(forms))


def units(parts: Column, first: list[str]) -> Column:
    """(scope, digest) of the lines, paragraphs and the whole that begin with one of the first words."""
    def unit(scope: str, texts: Column) -> Column:
        able = F.filter(texts, lambda c: F.substring_index(c, " ", 1).isin(first))
        return F.transform(able, lambda c: F.struct(F.lit(scope).alias("scope"), F.sha2(canonical_words(c), 256).alias("digest")))

    return F.concat(unit("line", F.flatten(parts)),
                    unit("paragraph", F.transform(parts, lambda lines: F.array_join(lines, " "))),
                    unit("text", F.array(_whole(parts))))


def canonical_texts(spark, known=KNOWN) -> DataFrame:
    """(license, canonical) of the known texts."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select("license", canonical_words(_whole(paragraphs(F.col("text")))).alias("canonical")).where("canonical <> ''")


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """(doc_id, n_matches, licenses, is_license): one row per document row.

    ``licenses`` are the distinct names in order, joined by commas;
    ``is_license`` says that the whole text is one of them. Documents with the
    same units share one outcome, so copies meet the known digests once.
    """
    texts = canonical_texts(docs.sparkSession, known)
    digests = texts.select(F.sha2("canonical", 256).alias("digest"), "license").distinct()
    # The known texts are a list held by the caller.
    first = first_words([r.canonical for r in texts.collect()])
    folded = docs.select("doc_id", paragraphs(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("parts"))
    able = folded.select("doc_id", units(F.col("parts"), first).alias("units"))
    kept = stage(able.withColumn("outcome", F.when(F.size("units") > 0, F.sha2(F.to_json("units"), 256))), "license-units")
    hits = (kept.where("outcome IS NOT NULL").dropDuplicates(["outcome"]).select("outcome", F.inline("units"))
            .join(digests, "digest").groupBy("outcome").agg(
                F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
                F.bool_or(F.col("scope") == "text").alias("is_license")))
    return kept.where("outcome IS NULL").select(
        "doc_id", F.lit(0).cast("long").alias("n_matches"), F.lit("").alias("licenses"), F.lit(False).alias("is_license")
    ).unionByName(kept.where("outcome IS NOT NULL").join(hits, "outcome", "left").select(
        "doc_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("is_license", F.lit(False)).alias("is_license")))
