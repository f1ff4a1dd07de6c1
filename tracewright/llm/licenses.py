"""License scans: TF-IDF cosine of headers and licence files to templates, sentence by sentence, and inheritance from the nearest ancestor directory. DataFrame functions only."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, materialize

#: Texts of common licenses, their usual headers and statements. Each is cut into sentences.
TEXTS = (
    ("MIT", """The MIT License (MIT)

MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0.

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License.\n\nLicensed under the MIT License."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.\n\nBSD 2-Clause License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.\n\nThis program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.\n\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.\n\nThis library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.\n\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\n\nIf a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.\n\nThis work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.\n\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.\n\nThis work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: What a license adds to another one's text.
ADDED = (("BSD-3-Clause", "BSD-2-Clause", "BSD 3-Clause License\n\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),)
#: Titles of long licenses. A document that begins with one is a licence file, whatever sentences follow.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Identifiers in SPDX lines. Those of the GNU licenses have two more forms.
SPDX = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "Apache-2.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SPDX_GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")


def _templates() -> tuple[tuple[str, str], ...]:
    texts = dict(TEXTS[::-1])  # the first of a licence's texts is the longest
    out = [*TEXTS, *TITLES]
    out += [(name, texts[base] + "\n\n" + more) for name, base, more in ADDED]
    out += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
    out += [(name, f"SPDX-License-Identifier: {name}{form}") for name in SPDX_GNU for form in ("", "-only", "-or-later")]
    return tuple(out)


TEMPLATES = _templates()
SEPARATORS = r"(?:[\x09-\x0D\x20\"'\u2018\u2019\u201C\u201D(),;:!?<>]|\.(?=[\x09-\x0D\x20]|$))+"
_BETWEEN = r"\x09-\x0D\x20\"'\u2018\u2019\u201C\u201D(),;:!?<>"
#: Marks of comments at both ends of a line, and rules under titles.
COMMENT = r"(?md)^[\x09\x20]*(?:[#*;%/!=]+|<!--|--+|dnl\b|[Rr][Ee][Mm]\b)?[\x09\x20]*|[\x09\x20]*(?:\*+/|-->)[\x09\x20]*$"
SENTENCE_END = r"(?<=[.!?])[\x09-\x0D\x20]+(?![a-z0-9])"
#: Two ways to cut a text: within lines, and across the lines of a paragraph.
BY_LINE = r"\n+|" + SENTENCE_END
BY_PARAGRAPH = r"\n[\x09\x20]*\n[\x09-\x0D\x20]*|(?<=:)[\x09\x20]*\n|" + SENTENCE_END
LEAST_TOKENS = 2
LEAST_COSINE = 0.8
#: A document is a license file if sentences of its licence make up this share of its words.
FILE_SHARE = 0.5
#: File names of license files.
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicen[cs]e)(?:[-._][^/]*)?$"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")


def uncommented(text: Column) -> Column:
    """A text without carriage returns and marks of comments."""
    return F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), COMMENT, "")


def holds_word(words: list[str]) -> str:
    """A pattern for texts that may hold one of the words as a token: tried where a separator ends, by first character."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(re.escape(w[1:]))
    tries = "|".join(re.escape(first) + "(?:" + "|".join(rest) + ")" for first, rest in by_first.items())
    return f"(?<![^{_BETWEEN}])(?:{tries})(?=[{_BETWEEN}.]|$)" if words else "(?!)"


def template_sentences(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(sentence, license, title, text): the different sentences of each licence's templates, of two words or more."""
    titles = {(name, text) for name, text in TITLES}
    rows = spark.createDataFrame([(name, text, (name, text) in titles) for name, text in templates], "license string, text string, title boolean")
    cut = rows.select("license", "title", F.explode(F.split("text", BY_PARAGRAPH)).alias("text")).where(F.size(tokens(F.col("text"))) >= LEAST_TOKENS)
    return cut.groupBy("license", "text").agg(F.bool_or("title").alias("title")).withColumn("sentence", F.row_number().over(Window.orderBy("license", "text")))


def template_weights(docs: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(token, df, idf) of the templates' words, (token, sentence, weight / norm), and the idf of a word no document has.

    Document frequencies are of all documents; the templates' vocabulary bounds the tables.
    """
    spark = docs.sparkSession
    terms = sentences.select("sentence", F.explode(tokens(F.col("text"))).alias("token")).groupBy("sentence", "token").agg(F.count("*").alias("tf"))
    vocabulary = [r["token"] for r in terms.select("token").distinct().orderBy("token").collect()]
    present = F.array_intersect(F.split(F.lower("text"), SEPARATORS), F.array(*map(F.lit, vocabulary)))
    found = docs.where("text is not null").select(F.explode(F.concat(present, F.array(F.lit("")))).alias("token")).groupBy("token").count()
    df = {r["token"]: r["count"] for r in found.collect()}  # a row per word of the templates
    total = df.pop("", 0)  # every document has the empty mark
    idf = lambda n: math.log((total + 1) / (n + 1)) + 1
    words = spark.createDataFrame([(t, df.get(t, 0), idf(df.get(t, 0))) for t in vocabulary], "token string, df long, idf double")
    weighed = terms.join(F.broadcast(words), "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("sentence")))
    return words, weighed.select("token", "sentence", "df", (F.col("w") / norm).alias("unit")), idf(0)


def sure_words(units: DataFrame, least: float) -> list[str]:
    """Words of which a sentence must hold one to reach the cosine with any template.

    The words that two vectors share carry at least the cosine's square of either one's length, so a template's
    words above the rest of it can't all be missing: the rarest of each are taken. As many as templates have words at most.
    """
    so_far = F.sum(F.col("unit") * F.col("unit")).over(Window.partitionBy("sentence").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1))
    within = units.withColumn("before", F.coalesce(so_far, F.lit(0.0))).where(F.col("before") <= 1 - max(least - 1e-6, 0.0) ** 2 + 1e-9)
    return [r["token"] for r in within.select("token").distinct().orderBy("token").collect()]


def may_reach(words: Column, inside: Column, idf: dict[str, float], rarest: float, least: float) -> Column:
    """Whether a sentence's words can reach the cosine with any template at all.

    Templates hold words of the vocabulary only, so no cosine is above the length of a sentence's part inside it over its
    whole length. The part outside, of n words with d different ones, has a squared length of n * n / d rarest words at least.
    """
    square = max(least - 1e-6, 0.0) ** 2
    weights = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    tf = lambda t: F.size(F.filter(words, lambda w: w == t))
    n, d = F.size(words), F.size(F.array_distinct(words)) - F.size(inside)
    grown = lambda a, t: F.struct((a["n"] + tf(t)).alias("n"), (a["length"] + F.pow(tf(t) * weights[t], F.lit(2.0))).alias("length"))

    def enough(a: Column) -> Column:
        outside = F.when(d > 0, F.pow(n - a["n"], F.lit(2.0)) / d).otherwise(0.0) * rarest**2
        return a["length"] * (1 - square + 1e-9) >= square * outside

    return F.aggregate(inside, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("length")), grown, enough)


def scan_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """(doc_id, path, license, cosine, kind, from_dir) for every row of files (doc_id, path, text).

    Texts are read without marks of comments and cut into sentences twice, within lines and across the lines of a
    paragraph. A sentence's cosine to a template sentence is over TF-IDF vectors; words outside the templates
    weigh as the rarest. It speaks for the licences of its best cosine if that is `least` or more; a document's licence is the one
    for which sentences of most words speak (ties to the higher cosine, then by name), and cosine its highest. A document
    that begins with a long licence's title has that licence. kind is 'file' if it does, if its name is that of a licence file,
    or if its licence's sentences make up file_share of its words, else 'header'. A document without one inherits ('inherited') from the nearest
    ancestor directory that directly holds licence files; of several the most frequent licence counts, ties by
    name. Else kind is 'none' and the rest null. Null and empty texts have no licence of their own,
    a null path no directory; identical rows get identical results; an empty table gives an empty result.
    An SPDX line of several identifiers speaks for none. templates may hold whole licence texts.
    """
    rows = files.select("doc_id", "path", "text").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = ["doc_id", "path", "tie"]
    spoken = template_sentences(rows.sparkSession, templates)
    words, units, rarest = template_weights(rows, spoken)
    idf = {r["token"]: r["idf"] for r in words.collect()}  # the templates' vocabulary
    # Texts that may hold a word that decides are cut, and of their sentences those that can reach the cosine leave the row:
    # a word that decides may be a common one, and most sentences with it are far from any template.
    starts = F.lit(holds_word(sure_words(units, least)))
    told = lambda text: F.rlike(F.lower(text), starts)
    hits = rows.where(F.col("text").isNotNull() & told(F.col("text"))).withColumn("text", uncommented(F.col("text")))
    cut = lambda way, rule: F.transform(F.split("text", rule), lambda line, at: F.struct(F.lit(way).alias("way"), at.alias("at"), line.alias("line")))
    lines = F.concat(*[F.filter(cut(way, rule), lambda s: told(s["line"])) for way, rule in enumerate((BY_LINE, BY_PARAGRAPH))])
    lines = F.transform(lines, lambda s: F.struct(s["way"].alias("way"), s["at"].alias("at"), s["line"].alias("line"), tokens(s["line"]).alias("words")))
    vocabulary = F.array(*map(F.lit, idf))
    lines = F.transform(lines, lambda s: F.struct(s["way"].alias("way"), s["at"].alias("at"), s["line"].alias("line"), s["words"].alias("words"), F.array_intersect(s["words"], vocabulary).alias("inside")))
    kept = F.filter(lines, lambda s: may_reach(s["words"], s["inside"], idf, rarest, least))
    sentences = hits.withColumn("n_words", F.regexp_count("text", F.lit(WORD))).select(*keys, "n_words", F.inline_outer(kept)).where("line is not null").drop("words", "inside")  # inline alone would cut each text twice, to see whether rows come of it
    sentences = sentences.dropDuplicates([*keys, "way", "at"]).withColumn("line_words", F.regexp_count("line", F.lit(WORD)))
    sentences = materialize(sentences.withColumn("digest", F.xxhash64("line")), "license-sentences")
    # Each different sentence is compared once.
    lines = sentences.select("digest", "line").dropDuplicates(["digest"])
    terms = lines.select("digest", F.explode(tokens(F.col("line"))).alias("token")).groupBy("digest", "token").agg(F.count("*").alias("tf"))
    weighed = terms.join(F.broadcast(words), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    norms = weighed.groupBy("digest").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(units), "token").groupBy("digest", "sentence").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"))
    cosines = dots.join(norms, "digest").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least)
    named = cosines.join(F.broadcast(spoken.select("sentence", "license", "title")), "sentence").groupBy("digest", "license").agg(F.max(F.struct("cosine", "title")).alias("b"))
    best = F.max("b.cosine").over(Window.partitionBy("digest"))
    speaks = named.withColumn("best", best).where("b.cosine = best").select("digest", "license", "b.*")
    for_each = sentences.join(speaks, "digest").groupBy(*keys, "way", "license").agg(
        F.sum("line_words").alias("covered"), F.max("cosine").alias("cosine"), F.max("n_words").alias("n_words"),
        F.bool_or(F.col("title") & (F.col("at") <= 1) & (F.col("way") == 1)).alias("titled"),
    )
    choice = F.struct((~F.bool_or("titled")).alias("untitled"), (-F.max("covered")).alias("n"), (-F.max("cosine")).alias("c"), "license")
    own = for_each.groupBy(*keys, "license").agg(choice.alias("b"), F.max("n_words").alias("n_words")).groupBy(*keys).agg(F.min("b").alias("b"), F.max("n_words").alias("n_words"))
    is_file = ~F.col("b.untitled") | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)) | (-F.col("b.n") >= file_share * F.col("n_words"))
    own = materialize(own.select(*keys, F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), is_file.alias("is_file")), "license-own")

    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    votes = own.where("is_file and path is not null").groupBy(parent.alias("dir"), "license").count()
    held = votes.groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("n"), "license")).alias("v")).select("dir", F.col("v.license").alias("dir_license"))
    parts = F.split(parent, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    # Directories, not documents, look for their ancestors.
    dirs = rows.where("path is not null").select(parent.alias("own_dir"), F.explode(ancestors).alias("a")).distinct().select("own_dir", "a.depth", "a.dir")
    nearest = dirs.join(held, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("near"))
    nearest = nearest.select("own_dir", F.col("near.dir").alias("from_dir"), F.col("near.dir_license").alias("inherited"))

    narrow = rows.select(*keys, parent.alias("own_dir"))
    same = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys))
    joined = narrow.alias("r").join(own.alias("o"), same, "left").select("r.*", "o.license", "o.cosine", "o.is_file").join(nearest, "own_dir", "left")
    has, heir = F.col("license").isNotNull(), F.col("inherited").isNotNull()
    kind = F.when(has & F.col("is_file"), "file").when(has, "header").when(heir, "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("license", "inherited").alias("license"), "cosine", kind.alias("kind"), F.when(~has, F.col("from_dir")).alias("from_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/doc_id; null parts are written '_'."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
