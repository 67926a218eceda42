"""License scan by diagonal voting, on DataFrame functions.

The scanner knows templates: the phrases of the base contract, short license notices, and the texts of licenses. Every
rolling word k-gram of a document (k is 2 for phrases and notices, LONG for texts) is hashed and probed against a
small membership table; those that pass are joined with the template positions on their words. A match at document
word p and template word q votes for the diagonal p - q. Votes are gathered per document, template and diagonal;
diagonals at most MERGE apart (words put in or left out) are merged around each diagonal that has the most votes among
them; and the span is verified: a phrase must have every k-gram on one diagonal (then its words stand consecutively); of
a notice or text, at least `min_share` of the words must be covered by matched k-grams, each template word counted once
however often it is matched, and the k-grams of its key words, which tell it from its like, must all be there.

Null text has no words. Repeated rows are scanned separately. Of equal votes the first diagonal stands for its
neighbours; every verified span counts. An empty table gives an empty result; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM_WORD, ascii_lower, whole, words
from tessera.llm.grams import probes, slots_of, window_hash, word_hashes

# Fixed values of the base contract: phrase and label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Notices in common use, SPDX-like labels, and the words that tell them from others.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license"),
    ("you may not use this file except in compliance with the license", "apache-2.0", "in compliance with"),
    ("released under the mit license", "mit", "mit license"),
    ("licensed under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "free of charge"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "binary forms"),
    ("licensed under the gnu general public license", "gpl", "general public license"),
    ("licensed under the gnu general public license version 3", "gpl-3.0", "license version 3"),
    ("licensed under the gnu lesser general public license", "lgpl", "lesser general public"),
    ("subject to the terms of the mozilla public license", "mpl", "mozilla public license"),
    ("licensed under a creative commons attribution", "cc-by", "creative commons attribution"),
    ("licensed under creative commons attribution sharealike", "cc-by-sa", "attribution sharealike"),
    ("dedicated to the public domain", "public-domain", "public domain"),
]
# Texts of licenses and of the notices that go with them.
TEXTS = [
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""", "mit", "to deal in the software without restriction",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""", "bsd", "redistribution and use in source and binary forms",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS.""", "isc", "with or without fee is hereby granted",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: The origin of this software must not be misrepresented; you must not
        claim that you wrote the original software.""", "zlib", "to alter it and redistribute it freely",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""", "apache-2.0", "the apache license version",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""", "gpl", "of the gnu general public license as published",
    ),
    (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version.""", "lgpl", "gnu lesser general public license",
    ),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "mpl", "the mozilla public license",
    ),
    (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""", "unlicense", "free and unencumbered software released",
    ),
]
SHORT, LONG = 2, 4
#: Diagonals at most this far apart are one span.
MERGE = 2
MIN_SHARE = 0.8


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def known() -> list[tuple[int, bool, str, int, list[str], list[int]]]:
    """(template, phrase, label, k, words, places of the key k-grams) of all templates."""
    out = []
    for line, label in PHRASES:
        out.append((True, label, SHORT, _words(line), ""))
    for given, k in ((NOTICES, SHORT), (TEXTS, LONG)):
        out += [(False, label, k, _words(line), key) for line, label, key in given]
    rows = []
    for n, (phrase, label, k, own, key) in enumerate(out):
        sought, keys = _words(key), []
        for p in range(len(own) - len(sought) + 1) if sought else ():
            if own[p : p + len(sought)] == sought:
                keys = list(range(p, p + len(sought) - k + 1))
                break
        rows.append((n, phrase, label, k, own, keys))
    return rows


def templates(spark: SparkSession) -> DataFrame:
    """(template, phrase, label, k, size, keys, q, gram, h): the k-grams of the templates; its size is that of the lists above."""
    lines = spark.createDataFrame(known(), "template int, phrase boolean, label string, k int, w array<string>, keys array<int>")
    at = lines.select("template", "phrase", "label", "k", "w", F.size("w").alias("size"), "keys", F.explode(F.expr("sequence(0, size(w) - k)")).alias("q"))
    hashed = F.when(F.col("k") == SHORT, window_hash(word_hashes(F.col("w")), F.col("q"), SHORT)).otherwise(window_hash(word_hashes(F.col("w")), F.col("q"), LONG))
    return at.select("template", "phrase", "label", "k", "size", "keys", "q", F.expr("array_join(slice(w, q + 1, k), ' ')").alias("gram"), hashed.alias("h"))


def spans(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans: array of (phrase, label, first, last, share), verified."""
    own = templates(docs.sparkSession)
    split = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words(ascii_lower(whole()), ALNUM_WORD).alias("_w"))
    hashed = split.withColumn("_h", word_hashes(F.col("_w"))).withColumn("n_words", F.size("_w").cast("long"))

    def passing(k: int) -> Column:
        at = probes(F.col("_h"), F.col("n_words"), k, [(k, slots_of(own.where(F.col("k") == k), "h", 256))])
        return F.transform(at, lambda p: F.struct(p.alias("p"), F.lit(k).alias("k"), F.array_join(F.slice("_w", p + 1, k), " ").alias("gram")))

    grams = F.concat(passing(SHORT), passing(LONG))
    rows = hashed.select("_row", "doc_id", "n_words", F.explode_outer(grams).alias("g")).select("_row", "doc_id", "n_words", "g.p", "g.k", "g.gram")
    of = ["_row", "doc_id", "n_words", "template", "phrase", "label", "k", "size"]
    matched = rows.join(F.broadcast(own.drop("h")), ["k", "gram"], "left")
    votes = matched.groupBy(*of, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"), F.first("keys").alias("keys"))
    votes = votes.withColumn("votes", F.size("qs"))
    around = Window.partitionBy("_row", "template").orderBy("diagonal").rangeBetween(-MERGE, MERGE)
    # A diagonal stands for those around it if none of them has more votes, and none before it as many.
    best = F.max(F.struct("votes", (-F.col("diagonal")).alias("d"))).over(around)
    merged = votes.select(
        "*", F.array_distinct(F.flatten(F.collect_list("qs").over(around))).alias("all"), best.alias("best"),
    )
    k, gap = F.col("k"), F.array_except("keys", "all")
    at = lambda qs: F.array_distinct(F.flatten(F.transform(qs, lambda q: F.sequence(q, q + k - 1))))
    share = F.size(at(F.col("all"))) / F.col("size")
    whole_phrase = F.col("votes") == F.col("size") - k + 1
    notice = (F.col("best.votes") == F.col("votes")) & (F.col("best.d") == -F.col("diagonal")) & (share >= min_share) & (F.size(gap) == 0)
    qs = F.when(F.col("phrase"), F.col("qs")).otherwise(F.col("all"))
    span = F.struct(
        "phrase", "label", (F.col("diagonal") + F.array_min(qs)).cast("long").alias("first"),
        (F.col("diagonal") + F.array_max(qs) + k - 1).cast("long").alias("last"), F.when(F.col("phrase"), 1.0).otherwise(share).alias("share"),
    )
    kept = F.when(F.when(F.col("phrase"), whole_phrase).otherwise(notice), span)
    found = merged.select("_row", "doc_id", "n_words", kept.alias("span"))
    return found.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("span").alias("spans")).drop("_row")


def _labels(found: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda s: s.label))), ",")


def report(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best share of a
    template that a span of the document covers; 0 without spans)."""
    found = spans(docs, min_share).withColumn("base", F.filter("spans", lambda s: s.phrase))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s.first)).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s.first)).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"), _labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0)).alias("score"),
    )
