"""License scans by diagonal voting, in DataFrame functions only.

All rolling k-grams of words are joined by hash to the positions of the same k-grams in the templates (and compared word by
word); matches are counted by (document, template, diagonal), the diagonal being position in the document less position in
the template; neighbouring diagonals of one place are merged, and a place counts if its matches cover enough of the template.
A short phrase must be matched at every position of one diagonal, so its words stand consecutively.

The templates are fixed, so their table is broadcast.  A null text has no words; repeated rows and null doc_ids are reported
each; without a match counts are 0, places null, labels empty and the score 0.  An empty table gives no rows; columns but doc_id
and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 3
#: Fixed values of the contract: (label, phrase).
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Well-known wording of public licenses, as words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Whole texts of short licenses, and notices that stand for long ones.  Fixed values: their wording.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with
this program; if not, see https://www.gnu.org/licenses/."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVER, LONG = 0.7, 10  #: share of its k-grams that a place of a template with LONG k-grams must match; shorter ones match whole
NEAR, DRIFT = 3, 0.05  #: words by which neighbouring diagonals of one place may differ: so many, or this share of the template if more


def words(text):
    return F.filter(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def template_grams() -> list[tuple]:
    """(template, label, base, grams of the template, position, its k words)."""
    out = []
    for n, (label, phrase) in enumerate(BASE + TEMPLATES + TEXTS):
        w = [x for x in re.split(SPLIT, phrase.lower()) if x]
        out += [(n, label, n < len(BASE), len(w) - K + 1, p, *w[p : p + K]) for p in range(len(w) - K + 1)]
    return out


def places(docs: DataFrame) -> DataFrame:
    """uid, label, base, first, last (words), score: where templates stand in docs (uid, text)."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(template_grams(), "template int, label string, base boolean, size int, tpos int, a string, b string, c string")
    grams = F.broadcast(grams.withColumn("h", F.xxhash64("a", "b", "c")))  # as large as the templates
    rolled = common.let(words(F.col("text")), lambda w: F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("pos"), w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c")))))
    own = docs.select("uid", F.explode(rolled).alias("g")).select("uid", F.col("g.h").alias("dh"), "g.pos", F.col("g.a").alias("da"), F.col("g.b").alias("db"), F.col("g.c").alias("dc"))
    hits = own.join(grams, (F.col("dh") == F.col("h")) & (F.col("da") == F.col("a")) & (F.col("db") == F.col("b")) & (F.col("dc") == F.col("c")))
    votes = common.spool(hits.groupBy("uid", "template", "label", "base", "size", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("met")), "votes")
    exact = votes.where("base and size(met) = size").select("uid", "label", "base", F.col("diagonal").alias("first"), (F.col("last") + K - 1).alias("last"), F.lit(1.0).alias("score"))
    order = Window.partitionBy("uid", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.greatest(F.lit(NEAR), F.col("size") * DRIFT), F.lit(True))
    merged = votes.where("not base").withColumn("place", F.sum(fresh.cast("int")).over(order)).groupBy("uid", "template", "label", "base", "size", "place").agg(F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("n"))
    close = merged.withColumn("score", F.col("n") / F.col("size")).where((F.col("score") >= COVER) & (F.col("size") >= LONG) | (F.col("n") == F.col("size"))).where(F.col("last") - F.col("first") <= 2 * (F.col("size") + K))
    return exact.unionByName(close.select("uid", "label", "base", "first", "last", "score"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (array of label, base, first, last, score) of every document."""
    rows = docs.select("doc_id", "text", F.struct("doc_id", F.xxhash64("text").alias("h")).alias("uid"))
    found = places(rows.select("uid", "text"))
    found = found.distinct().groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("first", "last", "label", "base", "score"))).alias("places"))
    return rows.select("doc_id", "uid", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(found, "uid", "left").drop("uid")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("places", lambda p: p["base"])

    def labels(found):
        return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"]))), ","), F.lit(""))

    return scan(common.spread(docs.select("doc_id", "text"))).select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
