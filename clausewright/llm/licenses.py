"""License scans by diagonal voting.

Every run of three, two and one words of every text is joined with the runs of the license templates, each of
three words, or of all where a template has fewer. Matches that lie on one diagonal (place in the text minus
place in the template) belong to one copy; diagonals a few words apart, as insertions and deletions leave
them, are merged, up to a drift that the template's length bounds. What gets enough votes is verified on its
words: a span counts when enough of the template's words stand in it in their order, and few others between
them.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. The base is a phrase's words
standing consecutively; templates of notices, statements and names add labels of their own. A score says how
sure it is that a license applies: a name alone says little, a statement more, a notice the more the more of its
words are verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Tables, texts
from .words import ALPHANUMERIC, column, find, grams, pieces, starts

GRAM = 3
#: Words by which neighbouring diagonals of one copy may differ; the share of a template's runs that must vote for a span;
#: the share of its words that must stand there in order, which must also be that share of the span's words. Of templates
#: of fewer words than SHORT, and of the base, all words must stand there alone.
DRIFT, VOTED, ENOUGH, SHORT = 6, 0.4, 0.6, 12

#: The score of a license that is merely named, of one that is stated to apply, and the verified words by which a notice's
#: score comes half the way from there to 1.
NAMED, STATED, HALF_WAY = 0.3, 0.7, 10

#: The phrases of the base with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Phrases of the base that state a license; the others name one.
STATING = {"under the mit license"}

#: Short forms by which licenses are named.
SHORT_FORMS = [
    ("mit", "MIT license"), ("apache-2", "Apache License 2.0"), ("apache-2", "Apache 2 license"), ("apache-2", "Apache Software License 2"),
    ("bsd", "BSD 2-Clause"), ("bsd", "BSD 3-Clause"), ("bsd", "BSD license"), ("isc", "ISC license"), ("zlib", "zlib license"),
    ("gpl", "GNU General Public License"), ("lgpl", "GNU Lesser General Public License"), ("agpl", "GNU Affero General Public License"), ("mpl-2", "Mozilla Public License"),
    ("cc0", "CC0 1.0"), ("cc-by", "CC BY 3.0"), ("cc-by", "CC BY 4.0"), ("cc-by-sa", "CC BY-SA"), ("cc-by-nd", "CC BY-ND"), ("cc-by", "Creative Commons Attribution License"),
    ("gpl", "GPLv2"), ("gpl", "GPLv3"), ("gpl", "GPL v2"), ("gpl", "GPL v3"), ("lgpl", "LGPLv2"), ("lgpl", "LGPLv3"), ("agpl", "AGPLv3"), ("mpl-2", "MPL v2"), ("mpl-2", "MPL 2.0"),
    ("cc-by", "Creative Commons Attribution 4.0"), ("cc-by-sa", "Creative Commons Attribution-ShareAlike"), ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
]

#: Names that a statement may give a license: its identifier, or what people write.
GIVEN = {
    "mit": ["MIT"], "apache-2": ["Apache-2", "Apache-2.0", "Apache License 2", "Apache License 2.0", "Apache v2"], "bsd": ["BSD", "2-Clause BSD", "3-Clause BSD"], "isc": ["ISC"], "zlib": ["Zlib"], "unlicense": ["Unlicense"],
    "gpl": ["GPL", "GNU GPL", "GPLv2", "GPLv3"], "lgpl": ["LGPL", "GNU LGPL", "LGPLv2", "LGPLv3"], "agpl": ["AGPL", "GNU AGPL", "AGPLv3"], "mpl-2": ["MPL-2", "MPL-2.0", "MPLv2"], "cc0": ["CC0", "CC0 1.0"],
    "cc-by": ["CC-BY-3", "CC-BY-4", "CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA"], "cc-by-nc": ["CC-BY-NC"], "cc-by-nd": ["CC-BY-ND"],
}

#: Statements that a license applies. The words beside a name are few, so that no run of three words is in many of them.
STATEMENTS = ["SPDX-License-Identifier: {}", "License: {}", "license is {}", "{} licensed", "licensed under {}", "released under {}", "distributed under {}", "under the {} license", "project uses {}"]

_GNU = (
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, "
    "or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this {thing}."
)
_NO_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices of common licenses by label: whole, and the passages that are quoted alone.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
     "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
     "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", _GNU.format(thing="program", kind="General Public License", version="3")),
    ("lgpl", _GNU.format(thing="library", kind="Lesser General Public License", version="2.1")),
    ("agpl", _GNU.format(thing="program", kind="Affero General Public License", version="3")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
     "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
     "the following disclaimer in the documentation and/or other materials provided with the distribution. " + _NO_WARRANTY),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
     "appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
     "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
     "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())  # of bytes: A-Z alone


@cache
def every_template() -> list[tuple[str, list[bytes], bool, float]]:
    """Label, words, whether all words must stand alone, and the least score, of phrases of the base first, then of names, statements and notices."""
    stated = [(label, form.format(name)) for label, names in GIVEN.items() for name in names for form in STATEMENTS]
    base = [(label, text, STATED if text in STATING else NAMED) for text, label in PHRASES.items()]
    forms = [(label, text, NAMED) for label, text in SHORT_FORMS] + [(label, text, STATED) for label, text in stated + NOTICES]
    every = [(label, words_of(text), least) for label, text, least in base + forms]
    return [(label, words, k < len(PHRASES) or len(words) < SHORT, least) for k, (label, words, least) in enumerate(every)]


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text and each number of words in a run, 1 to GRAM, the hashes of its runs in order."""
    for batch in batches:
        data, bounds = column(batch)
        for a, z, own, cuts in pieces(data, bounds):
            words = find(own, cuts, ALPHANUMERIC, fold=True)
            for length in range(1, GRAM + 1):
                at = starts(words, length)
                runs = grams(words.hash, length)[at] if len(at) else np.zeros(0, np.uint64)
                n = np.maximum(words.counts - length + 1, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(runs.view(np.int64)))
                alike = {c: batch.column(c).slice(a, z - a) for c in ("row", "doc_id")}
                yield pa.record_batch({**alike, "n_words": pa.array(words.counts, pa.int64()), "length": pa.array(np.full(z - a, length, np.int32)), "runs": lists})


#: Stands for a text as a whole: every text has one such run, so that one pass also tells its number of words.
WHOLE = 0x5EED


def run_length(words: list[bytes]) -> int:
    """Words in a run of a template: GRAM, or all where there are fewer."""
    return min(GRAM, len(words))


def _runs(words: list[bytes]) -> list[int]:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return grams(find(data, np.array([0, len(data)]), ALPHANUMERIC, fold=True).hash, run_length(words)).view(np.int64).tolist()


def matches(rolled: DataFrame) -> DataFrame:
    """row, doc_id, n_words, template, strict, size (runs of the template), place (in the template), word (where the run starts in the text).

    The join of all runs of all texts with the templates, whose number is fixed; template is -1 once a text.
    """
    known = []
    for t, (_, words, strict, _) in enumerate(every_template()):
        runs = _runs(words)
        known += [(run_length(words), t, strict, len(runs), at, run) for at, run in enumerate(runs)]
    known = rolled.sparkSession.createDataFrame([*known, (1, -1, True, 1, 0, WHOLE)], "length int, template int, strict boolean, size int, place int, run long")
    whole = F.when(F.col("length") == 1, F.lit(WHOLE).cast("long"))  # else null, which meets nothing
    every = rolled.select("row", "doc_id", "n_words", "length", F.posexplode(F.array_append("runs", whole)).alias("word", "run"))
    return every.join(F.broadcast(known), ["run", "length"]).drop("run", "length")


def voted(found: DataFrame) -> DataFrame:
    """row, template, first, last (where its first and last run start): one row a place that enough of a template's runs vote for.

    Diagonals vote first, so a text that repeats a notice has a row a copy here, not a row a match. Diagonals of
    one template are neighbours while each is at most DRIFT words from the one before, and all are no farther
    from the first than a span of ENOUGH density can be longer than the template.
    """
    diagonals = found.withColumn("diagonal", F.col("word") - F.col("place"))
    votes = diagonals.groupBy("row", "template", "strict", "size", "diagonal").agg(F.collect_set("place").alias("places"), F.min("word").alias("first"), F.max("word").alias("last"))
    # phrases and short forms stand word by word, so their diagonal is alone; those of notices merge with neighbours
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.col("strict") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > DRIFT, F.lit(True))
    chained = votes.withColumn("chain", F.sum(new.cast("int")).over(by_diagonal))
    low = F.min("diagonal").over(Window.partitionBy("row", "template", "chain"))
    reach = F.ceil(F.col("size") * (1 / ENOUGH - 1)) + DRIFT
    copies = chained.withColumn("copy", F.floor((F.col("diagonal") - low) / reach)).groupBy("row", "template", "strict", "size", "chain", "copy")
    copies = copies.agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return copies.where(F.col("n") >= F.when(F.col("strict"), F.col("size")).otherwise(F.col("size") * VOTED)).select("row", "template", "first", "last")


def in_order(template: list[bytes], span: list[bytes]) -> int:
    """How many of a template's words stand in a span in their order, at most (the longest common subsequence)."""
    own = np.array(span, object)
    best = np.zeros(len(span) + 1, np.int64)
    for word in template:
        with_it = np.where(own == word, best[:-1] + 1, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], with_it))
    return int(best[-1])


def certainty(template: list[bytes], span: list[bytes], strict: bool, least: float) -> float:
    """The score of a template at a span: from `least` towards 1 with the words verified, if the template may be a notice, times the share of its words that they are; 0 where that isn't enough."""
    if strict:
        return _raised(least, len(template)) if template == span else 0.0
    n = in_order(template, span)
    return _raised(least, n) * n / len(template) if n >= ENOUGH * len(template) and n >= ENOUGH * len(span) else 0.0


def _raised(least: float, verified: int) -> float:
    return least if verified < SHORT else 1 - (1 - least) * 0.5 ** (verified / HALF_WAY)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans that were voted for; returns those that their words confirm."""
    known = every_template()
    for batch in batches:
        data, bounds = column(batch)
        out: list[tuple] = []
        for row, spans, a, z in zip(batch.column("row").to_pylist(), batch.column("spans").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = data[a:z]
            words, raw = find(own, np.array([0, z - a]), ALPHANUMERIC), own.tobytes().lower()
            for span in spans:
                label, template, strict, least = known[span["template"]]
                at = range(span["first"], span["last"] + run_length(template))
                sure = certainty(template, [raw[words.start[k] : words.end[k]] for k in at], strict, least)
                if sure:
                    out.append((row, label, span["template"] < len(PHRASES), span["first"], sure))
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.float64())
        yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["row", "label", "base", "first_word", "score"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of all phrases; first_word and last_word are their smallest and largest start,
    null where there is none; labels are distinct, sorted and comma-joined, empty where there is none; score
    is the best of a template that was verified (NAMED for a name, STATED for a statement, more for a notice of
    many words, times the share of it that stands there), 0 without one. Null and empty texts have no words;
    repeated rows are scanned each; an empty table gives no rows.
    """
    tables = Tables(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    rolled = rows.mapInArrow(_rolled, "row long, doc_id long, n_words long, length int, runs array<long>")
    every = tables.cut(matches(rolled))
    sized = every.where("template < 0").select("row", "doc_id", "n_words")
    found = every.where("template >= 0").drop("doc_id", "n_words").distinct()  # equal rows have equal matches
    spans = voted(found).groupBy("row").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    # written, so that Spark knows whether it is small enough to send to the texts; if not, texts go to their spans
    spans = tables.cut(spans)
    confirmed = rows.join(spans, "row").select("row", "text", "spans").mapInArrow(_verified, "row long, label string, base boolean, first_word long, score double")
    base = F.col("base")
    by_row = confirmed.distinct().groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    none = F.lit("")
    return sized.join(by_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


#: doc_id, n_words, n_base, first_word, last_word, base_labels by DuckDB: all places where a phrase's words stand consecutively.
PHRASES_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {documents}),
phrases(phrase, label) as (values """ + ", ".join(f"({words_of(p)!r}, '{label}')".replace("b'", "'") for p, label in PHRASES.items()) + r"""),
places as (select doc_id, w, unnest(range(len(w))) as k from words),
hits as (select doc_id, k, label from places join phrases on w[k + 1] = phrase[1] and w[k + 1 : k + len(phrase)] = phrase),
found as (select doc_id, count(*) as n, min(k) as first_word, max(k) as last_word, array_to_string(list_sort(list_distinct(list(label))), ',') as labels from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0) as n_base, coalesce(first_word, -1) as first_word, coalesce(last_word, -1) as last_word, coalesce(labels, '') as base_labels from words left join found using (doc_id)"""
