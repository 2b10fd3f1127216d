"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

A document is compared as a whole, by line, and by runs of consecutive paragraphs, so that a licence of
several paragraphs is found inside a longer text. A run has RUN_WORDS words at most (twice the pairs that any
template admits, as pairs may repeat), and its first and last paragraph hold a word pair of some template; of a paragraph
that is repeated in a row two copies count. A place that too few pairs of any one template follow begins no run: that
is seen before the words of any run are taken. Text is
lower-cased, everything but a-z and 0-9 separates words, and a unit is its set of word pairs. A Dice
coefficient of at least t needs a set size between t/(2-t) and (2-t)/t of the template's; templates that
do not admit a unit's size are left out before pairs are compared. Of the templates over the threshold
those of the highest coefficient count, so that versions and variants of one wording are told apart.

A document without any of the words that ``needed`` gives can't reach the threshold (the pairs of a template that do
without them are too few), and is left out by one pattern before any pairs are made. DataFrame functions
only; nothing but matched rows is shuffled.

Defined results: null text has no units; units without a word pair match nothing; of a document's
units the best one counts for each licence, and equal doc_ids are one document; an empty table
gives no rows. Other columns can have any name.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence texts and notices, each without its copyright line.
TEMPLATES = [
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
_BSD_2 = next(text for name, kind, text in TEMPLATES if (name, kind) == ("BSD-2-Clause", "text"))
_GPL_3 = next(text for name, kind, text in TEMPLATES if (name, kind) == ("GPL-3.0", "text"))
# What further public licences add to those above, and more of them.
_BSD_3_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
TEMPLATES += [
    ("BSD-3-Clause", "text", _BSD_2.replace("THIS SOFTWARE", _BSD_3_CLAUSE + "THIS SOFTWARE", 1)),
    ("LGPL-3.0", "text", _GPL_3.replace("This program", "This library").replace("General Public", "Lesser General Public")),
    ("AGPL-3.0", "text", _GPL_3.replace("General Public", "Affero General Public")),
    ("GPL-2.0", "text", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("Zlib", "text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "text", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
#: Least Dice coefficient of a match, in percent, and most words in a run of paragraphs.
LEAST = 80


def bigrams_of(text: str) -> list[str]:
    """A template's word pairs: the same rule as for units, for the few fixed texts."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, least: int = LEAST) -> tuple[int, int, int]:
    """The least and most pairs of a unit that can match a template of n pairs, and the least pairs that they share."""
    low, high = -(-n * least // (200 - least)), n * (200 - least) // least
    return low, high, -(-least * (n + low) // 200)


#: Words of the longest run of paragraphs.
RUN_WORDS = 2 * max(bounds(len(bigrams_of(text)))[1] for _, _, text in TEMPLATES)


def needed(least: int = LEAST) -> list[str]:
    """Words of which every unit over the threshold has one: pairs without them are too few in each template.

    Chosen one by one, the word that most templates still ask for first; common words are not taken.
    """
    common = set("the of to and in a is this for by or any be not with you may from that on as an are it all under if at no other 0 1 2 3 4".split())
    open_ = [[set(pair.split()) for pair in bigrams_of(text)] for _, _, text in TEMPLATES]
    least_shared, out = [bounds(len(pairs), least)[2] for pairs in open_], []
    while any(len(pairs) >= n for pairs, n in zip(open_, least_shared, strict=True)):
        left = [pairs for pairs, n in zip(open_, least_shared, strict=True) if len(pairs) >= n]
        words = sorted({w for pairs in left for pair in pairs for w in pair} - common)
        best = max(words, key=lambda w: sum(sum(w in pair for pair in pairs) / len(pairs) for pairs in left))
        out.append(best)
        open_ = [[pair for pair in pairs if best not in pair] for pairs in open_]
    return sorted(out)


def templates(least: int = LEAST) -> Column:
    """The templates as a constant array of structs."""
    rows = []
    for license_id, _, text in TEMPLATES:
        pairs = bigrams_of(text)
        low, high, shared = bounds(len(pairs), least)
        rows.append({"license_id": license_id, "pairs": pairs, "low": low, "high": high, "shared": shared})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<license_id:string,pairs:array<string>,low:int,high:int,shared:int>>")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), "")


def _pairs(w: Column) -> Column:
    made = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) > 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once for each row, however often it is used; a plain projection would be copied into its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def units(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and the distinct word pairs of the whole text, of each line and of each run of paragraphs, where a match is possible at all."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("doc_id", text.alias("t")).where(F.col("t").rlike(rf"(?<![a-z0-9])(?:{'|'.join(needed(least))})(?![a-z0-9])"))
    known = F.from_json(F.lit(json.dumps(sorted({pair for _, _, text in TEMPLATES for pair in bigrams_of(text)}))), "array<string>")
    rows = _settled(_settled(rows, "own", _words(F.col("t"))), "hits", F.array_intersect(_pairs(F.col("own")), known))
    rows = rows.where(F.exists(templates(least), lambda t: F.size(F.array_intersect(F.col("hits"), t["pairs"])) >= t["shared"])).drop("hits")
    rows = _settled(rows, "pw", F.filter(F.transform(F.split("t", r"\n\s*\n"), _words), lambda w: F.size(w) > 0))
    again = lambda w, i: (i > 1) & (w == F.get("pw", i - 1)) & (w == F.get("pw", i - 2))
    rows = _settled(rows, "p", F.transform(F.filter("pw", lambda w, i: ~again(w, i)), lambda w: F.struct(w.alias("w"), F.arrays_overlap(_pairs(w), known).alias("end")))).drop("pw")

    def ahead(i):
        return F.slice(F.flatten(F.transform(F.slice("p", i, F.lit(RUN_WORDS)), lambda q: F.slice(q["w"], 1, F.lit(RUN_WORDS)))), 1, F.lit(RUN_WORDS))

    def possible(i):
        hits = F.array(F.array_intersect(_pairs(ahead(i)), known))  # in an array, as what a lambda is given is worked out once
        return F.exists(hits, lambda h: (F.size(h) >= fewest) & F.exists(templates(least), lambda t: F.size(F.array_intersect(h, t["pairs"])) >= t["shared"]))

    def ends(p, i):
        """Numbers of words of the runs from paragraph i."""
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

        def more(x, q):
            n = x["n"] + F.size(q["w"])
            return F.struct(n.alias("n"), F.when(q["end"] & (n > fewest) & (n <= RUN_WORDS), F.array_append(x["at"], n)).otherwise(x["at"]).alias("at"))

        return F.aggregate(F.slice(p, i, F.lit(RUN_WORDS)), start, more, lambda x: x["at"])

    fewest = min(bounds(len(bigrams_of(text)), least)[2] for _, _, text in TEMPLATES)
    places = F.when(F.size("p") > 0, F.sequence(F.lit(1), F.size("p"))).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: F.col("p")[i - 1]["end"] & possible(i))
    runs = F.transform(begins, lambda i: F.struct(ahead(i).alias("w"), ends(F.col("p"), i).alias("at")))
    whole = lambda w: F.struct(w.alias("w"), F.array(F.size(w)).alias("at"))
    lines = F.transform(F.transform(F.array_distinct(F.split("t", "\n")), _words), whole)
    rows = rows.select("doc_id", F.inline(F.concat(runs, F.array(whole(F.col("own"))), lines)))
    rows = rows.select("doc_id", "w", F.explode("at").alias("n")).select("doc_id", F.slice("w", 1, F.col("n")).alias("w"))
    return _settled(rows.where(F.size("w") > 1), "pairs", _pairs(F.col("w"))).drop("w")


def scan(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, license_id, dice_permille (best unit, rounded down) and n_units matched."""
    n = F.size("pairs")
    admitted = F.filter(templates(least), lambda t: (t["low"] <= n) & (n <= t["high"]))
    dice = F.transform(admitted, lambda t: F.struct(F.floor(2000 * F.size(F.array_intersect(F.col("pairs"), t["pairs"])) / (n + F.size(t["pairs"]))).cast("long").alias("d"), t["license_id"].alias("license_id")))
    met = _settled(_settled(units(docs, least), "m", dice), "best", F.array_max(F.transform("m", lambda x: x["d"]))).where(F.col("best") >= 10 * least)
    met = met.select("doc_id", F.xxhash64(F.array_sort("pairs")).alias("u"), F.explode(F.array_distinct(F.filter("m", lambda x: x["d"] == F.col("best")))).alias("x"))
    return met.groupBy("doc_id", F.col("x.license_id").alias("license_id")).agg(F.max("x.d").alias("dice_permille"), F.count_distinct("u").alias("n_units"))
