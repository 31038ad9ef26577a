"""Licence texts and notices in documents, by the Dice coefficient over word bigrams.

Native: only DataFrame functions.  Texts and templates are normalised to lower-case ASCII words.  A
window of a text is as many words as a template has, wherever it begins and however its lines are
broken; the distinct bigrams of a window are compared with those of the template, and the
coefficient 2 * common / (window + template) must reach LEAST.

Two sets can only reach it if they share two thirds of the template's bigrams.  So a text is a
candidate for a template only if it holds that many of them anywhere, which is counted by an
equi-join with the templates' bigrams (a fixed table, broadcast); and before any words are listed,
a text must hold one of the anchors, words that stand in more than a third of each template's
bigrams.  Neither step can lose a match.  Windows then begin at each bigram that a candidate shares
with its template.  Of windows of a template that overlap the best one counts (the first of equal
ones), and of templates that match from the same word on the best ones.

Edge cases: null and empty texts and texts of one word match nothing; a window at the end of a text
may be shorter than the template; repeated rows give repeated matches; rows with a null doc_id are
compared like any other; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table

LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-z0-9]+"
#: Words this long are preferred as anchors.
LONG = 6
#: Length of a window in the order in which overlapping ones are compared.
SPAN = 1_000_000
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THREE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %s for more details."
)
_GNU_TITLE = "GNU %s Version %s, %s Copyright (C) %s Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"


def _gnu_notice(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


#: Name and text of each template; fixed texts of public licences and usual notices.
TEMPLATES = {
    "mit": f"{_GRANT} {_MIT_REST}",
    "mit-grant": _GRANT,
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-2.0-notice": _gnu_notice(_GPL, "2"),
    "gpl-3.0-notice": _gnu_notice(_GPL, "3"),
    "lgpl-2.1-notice": _gnu_notice(_LGPL, "2.1"),
    "lgpl-3.0-notice": _gnu_notice(_LGPL, "3"),
    "agpl-3.0-notice": _gnu_notice(_AGPL, "3"),
    "gpl-warranty": _GNU_WARRANTY % _GPL,
    "lgpl-warranty": _GNU_WARRANTY % _LGPL,
    "agpl-warranty": _GNU_WARRANTY % _AGPL,
    "gpl-2.0-licensed": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-2.1-licensed": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-licensed": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-licensed": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-2.0-title": _GNU_TITLE % (_GPL, "2", "June 1991", "1989, 1991"),
    "gpl-3.0-title": _GNU_TITLE % (_GPL, "3", "29 June 2007", "2007"),
    "lgpl-2.1-title": _GNU_TITLE % (_LGPL, "2.1", "February 1999", "1991, 1999"),
    "lgpl-3.0-title": _GNU_TITLE % (_LGPL, "3", "29 June 2007", "2007"),
    "agpl-3.0-title": _GNU_TITLE % (_AGPL, "3", "19 November 2007", "2007"),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "epl-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "bsd-conditions": _BSD_HEAD,
    "bsd-2-clause": f"{_BSD_HEAD} {_BSD_TWO} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_HEAD} {_BSD_TWO} {_BSD_THREE} {_BSD_END}",
    "bsd-licensed": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}
#: The six licences of Creative Commons: name, words of the notice, letters.
CREATIVE_COMMONS = (
    ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
    ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
)
for _letters, _name in CREATIVE_COMMONS:
    TEMPLATES[f"cc-{_letters}-4.0-notice"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
    TEMPLATES[f"cc-{_letters}-4.0-licensed"] = f"Licensed under CC {_letters.upper()} 4.0."


def read_templates(folder: str) -> dict[str, str]:
    """More templates: the whole texts of the files in a folder, by file name."""
    out = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            out[name] = f.read()
    return out


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def bigrams_of(text: str) -> list[str]:
    """Distinct bigrams of a template, normalised as the texts are."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every match has one: they stand in more than a third of each template's bigrams.

    A match lacks a third of the bigrams at most.  The word that covers most of what is still to be
    covered comes next, long words before short ones.
    """
    open_ = {name: set(bigrams_of(t)) for name, t in templates.items()}
    need = {name: len(b) // 3 + 1 for name, b in open_.items() if b}
    chosen: list[str] = []
    while need:
        gain: dict[str, int] = {}
        for name in need:
            for word in {w for b in open_[name] for w in b.split()}:
                gain[word] = gain.get(word, 0) + min(need[name], sum(word in b.split() for b in open_[name]))
        best = min(gain, key=lambda w: (len(w) < LONG, -gain[w], w))
        chosen.append(best)
        for name in list(need):
            hit = {b for b in open_[name] if best in b.split()}
            open_[name] -= hit
            need[name] -= len(hit)
            if need[name] <= 0:
                del need[name]
    return sorted(chosen)


def anchor_pattern(templates: dict[str, str]) -> str:
    return f"(?i)(?<![a-z0-9])(?:{'|'.join(anchors(templates))})(?![a-z0-9])"


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, m (its bigrams), size (its words), bigrams and bigram, one row for each bigram."""
    rows = []
    for name, text in templates.items():
        b = bigrams_of(text)
        rows += [(name, len(b), len(words_of(text)), b, x) for x in b]
    return spark.createDataFrame(rows, "template string, m int, size int, bigrams array<string>, bigram string")


def _bigrams(words: Column) -> Column:
    # of words a, b, c: (a, b), (b, c)
    second = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(F.slice(words, 1, F.size(second)), second, lambda a, b: F.concat_ws(" ", a, b))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """key, template, word (first word of the window, from 1), common, n_window, n_template and dice of every match."""
    t = F.col(text).cast("string")
    some = docs.select(F.col(key).alias("k"), t.alias("t")).where(F.col("t").rlike(anchor_pattern(templates)))
    listed = some.select("k", F.regexp_extract_all(F.translate("t", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w"))
    listed = save(listed.withColumn("r", F.monotonically_increasing_id()), "licence-words")
    known = template_table(docs.sparkSession, templates)
    each = listed.select("r", F.posexplode(_bigrams(F.col("w"))).alias("pos", "b"))
    hits = each.join(F.broadcast(known.select("template", "m", "size", "bigram")), F.col("b") == F.col("bigram")).select("r", "template", "m", "size", F.col("pos") + 1, "b").toDF("r", "template", "m", "size", "pos", "b")
    hits = save(hits, "licence-hits")
    enough = hits.groupBy("r", "template").agg(F.count_distinct("b").alias("held"), F.first("m").alias("m")).where("3 * held >= 2 * m").select(F.col("r").alias("er"), F.col("template").alias("et"))
    starts = hits.join(enough, (F.col("r") == F.col("er")) & (F.col("template") == F.col("et")), "left_semi").select(F.col("r").alias("hr"), "template", "m", "size", "pos")
    whole = F.broadcast(known.select(F.col("template").alias("wt"), "bigrams").distinct())
    window = starts.join(listed, F.col("hr") == F.col("r")).join(whole, F.col("template") == F.col("wt")).withColumn("b", F.array_distinct(_bigrams(F.slice("w", F.col("pos"), F.col("size")))))
    found = window.select("r", "k", "template", "m", "pos", F.expr(f"pos * {SPAN}l div size").alias("place"), F.size("b").alias("n"), F.size(F.array_intersect("b", "bigrams")).alias("common"))
    found = found.withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("m"))).where(F.col("dice") >= LEAST)
    order = Window.partitionBy("r", "template").orderBy("place")
    before, after = F.max("dice").over(order.rangeBetween(1 - SPAN, -1)), F.max("dice").over(order.rangeBetween(1, SPAN - 1))
    best = found.withColumn("before", before).withColumn("after", after).where("(before is null or dice > before) and (after is null or dice >= after)")
    best = best.withColumn("most", F.max("dice").over(Window.partitionBy("r", "pos"))).where("dice = most")
    return best.select(F.col("k").alias(key), "template", F.col("pos").cast("long").alias("word"), F.col("common").cast("long").alias("common"), F.col("n").cast("long").alias("n_window"), F.col("m").cast("long").alias("n_template"), F.round("dice", 6).alias("dice"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ",\n".join(f"('{name}', {len(bigrams_of(text))}, {len(words_of(text))}, '{x}')" for name, text in TEMPLATES.items() for x in bigrams_of(text))
    return f"""
with templates(template, m, size, bigram) as (values {rows}),
whole as (select template, list(bigram) as bigrams from templates group by 1),
words as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
grams as (select r, unnest(range(1, len(w))) as pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from words where len(w) > 1),
hits as (select r, template, m, size, pos, b from grams join templates on b = bigram),
enough as (select r, template from hits group by r, template, m having 3 * count(distinct b) >= 2 * m),
cut as (
  select r, doc_id, template, m, size, pos, w[pos:pos + size - 1] as v from hits join enough using (r, template) join words using (r)),
pairs as (select *, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) as b from cut),
found as (
  select r, doc_id, template, m, pos, pos * {SPAN} // size as place, len(b) as n, len(list_intersect(b, bigrams)) as common,
         2.0::double * len(list_intersect(b, bigrams)) / (len(b) + m) as dice
  from pairs join whole using (template)),
near as (
  select *, max(dice) over (partition by r, template order by place range between {SPAN - 1} preceding and 1 preceding) as before,
         max(dice) over (partition by r, template order by place range between 1 following and {SPAN - 1} following) as after
  from found where dice >= {LEAST}),
best as (
  select *, max(dice) over (partition by r, pos) as most from near where (before is null or dice > before) and (after is null or dice >= after))
select doc_id, template, cast(pos as bigint) as word, cast(common as bigint) as common, cast(n as bigint) as n_window, cast(m as bigint) as n_template,
       round(dice, 6) as dice
from best where dice = most
"""


OP6_SQL = _sql()
