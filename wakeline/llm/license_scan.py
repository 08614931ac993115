"""License scan: runs of words against licence templates by the Dice coefficient of their word bigrams.

Everything is DataFrame functions. A text is normalised (lower case, every run of characters that are no letters or digits
becomes one space), each word keeping its line, so that a licence is found however it is wrapped, indented or marked as a
comment. A run is as many consecutive words as a template has, at any place (the text's ends cut it); it matches if the
coefficient of the sets of word bigrams is at least t. All matching runs are found. With sets of a and b bigrams of which c
are shared, 2 c / (a + b) >= t needs c >= t / (2 - t) * b, so a run is compared only if it holds that many bigrams of its
template, counted by place; the count is never below c. Texts without any of a few words that every match must hold
(derived from the templates) are passed over before that. The templates are a fixed list that stands in the plan as a
literal. Of runs that overlap, the best one is reported, by coefficient, length, place and template: the best of all, then
the best that does not overlap it, and so on, so that a run is left out only for a better one that is reported. (What is
left of a notice beside a shorter one of its licence, both at one better place of the same template, is no second place.)

Edge cases: null, empty and wordless texts, and texts of a single word, match nothing; repeated rows are reported each;
a null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, ANCHORS = 0.85, 3
#: Places of the table of bigrams; a template's places in a text take so many bits.
SLOTS, BITS = 4096, 40
SPAN = 1 << BITS

# Public licence texts, notices and names.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{either} version {number} of the License, or (at your option) any later version."
GNU_WARRANTY = "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
TEXTS: list[tuple[str, str]] = [
    ("Apache-2.0", " ".join(APACHE)),
    ("Apache-2.0", APACHE[0]),
    ("BSD-2-Clause", " ".join((*BSD[:2], BSD[3]))),
    ("BSD-2-Clause", " ".join(BSD[:2])),
    ("BSD-3-Clause", " ".join(BSD)),
    ("BSD-3-Clause", " ".join(BSD[:3])),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", " ".join(MIT)),
    ("MIT", MIT[0]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
#: Licences with the names that short notices give them.
NAMES: dict[str, list[str]] = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "Zlib": ["zlib License"],
}
#: Words that say little about a licence, as anchors.
FREQUENT = frozenset("a all an and any as at be by can copies copy copyright documentation following for form free from general has holder in including is it later license licensed may must no not notice of on or other permission person provided public released rights software source subject terms that the their this to under use version warranty was with without work you your".split())


def named_notices() -> list[tuple[str, str]]:
    """Short notices by rule: SPDX tags, and who says under which name a work is published."""
    out = []
    for spdx, names in NAMES.items():
        out.append((spdx, f"SPDX-License-Identifier: {spdx}"))
        for name in names:
            the = "" if name.startswith(("CC ", "AGPLv", "GPLv")) else "the " if not name.startswith("Creative") else "a "
            out += [(spdx, f"{verb} under {the}{name}") for verb in ("Licensed", "Released", "Distributed", "Available", "Published")]
            if spdx.startswith("CC"):
                out.append((spdx, f"This work is licensed under {the}{name}"))
    return out


def gnu_notices() -> list[tuple[str, str]]:
    out = []
    for spdx, kind, number, what in (("AGPL-3.0-or-later", "Affero ", "3", "program"), ("GPL-2.0-or-later", "", "2", "program"), ("GPL-3.0-or-later", "", "3", "program"), ("LGPL-2.1-or-later", "Lesser ", "2.1", "library"), ("LGPL-3.0-or-later", "Lesser ", "3", "program")):
        notice = GNU.format(what=what, kind=kind, number=number, colon=":" if number == "3" else ";", either=", either" if number == "3" else "; either")
        out += [(spdx, notice), (spdx, f"{notice} {GNU_WARRANTY.format(what=what, kind=kind)}")]
    return out


TEMPLATES: list[tuple[str, str]] = [*TEXTS, *gnu_notices(), *named_notices()]


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_bigrams(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    out = []
    for name, text in templates:
        w = words_of(text)
        out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))))
    return out


def gate_words(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """A few words one of which every matching run holds.

    A match with b template bigrams shares at least threshold / (2 - threshold) * b of them, so it has one of any set that
    is larger than the rest. Words are taken greedily until their bigrams are such a set for every template.
    """
    short = {i: max(0, int(len(b) * (1 - threshold / (2 - threshold)) + 1e-9)) + 1 for i, (_, b) in enumerate(known)}
    left, chosen = {i: set(b) for i, (_, b) in enumerate(known)}, []
    while any(n > 0 for n in short.values()):
        gain: dict[str, int] = {}
        for i, b in left.items():
            if short[i] > 0:
                for w in {w for x in b for w in x.split() if len(w) > 5} or {w for x in b for w in x.split()}:
                    gain[w] = gain.get(w, 0) + min(short[i], sum(w in x.split() for x in b))
        word = max(gain, key=lambda w: (gain[w], w))
        chosen.append(word)
        for i, b in left.items():
            hit = {x for x in b if word in x.split()}
            short[i] -= len(hit)
            left[i] = b - hit
    return sorted(chosen)


def anchors(templates: list[tuple[str, str]], most: int = ANCHORS) -> list[tuple[str, int, int]]:
    """(word, template, place): of each part of a template, its word that the fewest templates have, long before short.

    Only the SQL counterpart begins its runs there; scan_licenses compares every run that can match.
    """
    texts = [words_of(t) for _, t in templates]
    spread: dict[str, int] = {}
    for w in texts:
        for x in set(w):
            spread[x] = spread.get(x, 0) + 1
    out = []
    for k, w in enumerate(texts):
        parts = min(most, max(1, len(w) // 6))
        for i in range(parts):
            lo, hi = i * len(w) // parts, (i + 1) * len(w) // parts
            at = min(range(lo, hi), key=lambda j: (w[j] in FREQUENT, spread[w[j]], -len(w[j]), j))
            out.append((w[at], k, at))
    return sorted(out)


def shared_least(b: int, threshold: float) -> int:
    """How many of its b bigrams every match of a template shares."""
    return max(1, math.ceil(b * threshold / (2 - threshold) - 1e-9))


def bigram_slots(known: list[tuple[str, list[str]]]) -> list[list[dict]]:
    """The bigrams by CRC-32, each with its templates."""
    having: dict[str, list[int]] = {}
    for k, (_, b) in enumerate(known):
        for pair in b:
            having.setdefault(pair, []).append(k)
    out: list[list[dict]] = [[] for _ in range(SLOTS)]
    for pair, ks in having.items():
        out[zlib.crc32(pair.encode()) % SLOTS].append({"pair": pair, "ks": ks})
    return out


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _once(value: Column) -> Column:
    """A generator of the one value: later filters and lambdas then read it instead of repeating its expression."""
    return F.explode(F.array(value))


def _literal(value: object, kind: str) -> Column:
    """A constant of a nested type; the optimiser folds it."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line and last_line (from 1), license, dice: one row for each place where a licence stands."""
    templates = [(name, text) for name, text in templates or TEMPLATES if len(words_of(text)) > 1]
    known = template_bigrams(templates)
    # Literals: the templates by number, and the bigrams with the templates that have them.
    listed = _literal([{"name": name, "b": b, "n": len(words_of(text)), "least": shared_least(len(b), threshold)} for (name, b), (_, text) in zip(known, templates)], "array<struct<name:string,b:array<string>,n:int,least:int>>")
    slots = _literal(bigram_slots(known), "array<array<struct<pair:string,ks:array<long>>>>")
    gate = gate_words(known, threshold)

    found = docs.where(F.exists(F.array(F.lower("text")), lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in gate))))
    worded = F.flatten(F.transform(F.split("text", "\n"), lambda t, i: F.transform(F.filter(F.split(normalised(t), " "), lambda w: w != ""), lambda w: F.struct(w.alias("word"), (i + 1).alias("line")))))
    found = found.select("doc_id", _once(worded).alias("_w")).where(F.size("_w") > 1)
    pairs = F.transform(F.slice("_w", F.lit(1), F.size("_w") - 1), lambda x, i: F.concat_ws(" ", x["word"], F.get(F.col("_w"), i + 1)["word"]))
    found = found.select("doc_id", F.transform("_w", lambda x: x["line"]).alias("_lines"), _once(pairs).alias("_pairs"))

    # Template and place as one number, template * SPAN + SPAN / 2 + place, so that sorting brings a template's bigrams together.
    def template(x: Column) -> Column:
        return F.get(listed, F.shiftright(x, BITS).cast("int"))

    def of_slot(p: Column, i: Column) -> Column:
        own = F.filter(F.get(slots, F.pmod(F.crc32(p), F.lit(SLOTS)).cast("int")), lambda y: y["pair"] == p)
        return F.flatten(F.transform(own, lambda y: F.transform(y["ks"], lambda k: k * SPAN + (SPAN // 2) + i)))

    found = found.select("doc_id", "_lines", "_pairs", _once(F.sort_array(F.flatten(F.transform("_pairs", of_slot)))).alias("_at")).where(F.size("_at") > 0)
    # From each bigram on: enough of them near enough for one run. Its start is at most the first of them, and at least what still reaches the last.
    spans = F.transform("_at", lambda x, i: F.struct((F.get("_at", i + template(x)["least"] - 1) - template(x)["n"] + 2).alias("lo"), x.alias("hi")))
    found = found.select("doc_id", "_lines", "_pairs", _once(F.filter(spans, lambda x: x["lo"] <= x["hi"])).alias("_spans")).where(F.size("_spans") > 0)
    starts = F.flatten(F.transform("_spans", lambda x, j: F.sequence(F.greatest(x["lo"], F.get("_spans", j - 1)["hi"] + 1), x["hi"])))
    found = found.select("doc_id", "_lines", "_pairs", _once(starts).alias("_starts"))

    def placed(x: Column) -> Column:
        k = F.shiftright(x, BITS).cast("int")
        start, n = (F.pmod(x, F.lit(SPAN)) - SPAN // 2).cast("int"), F.get(listed, k)["n"]
        return F.struct(F.greatest(start, F.lit(0)).alias("first"), F.least(start + n, F.size("_lines")).alias("end"), k.alias("k"), n.alias("n"), start.alias("start"))

    def compared(x: Column) -> Column:
        t = F.get(listed, x["k"])
        own = F.array_distinct(F.slice("_pairs", x["first"] + 1, F.greatest(x["end"] - x["first"] - 1, F.lit(0))))
        same = F.get(F.transform(F.array(own), lambda b: 2.0 * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + F.size(t["b"]))), F.lit(0))
        return F.struct(same.alias("dice"), x["n"].alias("n"), (-x["first"]).alias("at"), (-x["k"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), t["name"].alias("license"))

    matching = F.filter(F.transform(F.transform("_starts", placed), compared), lambda x: x["dice"] >= threshold)
    found = found.select("doc_id", "_lines", _once(matching).alias("_m")).where(F.size("_m") > 0)
    # They stand by template and start; taken by place, they are cut where no template is long enough for two neighbours to overlap.
    longest = max(len(words_of(text)) for _, text in templates)
    found = found.select("doc_id", "_lines", "_m", _once(F.sort_array(F.transform("_m", lambda x, i: F.struct((-x["at"]).alias("first"), i.alias("i"))))).alias("_by"))
    cuts = F.filter(F.sequence(F.lit(0), F.size("_by") - 1), lambda j: (j == 0) | (F.get("_by", j)["first"] - F.get("_by", j - 1)["first"] >= longest))
    found = found.select("doc_id", "_lines", "_m", "_by", _once(cuts).alias("_cuts"))
    groups = F.transform("_cuts", lambda c, j: F.transform(F.slice("_by", c + 1, F.coalesce(F.get("_cuts", j + 1), F.size("_by")) - c), lambda o: F.struct(F.get("_m", o["i"]).alias("run"), o["i"].alias("i"))))
    meets = lambda y, x: (-y["at"] < x["end"]) & (-x["at"] < y["end"])
    inside = lambda z, y: (z["at"] <= y["at"]) & (z["end"] <= y["end"])

    def beside(z: Column, x: Column, i: Column) -> Column:
        most = x["n"] - F.get(listed, -x["rank"])["least"]  # moved by more words, a run shares too little with the same place
        others = F.slice("_m", F.greatest(i - most, F.lit(0)) + 1, 2 * most + 1)
        return (z["license"] == x["license"]) & (z["n"] < x["n"]) & F.exists(others, lambda y: (y["rank"] == x["rank"]) & (y > x) & (F.abs(y["start"] - x["start"]) <= most) & inside(z, y))

    def best_apart(group: Column) -> Column:
        """Kept runs by cells as wide as the longest template: what overlaps a run, or lies beside it, is at most two cells away."""
        cell = lambda run: F.floor((-run["at"] + F.get(group, F.lit(0))["run"]["at"]) / longest).cast("int")

        def step(kept: Column, x: Column) -> Column:
            close = F.flatten(F.slice(kept, F.greatest(cell(x["run"]) - 1, F.lit(1)), F.lit(5)))
            with_x = F.transform(kept, lambda own, c: F.when(c == cell(x["run"]), F.array_append(own, x["run"])).otherwise(own))
            return F.when(F.exists(close, lambda z: meets(z, x["run"]) | beside(z, x["run"], x["i"])), kept).otherwise(with_x)

        none = F.transform(F.sequence(F.lit(0), cell(F.get(group, F.size(group) - 1)["run"])), lambda _: F.slice("_m", 1, 0))
        return F.flatten(F.aggregate(F.sort_array(group, asc=False), none, step))

    found = found.select("doc_id", "_lines", F.explode(F.flatten(F.transform(groups, best_apart))).alias("_m"))
    return found.select("doc_id", F.get("_lines", -F.col("_m.at")).alias("line"), F.get("_lines", F.col("_m.end") - 1).alias("last_line"), "_m.license", F.round("_m.dice", 6).alias("dice"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LOW = THRESHOLD / (2 - THRESHOLD)
ORACLE_SQL = f"""
with t(k, license, n, b) as (values {", ".join(f"({k}, {_quoted(n)}, {len(words_of(text))}, [{', '.join(map(_quoted, b))}])" for k, ((n, b), (_, text)) in enumerate(zip(template_bigrams(TEMPLATES), TEMPLATES)))}),
a(word, k, place) as (values {", ".join(f"({_quoted(w)}, {k}, {j})" for w, k, j in anchors(TEMPLATES))}),
d as (select row_number() over () r, doc_id, string_split(text, chr(10)) lines from documents where text is not null),
l as (select r, doc_id, generate_subscripts(lines, 1) line, unnest(lines) s from d),
x as (select r, doc_id, line, list_filter(string_split(trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '') ws from l),
y as (select r, doc_id, line, generate_subscripts(ws, 1) j, unnest(ws) w from x),
w as (select r, doc_id, line, w, row_number() over (partition by r order by line, j) - 1 i from y),
p as (select r, any_value(doc_id) doc_id, list(w order by i) ws, list(line order by i) lines from w group by r),
h as (select distinct r, a.k, i - place s from w join a on a.word = w.w),
c as (select h.r, h.k, t.license, t.n, t.b, s, greatest(s, 0) f, least(s + t.n, len(ws)) e, doc_id, ws, lines from h join p using (r) join t using (k)),
g as (select *, list_distinct(list_transform(range(f + 1, e), lambda i: ws[i] || ' ' || ws[i + 1])) own from c where e - f - 1 >= greatest(1, floor(len(b) * {LOW!r}))),
m as (select *, 2.0 * len(list_intersect(own, b)) / (len(own) + len(b)) dice from g),
q as (select * from m where dice >= {THRESHOLD})
select doc_id, cast(lines[f + 1] as integer) line, cast(lines[e] as integer) last_line, license, round(dice, 6) dice from q
where not exists (select 1 from q z where z.r = q.r and z.f < q.e and q.f < z.e
  and (z.dice > q.dice or (z.dice = q.dice and (z.n > q.n or (z.n = q.n and (z.f < q.f or (z.f = q.f and (z.k < q.k or (z.k = q.k and z.s > q.s)))))))))
"""
