"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of a document, or a run of consecutive words over several
lines, at most 1 / ``threshold`` times as many as the template has; block and
template are sets of lower-cased words.  A block matches a template when it holds
at least ``threshold`` of the template's words, and all of its obligatory ones
(those that tell the license from others).  Words are ordered by their frequency
over all documents (the rarest first).  A match must touch the template's shortest
prefix, and hold each obligatory word; whichever is rarer is looked for first.
The filters never drop a match, so the join is exact.

Defined results
---------------
* null or empty text, and blank lines, match nothing; all lines of a text are read;
* a template without words matches nothing; equal templates match separately;
* a line that matches several templates, or lines that repeat, give a row each;
* runs lie between the lines that match the template alone, and are taken from the
  first end to the last, each at its shortest; ``line_no`` is the line of its first
  word, and the words shared are counted over the whole reach from there;
* obligatory words that a template lacks are ignored;
* ties in frequency are ordered by the word itself;
* an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.llm._common import WORD

THRESHOLD = 0.8
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "Copyright. All rights reserved.",
}
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
#: The sentences above, and the usual full notices and file headers.
NOTICES = TEMPLATES | {
    "all-rights-reserved-alone": "All rights reserved.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-notice": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-header": _GPL.format(2),
    "gpl-3.0-header": _GPL.format(3),
    "mpl-2.0-header": TEMPLATES["mpl-2.0"] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
OBLIGATORY = {
    "apache-2.0": {"apache"}, "apache-2.0-header": {"apache"}, "mit": {"mit"}, "mit-notice": {"sublicense"}, "isc-notice": {"fee"}, "gpl-3.0": {"gnu"}, "gpl-2.0-header": {"gnu", "2"}, "gpl-3.0-header": {"gnu", "3"},
    "cc-by-nc-4.0": {"nc"}, "cc-by-nc-4.0-notice": {"noncommercial"}, "bsd": {"redistribution"}, "bsd-notice": {"redistributions"}, "mpl-2.0": {"mozilla"}, "mpl-2.0-header": {"mozilla"}, "all-rights-reserved": {"reserved"}, "all-rights-reserved-alone": {"reserved"},
}


def word_set(block: str) -> set[str]:
    return set(WORD.findall(block.lower()))


def needed(size: int, threshold: float) -> int:
    """Words of a template of that size that a match must hold."""
    return max(1, math.ceil(round(threshold * size, 9)))


def frequencies(docs: DataFrame, vocabulary: frozenset[str], text_col: str = "text") -> dict[str, int]:
    """In how many blocks of all documents each word of the templates stands."""

    def run(batches):
        n: Counter = Counter()
        some = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(vocabulary))) + r")\b") if vocabulary else None
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and some:
                    at = -1
                    t = t.lower()
                    seen: set = set()
                    for m in some.finditer(t):
                        if m.start() >= at:  # a new line began
                            n.update(seen)
                            seen = set()
                            at = t.find("\n", m.end())
                            at = len(t) + 1 if at < 0 else at
                        seen.add(m.group())
                    n.update(seen)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    rows = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    return {r["word"]: r["n"] for r in rows}


class TemplateIndex:
    def __init__(self, templates: dict[str, str], freq: dict[str, int], threshold: float, obligatory: dict[str, set[str]]):
        self.names, self.sets, self.least, self.must, self.reach, self.anchors = list(templates), [], [], [], [], []
        for name in self.names:
            tokens = WORD.findall(templates[name].lower())
            s = sorted(set(tokens), key=lambda w: (freq.get(w, 0), w))
            least = needed(len(s), threshold)
            must = [w for w in s if w in obligatory.get(name, ())]
            prefix = s[: len(s) - least + 1] if s else []
            self.sets.append(frozenset(s))
            self.least.append(least)
            self.must.append(frozenset(must))
            self.reach.append(max(len(tokens), math.floor(round(len(tokens) / threshold, 9))) if threshold > 0 else len(tokens))
            self.anchors.append(must[:1] if must and freq.get(must[0], 0) <= sum(freq.get(w, 0) for w in prefix) else prefix)

    def candidates(self, low: str) -> list[int]:
        """Templates of which the text has an anchor, all obligatory words and enough of the others, be it inside longer words."""
        return [k for k, a in enumerate(self.anchors) if any(w in low for w in a) and all(w in low for w in self.must[k]) and sum(w in low for w in self.sets[k]) >= self.least[k]]

    def matches(self, k: int, block) -> bool:
        return len(block) >= self.least[k] and self.must[k] <= set(block)

    def runs(self, k: int, points: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
        """(line, template, words shared) of the runs among (word number, line, word) of the template's words."""
        out, reach, a = [], self.reach[k], 0
        held: Counter = Counter()

        def drop(a):
            w = points[a][2]
            held[w] -= 1
            if not held[w]:
                del held[w]

        for b, (at, _, word) in enumerate(points):
            held[word] += 1
            while at - points[a][0] >= reach:
                drop(a)
                a += 1
            if self.matches(k, held):
                while held[points[a][2]] > 1 or (len(held) > self.least[k] and points[a][2] not in self.must[k]):
                    drop(a)
                    a += 1
                end = points[a][0] + reach
                out.append((points[a][1], k, len({w for at, _, w in points[a : a + reach] if at < end})))
                held.clear()
                a = b + 1
        return out

    def scan(self, text) -> list[tuple[int, int, int]]:
        """(line number from 0, template, words shared); texts without a candidate aren't cut up."""
        out: list = []
        if not text:
            return out
        low = text.lower()
        some = self.candidates(low)
        if not some:
            return out
        of = [(at, line, w) for at, (line, w) in enumerate((i, w) for i, row in enumerate(low.split("\n")) for w in WORD.findall(row))]
        for k in some:
            points = [x for x in of if x[2] in self.sets[k]]
            between: list = []
            for line, here in groupby(points, key=lambda x: x[1]):
                here = list(here)
                block = {w for _, _, w in here}
                if self.matches(k, block):
                    out += [*self.runs(k, between), (line, k, len(block))]
                    between = []
                else:
                    between += here
            out += self.runs(k, between)
        return sorted(out)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = NOTICES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", obligatory: dict[str, set[str]] = OBLIGATORY) -> DataFrame:
    """(id, ``line_no``, ``template``, ``shared_words``, ``containment``) of every matching block."""
    vocabulary = frozenset().union(*map(word_set, templates.values())) if templates else frozenset()
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, frequencies(docs, vocabulary, text_col), threshold, obligatory))  # grows with the templates alone
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("line_no", T.IntegerType()), T.StructField("template", T.StringType()), T.StructField("shared_words", T.IntegerType()), T.StructField("containment", T.DoubleType())])

    def run(batches):
        x = index.value
        for b in batches:
            rows = [(i, line, x.names[k], n, n / len(x.sets[k])) for i, t in enumerate(b.column(1).to_pylist()) for line, k, n in x.scan(t)]
            i, line, k, n, c = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int64())), pa.array(line, pa.int32()), pa.array(k, pa.string()), pa.array(n, pa.int32()), pa.array(c, pa.float64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def sql(templates: dict[str, str] = NOTICES, threshold: float = THRESHOLD, obligatory: dict[str, set[str]] = OBLIGATORY) -> str:
    """The same rows in DuckDB's SQL, without any filter but the obligatory words, for distinct ids; every template must have one of those.

    ``pt`` holds the words of a document that a template has, by word number; ``ln`` the lines that match alone, which
    cut what is left into segments; ``en`` for each word of a segment the latest begin of a run that ends there and matches."""
    index = TemplateIndex(templates, {}, threshold, obligatory)
    quoted = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(ws)) + "]"
    values = ", ".join(f"('{n}', {quoted(s)}, {quoted(m)}, {least}, {reach})" for n, s, m, least, reach in zip(index.names, index.sets, index.must, index.least, index.reach))
    enough = "len(list_distinct(list({0}))) >= least AND len(list_intersect(list_distinct(list({0})), must)) = len(must)"
    return f"""
    WITH RECURSIVE tp(template, words, must, least, reach) AS (VALUES {values}),
    tx AS MATERIALIZED (SELECT doc_id, template, words, must, least, reach, string_split(lower(text), chr(10)) AS lines FROM documents JOIN tp ON list_bool_and(list_transform(must, lambda m: contains(lower(text), m))) WHERE text IS NOT NULL),
    bl AS (SELECT * EXCLUDE (lines), unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM tx),
    tk AS (SELECT * EXCLUDE (line), regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+') AS w FROM bl),
    wd AS (SELECT * EXCLUDE (w), unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tk),
    nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY line_no, i) AS wn FROM wd),
    pt AS MATERIALIZED (SELECT * EXCLUDE (words, i), row_number() OVER (PARTITION BY doc_id, template ORDER BY wn) AS k FROM nu WHERE list_contains(words, word)),
    ln AS MATERIALIZED (SELECT doc_id, template, line_no, len(list_distinct(list(word))) AS shared FROM pt GROUP BY doc_id, template, line_no, must, least HAVING {enough.format('word')}),
    sg AS MATERIALIZED (SELECT p.*, (SELECT count(*) FROM ln WHERE ln.doc_id = p.doc_id AND ln.template = p.template AND ln.line_no < p.line_no) AS seg FROM pt p WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.doc_id = p.doc_id AND ln.template = p.template AND ln.line_no = p.line_no)),
    rn AS (SELECT e.doc_id, e.template, e.seg, b.k AS a, e.k AS e FROM sg b JOIN sg e USING (doc_id, template, seg) JOIN sg m USING (doc_id, template, seg) WHERE b.k <= e.k AND e.wn - b.wn < e.reach AND m.k BETWEEN b.k AND e.k GROUP BY e.doc_id, e.template, e.seg, b.k, e.k, e.must, e.least HAVING {enough.format('m.word').replace('least', 'e.least').replace('must', 'e.must')}),
    en AS MATERIALIZED (SELECT doc_id, template, seg, e, max(a) AS a FROM rn GROUP BY ALL),
    gr AS (SELECT doc_id, template, seg, min(e) AS e FROM en GROUP BY ALL UNION ALL SELECT gr.doc_id, gr.template, gr.seg, (SELECT min(n.e) FROM en n WHERE n.doc_id = gr.doc_id AND n.template = gr.template AND n.seg = gr.seg AND n.a > gr.e) FROM gr WHERE gr.e IS NOT NULL),
    st AS (SELECT en.* FROM gr JOIN en USING (doc_id, template, seg, e)),
    ru AS (SELECT st.doc_id, st.template, b.line_no, len(list_distinct(list(m.word))) AS shared FROM st JOIN sg b ON b.doc_id = st.doc_id AND b.template = st.template AND b.k = st.a JOIN sg m ON m.doc_id = st.doc_id AND m.template = st.template AND m.seg = st.seg WHERE m.k >= st.a AND m.wn < b.wn + b.reach GROUP BY st.doc_id, st.template, st.e, b.line_no)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, template, CAST(shared AS INTEGER) AS shared_words, CAST(shared AS DOUBLE) / len(words) AS containment FROM (SELECT * FROM ln UNION ALL SELECT doc_id, template, line_no, shared FROM ru) JOIN tp USING (template)"""
