"""License scans: phrases, and an exact set-similarity join with templates.

Words are runs of digits, ASCII letters (lower-cased) and anything beyond ASCII.
A phrase is found wherever its words stand one after another. Beyond that the
words of every line of a text are cut into blocks, and so are, as notices are
wrapped, those of the joined lines of each paragraph: overlapping windows of
twice a span at every span, so that whatever is no longer than the span is whole
in one. Templates are the sentences and paragraphs of the licenses; those of up
to ``SPAN`` words meet windows of that span, longer ones windows of the longest
template's. Every template whose words are contained in a block to at least
``threshold`` gives its label. The join is exact: words are ordered by their
frequency over all blocks, rarest first; a template and a
block that overlap in the ``need`` words required share one within the first
size - need + 1 of either (prefix filter), the block must hold enough words
(length filter), and what follows the shared word in either must suffice
(positional filter). Candidates are verified on the full word sets.

Lines and paragraphs that hold none of the templates' anchors are passed over:
of a template's words, size - need + 1 are anchors, the longest ones, so that
whatever contains it to the threshold holds one of them.

Templates are a fixed, small library, so their side of the join and the counts
of their words are bounded; words outside it are never shuffled. All is
DataFrame operations.

Null texts count as empty: no words, nulls for first_word and last_word, empty
labels, score 0. Repeated rows each get their own row. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm._shared import ascii_lower, stash

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARAGRAPHS = r"\n[ \t\r\n\x0B\x0C]*\n"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# What public licenses and the notices of their use say.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl", "Licensed under the GNU General Public License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT INCLUDING NEGLIGENCE OR OTHERWISE ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("reserved", "All rights reserved"),
]
SPAN = 24
THRESHOLD = 0.9


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return [(label, sorted({w for w in re.split(SEPARATORS, text.lower()) if w})) for label, text in templates]


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def phrase_places(words: Column, lower: Column, phrase: str) -> Column:
    """Ascending places of a phrase; texts without its words skip the scan."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        found = F.lit(True)
        for k, part in enumerate(parts):
            found = found & (F.get(words, i + k) == part)
        return found

    scan = F.filter(F.sequence(F.lit(0), last), here)
    possible = last >= 0
    for part in parts:
        possible = possible & lower.contains(part)
    return F.when(possible, scan).otherwise(F.array().cast("array<int>"))


def words_in(text: str) -> int:
    return sum(w != "" for w in re.split(SEPARATORS, text.lower()))


def spans(templates: list[tuple[str, str]]) -> list[int]:
    """The two spans of windows; of each template the second if it is longer than the first."""
    return [SPAN, max([SPAN, *(words_in(text) for _, text in templates)])]


def windows(blocks: Column, span: int) -> Column:
    """Of every block of words overlapping windows of 2 * span at every span."""
    places = lambda ws: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(ws) / span).cast("int") - 2))
    cut = lambda ws: F.transform(places(ws), lambda k: F.slice(ws, k * span + 1, F.lit(2 * span)))
    return F.flatten(F.transform(blocks, cut))


def word_lists(parts: Column) -> Column:
    return F.transform(parts, lambda part: F.filter(F.split(part, SEPARATORS), lambda w: w != ""))


def anchors(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    found = set()
    for _, ws in template_sets(templates):
        found |= set(sorted(ws, key=lambda w: (-len(w), w))[: len(ws) - needed(len(ws), threshold) + 1])
    return sorted(found)


def scanned(docs: DataFrame, vocabularies: list[list[str]], held: list[str], phrases: dict[str, str], spans: list[int]) -> DataFrame:
    """One narrow pass: phrase columns, and per window of either span the words
    of that span's templates."""
    lower = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("lower"))
    split = lower.withColumn("lines", word_lists(F.split("lower", "\n"))).withColumn("words", F.flatten("lines"))
    placed = split.withColumns({f"at{k}": phrase_places(F.col("words"), F.col("lower"), p) for k, p in enumerate(phrases)})
    places = [F.col(f"at{k}") for k in range(len(phrases))]
    every = F.flatten(F.array(*places))
    found = F.filter(F.array(*[F.when(F.size(at) > 0, F.lit(label)) for at, label in zip(places, phrases.values())]), lambda x: x.isNotNull())
    holding = lambda parts: F.filter(parts, lambda ws: F.exists(ws, lambda w: w.isin(held)))
    placed = placed.withColumn("held", holding(F.col("lines")))
    wrapped = word_lists(F.filter(F.split("lower", PARAGRAPHS), lambda p: p.contains("\n")))  # the others are lines
    parts = F.when((F.size("held") > 0) & (F.size("lines") > 1), F.concat("held", holding(wrapped))).otherwise(F.col("held"))
    placed = placed.withColumn("parts", parts)

    def known(vocabulary: list[str], span: int, scale: int) -> Column:
        kept = F.transform(windows(F.col("parts"), span), lambda ws: F.array_distinct(F.filter(ws, lambda w: w.isin(vocabulary))))
        return F.transform(F.array_distinct(F.filter(kept, lambda ws: F.size(ws) > 0)), lambda ws: F.struct(F.lit(scale).alias("scale"), ws.alias("tokens")))

    blocks = F.concat(*[known(v, span, k) for k, (v, span) in enumerate(zip(vocabularies, spans))])
    return placed.select(
        "doc_id",
        F.xxhash64("lower").alias("content"),
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.sort_array(F.array_distinct(found)).alias("base"),
        blocks.alias("blocks"),
    )


def similar_blocks(blocks: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """blocks: any key columns and ``tokens``, an array of distinct words. Adds
    label and containment for every template that a block contains."""
    spark: SparkSession = blocks.sparkSession
    sets = template_sets(templates)
    counted = {r["token"]: r["count"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()}  # at most the library's words
    order = sorted({w for _, ws in sets for w in ws}, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows, least = [], min(needed(len(ws), threshold) for _, ws in sets)
    for number, (label, ws) in enumerate(sets):
        ordered, need = sorted(rank[w] for w in ws), needed(len(ws), threshold)
        rows += [(r, i, number, label, need, ordered) for i, r in enumerate(ordered[: len(ordered) - need + 1])]
    index = spark.createDataFrame(rows, "rank int, at int, template int, label string, need int, template_ranks array<int>")
    prefixes = [order[r] for r in sorted({row[0] for row in rows})]
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])
    keys = [c for c in blocks.columns if c != "tokens"]
    ranked = (
        blocks.where((F.size("tokens") >= least) & F.exists("tokens", lambda w: w.isin(prefixes)))
        .withColumn("ranks", F.array_sort(F.transform("tokens", lambda w: F.element_at(ranks, w))))
        .select(*keys, "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - least + 1)).alias("place", "rank"))
    )
    joined = ranked.join(F.broadcast(index), "rank")  # the fixed library
    rest_block, rest_template = F.size("ranks") - F.col("place"), F.size("template_ranks") - F.col("at")
    passed = joined.where((F.size("ranks") >= F.col("need")) & (F.least(rest_block, rest_template) >= F.col("need")))
    overlap = F.size(F.array_intersect("ranks", "template_ranks"))
    return passed.withColumn("overlap", overlap).where("overlap >= need").select(*keys, "label", (F.col("overlap") / F.size("template_ranks")).alias("containment"))


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    own = [[t for t in templates if words_in(t[1]) <= SPAN], [t for t in templates if words_in(t[1]) > SPAN]]
    vocabularies = [sorted({w for _, ws in template_sets(ts) for w in ws}) for ts in own]
    base = stash(scanned(docs, vocabularies, anchors(templates, threshold), phrases, spans(templates)), "blocks")
    blocks = base.select("doc_id", "content", F.explode("blocks").alias("b")).select("doc_id", "content", "b.scale", "b.tokens")
    found = None
    for scale, ts in enumerate(own):
        if ts:
            one = similar_blocks(blocks.where(F.col("scale") == scale).drop("scale"), ts, threshold)
            found = one if found is None else found.unionByName(one)
    found = found.groupBy(F.col("doc_id").alias("id"), F.col("content").alias("what")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("what")), "left_outer")
    labels = F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql(threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    """The same scan by brute force: every window against every template."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    sets = template_sets(templates)
    values = ", ".join(f"('{label}', {ws!r}, {needed(len(ws), threshold)}, {int(words_in(text) > SPAN)})" for (label, ws), (_, text) in zip(sets, templates))
    places = []
    for phrase in phrases:
        parts = phrase.split(" ")
        test = " and ".join(f"ws[i + {k}] = '{part}'" for k, part in enumerate(parts))
        places.append(f"list_filter(range(1, len(ws) - {len(parts) - 2}), lambda i: {test})")
    labels = ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, label in enumerate(phrases.values()))
    cuts = " union all ".join(
        f"select r, {scale} as scale, unnest(list_transform(range(0, greatest(1, cast(ceil(len(ws) / {span}) as bigint) - 1)), lambda k: ws[k * {span} + 1 : (k + 2) * {span}])) as tokens from l" for scale, span in enumerate(spans(templates))
    )
    return f"""
with t(label, tokens, need, scale) as (values {values}),
d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as lower from documents),
w as (select r, doc_id, lower, regexp_extract_all(lower, '{word}') as ws from d),
p as (select r, doc_id, len(ws) as n_words, {", ".join(f"{x} as p{k}" for k, x in enumerate(places))} from w),
b as (select r, doc_id, n_words, list_concat({", ".join(f"p{k}" for k in range(len(places)))}) as places,
  list_sort(list_distinct(list_filter([{labels}], lambda x: x is not null))) as base from p),
j as (select r, unnest(list_concat(string_split(lower, chr(10)), regexp_split_to_array(lower, '{PARAGRAPHS}'))) as part from w),
l as (select r, regexp_extract_all(part, '{word}') as ws from j),
c as ({cuts}),
s as (select r, scale, list_distinct(tokens) as tokens from c),
m as (select r, label, len(list_intersect(s.tokens, t.tokens)) as overlap, need, len(t.tokens) as size from s join t on s.scale = t.scale),
f as (select r, list(distinct label) as more, max(overlap / size) as best from m where overlap >= need group by r)
select b.doc_id, cast(n_words as bigint) as n_words, cast(len(places) as bigint) as n_base,
  cast(list_min(places) - 1 as bigint) as first_word, cast(list_max(places) - 1 as bigint) as last_word,
  array_to_string(base, ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') as labels,
  case when len(places) > 0 then 1.0::double else coalesce(best, 0)::double end as score
from b left join f on b.r = f.r"""
