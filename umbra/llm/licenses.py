"""License scans, in DataFrame functions only: named phrases, and license texts by an exact set-similarity join.

A text block (a paragraph) matches a template if a line of it, or a run of about as many words as
the template has, wherever its lines break, holds at least ``CONTAINMENT`` of the template's
distinct words; so a wrapped notice is found as one on a single line is.  The join is exact: the template's words are ordered by their count over all blocks, rarest first, and a
match must hold one of the first ``|T| - need + 1`` of them (prefix filter), have at least
``need`` distinct words (length filter), and still have ``need`` words of the template from its
first shared word on (positional filter).  Only blocks that hold enough words of a template are
cut into lines and runs.  The templates are a fixed parameter of a few hundred words; only their words'
counts reach the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialise

CONTAINMENT = 0.9
# A word, and the phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# License notices by label, as the public licenses have them, paragraph by paragraph, and
# the short forms in which files name a license; a block is compared with the distinct words of each.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of a text before lower-casing: what stands inside a word and between words.
_INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Lower case in which no other letter turns into an ASCII one: of those that would, stand-ins are lowered."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001")))


def words(text: Column) -> Column:
    """The words of a text in lower case, with an empty string before or behind them where the text begins or ends between words.

    A split is several times cheaper than extracting every match.
    """
    return F.split(lower_ascii(text), _BETWEEN)


def count_words(text: Column) -> Column:
    pieces = F.split(text, _BETWEEN)
    return (F.size(pieces) - F.when(F.get(pieces, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)).cast("long")


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]  # distinct, rarest in the corpus first
    length: int  # in words, repeated ones too

    @property
    def need(self) -> int:
        return max(1, math.ceil(CONTAINMENT * len(self.words) - 1e-9))

    @property
    def span(self) -> int:
        """Words on end among which a notice is looked for: its own, and some of comment marks between them."""
        return math.ceil(self.length / CONTAINMENT)

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def _split(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(WORD, text.lower())))


def blocks(docs: DataFrame, key: str) -> DataFrame:
    """(key, block, paragraph, words): the paragraphs of each text (runs of lines that are not blank), with their words in order."""
    cut = docs.where("text is not null").select(F.col(key).alias("key"), F.posexplode(F.split("text", r"\n[ \t\r\f\n]*\n")).alias("block", "paragraph"))
    return cut.select("key", "block", "paragraph", words(F.col("paragraph")).alias("words"))


def closest(paragraph: Column, template: Column, need: Column, span: Column) -> Column:
    """The most distinct words of a template in a line, or in ``span`` words on end about one of its rarest words, if that is enough."""
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  # the value is worked out once
    shared = lambda held: F.size(F.array_intersect(held, template))
    by_line = F.array_max(F.transform(F.split(paragraph, "\n"), lambda line: shared(words(line))))

    def by_run(held: Column) -> Column:
        rarest = F.slice(template, F.lit(1), F.size(template) - need + 1)  # a run with enough words holds one of them
        places = F.filter(F.sequence(F.lit(1), F.size(held)), lambda i: F.array_contains(rarest, F.get(held, i - 1)))
        near = F.transform(places, lambda i: F.slice(held, F.greatest(F.lit(1), i - span + 1), 2 * span - 1))
        runs = lambda some: F.array_max(F.transform(F.sequence(F.lit(1), F.size(some)), lambda k: shared(F.slice(some, k, span))))
        return F.coalesce(F.array_max(F.transform(near, runs)), F.lit(0))

    run = once(F.filter(words(paragraph), lambda w: w != ""), by_run)
    return once(by_line, lambda n: F.when(n == F.size(template), n).otherwise(F.greatest(n, run)))


def ordered_templates(docs: DataFrame, templates=TEMPLATES) -> list[Template]:
    """The templates with their words in the order of the words' counts over all texts."""
    known = sorted({w for _, text in templates for w in _split(text)})
    counts = (
        docs.where("text is not null")
        .select(F.explode(words(F.col("text"))).alias("word"))
        .join(F.broadcast(_values(docs, "word string", [(w,) for w in known])), "word")
        .groupBy("word")
        .count()
    )
    count = {r["word"]: r["count"] for r in counts.collect()}  # a row for each template word at most
    return [Template(i, label, tuple(sorted(_split(text), key=lambda w: (count.get(w, 0), w))), len(re.findall(WORD, text.lower()))) for i, (label, text) in enumerate(templates)]


def _values(df: DataFrame, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table as literals in the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]

    def lit(v: object) -> str:
        return "array(" + ", ".join(lit(x) for x in v) + ")" if isinstance(v, tuple) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    table = df.sparkSession.sql(f"select * from values {body} as t({', '.join(names)})")
    return table.select(*[F.col(n).cast(k) for n, k in zip(names, kinds)])


def containment_join(docs: DataFrame, key: str, templates=TEMPLATES) -> DataFrame:
    """All (key, block, label, containment) of text blocks that hold a template: exact, and without a shuffle of texts."""
    ordered = ordered_templates(docs, templates)
    # One row for each template and word of its prefix: at most the templates' words, whatever the corpus.
    index = [(w, t.number, t.label, at, t.need, t.span, t.words) for t in ordered for at, w in enumerate(t.prefix)]
    prefixes = F.broadcast(_values(docs, "word string, template int, label string, at int, need int, span int, template_words array<string>", index))
    some = lambda words: F.array(*[F.lit(w) for w in sorted(words)])
    rarest, known = some({w for t in ordered for w in t.prefix}), some({w for t in ordered for w in t.words})
    # Only blocks with a word of a prefix go on, and of their words only the templates', each once.
    hit = blocks(docs, key).withColumn("rare", F.array_intersect("words", rarest)).where(F.size("rare") > 0)
    hit = hit.select("key", "block", "paragraph", "rare", F.array_intersect("words", known).alias("words"))
    held = hit.select("key", "block", "paragraph", "words", F.explode("rare").alias("word")).join(prefixes, "word")
    # Length and position: words enough in the block, and words enough of the template from this one on.
    held = held.where((F.size("words") >= F.col("need")) & (F.size("template_words") - F.col("at") >= F.col("need")))
    # A block meets a template at the first prefix word that it holds.
    held = held.where(~F.arrays_overlap("words", F.expr("slice(template_words, 1, at)")) | (F.col("at") == 0))
    held = held.where(F.size(F.array_intersect("words", "template_words")) >= F.col("need"))
    held = held.withColumn("shared", closest(F.col("paragraph"), F.col("template_words"), F.col("need"), F.col("span"))).where("shared >= need")
    return held.select("key", "block", "label", (F.col("shared") / F.size("template_words")).alias("containment")).distinct()


def _places(pieces: Column, words_of_phrase: int) -> Column:
    """Of a text split at a phrase: how often it stands there, and its first and last place; each piece is counted once."""
    n = F.size(pieces) - 1
    behind = F.aggregate(F.slice(pieces, 1, n), F.lit(0).cast("long"), lambda at, p: at + count_words(p))
    return F.struct(n.cast("long").alias("n"), count_words(F.get(pieces, F.lit(0))).alias("first"), (behind + (n - 1) * words_of_phrase).alias("last"))


def _phrase(phrase: str) -> str:
    return f"(?<!{_INSIDE})(?i:{_BETWEEN.join(phrase.split())})(?!{_INSIDE})"


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Nulls: null text is empty, a null doc_id is kept.  Equal rows give equal rows; templates that
    tie all give their labels.  A text of any length is scanned whole, in time that grows with
    its length.  The score is the best containment of a block, 1 where a phrase stands, 0 without
    a label.  An empty table gives no rows.  Other columns, whatever their names, are ignored.
    """
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key)
    maybe = F.col("text").rlike("(?i)license")  # every phrase ends in it
    out = rows.withColumn("n_words", count_words(F.col("text")))
    for i, (phrase, _) in enumerate(PHRASES):
        # The phrase stands between the pieces: the first behind the first piece, the last before the last one.
        pieces = F.split("text", _phrase(phrase), -1)
        out = out.withColumn(f"p{i}", F.when(maybe & F.col("text").rlike(_phrase(phrase)), _places(pieces, len(phrase.split()))))
    every = [F.col(f"p{i}") for i in range(len(PHRASES))]
    base = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for p, (_, label) in zip(every, PHRASES)]))
    n_base = sum((F.coalesce(p["n"], F.lit(0).cast("long")) for p in every[1:]), F.coalesce(every[0]["n"], F.lit(0).cast("long")))
    out = out.select("key", "doc_id", "n_words", n_base.alias("n_base"), F.least(*[p["first"] for p in every]).alias("first_word"), F.greatest(*[p["last"] for p in every]).alias("last_word"), base.alias("base"))
    matched = containment_join(rows, "key", templates).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    none = F.array().cast("array<string>")
    # A table of its own: of few rows as a rule, and rows of one id and text may be very many.
    return join_small(out, materialise(matched), "key", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle(templates=TEMPLATES) -> str:
    """DuckDB SQL for ``scan`` over the view documents: every paragraph with every template, by its lines and by its runs of words."""
    values = ", ".join(f"('{label}', {_split(text)!r}, {Template(0, label, (), len(re.findall(WORD, text.lower()))).span})" for label, text in templates)
    phrase = " union all ".join(
        f"select r, i - 1 as place, '{label}' as label from tokens, unnest(range(1, len(w) + 1)) as u(i) where "
        + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES
    )
    return f"""
with rows as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text from documents),
tokens as (select r, regexp_extract_all(text, '{WORD}') as w from rows),
places as ({phrase}),
base as (select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as base from places group by r),
templates as (select label, words, span, ceil({CONTAINMENT} * len(words) - 1e-9) as need from (values {values}) as t(label, words, span)),
paragraphs as (select r, p, regexp_extract_all(p, '{WORD}') as w from (select r, unnest(regexp_split_to_array(text, '\n[ \t\r\f\n]*\n')) as p from rows)),
held as (select r, p, w, label, words, span, need from paragraphs, templates where len(list_intersect(list_distinct(w), words)) >= need),
measured as (select r, label, need, len(words) as size, greatest(
    list_max(list_transform(string_split(p, chr(10)), lambda x: len(list_intersect(list_distinct(regexp_extract_all(x, '{WORD}')), words)))),
    list_max(list_transform(range(1, len(w) + 1), lambda i: len(list_intersect(list_distinct(w[i:i + span - 1]), words))))) as n from held),
matched as (select r, list(distinct label) as more, max(n / size) as best from measured where n >= need group by r)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') as labels,
  greatest(coalesce(best, 0.0), case when n_base > 0 then 1.0 else 0.0 end) as score
from rows join tokens using (r) left join base using (r) left join matched using (r)
"""
