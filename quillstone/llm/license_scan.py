"""License scans: exact phrases, and an exact set-similarity join against templates.

Built from DataFrame functions only. One pass over the texts finds the base
phrases and keeps the text of the documents whose words could hold a template
at all (a necessary condition, as a block's words are among its document's).
The rest is a prefix-filtered set-similarity join of those documents' blocks:
template words are put in the order of their document frequency in the whole
corpus, rarest first; a block that holds the required share of a template must
have one of the template's first ``size - needed + 1`` words; length and
positional bounds cut the candidates; overlaps are then counted in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.storage import stash

NAME = "op3_license_scan"
#: The share of a template's distinct words that a block must have.
CONTAINMENT = 0.9
# The base phrases, and the notices of public licences, each with its label. A template of several sentences stands for a paragraph; two words joined by _ are one element, which a block has where they follow each other.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions",
    ),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied"),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement. in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "isc",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall "
        "the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of "
        "the license or at your option any later version",
    ),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version "
        "of the license or at your option any later version",
    ),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
        "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by", "licensed under cc by_4 0"),
    ("cc-by-nc", "licensed under cc by_nc 4 0"),
    ("cc-by-sa", "licensed under cc by_sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "all rights reserved"),
)
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Blocks are lines, cut further after a full stop, mark or semicolon before white space.
BLOCK = r"\n|[.!?;](?=[ \t\r\n])"
#: Sentences, which go on over line ends up to a blank line; those of several lines are blocks as well, for notices that are wrapped.
SENTENCE = r"\n[ \t\r]*\n|[.!?;](?=[ \t\r\n])"
#: Paragraphs; those of several sentences are blocks for the templates that have several.
PARAGRAPH, ENDED = r"\n[ \t\r]*\n", r"[.!?;][ \t\r\n]"


def template_words(text: str) -> list[str]:
    return sorted(set(text.replace(".", " ").split()))


def is_paragraph(text: str) -> bool:
    return "." in text


def split_words(text: Column) -> Column:
    """The runs of digits, letters and non-ASCII characters of a lower-cased text."""
    return F.filter(F.split(text, SEPARATOR), lambda w: w != "")


def elements(words: Column, pairs: list[str]) -> Column:
    """The words, and those of the given pairs of words that follow each other among them."""
    def with_pairs(own: Column) -> Column:
        def there(pair: str) -> Column:
            a, b = pair.split("_")
            return F.array_contains(own, a) & F.array_contains(own, b) & F.contains(F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")), F.lit(f" {a} {b} "))

        return F.concat(own, F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in pairs])))

    # the lambda's argument keeps the words from being computed anew at each place they are used
    return F.get(F.transform(F.array(words), with_pairs), F.lit(0)) if pairs else words


def phrase_starts(words: Column, phrase: str) -> Column:
    """The places (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i):
        found = F.element_at(words, i + 1) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (F.element_at(words, i + 1 + k) == p)
        return found

    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("start"), F.lit(label).alias("label")))


def needed(size: int, containment: float) -> int:
    return max(1, math.ceil(containment * size - 1e-9))


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """(rows, matches) of ``docs`` (doc_id, text; other columns are ignored).

    rows: row_no, doc_id, n_words, hits (array of start and label of each
    place of a base phrase). matches: row_no, block_no, template, label,
    containment of each template and each block that has the required share
    of its elements. Blocks are numbered lines first, then sentences
    of several lines, then paragraphs of several sentences. A null
    or empty text has no words and no blocks; repeated rows stay apart by
    row_no; lower-casing follows Unicode, which changes none of the words
    that templates or phrases consist of.
    """
    sets = [(k, label, template_words(t)) for k, (label, t) in enumerate(templates)]
    wide = {k for k, (_, t) in enumerate(templates) if is_paragraph(t)}
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    pairs = [w for w in vocabulary if "_" in w]
    low = F.lower(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", low.alias("low")).withColumn("words", split_words(F.col("low")))
    hits = F.array_sort(F.concat(*[labelled(phrase_starts(F.col("words"), p), label) for p, label in PHRASES.items()]))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    own = F.array_intersect(elements(F.col("words"), pairs), F.array(*map(F.lit, vocabulary)))
    could = F.lit(False)
    for _, _, ws in sets:
        could = could | (F.size(F.array_intersect("own", F.array(*map(F.lit, ws)))) >= needed(len(ws), containment))
    rows = stash(
        base.withColumn("own", own)
        .select(
            F.monotonically_increasing_id().alias("row_no"), "doc_id", F.size("words").cast("bigint").alias("n_words"), "own",
            F.when(F.array_contains("own", "license"), hits).otherwise(none).alias("hits"),
            F.when(could, F.col("low")).alias("low"),
        ),
        "license-rows",
    )
    # at most one row a template word: its document frequency over the whole corpus
    seen = {r["w"]: r["n"] for r in rows.select(F.explode("own").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    prefix = []
    for k, label, ws in sets:
        ws = sorted(ws, key=order.get)
        need = needed(len(ws), containment)
        prefix += [(w, k, label, i, len(ws), need, ws, k in wide) for i, w in enumerate(ws[: len(ws) - need + 1])]
    spark = docs.sparkSession
    table = spark.createDataFrame(prefix, "w string, template int, label string, i int, size int, need int, ws array<string>, wide boolean")
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
    several_lines = F.filter(F.split("low", SENTENCE), lambda x: F.trim(x, F.lit(" \t\r\n")).contains("\n"))
    several_sentences = F.filter(F.split("low", PARAGRAPH), lambda x: x.rlike(ENDED))

    def of_kind(parts: Column, is_paragraph: bool) -> Column:
        return F.transform(parts, lambda x: F.struct(x.alias("text"), F.lit(is_paragraph).alias("is_paragraph")))

    kinds = [of_kind(F.split("low", BLOCK), False), of_kind(several_lines, False), of_kind(several_sentences, True)]
    blocks = (
        rows.filter("low IS NOT NULL")
        .select("row_no", F.posexplode(F.concat(*kinds)).alias("block_no", "block"))
        .select("row_no", "block_no", "block.is_paragraph", split_words(F.col("block.text")).alias("b"))
        .withColumn("b", F.array_intersect(elements(F.col("b"), pairs), F.array(*map(F.lit, vocabulary))))
        .filter(F.size("b") > 0)
        .withColumn("b", F.transform(F.array_sort(F.transform("b", lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda s: s.w))
    )
    tokens = blocks.select("row_no", "block_no", "is_paragraph", "b", F.size("b").alias("n"), F.posexplode("b").alias("j", "w"))
    bound = F.least("i", "j") + 1 + F.least(F.col("size") - F.col("i") - 1, F.col("n") - F.col("j") - 1)
    found = (
        tokens.join(F.broadcast(table), "w")  # a row for each prefix word of the templates given
        .filter((F.col("n") >= F.col("need")) & (bound >= F.col("need")) & (F.col("wide") | ~F.col("is_paragraph")))
        .withColumn("overlap", F.size(F.array_intersect("b", "ws")))
        .filter("overlap >= need")
        .groupBy("row_no", "block_no", "template", "label")
        .agg(F.max("overlap").alias("overlap"), F.max("size").alias("size"))
    )
    matches = found.select("row_no", "block_no", "template", "label", (F.col("overlap") / F.col("size")).alias("containment"))
    return rows.select("row_no", "doc_id", "n_words", "hits"), matches


def digest(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """A row per document: counts and places of base phrases, labels, and the best containment (1 with a base phrase)."""
    own = matches.groupBy("row_no").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = F.array_distinct(F.transform("hits", lambda h: h.label))
    return rows.join(own, "row_no", "left").select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_base"),
        F.array_min(F.transform("hits", lambda h: h.start)).alias("first_word"),
        F.array_max(F.transform("hits", lambda h: h.start)).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("hits") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(*scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _oracle() -> str:
    phrases = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        phrases.append(f"SELECT row_no, i AS start, '{label}' AS label FROM (SELECT row_no, w, unnest(range(len(w) - {len(parts) - 1})) AS i FROM d) WHERE {same}")
    sets = [(k, label, template_words(t), is_paragraph(t)) for k, (label, t) in enumerate(TEMPLATES)]
    rows = ", ".join(f"({k}, '{label}', {ws!r}, {needed(len(ws), CONTAINMENT)}, {wide})" for k, label, ws, wide in sets)
    pairs = sorted({w for _, _, ws, _ in sets for w in ws if "_" in w})
    firsts, seconds = (sorted({p.split("_")[k] for p in pairs}) for k in (0, 1))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM documents),
h AS ({" UNION ALL ".join(phrases)}),
t(template, label, ws, need, wide) AS (VALUES {rows}),
s AS (SELECT row_no, low, regexp_replace(low, '[.!?;]([ \t\r\n])', chr(1) || '\1', 'g') AS cut FROM d),
x AS (SELECT row_no, false AS is_paragraph, unnest(string_split_regex(cut, '[' || chr(1) || '\n]')) AS x FROM s
      UNION ALL SELECT * FROM (SELECT row_no, false, unnest(string_split(regexp_replace(cut, '\n[ \t\r]*\n', chr(1), 'g'), chr(1))) AS x FROM s) WHERE contains(trim(x, ' ' || chr(9) || chr(13) || chr(10)), chr(10))
      UNION ALL SELECT * FROM (SELECT row_no, true, unnest(string_split_regex(low, '\n[ \t\r]*\n')) AS x FROM s) WHERE regexp_matches(x, '[.!?;][ \t\r\n]')),
r AS (SELECT row_number() OVER () AS block, row_no, is_paragraph, regexp_extract_all(x, '{word}') AS w FROM x),
b AS (SELECT block, row_no, is_paragraph, list_distinct(CASE WHEN list_has_any(w, {firsts!r}) AND list_has_any(w, {seconds!r})
    THEN list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) ELSE w END) AS b FROM r),
m AS (SELECT row_no, block, template, label, len(list_intersect(b, ws)) AS o, len(ws) AS size FROM b, t WHERE len(b) >= need AND (wide OR NOT is_paragraph) AND len(list_intersect(b, ws)) >= need),
g AS (SELECT row_no, list(DISTINCT label) AS more, max(o / size) AS best FROM m GROUP BY row_no),
a AS (SELECT row_no, count(*) AS n, min(start) AS f, max(start) AS z, list(DISTINCT label) AS labels FROM h GROUP BY row_no)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f AS first_word, z AS last_word,
  array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN a USING (row_no) LEFT JOIN g USING (row_no)
"""


ORACLE = _oracle()
