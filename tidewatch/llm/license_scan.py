"""License scans by sentence rules.

A text is normalised (lower case; runs of other than a-z and 0-9 become one
mark: of a sentence's end, a line's end or a space). Known license sentences
are found in it where they begin and end at the end of a sentence, a line or the
text; they may go over line ends, but not over sentence ends.
What remains is the sequence of their identifiers. Ordered rules, the more
specific first, name a license for a run of identifiers and consume it, so a
short notice inside a longer one isn't counted again; a mark stays in its place,
so identifiers that weren't neighbours don't become a run. Identifiers that no rule
consumes make the finding partial.

Everything is an expression over one row: no shuffle, no Python, and the size
of a text is bounded only by its row.

Defined cases: a null or empty text has no sentence and no license; a sentence
as often as it stands in the text; null or repeated ids get a row each;
an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns

#: Where sentences end: at . ! ? before white space, and at blank lines.
SENTENCE_END = r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n"

#: Known sentences as they are after normalisation; the place in the list is the identifier, from 1.
SENTENCES = [
    "this work is licensed under the gnu general public license version 3",
    "released under the mit license",
    "licensed under the apache license version 2 0",
    "licensed under cc by nc 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
]
#: Licenses and the identifiers that name them, in the order the rules are tried.
RULES = [
    ("MIT", [7, 8, 9, 10]),
    ("MIT", [7, 8, 9]),
    ("MIT", [7, 8]),
    ("BSD-3-Clause", [13, 14]),
    ("BSD-2-Clause", [13]),
    ("GPL-3.0-or-later", [15, 16]),
    ("GPL-3.0-or-later", [15]),
    ("Apache-2.0", [11, 12]),
    ("Apache-2.0", [11]),
    ("ISC", [17]),
    ("MPL-2.0", [18]),
    ("GPL-3.0-only", [1]),
    ("MIT", [2]),
    ("Apache-2.0", [3]),
    ("CC-BY-NC-4.0", [4]),
    ("CC-BY-4.0", [5]),
    ("CC-BY-SA-4.0", [6]),
]
#: What stays of a run that a rule has consumed.
MARK = "."


def normalised(text: Column) -> Column:
    """The text's words, parted by | where a sentence ends (as at either end of the text), a newline where a line does, or a space."""
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9.!? \t\r\n]", ","), SENTENCE_END, "|")
    spaced = F.regexp_replace(F.concat(F.lit("|"), marked, F.lit("|")), r"[^a-z0-9|\n]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"), r"[ \n]?\|[ \n|]*", "|")


def identifiers(text: Column) -> Column:
    """The sequence of known sentences' identifiers, as an array of strings."""
    known = F.create_map(*(F.lit(x) for k, s in enumerate(SENTENCES, 1) for x in (s, str(k))))
    any_ = "|".join(s.replace(" ", r"[ \n]") for s in sorted(SENTENCES, key=len, reverse=True))
    found = F.regexp_extract_all(normalised(text), F.lit(rf"(?<=[|\n])(?:{any_})(?=[|\n])"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))


def _run(ids: list[int]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (like <7><8>), licenses (|-joined, in the order found first by the rules), finding (none, partial, full)."""
    d = columns(docs, doc_id="doc_id", text="text")
    ids = F.coalesce(F.array_join(F.transform(identifiers(F.col("text")), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""), F.lit(""))
    d = d.select("doc_id", ids.alias("sentence_ids")).withColumn("rest", F.col("sentence_ids"))
    for k, (_, run) in enumerate(RULES):
        d = d.withColumn(f"r{k}", F.contains("rest", F.lit(_run(run)))).withColumn("rest", F.replace("rest", F.lit(_run(run)), F.lit(MARK)))
    found = F.array_distinct(F.filter(F.array(*(F.when(F.col(f"r{k}"), F.lit(name)) for k, (name, _) in enumerate(RULES))), lambda x: x.isNotNull()))
    finding = F.when(F.col("sentence_ids") == "", "none").when(~F.contains("rest", F.lit("<")), "full").otherwise("partial")
    return d.select("doc_id", "sentence_ids", F.array_join(found, "|").alias("licenses"), finding.alias("finding"))


def _oracle() -> str:
    steps, last = [], "ids"
    for k, (_, run) in enumerate(RULES):
        steps.append(f"s{k} AS (SELECT *, contains(rest{k}, '{_run(run)}') AS r{k}, replace(rest{k}, '{_run(run)}', '{MARK}') AS rest{k + 1} FROM {last})")
        last = f"s{k}"
    names = ", ".join(f"CASE WHEN r{k} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    order = list(dict.fromkeys(name for name, _ in RULES))
    first = ", ".join(f"'{x}'" for x in order)
    known = ", ".join(f"'{s}'" for s in SENTENCES)
    any_ = "|".join(s.replace(" ", "(?: |\\n\\n)") for s in sorted(SENTENCES, key=len, reverse=True))
    # Marks stand twice, as one match takes the mark that the next one would begin with.
    return f"""
WITH marked AS (
  SELECT doc_id, '|' || regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.!? \\t\\r\\n]', ',', 'g'), '{SENTENCE_END}', '|', 'g') || '|' AS t FROM documents),
norm AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[^a-z0-9|\\n]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '[ \\n]?\\|[ \\n|]*', '|', 'g') AS t FROM marked),
seq AS (
  SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(replace(t, '|', '||'), chr(10), chr(10) || chr(10)), '[|\\n]({any_})[|\\n]', 1),
    lambda x: '<' || list_position([{known}], replace(x, chr(10) || chr(10), ' ')) || '>'), '') AS sentence_ids
  FROM norm),
ids AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(sentence_ids, '') AS rest0 FROM seq),
{", ".join(steps)}
SELECT doc_id, sentence_ids,
  array_to_string(list_filter([{first}], lambda x: list_contains([{names}], x)), '|') AS licenses,
  CASE WHEN sentence_ids = '' THEN 'none' WHEN NOT contains(rest{len(RULES)}, '<') THEN 'full' ELSE 'partial' END AS finding
FROM {last}
"""


ORACLE = _oracle()
