"""Licence recognition by known sentences and ordered rules, in DataFrame functions alone.

Indents, comment marks and bullets at the line starts are stripped. A text is cut into sentences (at ``.;:!?`` before white space, but not in
``v. 2.0``, and at blank lines); a line that starts with a lower-case letter goes on with the sentence before it. Any other line may start a sentence or
go on with one, so up to ``LINES`` such pieces are tried together, the longest known run first. Every sentence is normalised: lower case, everything but letters, digits and dots between digits replaced by one space. A literal map gives known
licence sentences their identifiers; the identifiers of a text, in order, are its sequence. A rule is a sequence of identifiers that must
occur in this order, other known sentences between them allowed. Rules are tried in their order; a rule may stand for several that it
implies, so the most particular ones come first and silence the rest.

Defined results: a null or empty text has no sentences and no licence; a sentence that occurs several times counts each time; null or
repeated ids make no difference; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of the notices that name them, normalised, by identifier.
SENTENCES = {
    1: "licensed under the apache license version 2.0",
    2: "licensed under the apache license version 2.0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "released under the mit license",
    5: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
       " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
       " publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do"
       " so subject to the following conditions",
    6: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    7: "this work is licensed under the gnu general public license version 3",
    8: "this program is free software",
    9: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
       " foundation either version 3 of the license or at your option any later version",
    10: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation either version 2 of the license or at your option any later version",
    11: "licensed under cc by nc 4.0",
    12: "licensed under cc by 4.0",
    13: "licensed under cc by sa 4.0",
    14: "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met",
    15: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    16: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in"
        " the documentation and or other materials provided with the distribution",
    17: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
    18: "this source code form is subject to the terms of the mozilla public license v 2.0",
    19: "licensed under the mit license",
    20: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation",
    21: "either version 2 of the license or at your option any later version",
    22: "either version 3 of the license or at your option any later version",
    23: "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
    24: "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
    25: "the name of the author may not be used to endorse or promote products derived from this software without specific prior written"
        " permission",
    26: "this library is free software",
    27: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free"
        " software foundation",
    28: "either version 2.1 of the license or at your option any later version",
    29: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free"
        " software foundation either version 3 of the license or at your option any later version",
    30: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"
        " the above copyright notice and this permission notice appear in all copies",
}
#: Sentences that the SQL knows.
SQL_SENTENCES = {number: SENTENCES[number] for number in range(1, 20)}
#: (licence, sequence of identifiers, licences that it silences), the most particular first.
SQL_RULES = (
    ("BSD-3-Clause", (14, 15, 16, 17), ("BSD-2-Clause",)),
    ("BSD-2-Clause", (14, 15, 16), ()),
    ("GPL-3.0-or-later", (8, 9), ("GPL-3.0",)),
    ("GPL-2.0-or-later", (8, 10), ()),
    ("GPL-3.0", (7,), ()),
    ("MIT", (5, 6), ()),
    ("MIT", (4,), ()),
    ("MIT", (19,), ()),
    ("Apache-2.0", (2, 3), ()),
    ("Apache-2.0", (1,), ()),
    ("MPL-2.0", (18,), ()),
    ("CC-BY-NC-4.0", (11,), ()),
    ("CC-BY-SA-4.0", (13,), ()),
    ("CC-BY-4.0", (12,), ()),
)
#: All rules: those of the SQL, and those on the sentences that it does not know.
RULES = (
    ("BSD-3-Clause", (14, 15, 16, 23), ("BSD-2-Clause",)),
    ("BSD-3-Clause", (14, 15, 16, 24), ("BSD-2-Clause",)),
    ("BSD-3-Clause", (14, 15, 16, 25), ("BSD-2-Clause",)),
    *SQL_RULES[:3],
    ("GPL-3.0-or-later", (8, 20, 22), ("GPL-3.0",)),
    SQL_RULES[3],
    ("GPL-2.0-or-later", (8, 20, 21), ()),
    ("LGPL-2.1-or-later", (26, 27, 28), ()),
    ("AGPL-3.0-or-later", (8, 29), ()),
    *SQL_RULES[4:],
    ("ISC", (30,), ()),
)
#: Pieces that may start a sentence or go on with one, tried together at most.
LINES = 12
#: Comment marks and bullets before the text of a line, and ends of comments after it.
_MARKS = "(?m)^[ \\t]*(?:(?:/\\*+|\\*+/?|//+|#+|;+|%+|<!--|-+|\\||\\u2022|dnl(?= )|REM(?= ))[!]?[ \\t]*)*"
_ENDS = "(?m)[ \\t]*(?:\\*+/|-->|\\*+$)?[ \\t\\r]*$"
_BREAK = "\x01"


def sentences(text: Column) -> Column:
    """Array of the normalised sentences of a text, in order, empty ones left out; ``_BREAK`` stands between pieces that may be one sentence."""
    plain = F.translate(F.coalesce(text, F.lit("")), _BREAK, " ")
    lines = F.regexp_replace(F.regexp_replace(plain, _MARKS, ""), _ENDS, "")
    joined = F.regexp_replace(lines, "(?<=[^.;:!?\\n])\\n(?=[a-z])", " ")
    joined = F.regexp_replace(joined, "(?<=[^.;:!?\\n])\\n(?=[^\\n])", _BREAK)
    joined = F.regexp_replace(joined, f"(?i)\\bv\\.[ {_BREAK}\\n]*(?=[0-9])", "v ")
    cut = F.split(F.regexp_replace(joined, f"[.;:!?]+([ \\t\\r\\n{_BREAK}]|\\z)", "\n"), "\n")

    def normalised(sentence: Column) -> Column:
        words = F.regexp_replace(F.lower(sentence), f"[^\\p{{L}}\\p{{N}}.{_BREAK}]+", " ")
        return F.regexp_replace(F.regexp_replace(words, f" *{_BREAK}[ {_BREAK}]*", _BREAK), f"^[ {_BREAK}]+|[ {_BREAK}]+$", "")

    return F.filter(F.transform(cut, normalised), lambda s: s != "")


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for number, sentence in SENTENCES.items() for x in (sentence, number)])
    lengths = sorted({len(s) for s in SENTENCES.values()})

    def of(sentence: Column) -> Column:
        return F.when(F.length(sentence).isin(lengths), F.try_element_at(known, sentence))  # most sentences go no further

    def runs(sentence: Column) -> Column:
        pieces = F.split(sentence, _BREAK)
        longest = [F.when(F.size(pieces) >= k, of(F.array_join(F.slice(pieces, 1, k), " "))) for k in range(LINES, 0, -1)]
        return F.coalesce(*longest)

    def starts(sentence: Column) -> Column:
        pieces = F.split(sentence, _BREAK)
        return F.transform(pieces, lambda _, i: F.array_join(F.slice(pieces, i + 1, LINES), _BREAK))

    tails = F.flatten(F.transform(sentences(text), lambda s: F.when(F.instr(s, _BREAK) > 0, starts(s)).otherwise(F.array(s))))
    return F.filter(F.transform(tails, lambda s: F.when(F.instr(s, _BREAK) > 0, runs(s)).otherwise(of(s))), lambda n: n.isNotNull())


def rule_pattern(sequence: tuple[int, ...]) -> str:
    """A pattern over identifiers written as `` 3  7  12 ``: the sequence in order, other identifiers between."""
    return "( [0-9]+ )*".join(f" {n} " for n in sequence)


def licences_of(ids: Column) -> Column:
    """Licences whose rules the identifiers match, in the order of the rules, without the silenced ones."""
    written = F.concat(F.lit(" "), F.array_join(ids.cast("array<string>"), "  "), F.lit(" "))
    matched = [(name, written.rlike(rule_pattern(sequence)), silenced) for name, sequence, silenced in RULES]
    silent = [F.when(hit, F.array(*map(F.lit, silenced))) for _, hit, silenced in matched if silenced]
    found = F.array_distinct(F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit, _ in matched])))
    for names in silent:
        found = F.array_except(found, F.coalesce(names, F.array().cast("array<string>")))
    return found


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, sentence_ids, licences, licence) of every document; ``licence`` is the first of its licences, null without one."""
    rows = docs.select(F.col(key), identifiers(F.col(text)).alias("sentence_ids"))
    found = rows.withColumn("licences", licences_of(F.col("sentence_ids")))
    return found.withColumn("licence", F.get("licences", F.lit(0)))


def scan_sql() -> str:
    """The same scan of ``documents`` as DuckDB SQL."""
    known = ", ".join(f"'{sentence}': {number}" for number, sentence in SQL_SENTENCES.items())
    hits: dict[str, list[str]] = {}
    for name, sequence, _ in SQL_RULES:
        hits.setdefault(name, []).append(f"regexp_matches(w, '{rule_pattern(sequence)}')")
    silenced = {name: [by for by, _, names in SQL_RULES if name in names] for name in hits}
    cases = ", ".join(
        f"CASE WHEN ({' OR '.join(tests)}) AND NOT ({' OR '.join(t for by in silenced[name] for t in hits[by]) or 'false'}) THEN '{name}' END"
        for name, tests in hits.items()
    )
    return f"""
WITH j AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '([^.;:!?\\n])\\n([a-z])', '\\1 \\2', 'g') AS t FROM documents
), s AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(t, '[.;:!?]+([ \\t\\r\\n]|\\z)', chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g'))) AS s FROM j
), i AS (
  SELECT doc_id, list_filter(list_transform(s, lambda x: MAP {{{known}}}[x]), lambda n: n IS NOT NULL) AS sentence_ids FROM s
), w AS (
  SELECT *, ' ' || coalesce(array_to_string(sentence_ids, '  '), '') || ' ' AS w FROM i
), l AS (
  SELECT doc_id, sentence_ids, list_filter([{cases}], lambda x: x IS NOT NULL) AS licences FROM w
)
SELECT doc_id, sentence_ids, licences, licences[1] AS licence FROM l
"""
