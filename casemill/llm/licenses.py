"""License scans by sentences: known licence sentences get identifiers, and licence rules are matched on their order.

A text is cut into sentences, which are normalised to lower-case words and looked up among known ones. What is left of a
text is a short sequence of identifiers, and a licence is recognised where the sentences of one of its rules stand in
their order and near one another: at most `BETWEEN` other known ones and less than `FAR` unknown sentences in a row come between. Rules of
a family are tried in turn, longer ones first, and what a rule has matched is no longer there for the next: every licence
of a text is named, and a short rule does not match inside the notice of a longer one.

A text is cut twice: at line ends, which finds notices without a full stop, and with lines joined, which finds sentences
that are wrapped. Texts without a word that every known sentence has one of are not cut at all. Everything is built-in
functions in one projection; no row moves.

Null and empty texts have no licence; repeated rows and null doc_ids are rows like others; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import texts_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of public licences and of the usual notices, normalised, by identifier.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    6: "see the license for the specific language governing permissions and limitations under the license",
    7: "released under the mit license",
    8: "licensed under the mit license",
    9: "the mit license mit",
    10: "mit license",
    11: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    12: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    13: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    14: "this work is licensed under the gnu general public license version 3",
    15: "this work is licensed under the gnu general public license version 2",
    16: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    17: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    18: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    19: "see the gnu general public license for more details",
    20: "licensed under cc by nc 4 0",
    21: "licensed under cc by 4 0",
    22: "licensed under cc by sa 4 0",
    23: "licensed under cc by nc sa 4 0",
    24: "licensed under cc by nd 4 0",
    25: "licensed under cc0 1 0",
    26: "this work is licensed under a creative commons attribution 4 0 international license",
    27: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    28: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    29: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    30: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    31: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    32: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    33: "all rights reserved",
    34: "this source code form is subject to the terms of the mozilla public license v 2 0",
    35: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    36: "this is free and unencumbered software released into the public domain",
    37: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    38: "licensed under the bsd license",
    39: "licensed under the gnu general public license version 3",
    40: "licensed under the gnu general public license version 2",
    41: "this work is licensed under the gnu lesser general public license version 3",
    42: "licensed under the mozilla public license version 2 0",
    # The pieces of 16, 17, 18 and 34 as their usual punctuation cuts them. The last wording is that of version 2.0 alone.
    43: "this program is free software",
    44: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    45: "either version 3 of the license or at your option any later version",
    46: "either version 2 of the license or at your option any later version",
    47: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    48: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    49: "this program is distributed in the hope that it will be useful but without any warranty",
    50: "without even the implied warranty of merchantability or fitness for a particular purpose",
    51: "this source code form is subject to the terms of the mozilla public license v",
    52: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
}
# Ways in which the two sentences of the GNU notice are cut.
GPL_3_OPENINGS = ((16,), (43, 47), (43, 44, 45))
GPL_2_OPENINGS = ((17,), (43, 48), (43, 44, 46))
NO_WARRANTY = ((18,), (49, 50))
# Rules in the order they are tried: family, licence, sentences in their order.
RULES = (
    ("apache", "Apache-2.0", (2, 3, 5, 6)),
    ("apache", "Apache-2.0", (2,)),
    ("apache", "Apache-2.0", (1,)),
    ("mit", "MIT", (11, 12, 13)),
    ("mit", "MIT", (7,)),
    ("mit", "MIT", (8,)),
    ("mit", "MIT", (9,)),
    ("mit", "MIT", (10,)),
    ("bsd", "BSD-3-Clause", (29, 30, 31, 32)),
    ("bsd", "BSD-2-Clause", (29, 30, 31)),
    ("bsd", "BSD", (38,)),
    *(("gpl", "GPL-3.0-or-later", (*x, *y, 19)) for x in GPL_3_OPENINGS for y in NO_WARRANTY),
    *(("gpl", "GPL-2.0-or-later", (*x, *y, 19)) for x in GPL_2_OPENINGS for y in NO_WARRANTY),
    ("gpl", "GPL-3.0", (14,)),
    ("gpl", "GPL-3.0", (39,)),
    ("gpl", "GPL-2.0", (15,)),
    ("gpl", "GPL-2.0", (40,)),
    ("lgpl", "LGPL-3.0", (41,)),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", (23,)),
    ("cc-by-nc", "CC-BY-NC-4.0", (20,)),
    ("cc-by-nc", "CC-BY-NC-4.0", (28,)),
    ("cc-by-sa", "CC-BY-SA-4.0", (22,)),
    ("cc-by-sa", "CC-BY-SA-4.0", (27,)),
    ("cc-by-nd", "CC-BY-ND-4.0", (24,)),
    ("cc-by", "CC-BY-4.0", (21,)),
    ("cc-by", "CC-BY-4.0", (26,)),
    ("cc0", "CC0-1.0", (25,)),
    ("mpl", "MPL-2.0", (34, 35)),
    ("mpl", "MPL-2.0", (34,)),
    ("mpl", "MPL-2.0", (51, 35)),
    ("mpl", "MPL-2.0", (51, 52)),
    ("mpl", "MPL-2.0", (51,)),
    ("mpl", "MPL-2.0", (42,)),
    ("unlicense", "Unlicense", (36,)),
    ("isc", "ISC", (37,)),
    ("reserved", "All-Rights-Reserved", (33,)),
)
#: Every known sentence has one of these; tests hold the list against it.
ANCHORS = ("licens", "copyright", "copies", "all rights reserved", "redistribution", "redistribute", "without warranty", "mpl", "unencumbered software",
           "free software", "without any warranty", "implied warranty")
#: Known sentences that may stand between two of a rule, and unknown ones in a row that keep them apart.
BETWEEN, FAR = 12, 20
FAR_APART = f"(?:u,){{{FAR},}}"
OUTER_MARKS = "(?:_,)+$|(?<=^,)(?:_,)+"
SENTENCE_END = r"[.!?;:]+([\x09-\x0D\x20]|$)"
BLANK_LINE = r"\n[\x09\x0B-\x0D\x20]*\n"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def _identified(cut: Column) -> Column:
    """Identifiers of the known sentences of a text that is cut by line feeds, as `,1,3,`; `_` stands where many unknown ones do."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, str(i))])
    ids = F.transform(F.split(cut, "\n"), lambda s: F.coalesce(F.try_element_at(known, normalised(s)), F.lit("u")))
    marked = F.regexp_replace(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")), FAR_APART, "_,")
    return F.regexp_replace(F.replace(marked, F.lit("u,"), F.lit("")), OUTER_MARKS, "")


def rule_pattern(sentences: tuple[int, ...]) -> str:
    """Finds the identifiers in their order, in a text of them in which each has commas of its own on both sides."""
    return f"(?:,[0-9]+,){{0,{BETWEEN}}}?".join(f",{i}," for i in sentences)


def families() -> dict[str, list[tuple[str, tuple[int, ...]]]]:
    out: dict[str, list[tuple[str, tuple[int, ...]]]] = {}
    for family, licence, sentences in RULES:
        out.setdefault(family, []).append((licence, sentences))
    return out


def longer_rules(rules: list[tuple[str, tuple[int, ...]]], k: int) -> list[int]:
    """Earlier rules that hold all sentences of rule `k`."""
    return [j for j in range(k) if set(rules[k][1]) <= set(rules[j][1])]


def _hits(ids: Column, rules: list[tuple[str, tuple[int, ...]]]) -> list[Column]:
    """Whether each rule matches what the rules before it have left."""
    left, out = F.replace(ids, F.lit(","), F.lit(",,")), []
    for _, sentences in rules:
        out.append(left.rlike(rule_pattern(sentences)))
        left = F.regexp_replace(left, rule_pattern(sentences), ",_,")
    return out


def _named(rules: list[tuple[str, tuple[int, ...]]]) -> list[Column]:
    """Licences of a family. A hit of one cut is part of a longer rule's notice if only the other cut shows that one whole."""
    line, joined = _hits(F.col("line_ids"), rules), _hits(F.col("joined_ids"), rules)
    out = []
    for k, (licence, _) in enumerate(rules):
        here, there = joined[k], line[k]
        for j in longer_rules(rules, k):
            here, there = here & ~(line[j] & ~joined[j]), there & ~(joined[j] & ~line[j])
        out.append(F.when(here | there, licence))
    return out


def sentence_ids(text: Column) -> tuple[Column, Column]:
    """The identifiers of a text cut at line ends, and of the text with its lines joined."""
    lines = F.regexp_replace(text, SENTENCE_END, "\n")
    joined = F.translate(F.regexp_replace(F.translate(F.regexp_replace(text, BLANK_LINE, "\x01"), "\n", " "), SENTENCE_END, "\x01"), "\x01", "\n")
    return _identified(lines), _identified(joined)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, line_ids, joined_ids, licences (in the order of the rules) for every row."""
    text = F.coalesce("text", F.lit(""))
    folded = F.translate(text, UPPER, LOWER)
    possible = folded.contains(ANCHORS[0])
    for anchor in ANCHORS[1:]:
        possible = possible | folded.contains(anchor)
    by_line, by_sentence = sentence_ids(text)
    found = texts_of(docs).withColumns({
        "line_ids": F.when(possible, by_line).otherwise(","), "joined_ids": F.when(possible, by_sentence).otherwise(",")})
    named = F.array_distinct(F.array_compact(F.array(*[c for rules in families().values() for c in _named(rules)])))
    known = (F.col("line_ids") != ",") & (F.col("line_ids") != ",,") | (F.col("joined_ids") != ",") & (F.col("joined_ids") != ",,")
    return found.select("doc_id", "line_ids", "joined_ids", F.when(known, named).otherwise(F.array().cast("array<string>")).alias("licences"))
