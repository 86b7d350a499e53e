"""Licence recognition by sentence rules.

Sentences are normalised and looked up among known licence sentences; the
identifiers found, in document order, are matched against ordered rules. The
first rule whose identifier sequence occurs consecutively names the licence.
Built-in functions only: no shuffle, one projection over the texts.

``SENTENCES`` and ``RULES`` are one-line notices; ``CANONICAL`` and
``CANONICAL_RULES`` are the sentences of the licences and their headers
themselves, which are mostly wrapped and inside comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (lower case; runs of
# anything but letters and digits are one blank), with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2-grant",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-warranty",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-grant",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "all rights reserved": "all-rights-reserved",
}
# Rules in order of precedence; each lists consecutive identifiers.
RULES = (
    ("Apache-2.0", ("apache-2-grant", "apache-2-compliance", "apache-2-warranty")),
    ("MIT", ("mit-grant", "mit-warranty")),
    ("GPL-3.0", ("gpl-3-grant",)),
    ("Apache-2.0", ("apache-2-grant",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("proprietary", ("all-rights-reserved",)),
)
# Sentences of the common licences and headers, normalised alike.
_GRANT = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version"
CANONICAL = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2-header",
    "apache license version 2 0 january 2004": "apache-2-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-permission",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-inclusion",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-disclaimer",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-permission",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorsement",
    _GRANT.format("general public license", "2"): "gpl-2-grant",
    _GRANT.format("affero general public license", "3"): "agpl-3-grant",
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-title",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-header",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permission",
}
# Rules over canonical sentences, in order; they go before RULES and are numbered after them.
CANONICAL_RULES = (
    ("Apache-2.0", ("apache-2-header",)),
    ("Apache-2.0", ("apache-2-title",)),
    ("MIT", ("mit-permission", "mit-inclusion", "mit-disclaimer")),
    ("MIT", ("mit-permission",)),
    ("BSD-3-Clause", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("BSD-2-Clause", ("bsd-permission", "bsd-source", "bsd-binary")),
    ("AGPL-3.0", ("agpl-3-grant",)),
    ("AGPL-3.0", ("agpl-3-title",)),
    ("LGPL-3.0", ("lgpl-3-title",)),
    ("GPL-3.0", ("gpl-3-title",)),
    ("GPL-2.0", ("gpl-2-grant",)),
    ("GPL-2.0", ("gpl-2-title",)),
    ("MPL-2.0", ("mpl-2-header",)),
    ("ISC", ("isc-permission",)),
)
_WORD = r"a-z0-9\x{80}-\x{10FFFF}"
#: a line without a word (blank, or a comment sign alone), or a stop before white space: always a sentence end
#: (one character class and no repeated group, which the pattern engine would follow on its stack, line by line)
HARD = rf"\n[^A-Z{_WORD}]*\n|[.!?](?=[ \t\r\f\x0B]|$)|[.!?]\n"


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES | CANONICAL) -> Column:
    """Identifiers of the known sentences of a text, in order of appearance (never null).

    A sentence ends at . ! ? before white space or the text's end, and at a
    line without a word. A single line break may end one or stand between two
    of its words; comment signs are white space. The text is normalised as a
    whole first, with one sign for an end and another for a line break, and the
    known sentences are looked for between signs, the longest first.
    """
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x02", " "), HARD, "\x01")
    marked = F.translate(marked, "\n", "\x02")
    # A-Z only: translate, not lower, so that other letters keep their case
    low = F.translate(marked, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(low, rf"[^\x01\x02{_WORD}]+", " ")
    plain = F.trim(F.regexp_replace(plain, " ?([\x01\x02]) ?", "$1"))
    longest = sorted(sentences, key=len, reverse=True)
    pattern = r"(?<![^\x01\x02])(?:" + "|".join(s.replace(" ", r"[ \x02]") for s in longest) + r")(?![^\x01\x02])"
    found = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: F.element_at(known, F.translate(s, "\x02", " ")))


def match_rules(ids: Column, rules=RULES, first=()) -> tuple[Column, Column]:
    """Licence of the first matching rule, and the rule's number from 1 (both null if none matches).

    The rules ``first`` go before ``rules`` but are numbered after them.
    """
    line = F.concat(F.lit("|"), F.concat_ws("|", ids), F.lit("|"))
    name, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    numbered = [*enumerate(first, len(rules) + 1), *enumerate(rules, 1)]
    for i, (licence, seq) in reversed(numbered):
        hit = F.contains(line, F.lit("|" + "|".join(seq) + "|"))
        name = F.when(hit, F.lit(licence)).otherwise(name)
        number = F.when(hit, F.lit(i)).otherwise(number)
    return name, number


def scan(docs: DataFrame, id_col="doc_id", text_col="text", sentences=SENTENCES | CANONICAL, rules=RULES, first=CANONICAL_RULES) -> DataFrame:
    """One row per document row: doc_id, sentence_ids (joined by |), n_sentences found, license, rule.

    Null, empty and licence-free texts have no identifiers and a null license;
    any number of blank or sign-only lines in a row is one sentence end.
    Repeated sentences repeat their identifier; a rule matches consecutive
    identifiers, other text between their sentences does not matter.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col).cast("string"), sentences).alias("ids"))
    name, number = match_rules(F.col("ids"), rules, first)
    return d.select("doc_id", F.concat_ws("|", "ids").alias("sentence_ids"), F.size("ids").alias("n_sentences"), name.alias("license"), number.alias("rule"))
