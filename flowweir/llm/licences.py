"""Licence recognition by sentences: known sentences to identifiers, identifiers to rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.llm.text import full_text

# Sentences of public licence texts and notices, normalised (lower case,
# letters and digits only, single spaces).
SENTENCES = {
    "mit-notice": (
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the mit license",
        "the mit license",
        "the mit license mit",
        "mit license",
        "spdx license identifier mit",
    ),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions",
    ),
    "mit-condition": (
        "the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software",
    ),
    "as-is": (
        "the software is provided as is without warranty of any kind express or implied including "
        "but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement",
    ),
    "apache-notice": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0",
        "apache license version 2 0",
        "spdx license identifier apache 2 0",
    ),
    "apache-condition": (
        "you may not use this file except in compliance with the license",
    ),
    "apache-warranty": (
        "unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied",
    ),
    "gpl3-notice": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "gnu general public license version 3",
        "spdx license identifier gpl 3 0 only",
        "spdx license identifier gpl 3 0 or later",
    ),
    "gpl2-notice": (
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
        "spdx license identifier gpl 2 0 only",
        "spdx license identifier gpl 2 0 or later",
    ),
    "gpl-grant": (
        "this program is free software you can redistribute it and or modify it under the terms of "
        "the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version",
    ),
    "gpl-warranty": (
        "this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution",
    ),
    "bsd-names": (
        "neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission",
    ),
    "mpl-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    "cc-by-notice": (
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
    "cc-by-sa-notice": (
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international "
        "license",
    ),
    "cc-by-nc-notice": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 "
        "international license",
    ),
    "reserved": ("all rights reserved",),
}

# Rules as sequences of sentence identifiers, in order and next to each
# other once unknown sentences are left out. Longer rules of a licence come first.
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-notice", "apache-condition", "apache-warranty")),
    ("Apache-2.0", ("apache-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0", ("gpl-grant", "gpl-warranty")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("reserved", ("reserved",)),
)
# A rule that is the beginning of a longer one stands only where the longer one fails.
LONGER = {"BSD-2-Clause": "BSD-3-Clause"}

# Sentences end where the split of the SQL ends them; a line without letters and digits ends
# a paragraph. Upper-case letters mark both ends: none is left in a lower-case text.
PARAGRAPH_END = r"\n[^a-z0-9]*\n"
SENTENCE_END = r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|\n"


def _marked(text: Column) -> Column:
    """Words of a-z and 0-9 in lower case, with P and S for paragraph and sentence ends."""
    paragraphs = F.regexp_replace(F.lower(text), PARAGRAPH_END, "P")
    return F.regexp_replace(
        F.regexp_replace(paragraphs, SENTENCE_END, "S"), "[^a-z0-9PS]+", " "
    )


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences in the order of the text.

    A known sentence begins and ends at sentence or line ends and may run over
    such ends, but not over a paragraph end: licence texts are wrapped, and have
    colons and points inside their sentences. The longest one at a place counts.
    """
    known = [(s, name) for name, forms in SENTENCES.items() for s in forms]
    named = F.create_map(*[F.lit(x) for pair in known for x in pair])
    forms = sorted((s for s, _ in known), key=len, reverse=True)
    any_form = "|".join(s.replace(" ", "[ S]+") for s in forms)
    pattern = f"(?:^|(?<=[PS])) ?({any_form})(?= ?(?:[PS]|$))"
    hits = F.regexp_extract_all(_marked(text), F.lit(pattern), 1)
    return F.transform(hits, lambda s: F.element_at(named, F.regexp_replace(s, "[ S]+", " ")))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``sentence_ids`` (array, in text order) and ``licences`` (sorted array).

    A licence is found when one of its rules occurs in the sequence of known
    sentences. A null text counts as empty and has none. Equal rows get equal
    results, an empty table an empty one; texts are read whole. Columns other
    than id and text are ignored, so none can clash.
    """
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), full_text(f"`{text_col}`").alias("text"))
    sequenced = read.select("doc_id", _identifiers(F.col("text")).alias("sentence_ids"))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    holds: dict[str, Column] = {}
    for licence, rule in RULES:
        found = F.contains(line, F.lit(f",{','.join(rule)},"))
        holds[licence] = holds[licence] | found if licence in holds else found
    for short, longer in LONGER.items():
        holds[short] = holds[short] & ~holds[longer]
    licences = F.array_sort(
        F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in holds.items()]))
    )
    return sequenced.select("doc_id", "sentence_ids", licences.alias("licences"))
