"""Licences by sentence rules.

A text is cut into sentences, each is normalised and looked up among known
licence sentences; the identifiers found stand in the order of the text. Rules,
tried in their order, are sequences of identifiers that together are a licence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import let

# Sentences of public licence texts and notices, normalised. Where a
# blank line or a list cuts the text, or does not, both forms are here.
SENTENCES = {
    "mit-title": ("mit license", "the mit license", "the mit license mit"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute"
        " sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions the above copyright notice and this"
        " permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mit-permission": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute"
        " sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions",
    ),
    "mit-clause": (
        "the above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the software",
        "the above copyright notice and this permission notice including the next paragraph shall be"
        " included in all copies or substantial portions of the software",
    ),
    "mit-warranty": (
        "the software is provided as is without warranty of any kind express or implied including but"
        " not limited to the warranties of merchantability fitness for a particular purpose and"
        " noninfringement",
    ),
    "mit-notice": (
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the mit license",
        "distributed under the mit license",
    ),
    "apache-notice": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "this project is licensed under the apache license version 2 0",
    ),
    "apache-limit": (
        "you may not use this file except in compliance with the license",
    ),
    "apache-copy": (
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may obtain a copy of the license at https www apache org licenses license 2 0",
    ),
    "apache-obtain": ("you may obtain a copy of the license at",),
    "apache-url": (
        "http www apache org licenses license 2 0",
        "https www apache org licenses license 2 0",
    ),
    "bsd-title": ("bsd license", "the bsd license", "licensed under the bsd license"),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        # the number of the first condition, in lists without blank lines
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met 1",
    ),
    "bsd-grant-source": (
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met redistributions of source code must retain"
        " the above copyright notice this list of conditions and the following disclaimer",
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions"
        " and the following disclaimer",
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of"
        " conditions and the following disclaimer in the documentation and or other materials provided"
        " with the distribution",
    ),
    "bsd-name": (
        "neither the name of the copyright holder nor the names of its contributors may be used to"
        " endorse or promote products derived from this software without specific prior written"
        " permission",
    ),
    "gpl3-notice": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "licensed under the gnu gpl version 3",
    ),
    "gpl2-notice": (
        "licensed under the gnu general public license version 2",
        "this work is licensed under the gnu general public license version 2",
    ),
    "gpl3-grant": (
        "this program is free software you can redistribute it and or modify it under the terms of the"
        " gnu general public license as published by the free software foundation either version 3 of"
        " the license or at your option any later version",
    ),
    "gpl2-grant": (
        "this program is free software you can redistribute it and or modify it under the terms of the"
        " gnu general public license as published by the free software foundation either version 2 of"
        " the license or at your option any later version",
    ),
    "gpl-copy": (
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "mpl-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        # cut after "v."; no other version has this wording
        "this source code form is subject to the terms of the mozilla public license v",
    ),
    "cc-by-notice": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "cc-by-sa-notice": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    "cc-by-nc-notice": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
}
# Rules in the order in which they are tried.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-warranty")),
    ("MIT", ("mit-title", "mit-permission", "mit-clause", "mit-warranty")),
    ("MIT", ("mit-permission", "mit-clause", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-grant-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-limit", "apache-copy")),
    ("Apache-2.0", ("apache-notice", "apache-limit", "apache-obtain", "apache-url")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("BSD", ("bsd-title",)),
    ("MIT", ("mit-title",)),
)
# Every known sentence holds one of these; other texts are not cut up at all.
TRIGGER = "(?i)licen|permission|redistribut|warrant|copyright"
SENTENCE_END = r"(?<![.!?])[.!?]++(?:\s++|$)|\n\s*\n"


def known_sentences() -> dict[str, str]:
    return {text: name for name, texts in SENTENCES.items() for text in texts}


def normalised(sentence: Column) -> Column:
    """Lower-case letters and digits, single blanks; comment marks and layout go."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences of a text; one that runs over several lines is followed by its lines."""

    def with_lines(sentence: Column) -> Column:
        lines = F.split(sentence, "\n")
        return F.when(F.size(lines) > 1, F.concat(F.array(sentence), lines)).otherwise(F.array(sentence))

    return F.flatten(F.transform(F.split(text, SENTENCE_END), with_lines))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in the order of the text."""
    pairs = [F.lit(x) for pair in known_sentences().items() for x in pair]
    found = F.transform(
        sentences(text), lambda s: F.try_element_at(F.create_map(*pairs), normalised(s))
    )
    none = F.array().cast("array<string>")
    return F.when(text.rlike(TRIGGER), F.array_compact(found)).otherwise(none)


def applied(sequence: Column) -> Column:
    """Rules rewrite ``;a;;b;`` (identifiers in semicolons) to ``;=LICENCE;``, in their order."""
    pattern = lambda names: "".join(f";{n};" for n in names)
    return reduce(
        lambda s, rule: F.replace(s, F.lit(pattern(rule[1])), F.lit(f";={rule[0]};")), RULES, sequence
    )


def recognise(docs: DataFrame) -> DataFrame:
    """Per document: known sentences, licences in order, and sentences no rule used.

    Everything happens inside a row, so no row is shuffled and no hot group
    exists. Null and empty texts have none of these (0 and empty strings);
    repeated rows are judged one by one; an empty table gives no rows.
    """

    def judged(ids: Column) -> Column:
        rest = applied(F.array_join(F.transform(ids, lambda i: F.concat(F.lit(";"), i, F.lit(";"))), ""))
        return F.struct(
            F.size(ids).cast("long").alias("n_sentences"),
            F.array_join(ids, ",").alias("sentence_ids"),
            F.array_join(F.regexp_extract_all(rest, F.lit(";=([^;]*);"), F.lit(1)), ",").alias("licenses"),
            F.array_join(F.regexp_extract_all(rest, F.lit(";([^=;][^;]*);"), F.lit(1)), ",").alias("unmatched"),
        )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", let(sentence_ids(text), judged).alias("j")).select("doc_id", "j.*")
