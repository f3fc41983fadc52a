"""License scans by sentence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewarden.llm.common import pick, table

# Sentences of public licenses and notices, lower-cased, other characters than a-z and 0-9 as one blank.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to "
    "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to "
    "the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-file": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
    "with the license",
    "apache-file-2": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your option any later "
    "version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
}
#: Rules in the order in which they are tried: the license, and the sentences that must follow one another.
RULES = (
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("Apache-2.0", ("apache-file", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-notice", "apache-file-2", "apache-copy", "apache-basis")),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("Apache-2.0", ("apache-file",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
)

# Sentences of headers and further notices in their usual wording, as SENTENCE_END parts them.
HEADER_SENTENCES = {
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-at": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-url-2": "https www apache org licenses license 2 0",
    "free-program": "this program is free software",
    "free-library": "this library is free software",
    "gpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation either version 3 of the license or at your option any later version",
    "gpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation",
    "lgpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
    "published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
    "published by the free software foundation",
    "agpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license as "
    "published by the free software foundation either version 3 of the license or at your option any later version",
    "later-2": "either version 2 of the license or at your option any later version",
    "later-2-1": "either version 2 1 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl-without": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "number-2-0": "2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to "
    "this software to the public domain worldwide",
    "cc0-warranty": "this software is distributed without any warranty",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form "
    "or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc0-notice": "licensed under cc0 1 0",
    "cc0-notice-2": "released under cc0 1 0",
}
#: The third BSD condition names the holder.
BSD_NEITHER = (
    "^neither the names? of .+ may be used to endorse or promote products derived from this software without specific prior written "
    "permission$"
)
#: Tried before RULES.
HEADER_RULES = (
    ("Apache-2.0", ("apache-head", "apache-file-2", "apache-at", "apache-url", "apache-basis")),
    ("Apache-2.0", ("apache-head", "apache-file-2", "apache-at", "apache-url-2", "apache-basis")),
    ("Apache-2.0", ("apache-head", "apache-file-2")),
    ("GPL-3.0-or-later", ("free-program", "gpl3-redistribute", "gpl-hope", "gpl-without")),
    ("GPL-3.0-or-later", ("free-program", "gpl3-redistribute")),
    ("LGPL-3.0-or-later", ("free-program", "lgpl3-redistribute", "gpl-hope", "gpl-without")),
    ("LGPL-3.0-or-later", ("free-program", "lgpl3-redistribute")),
    ("LGPL-3.0-or-later", ("free-library", "lgpl3-redistribute", "lgpl-hope", "gpl-without")),
    ("LGPL-3.0-or-later", ("free-library", "lgpl3-redistribute")),
    ("LGPL-2.1-or-later", ("free-library", "lgpl-redistribute", "later-2-1", "lgpl-hope", "gpl-without")),
    ("LGPL-2.1-or-later", ("free-library", "lgpl-redistribute", "later-2-1")),
    ("AGPL-3.0-or-later", ("free-program", "agpl3-redistribute", "gpl-hope", "gpl-without")),
    ("AGPL-3.0-or-later", ("free-program", "agpl3-redistribute")),
    ("GPL-2.0-or-later", ("free-program", "gpl-redistribute", "later-2", "gpl-hope", "gpl-without")),
    ("GPL-2.0-or-later", ("free-program", "gpl-redistribute", "later-2")),
    ("MPL-2.0", ("mpl-form", "number-2-0", "mpl-copy")),
    ("MPL-2.0", ("mpl-form", "number-2-0", "mpl-copy-2")),
    ("MPL-2.0", ("mpl-form", "number-2-0")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant-2", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-2",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-neither")),
    ("CC0-1.0", ("cc0-dedicated", "cc0-warranty")),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("CC0-1.0", ("cc0-notice-2",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-4.0", ("cc-by-work",)),
)

ALL_SENTENCES, ALL_RULES = SENTENCES | HEADER_SENTENCES, HEADER_RULES + RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends at a mark before white space or the end, and at an empty line.
SENTENCE_END = r"[.!?:;]+([\x09-\x0D\x20]+|\z)|\n[\x09-\x0D\x20]*\n"
#: A known sentence also begins at the beginning of a line, after marks of comments and lists: its first words tell.
FIRST_WORDS = 4
LINE_START = "\\n[^a-z0-9\\n]*(" + "|".join(
    sorted({"[^a-z0-9\\x01]+".join(words.split()[:FIRST_WORDS]) for words in ALL_SENTENCES.values() if len(words.split()) >= FIRST_WORDS})
) + ")"
OTHER = r"[^a-z0-9\x01]+"
#: Stands for any run of sentences that are not known, and for what a rule has explained.
UNKNOWN, EXPLAINED = "~", "*"


def _mark(name: str) -> str:
    return f"<{name}>"


def _pattern(names: tuple[str, ...]) -> str:
    return "".join(map(_mark, names))


def sentence_marks(text: Column) -> Column:
    """The known sentences of a text in order as ``<name>``, runs of other sentences as ``~``; numbers of lists and empty ones are none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    flat = F.regexp_replace(F.regexp_replace(low, F.lit(LINE_START), F.lit("\x01$1")), F.lit(SENTENCE_END), F.lit("\x01"))
    sentences = F.split(F.regexp_replace(flat, F.lit(OTHER), F.lit(" ")), "\x01")
    known = F.create_map(*[F.lit(x) for name, words in ALL_SENTENCES.items() for x in (words, _mark(name))])
    mark = lambda s: F.coalesce(
        F.try_element_at(known, s), F.when(s.rlike("^[0-9]{0,2}$"), ""), F.when(s.rlike(BSD_NEITHER), _mark("bsd-neither")), F.lit(UNKNOWN),
    )
    marks = F.transform(F.transform(sentences, lambda s: F.trim(s)), mark)
    return F.regexp_replace(F.array_join(marks, ""), F.lit(f"{UNKNOWN}+"), F.lit(UNKNOWN))


def recognise(docs: DataFrame) -> DataFrame:
    """``doc_id, licenses, sentences, n_unexplained`` for every row of ``docs`` (``doc_id, text``).

    Rules are tried in order; a rule holds where its sentences stand next to one
    another, and explains them, so that no later rule takes them again.
    ``licenses`` are the names found, in rule order, each once, joined by commas.
    ``sentences`` are the known sentences in order, ``n_unexplained`` those that
    no rule took. NULL and empty texts have none. Rows are judged one by one
    without any shuffle, so repeated rows, NULL ids and ties need no care; the
    work is linear in the text.
    """
    rules = F.array(*[F.struct(F.lit(license).alias("license"), F.lit(_pattern(names)).alias("pattern")) for license, names in ALL_RULES])
    rows = pick(docs, "doc_id", "text").select("doc_id", sentence_marks(F.col("text")).alias("marks"))
    start = F.struct(F.col("marks").alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.when(
        F.contains(acc["left"], r["pattern"]),
        F.struct(
            F.replace(acc["left"], r["pattern"], F.lit(EXPLAINED)).alias("left"),
            F.array_append(acc["found"], r["license"]).alias("found"),
        ),
    ).otherwise(acc)
    # texts without a known sentence need no rules
    none = F.struct(F.lit(UNKNOWN).alias("left"), F.array().cast("array<string>").alias("found"))
    rows = rows.withColumn("result", F.when(F.contains("marks", F.lit("<")), F.aggregate(rules, start, step)).otherwise(none))
    marked = lambda c: F.regexp_extract_all(c, F.lit("<([^>]+)>"), F.lit(1))
    return rows.select(
        "doc_id", F.array_join(F.array_distinct("result.found"), ",").alias("licenses"),
        F.array_join(marked(F.col("marks")), ",").alias("sentences"),
        F.size(marked(F.col("result.left"))).cast("long").alias("n_unexplained"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    """From the same sentences and rules as the query."""
    known = " ".join(f"WHEN trim(s) = {_quoted(words)} THEN {_quoted(_mark(name))}" for name, words in ALL_SENTENCES.items())
    others = (
        f"WHEN regexp_matches(trim(s), '^[0-9]{{0,2}}$') THEN '' WHEN regexp_matches(trim(s), {_quoted(BSD_NEITHER)}) "
        f"THEN {_quoted(_mark('bsd-neither'))} ELSE {_quoted(UNKNOWN)}"
    )
    query = (
        "SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace("
        f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_quoted(LINE_START)}, chr(1) || '\\1', 'g'), "
        f"{_quoted(SENTENCE_END)}, chr(1), 'g'), {_quoted(OTHER)}, ' ', 'g'), chr(1)), "
        f"lambda s: CASE {known} {others} END), ''), '{UNKNOWN}+', '{UNKNOWN}', 'g') AS marks FROM documents"
    )
    query = f"SELECT doc_id, marks, marks AS rest, []::VARCHAR[] AS found FROM ({query})"
    for license, names in ALL_RULES:
        p = _quoted(_pattern(names))
        query = (
            f"SELECT doc_id, marks, replace(rest, {p}, '{EXPLAINED}') AS rest, CASE WHEN contains(rest, {p}) AND NOT "
            f"list_contains(found, {_quoted(license)}) THEN list_append(found, {_quoted(license)}) ELSE found END AS found FROM ({query})"
        )
    return (
        "SELECT doc_id, coalesce(array_to_string(found, ','), '') AS licenses, "
        "coalesce(array_to_string(regexp_extract_all(marks, '<([^>]+)>', 1), ','), '') AS sentences, "
        f"CAST(len(regexp_extract_all(rest, '<([^>]+)>', 1)) AS BIGINT) AS n_unexplained FROM ({query})"
    )


SQL = _sql()
