"""License scans by a positional index of rare licence words.

A template is a licence's notice with the phrases it must hold word for word. Document frequencies of the templates' words
over all documents tell which of a template's mandatory words is rarest; the index has, for each such word, the templates and
the place it takes in them (a posting). A file's words are looked up in that index only: each hit puts a template at one
offset of the file. The template's other mandatory words, next rarest first, are then intersected by their place relative to
the hit, so an offset stays only if every mandatory phrase stands there, and the share of all template words that stand at
their place decides (`least` thousandths). A template whose mandatory phrase occurs is always found, since its rarest word
is one of it: nothing is capped, and the work of a text is its words plus its hits.

Phrases that are licence names on their own are templates whose words are all mandatory. The templates, hence the index, are
a parameter; frequencies are counted for their words alone (a few hundred rows). Everything is DataFrame functions in the
row; texts are not shuffled.

Defined cases: NULL and empty texts have no words, no licences, empty labels and score 0; texts that start or end within a
notice match if the share is reached; repeated rows are scanned each; equal frequencies go by word and place; other columns
are ignored, however they are named.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlens.llm import common as c

# What separates words, after A-Z were lowered.
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST = 700
MATCHES = "array<struct<label:string,name:string,start:bigint,share:double>>"


class Template(NamedTuple):
    label: str
    name: str
    text: str
    mandatory: tuple[str, ...]


# Licence names and notices.
PHRASES = (
    Template("mit", "mit license", "mit license", ("mit license",)),
    Template("apache", "apache license", "apache license", ("apache license",)),
    Template("gpl", "general public license", "general public license", ("general public license",)),
)
NOTICES = (
    Template("mit", "mit line", "Released under the MIT License", ("the mit license",)),
    Template(
        "mit", "mit notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    Template("apache", "apache line", "Licensed under the Apache License, Version 2.0", ("the apache license version 2 0",)),
    Template(
        "apache", "apache notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template("gpl", "gpl line", "licensed under the GNU General Public License, version 3", ("gnu general public license version",)),
    Template(
        "gpl", "gpl notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("free software", "gnu general public license"),
    ),
    Template(
        "lgpl", "lgpl notice", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "agpl", "agpl notice", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        ("gnu affero general public license",),
    ),
    Template(
        "bsd", "bsd notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template("mpl", "mpl notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("source code form", "mozilla public license")),
    Template(
        "isc", "isc notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template("cc-by", "cc-by line", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-nc", "cc-by-nc line", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "cc-by-sa line", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("unlicense", "unlicense notice", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.translate({k: k + 32 for k in range(65, 91)})) if w]


def mandatory_places(template: Template) -> list[int]:
    """The places of a template's words that its mandatory phrases cover, in order."""
    own, places = template_words(template.text), set()
    for phrase in map(template_words, template.mandatory):
        starts = [k for k in range(len(own) - len(phrase) + 1) if own[k : k + len(phrase)] == phrase]
        if not starts:
            raise ValueError(f"template {template.name!r} does not hold its phrase {' '.join(phrase)!r}")
        places |= set(range(starts[0], starts[0] + len(phrase)))
    if not places:
        raise ValueError(f"template {template.name!r} needs a mandatory phrase")
    return sorted(places)


def file_words(text: Column) -> Column:
    return F.array_remove(F.split(c.lower_ascii(F.coalesce(text, F.lit(""))), SPLIT), "")


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; one row per word reaches the driver."""
    held = F.array_intersect(file_words(F.col(text)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {word: 0 for word in vocabulary} | {r["word"]: r["count"] for r in rows}


def rare_index(templates: Sequence[Template], frequency: dict[str, int]) -> tuple[Column, Column, list[str]]:
    """(postings: map word -> [(template, place)], templates: [(label, name, named, words, mandatory (word, place), rarest first)], words)."""
    postings, entries = {}, []
    for number, template in enumerate(templates):
        own = template_words(template.text)
        rarest = sorted((frequency[own[k]], own[k], k) for k in mandatory_places(template))
        postings.setdefault(rarest[0][1], []).append((number, rarest[0][2]))
        entries.append(
            F.struct(
                F.lit(template.label).alias("label"), F.lit(template.name).alias("name"),
                F.array(*map(F.lit, own)).alias("words"),
                F.array(*(F.struct(F.lit(w).alias("word"), F.lit(k).alias("at")) for _, w, k in rarest)).alias("mandatory"),
            )
        )
    listed = [
        part
        for word, places in postings.items()
        for part in (F.lit(word), F.array(*(F.struct(F.lit(t).alias("template"), F.lit(k).alias("at")) for t, k in places)))
    ]
    return F.create_map(*listed), F.array(*entries), list(postings)


def _matches(words: Column, index: tuple[Column, Column, list[str]], least: int) -> Column:
    """(label, name, start, share) of every template that stands in the words, in order of its rarest word's places."""
    postings, templates, rare = index

    def placed(i: Column) -> Column:
        return F.transform(F.element_at(postings, F.get(words, i)), lambda p: F.struct(p["template"].alias("template"), (i - p["at"]).alias("start")))

    def aligned(hit: Column) -> Column:
        template = F.get(templates, hit["template"])
        stands = F.aggregate(
            F.transform(template["words"], lambda w, k: F.coalesce((F.get(words, hit["start"] + k) == w).cast("int"), F.lit(0))), F.lit(0), lambda a, x: a + x
        )
        return F.struct(
            template["label"].alias("label"), template["name"].alias("name"), hit["start"].cast("long").alias("start"), stands.alias("n"), F.size(template["words"]).alias("of")
        )

    def mandatory_stand(hit: Column) -> Column:
        return F.forall(F.get(templates, hit["template"])["mandatory"], lambda m: F.coalesce(F.get(words, hit["start"] + m["at"]) == m["word"], F.lit(False)))

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rare))
    offsets = F.filter(F.flatten(F.transform(places, placed)), mandatory_stand)
    found = F.filter(F.transform(offsets, aligned), lambda m: 1000 * m["n"] >= least * m["of"])
    shared = F.transform(found, lambda m: F.struct(m["label"], m["name"], F.greatest(m["start"], F.lit(0)).alias("start"), (m["n"] / m["of"]).alias("share")))
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, rare))), shared).otherwise(F.array().cast(MATCHES))


def scan_licenses(
    docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, least: int = LEAST, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, n_words, matches (label, name, start in words, share of the template's words)."""
    vocabulary = sorted({template_words(t.text)[k] for t in templates for k in mandatory_places(t)})
    index = rare_index(templates, document_frequencies(docs, vocabulary, text))
    found = c.let(file_words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _matches(w, index, least).alias("matches")))
    return docs.select(F.col(key), found.alias("_found")).select(key, "_found.n_words", "_found.matches")


def license_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    named = [t.name for t in PHRASES]
    base = F.filter("matches", lambda m: m["name"].isin(named))
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
