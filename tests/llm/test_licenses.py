"""Licence scans against a plain computation, on odd texts."""

import re

import pytest
from pyspark.sql import functions as F

from spreadlens.llm import license_scan as ls

TEXTS = [
    None, "", " \t\n", "license", "MIT License", "The MIT-license and the mit LICENSE; MIT\x00license mit licensé", "Released under the MIT License." * 3,
    "Apache License " * 4000, "gnu general public license version " * 500, "a" * 50_000 + " apache license",
    "hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "X permission is hereby granted free of charge to any person obtaining a copy of this software and some other documentation files "
    "the software to deal in the software without restriction",
    "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "licensed under cc by-nc 4.0", "Licensed under CC BY 4.0", "cc by nc", "über mit license über general public license", "general public\nlicense", "license mit",
]


def plain(text, templates=ls.PHRASES + ls.NOTICES, least=ls.LEAST):
    lowered = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for t in templates:
        own = ls.template_words(t.text)
        must = set(ls.mandatory_places(t))
        for start in range(-len(own), len(words)):
            stands = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(own)]
            if all(stands[k] for k in must) and 1000 * sum(stands) >= least * len(own):
                found.append((t.label, t.name, max(start, 0), sum(stands) / len(own)))
    return len(words), found


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(TEXTS)] + [(3, "mit license", "x", 0), (3, "mit license", "x", 0), (None, "apache license", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, matches string, n_words int")


def test_every_match_of_every_template(texts):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, sorted(map(tuple, r.matches))) for r in ls.scan_licenses(texts).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, plain(r.text)[0], sorted(plain(r.text)[1])) for r in texts.collect() if len(r.text or "") < 100_000)
    assert got == want


def test_digest(texts):
    names = {t.name for t in ls.PHRASES}
    for r in ls.license_digest(texts).where("doc_id is not null and doc_id <> 3").collect():
        n, found = plain(TEXTS[r.doc_id])
        base = [m for m in found if m[1] in names]
        starts = [m[2] for m in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({m[0] for m in base})) and r.labels == ",".join(sorted({m[0] for m in found}))
        assert r.score == max((m[3] for m in found), default=0.0)


def test_rarest_word_is_the_anchor_and_every_frequency_gives_the_same_matches(texts):
    vocabulary = sorted({w for t in ls.PHRASES + ls.NOTICES for w in ls.template_words(t.text)})
    frequency = {w: k for k, w in enumerate(vocabulary)}
    _, _, rare = ls.rare_index(ls.PHRASES, frequency)
    assert rare == ["license", "apache", "general"] and ls.rare_index(ls.PHRASES, frequency | {"mit": -1})[2][0] == "mit"


def test_no_documents(spark, nothing):
    assert ls.license_digest(nothing).collect() == []


def test_template_must_hold_its_phrase(spark):
    with pytest.raises(ValueError, match="does not hold"):
        ls.mandatory_places(ls.Template("x", "x", "one two", ("two one",)))


def test_stays_native_and_in_the_row(texts):
    plan = ls.license_digest(texts.select(F.col("doc_id"), "text"))._jdf.queryExecution().toString()
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "Exchange", "Join"))
