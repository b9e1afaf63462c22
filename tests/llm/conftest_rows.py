"""Odd documents for the tests."""

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG_WORD = "x" * 30_000
PROSE = "It was a bright cold day in April, and the clocks were striking thirteen. "


def rows():
    """Documents with NULLs, empty and long texts, ties, repeated rows and shared passages."""
    passage = "this passage of well over fifty bytes stands in several of the documents, word for word. "
    out = [
        (1, PROSE * 3, "en", "a"), (2, PROSE * 3, "en", "a"), (3, (PROSE * 3).upper(), "en", None), (4, None, "en", "b"), (5, "", None, "b"),
        (6, " \t\n", "en", "c"), (7, "one", "en", "c"), (8, "One", "de", "c"), (9, passage + "and then something of its own", "en", "a"),
        (10, "something else first, and then: " + passage, "fr", ""), (11, LONG_WORD + " " + "word " * 20_000, "en", "a"),
        (12, "Grüße, naïve café \U0001f600 é " * 30, "de", "b"), (None, "a row without an id", "en", "a"), (None, None, None, None),
        (13, "one two one two three four\nline\nline\n\nline", "en", "d"), (13, "one two one two three four\nline\nline\n\nline", "en", "d"),
        (14, "it's <|endoftext|> 42% of $9, isn't it? <|ENDOFTEXT|>", "en", "d"), (-5, passage * 2, "en", "a"),
        (15, " ".join(f"w{i}" for i in range(120)), "en", "e"), (16, " ".join(f"w{i}" for i in range(118)) + " z z2", "en", "e"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]
