"""Text expressions: normalising, counting, lexicon hits and the reading of a post aloud."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelled out rather than \w and \s, whose meaning differs between regex engines.
WORD = r"[\p{L}\p{N}_]"
ODD_BLANKS = r"\t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = " " + ODD_BLANKS
SPACE = f"[{BLANKS}]"
# The same characters one by one.
BLANK_SIGNS = tuple(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
URL = f"https?://[^{BLANKS}]+|www\\.[^{BLANKS}]+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"

# The default register lexicon.
REGISTER_LEXICON = (
    "lowkey", "highkey", "no cap", "fr fr", "rizz", "sus", "based", "cringe", "slay", "vibe", "vibes",
    "goated", "unhinged", "delulu", "brainrot", "skibidi", "sigma", "gyat", "aura", "cooked",
    "it's giving", "main character", "npc", "ratio", "tell me you", "without telling me", "pov:",
    "nobody:", "me:", "asmr", "let him cook", "chat is this real", "crash out", "ts pmo", "6 7",
    "bussin", "yeet", "stan", "simp", "bet", "cap", "iykyk", "ded", "💀", "🔥", "😭",
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` computed once however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends; lone blanks, by far the most, are left alone."""
    return F.trim(F.regexp_replace(text, f"[{ODD_BLANKS}]{SPACE}*| {SPACE}+", " "))


def without(text: Column, pattern: str, signs: Sequence[str], keep: str = "") -> Column:
    """`text` with `pattern` replaced; the pattern is only tried where one of its `signs` occurs."""

    def replaced(t: Column) -> Column:
        seen = reduce(operator.or_, [t.contains(sign) for sign in signs])
        return F.when(seen, F.regexp_replace(t, pattern, keep)).otherwise(t)

    return bound(text, replaced)


def normalise(text: Column) -> Column:
    """The identity of a template: lower case, no links, handles or hashtags, single blanks."""
    without_links = without(F.lower(text), URL, ("http", "www."))
    # A handle or hashtag takes every word character after it, so one pass removes both kinds.
    return collapse(without(without_links, f"[@#]{WORD}+", ("@", "#")))


def has_link_raw(text: Column) -> Column:
    """A link as the scan sees it: case-sensitive, with its scheme."""
    return text.contains("http://") | text.contains("https://")


def has_link_text(text: Column) -> Column:
    """A link as a reader sees it: any case, `www.` counts. The pattern is only tried where one of its signs occurs."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.contains("://") | F.lower(whole).contains("www."), whole.rlike(f"(?i){URL}")).otherwise(False)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def truncate(text: Column, limit: int = 80) -> Column:
    if limit < 4:
        raise ValueError("limit must be at least 4")
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def occurrences(text: Column, piece: str) -> Column:
    """How often a one-character `piece` occurs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))).cast("bigint")


def all_caps(word: Column) -> Column:
    return word.rlike(r"\p{Lu}") & ~word.rlike(r"[\p{Ll}\p{Lt}]")


def _lexicon_pattern(lexicon: Sequence[str]) -> str:
    if not lexicon:
        raise ValueError("lexicon is empty")
    longest_first = sorted(lexicon, key=len, reverse=True)
    return f"(?iu)(?<!{WORD})(" + "|".join(re.escape(entry) for entry in longest_first) + f")(?!{WORD})"


def lexicon_hits(text: Column, lexicon: Sequence[str] = REGISTER_LEXICON) -> Column:
    """Whole-word entries in order of appearance, lower-cased."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_lexicon_pattern(lexicon)), 1)
    return F.transform(hits, F.lower)


def uses_lexicon(text: Column, lexicon: Sequence[str] = REGISTER_LEXICON) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_lexicon_pattern(lexicon))


def spoken_text(text: Column) -> Column:
    """What a voice should read: no links, handles and hashtags as plain words."""
    without_links = without(text, f"(?i){URL}", ("://", ".",))
    return collapse(without(without_links, f"[@#]({WORD}+)", ("@", "#"), "$1"))


# The three visual moods.
MOODS = {
    "urgent": "urgent, high contrast, fast drift",
    "curious": "curious, cool tones, slow drift",
    "calm": "calm, warm tones, slow drift",
}


def mood(text: Column) -> Column:
    shouted = F.size(F.filter(words(text), lambda w: (F.length(w) > 2) & all_caps(w)))
    return (
        F.when((shouted >= 2) | (occurrences(text, "!") >= 2), MOODS["urgent"])
        .when(text.contains("?"), MOODS["curious"])
        .otherwise(MOODS["calm"])
    )


# Fixed value: the longest post that can be published.
MAX_POST_CHARS = 280


def validated(text: Column) -> Column:
    """struct<cleaned, ok, reason>: the trimmed post, or why it cannot be published."""
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    size = F.length(cleaned)
    reason = F.when(size == 0, F.lit("post text is empty")).when(
        size > MAX_POST_CHARS,
        F.format_string(f"post is %d characters; the limit is {MAX_POST_CHARS}", size),
    )
    return F.struct(cleaned.alias("cleaned"), reason.isNull().alias("ok"), reason.alias("reason"))
