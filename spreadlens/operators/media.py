"""Timed words and captions of a spoken post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadlens.functions.text import BLANK_SIGNS, spoken_text, words

# Words per caption, reading pace, and the clip's shortest, longest and trailing seconds.
PER_CAPTION = 4
WORDS_PER_MINUTE = 150
MIN_SECONDS, MAX_SECONDS, TAIL_SECONDS = 4.0, 30.0, 1.0


def timed_words(posts: DataFrame, wpm: int = WORDS_PER_MINUTE) -> DataFrame:
    """(id, pos, word, start_s, end_s) for (id, text): the spoken words at an even pace."""
    if not 40 <= wpm <= 400:
        raise ValueError("wpm must be between 40 and 400")
    each = 60.0 / wpm
    spoken = posts.select("id", F.posexplode(words(spoken_text(F.col("text")))).alias("pos", "word"))
    return spoken.select(
        "id",
        "pos",
        "word",
        F.round(F.col("pos") * each, 3).alias("start_s"),
        F.round((F.col("pos") + 1) * each, 3).alias("end_s"),
    )


def captions(timed: DataFrame, per_caption: int = PER_CAPTION) -> DataFrame:
    """(id, caption, text, start_s, end_s) from words (id, pos, word, start_s, end_s) that were timed elsewhere."""
    if per_caption < 1:
        raise ValueError("per_caption must be at least 1")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    return timed.groupBy("id", F.floor(F.col("pos") / per_caption).alias("caption")).agg(
        text.alias("text"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")
    )


def even_captions(posts: DataFrame, wpm: int = WORDS_PER_MINUTE, per_caption: int = PER_CAPTION) -> DataFrame:
    """(id, caption, text, start_s, end_s) for (id, text): consecutive spoken words in groups, each a handful of words.

    Captions are slices of the row's own words, so nothing is shuffled.
    """
    if per_caption < 1:
        raise ValueError("per_caption must be at least 1")
    if not 40 <= wpm <= 400:
        raise ValueError("wpm must be between 40 and 400")
    each = 60.0 / wpm
    spoken = posts.select("id", words(spoken_text(F.col("text"))).alias("words")).where(F.size("words") > 0)
    n = F.size("words")

    def caption(first: Column) -> Column:
        return F.struct(
            F.array_join(F.slice("words", first + 1, per_caption), " ").alias("text"),
            F.round(first * each, 3).alias("start_s"),
            F.round(F.least(first + per_caption, n) * each, 3).alias("end_s"),
        )

    made = F.transform(F.sequence(F.lit(0), n - 1, F.lit(per_caption)), caption)
    return spoken.select("id", F.posexplode(made).alias("caption", "c")).select("id", F.col("caption").cast("bigint").alias("caption"), "c.*")


def clip_seconds(text: Column, wpm: int = WORDS_PER_MINUTE) -> Column:
    """The clip's length: the speech and a tail, within bounds."""
    speech = F.round(F.size(words(spoken_text(text))) * (60.0 / wpm), 3)
    return F.least(F.greatest(speech + TAIL_SECONDS, F.lit(MIN_SECONDS)), F.lit(MAX_SECONDS))


def chars_to_words(timed: DataFrame) -> DataFrame:
    """(id, word, start_s, end_s) from (id, chars: array<struct<char, start_s, end_s>>), as a speech service returns them.

    A word is a run of characters between white space; it starts with its first character and ends with the
    white space that closes it, or with its own last character at the end of the text. Words are slices of the
    row's own characters between its blanks, so nothing is shuffled.
    """
    n = F.size("chars")
    # A look in a set instead of a pattern, and no filter on the array, which would be moved below and make the array twice.
    blank = lambda i: F.get("chars", i)["char"].isin(*BLANK_SIGNS)
    blanks = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), blank)
    placed = timed.select("id", "chars", F.col("chars")["char"].alias("signs"), blanks.alias("blanks"))
    # Islands lie after each blank and before the next one; the text's own ends close the first and the last.
    bounds = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform("blanks", lambda b: b + 1)).alias("first"), F.concat("blanks", F.array(n)).alias("stop")
    )
    islands = F.filter(bounds, lambda x: x["stop"] > x["first"])
    word = F.transform(
        islands,
        lambda x: F.struct(
            F.concat_ws("", F.slice("signs", x["first"] + 1, x["stop"] - x["first"])).alias("word"),
            F.col("chars")[x["first"]]["start_s"].alias("start_s"),
            F.col("chars")[F.least(x["stop"], n - 1)]["end_s"].alias("end_s"),
        ),
    )
    return placed.select("id", F.explode(word).alias("w")).select("id", "w.*")
