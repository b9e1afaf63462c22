"""Author baselines: medians, leave-one-out medians and the monthly adoption of a register."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadlens.functions.text import REGISTER_LEXICON, uses_lexicon
from spreadlens.operators.ranks import ranked_values, value_at
from spreadlens.schemas import require_columns

# Rows an author must exceed to have a history, and flagged posts a lift needs.
MIN_HISTORY = 2
MIN_FLAGGED = 3
# Ways to spread the rows of one author and like count.
SALTS = 16


def author_baselines(df: DataFrame, author: str = "author_id", likes: str = "like_count") -> DataFrame:
    """(author, median_likes, posts) over rows that have both.

    Equal like counts are counted first and ranked inside value buckets, so no author's values meet in one task.
    """
    require_columns(df, (author, likes))
    rows = df.where(F.col(author).isNotNull() & F.col(likes).isNotNull()).select(F.col(author).cast("string").alias("author"), F.col(likes).alias("likes"))
    n = F.col("total")
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    middle = (value_at(low, "likes").cast("double") + value_at(high, "likes").cast("double")) / 2
    return ranked_values(rows, ["author"], "likes").groupBy("author").agg(middle.alias("median_likes"), F.max("total").alias("posts"))


def loo_table(df: DataFrame, author: str = "author_id", likes: str = "like_count") -> DataFrame:
    """(author, likes, n, loo_median, known): rows of one author with equal likes share a median.

    Dropping a row of rank r from n sorted values leaves v[k] at position k < r and v[k + 1] otherwise, so
    three order statistics around the middle answer every row.
    """
    require_columns(df, (author, likes))
    rows = df.select(
        F.coalesce(F.col(author).cast("string"), F.lit("None")).alias("author"),
        F.coalesce(F.col(likes), F.lit(0)).alias("likes"),
    )
    ranked = ranked_values(rows, ["author"], "likes")
    low = F.floor((F.col("total") - 1) / 2)
    middles = ranked.groupBy("author").agg(
        *[value_at(low + i, "likes").cast("double").alias(f"v{i}") for i in range(3)]
    )
    rank = F.col("below") + 1
    # n even leaves an odd number, m = n - 1, whose middle is k = n / 2 = low + 1.
    odd = F.when(low + 1 < rank, F.col("v1")).otherwise(F.col("v2"))
    # n odd leaves an even number, whose middles are k = low and low + 1.
    even = (
        F.when(low < rank, F.col("v0")).otherwise(F.col("v1")) + F.when(low + 1 < rank, F.col("v1")).otherwise(F.col("v2"))
    ) / 2
    known = F.col("total") > MIN_HISTORY
    return ranked.join(middles, "author").select(
        "author",
        "likes",
        "n",
        F.when(~known, F.lit(0.0)).when(F.col("total") % 2 == 0, odd).otherwise(even).alias("loo_median"),
        known.cast("double").alias("known"),
    )


def leave_one_out_medians(df: DataFrame, author: str = "author_id", likes: str = "like_count") -> DataFrame:
    """`df` with `loo_median` and `known`: the median of the author's other rows, and whether there were enough.

    Rows meet their median by (author, likes) and one of SALTS numbers, so an author's many rows with one count spread out.
    The numbers come from ids and short columns, so a caller that drops a row's text moves no text.
    """
    short = [c for c, t in df.dtypes if t not in ("string", "binary") or c in ("id", "tweet_id")]
    medians = loo_table(df, author, likes).drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = df.withColumns(
        {
            "_author": F.coalesce(F.col(author).cast("string"), F.lit("None")),
            "_likes": F.coalesce(F.col(likes), F.lit(0)),
            "_salt": F.pmod(F.xxhash64(*(short or df.columns)), F.lit(SALTS)).cast("int"),
        }
    )
    matched = (F.col("_author") == medians["author"]) & (F.col("_likes") == medians["likes"]) & (F.col("_salt") == medians["salt"])
    return keyed.join(medians, matched).select(*[keyed[c] for c in df.columns], "loo_median", "known")


def _official_posts(accounts: DataFrame, since: str, lexicon: Sequence[str]) -> DataFrame:
    return accounts.where(
        (F.col("account_kind") == "official")
        & (F.col("created_at") >= F.lit(f"{since}-01").cast("timestamp"))
        & ~F.col("text").startswith("RT @")
    ).select(
        F.date_format("created_at", "yyyy-MM").alias("month"),
        "author_handle",
        uses_lexicon(F.col("text"), lexicon).alias("flagged"),
        "like_count",
    )


def account_month_medians(accounts: DataFrame, since: str, lexicon: Sequence[str] = REGISTER_LEXICON) -> DataFrame:
    """Per month and account: posts, flagged posts, and the median likes of flagged and of other posts."""
    flagged = F.col("flagged")
    return (
        _official_posts(accounts, since, lexicon)
        .groupBy("month", "author_handle")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.count_if(flagged).alias("flagged_posts"),
            F.median(F.when(flagged, F.col("like_count"))).alias("flagged_median"),
            F.median(F.when(~flagged, F.col("like_count"))).alias("other_median"),
        )
    )


def register_adoption_monthly(accounts: DataFrame, since: str, lexicon: Sequence[str] = REGISTER_LEXICON) -> DataFrame:
    """Per month: posts, flagged share, accounts using the register, and the median lift over posts.

    The lift is a median over post rows of a per-account number, so each account-month enters it once with
    its posts as the frequency; the posts themselves need no second pass.
    """
    lift = F.col("flagged_median") / F.greatest(F.col("other_median"), F.lit(1.0))
    counted = (F.col("flagged_posts") >= MIN_FLAGGED) & F.col("other_median").isNotNull()
    return (
        account_month_medians(accounts, since, lexicon)
        .groupBy("month")
        .agg(
            F.sum("posts").alias("posts"),
            (F.sum("flagged_posts") / F.sum("posts")).alias("flagged_share"),
            F.count_if(F.col("flagged_posts") > 0).alias("accounts_using"),
            F.percentile(F.when(counted, lift), 0.5, F.col("posts")).alias("lift"),
        )
    )
