"""Templates: texts many accounts post, their hourly curves, near copies folded, and a verdict on each.

Every step before the threshold on accounts works on narrow rows keyed by the digest of the normalised text;
the text itself is read again only for the few templates that pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spreadlens.functions.text import normalise
from spreadlens.functions.verdict import MARKERS, verdict
from spreadlens.operators.similarity import Embed, fold_members, hash_vectors, linked_pairs
from spreadlens.operators.snapshots import latest
from spreadlens.schemas import VIDEO_COLUMNS, require_columns
from spreadlens.session import stored

# The thresholds a feed uses unless told otherwise.
MIN_AUTHORS = 5
MIN_CHARS = 20
MAX_TEMPLATES = 50
FOLD_THRESHOLD = 0.75
SHOWN = 5
# Distinct-count sketches have 2^14 registers: a standard error of 0.65 %.
SKETCH_LOG_K = 14


# Digests of bodies a task remembers, 16 bytes each and some tens more.
REMEMBERED = 1 << 16


def distinct_bodies(posts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(raw, body): each distinct body once, where its digest deals it, however its posts lie; of `wanted` digests only, if given.

    Spark groups texts by sorting them, so a task first drops the copies of the bodies it has lately seen: what is sorted and
    shuffled are the bodies, not the posts.
    """
    body = F.coalesce("body", F.lit(""))

    def drop_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        for batch in batches:
            fresh = []
            for k, raw in enumerate(batch.column("digest").to_pylist()):
                if raw not in seen:
                    seen[raw] = None
                    fresh.append(k)
            if fresh:
                yield batch.take(pa.array(fresh))
            for raw in list(seen)[: max(0, len(seen) - REMEMBERED)]:
                del seen[raw]

    fewer = posts.select(F.unhex(F.md5(body)).alias("digest"), body.alias("body")).mapInArrow(drop_copies, "digest binary, body string")
    named = fewer.select(F.lower(F.hex("digest")).alias("raw"), "body")
    if wanted is not None:
        named = named.join(wanted.select("raw"), "raw", "left_semi")
    return named.groupBy("raw").agg(F.first("body").alias("body"))


def marked_posts(posts: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Every observation as the narrow row of `narrow_rows`, written, with the `key` and `chars` of its normalised text where its
    task has not lately seen that body; NULL where it has.

    One pass over the posts: a body is normalised where it lies, once a task, and none is shuffled, sorted or written.
    """
    rows = narrow_rows(posts, ties, "body")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, None] = {}
        for batch in batches:
            fresh = []
            for raw in batch.column("raw").to_pylist():
                fresh.append(raw not in seen)
                seen[raw] = None
            bodies = pc.if_else(pa.array(fresh, pa.bool_()), batch.column("body"), pa.scalar(None, batch.column("body").type))
            yield batch.set_column(batch.num_columns - 1, "body", bodies)
            for raw in list(seen)[: max(0, len(seen) - REMEMBERED)]:
                del seen[raw]

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    normalised = rows.mapInArrow(mark, schema).withColumn("body", normalise(F.col("body")))
    return stored(normalised.withColumns({"key": F.md5("body"), "chars": F.length("body")}).drop("body"), "marked")


def keyed_marked(marked: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """`keyed_posts` of marked posts."""
    keys = marked.where("key is not null").select("raw", "key", "chars").distinct()
    return latest(marked.drop("key", "chars"), ties).join(keys, "raw")


def body_keys(posts: DataFrame) -> DataFrame:
    """(raw, key, chars): each distinct body normalised once."""
    normalised = distinct_bodies(posts).select("raw", normalise(F.col("body")).alias("normalised"))
    return normalised.select("raw", F.md5("normalised").alias("key"), F.length("normalised").alias("chars"))


def narrow_rows(posts: DataFrame, ties: Sequence[str] = (), *carry: str) -> DataFrame:
    """Ids, times, flags, and the digest of the body (`raw`) of each observation; at the end what is carried, as text."""
    return posts.select(
        "id",
        "version",
        *ties,
        "author_id",
        "created_at",
        F.md5(F.coalesce("body", F.lit(""))).alias("raw"),
        F.col("has_link").cast("int").alias("link"),
        (F.coalesce("views_count", F.lit(0)) == 0).cast("int").alias("unseen"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in carry],
    )


def keyed_posts(posts: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """The final state of each post as narrow rows: ids, times, flags, and the digests of its body (`raw`) and of its
    normalised text, with that text's length."""
    return latest(narrow_rows(posts, ties), ties).join(body_keys(posts), "raw")


def grouped(rows: DataFrame, key: str, actor: str, minimum: int) -> DataFrame:
    """Distinct actors, rows and first appearance per key, for keys with at least `minimum` actors.

    Spark spreads a distinct count over (key, actor) before it counts per key, so one viral key is not one task.
    """
    return (
        rows.groupBy(key)
        .agg(
            F.countDistinct(actor).alias("authors"),
            F.count(F.lit(1)).alias("posts"),
            F.min("created_at").alias("first_seen"),
            F.sum("link").alias("links"),
            F.sum("unseen").alias("unseen"),
        )
        .where(F.col("authors") >= minimum)
    )


def hour_cells(rows: DataFrame, key: str, actor: str, bucket: str = "hour") -> DataFrame:
    """Distinct actors and rows per key and hour (or day): the replication curve in long form."""
    return rows.groupBy(F.col(key), F.date_trunc(bucket, "created_at").alias("hour")).agg(
        F.countDistinct(actor).alias("authors"), F.count(F.lit(1)).alias("posts")
    )


def hour_sketches(rows: DataFrame, key: str = "key", actor: str = "author_id", bucket: str = "hour") -> DataFrame:
    """The hour layer with a mergeable sketch of each key's actors: key, hour, actors, posts, first_seen, links, unseen.

    Sketches of the same hour are merged before the shuffle, and those of several hours, or of several keys, by later reads,
    so no window and no folded template needs the posts again.
    """
    return rows.groupBy(F.col(key).alias("key"), F.date_trunc(bucket, "created_at").alias("hour")).agg(
        F.hll_sketch_agg(actor, F.lit(SKETCH_LOG_K)).alias("actors"),
        F.count(F.lit(1)).alias("posts"),
        F.min("created_at").alias("first_seen"),
        F.sum("link").alias("links"),
        F.sum("unseen").alias("unseen"),
    )


def merged_sketches(sketches: DataFrame, minimum: int = 1, by: str = "key") -> DataFrame:
    """What `grouped` tells, from hour sketches: the number of actors is approximate (`SKETCH_LOG_K`), all else exact."""
    return (
        sketches.groupBy(by)
        .agg(
            F.hll_sketch_estimate(F.hll_union_agg("actors")).alias("authors"),
            F.sum("posts").alias("posts"),
            F.min("first_seen").alias("first_seen"),
            F.sum("links").alias("links"),
            F.sum("unseen").alias("unseen"),
        )
        .where(F.col("authors") >= minimum)
    )


def folded_sketches(sketches: DataFrame, members: DataFrame, minimum: int = MIN_AUTHORS) -> DataFrame:
    """Folded templates (root, authors, posts, first_seen, link_share, zero_views_share, variants) from hour sketches and
    (key, root): an account that posted several variants counts once, as sketches forget who was counted where."""
    rooted = sketches.join(members, "key")
    variants = members.groupBy("root").agg(F.count(F.lit(1)).alias("variants"))
    return shares(merged_sketches(rooted, minimum, "root")).drop("links", "unseen").join(variants, "root")


def sketched_cells(sketches: DataFrame, members: DataFrame) -> DataFrame:
    """Hourly curves of folded templates (root, hour, authors, posts) from hour sketches."""
    return sketches.join(members, "key").groupBy("root", "hour").agg(
        F.hll_sketch_estimate(F.hll_union_agg("actors")).alias("authors"), F.sum("posts").alias("posts")
    )


def curve_arrays(cells: DataFrame, key: str) -> DataFrame:
    """Each key's curve as one ordered array; its length is bounded by the hours in the window."""
    points = F.collect_list(F.struct("hour", "authors", "posts"))
    return cells.groupBy(key).agg(F.sort_array(points).alias("curve"))


def velocity(curve: Column) -> Column:
    """Distinct actors in the curve's last hour; zero for an empty curve."""
    return F.coalesce(F.try_element_at(curve, F.lit(-1))["authors"], F.lit(0)).cast("bigint")


def peak_hours(cells: DataFrame, key: str) -> DataFrame:
    """The hour with most actors, the first one on ties."""
    peak = F.max(F.struct(F.col("authors"), (-F.unix_timestamp("hour")).alias("back"), F.col("hour"))).alias("peak")
    return cells.groupBy(key).agg(peak).select(key, F.col("peak.hour").alias("hour"), F.col("peak.authors").alias("authors"))


def first_posts(rows: DataFrame, keep: int = SHOWN, timeless_last: bool = False) -> DataFrame:
    """The earliest `keep` rows of each key, with their `position`; rows without a time come first unless they are to come last."""
    order = [F.asc_nulls_last(c) if timeless_last else F.asc(c) for c in ("created_at", "id")]
    by_time = Window.partitionBy("key").orderBy(*order)
    return rows.withColumn("position", F.row_number().over(by_time)).where(F.col("position") <= keep)


def author_lists(rows: DataFrame) -> DataFrame:
    """(key, author_ids): all accounts of each key in dictionary order; told apart before they meet."""
    once = rows.where(F.col("author_id").isNotNull()).select("key", "author_id").distinct()
    return once.groupBy("key").agg(F.sort_array(F.collect_list("author_id")).alias("author_ids"))


def template_texts(posts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, text, normalised): the earliest body of each key, looked up by its digest; only bodies that are asked for are grouped."""
    wanted = firsts.where("position = 1").select("key", "raw")
    one = distinct_bodies(posts, wanted).join(wanted, "raw").select("key", F.col("body").alias("text"))
    return one.withColumn("normalised", normalise(F.col("text")))


def shares(groups: DataFrame) -> DataFrame:
    return groups.withColumns(
        {"link_share": F.col("links") / F.col("posts"), "zero_views_share": F.col("unseen") / F.col("posts")}
    )


def cluster_templates(
    posts: DataFrame, min_authors: int = MIN_AUTHORS, min_chars: int = MIN_CHARS, ties: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """One row per template: text, normalised text, counts, first appearance, shares, first post ids, all its accounts
    (`author_ids`) and its hourly `curve`. A template whose posts lack a time or an id is one too.

    With `approx` the accounts are estimated from merged hour sketches: one exchange of at most a row per key and hour.
    The last two are left joins by a grouped key, so Spark drops them where a caller doesn't read them.
    """
    # Narrow, and read several times below.
    rows = stored(keyed_posts(posts, ties).where(F.col("chars") >= min_chars), "rows")
    counted = merged_sketches(hour_sketches(rows), min_authors) if approx else grouped(rows, "key", "author_id", min_authors)
    groups = shares(counted).drop("links", "unseen")
    kept = rows.join(groups.select("key"), "key", "left_semi")
    firsts = stored(first_posts(kept, timeless_last=True).select("key", "id", "raw", "position"), "firsts")
    samples = firsts.groupBy("key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "id"))), lambda p: p["id"]).alias("sample_ids")
    )
    curves = curve_arrays(hour_cells(kept, "key", "author_id"), "key")
    whole = groups.join(samples, "key").join(template_texts(posts, firsts), "key")
    return whole.join(author_lists(kept), "key", "left").join(curves, "key", "left")


def ridden_velocity(
    posts: DataFrame, min_authors: int = MIN_AUTHORS, min_chars: int = MIN_CHARS, ties: Sequence[str] = ()
) -> DataFrame:
    """(id, velocity): the distinct accounts in the last hour of the template a post rides; zero where it rides none."""
    rows = stored(keyed_posts(posts, ties), "ridden")
    long = rows.where(F.col("chars") >= min_chars)
    kept = long.join(grouped(long, "key", "author_id", min_authors).select("key"), "key", "left_semi")
    last = hour_cells(kept, "key", "author_id").groupBy("key").agg(F.max_by("authors", "hour").alias("velocity"))
    return rows.join(last, "key", "left").select("id", F.coalesce("velocity", F.lit(0)).alias("velocity"))


def cluster_sounds(videos: DataFrame, min_creators: int = 5, bucket: str = "hour") -> DataFrame:
    """One row per sound used by enough creators, with its curve."""
    require_columns(videos, VIDEO_COLUMNS)
    rows = videos.withColumns({"link": F.lit(0), "unseen": F.lit(0)})
    groups = grouped(rows, "music_id", "creator_id", min_creators)
    titles = videos.groupBy("music_id").agg(F.min(F.struct("created_at", "music_title"))["music_title"].alias("title"))
    curves = curve_arrays(hour_cells(videos, "music_id", "creator_id", bucket), "music_id")
    return groups.join(titles, "music_id").join(curves, "music_id").select(
        "music_id",
        "title",
        F.col("authors").alias("creators"),
        F.col("posts").alias("videos"),
        "first_seen",
        "curve",
    )


def sounds(videos: DataFrame, min_creators: int = 5, max_sounds: int = MAX_TEMPLATES, bucket: str = "hour") -> DataFrame:
    if min_creators < 2:
        raise ValueError("min_creators must be at least 2")
    return cluster_sounds(videos, min_creators, bucket).orderBy(F.desc("creators"), F.desc("videos"), "music_id").limit(max_sounds)


class Mined:
    """The tables of one mining run, before and after folding; each is a DataFrame.

    `cells` is (key, author_id, hour) with its posts: curves, memberships and exact recounts all come from it.
    """

    def __init__(
        self,
        posts: DataFrame,
        min_authors: int = MIN_AUTHORS,
        min_chars: int = MIN_CHARS,
        ties: Sequence[str] = (),
        threshold: float = FOLD_THRESHOLD,
        bucket: str = "hour",
        fold_before_filter: bool = False,
        embed: Embed = hash_vectors,
        candidates: str = "blocks",
        in_place: bool = False,
    ) -> None:
        if min_authors < 2:
            raise ValueError("min_authors must be at least 2; one author is a post, not a template")
        # Read several times below, so computed once: a few dozen bytes per post.
        # In place no body is shuffled for its key; behind its digest a document that most posts share is no task's alone.
        keyed = keyed_marked(marked_posts(posts, ties), ties) if in_place else keyed_posts(posts, ties)
        finals = stored(keyed.where(F.col("chars") >= min_chars), "finals")
        self.groups = stored(grouped(finals, "key", "author_id", 1 if fold_before_filter else min_authors), "groups")
        kept = finals.join(self.groups.select("key"), "key", "left_semi")
        self.kept = kept
        self.cells = stored(
            kept.groupBy("key", "author_id", F.date_trunc(bucket, "created_at").alias("hour")).agg(
                F.count(F.lit(1)).alias("posts")
            ),
            "cells",
        )
        self.firsts = stored(first_posts(kept).select("key", "id", "version", "raw", *ties, "position"), "firsts")
        known = self.firsts.dropna(subset=["id", "version", *ties])
        self.texts = stored(template_texts(posts, known), "texts")
        self.members = self._members(threshold, embed, candidates)
        self.min_authors = min_authors

    def _members(self, threshold: float, embed: Embed, candidates: str) -> DataFrame:
        """(key, root): every key with the largest key of its near-copy component."""
        # Most accounts first, then most posts, then the digest, as one string that sorts that way.
        big = 10**12
        rank = F.concat(
            F.lpad((F.lit(big) - F.col("authors")).cast("string"), 13, "0"),
            F.lpad((F.lit(big) - F.col("posts")).cast("string"), 13, "0"),
            F.col("key"),
        )
        vectors = embed(self.texts.join(self.groups.select("key", rank.alias("rank")), "key"), "rank", "normalised")
        components = fold_members(linked_pairs(vectors, "rank", threshold, forest=True, candidates=candidates))
        digest = lambda c: F.substring(c, 27, 32)
        moved = components.select(digest("node").alias("key"), digest("root").alias("root"))
        return stored(
            self.groups.select("key").join(moved, "key", "left").select("key", F.coalesce("root", "key").alias("root")),
            "members",
        )

    def folded(self) -> DataFrame:
        """One row per root: the head's text and samples, counts, shares and first appearance over all variants."""
        totals = (
            self.groups.join(self.members, "key")
            .groupBy("root")
            .agg(
                F.sum("posts").alias("posts"),
                F.min("first_seen").alias("first_seen"),
                F.sum("links").alias("links"),
                F.sum("unseen").alias("unseen"),
                F.count(F.lit(1)).alias("variants"),
            )
        )
        authors = self.authors().groupBy("root").agg(F.count(F.lit(1)).alias("authors"))
        head = self.texts.withColumnRenamed("key", "root")
        return (
            shares(totals)
            .drop("links", "unseen")
            .join(authors, "root")
            .where(F.col("authors") >= self.min_authors)
            .join(head, "root")
        )

    def authors(self) -> DataFrame:
        """Distinct (root, author_id)."""
        return self.cells.join(self.members, "key").where(F.col("author_id").isNotNull()).select("root", "author_id").distinct()

    def folded_cells(self, exact: bool = False) -> DataFrame:
        """Curves of the folded templates. Summed, an account with two variants in an hour counts twice; `exact` recounts."""
        by_hour = self.cells.join(self.members, "key").groupBy("root", "hour")
        actors = F.countDistinct("author_id") if exact else F.count("author_id")
        return by_hour.agg(actors.alias("authors"), F.sum("posts").alias("posts"))

    def first_authors(self) -> DataFrame:
        """(root, first_authors): the first five author ids in dictionary order."""
        order = Window.partitionBy("root").orderBy("author_id")
        top = self.authors().withColumn("n", F.row_number().over(order)).where(F.col("n") <= SHOWN)
        return top.groupBy("root").agg(F.sort_array(F.collect_list("author_id")).alias("first_authors"))

    def earliest_authors(self) -> DataFrame:
        """(root, earliest_authors): the first five authors by the hour they joined, the ones who started it."""
        joined = self.cells.join(self.members, "key").groupBy("root", "author_id").agg(F.min("hour").alias("hour"))
        order = Window.partitionBy("root").orderBy("hour", "author_id")
        top = joined.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SHOWN)
        ids = F.transform(F.sort_array(F.collect_list(F.struct("n", "author_id"))), lambda p: p["author_id"])
        return top.groupBy("root").agg(ids.alias("earliest_authors"))

    def samples(self) -> DataFrame:
        ids = F.transform(F.sort_array(F.collect_list(F.struct("position", "id"))), lambda p: p["id"])
        return self.firsts.groupBy(F.col("key").alias("root")).agg(ids.alias("sample_ids"))


def listen(
    posts: DataFrame,
    min_authors: int = MIN_AUTHORS,
    max_templates: int = MAX_TEMPLATES,
    min_chars: int = MIN_CHARS,
    ties: Sequence[str] = (),
    threshold: float = FOLD_THRESHOLD,
    markers: Sequence[str] = MARKERS,
    curve_mode: str = "sum",
    fold_before_filter: bool = False,
    embed: Embed = hash_vectors,
) -> DataFrame:
    """The feed: templates with near copies folded, most replicated first, each with its curve and verdict."""
    mined = Mined(posts, min_authors, min_chars, ties, threshold, fold_before_filter=fold_before_filter, embed=embed)
    # A feed is short by definition, so what follows joins at most `max_templates` rows.
    top = mined.folded().orderBy(F.desc("authors"), F.desc("posts"), "root").limit(max_templates)
    curves = curve_arrays(mined.folded_cells(exact=curve_mode == "exact"), "root")
    judged = (
        top.join(mined.samples(), "root")
        .join(mined.first_authors(), "root")
        .join(curves, "root")
        .withColumn(
            "spam",
            verdict(
                F.col("authors"), F.col("posts"), F.col("link_share"), F.col("zero_views_share"), F.col("normalised"), markers
            ),
        )
    )
    return judged.select(
        F.col("root").alias("key"), "text", "normalised", "authors", "posts", "first_seen", "first_authors",
        "sample_ids", "curve", "spam", "variants",
    ).orderBy(F.desc("authors"), F.desc("posts"), "key")


def feed_summary(feed: DataFrame) -> DataFrame:
    """One row: templates, organic, paid, and the organic template to ride with its latest-hour velocity."""
    organic = ~F.col("spam.is_spam")
    ride = F.struct("key", "authors", velocity(F.col("curve")).alias("velocity"))
    best = F.min(F.when(organic, F.struct(-F.col("authors"), -F.col("posts"), F.col("key"), ride.alias("ride"))))
    return feed.agg(
        F.count(F.lit(1)).alias("templates"),
        F.count_if(organic).alias("organic"),
        F.count_if(F.col("spam.is_spam")).alias("paid"),
        best["ride"].alias("ride"),
    ).select("templates", "organic", "paid", "ride.key", "ride.authors", "ride.velocity")
