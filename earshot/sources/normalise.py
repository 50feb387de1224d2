"""Payload items of the ten sources as mentions.

Every source states how its fields read (a ``Reading``); identity, language, term matching,
resampling unit and drift handling are shared. Items come from ``payload_items``.
"""

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot import schemas
from earshot.functions import scalars as S
from earshot.functions import text as X
from earshot.operators.terms import match_table
from earshot.sources import payloads as P


@dataclass(frozen=True)
class Reading:
    """Field expressions of one source over ``item``.

    ``drift`` maps a reason to the condition that breaks the contract; such items leave the
    mentions and enter the drift table. ``entity`` sources match their brand as a whole.
    """

    text: Column
    native_id: Column
    url: Column
    handle: Column
    published_at: Column
    engagement: Mapping[str, Column]
    drift: Mapping[str, Column]
    rating: Column | None = None
    parent: Column | None = None
    key_is_url: bool = False
    entity: bool = False
    skips_errors: bool = True
    extra: Mapping[str, Column] = field(default_factory=dict)


def _missing(path: str) -> Column:
    return P.string("item", path).isNull()


def _absent(path: str) -> Column:
    return P.value("item", path).isNull()


def _wrong_type(path: str, *allowed: str) -> Column:
    return P.kind("item", path).isNotNull() & ~P.kind("item", path).isin(*allowed, "VOID")


def _join_blank_line(first: Column, second: Column) -> Column:
    return F.when(first.isNotNull() | second.isNotNull(), F.concat_ws("\n\n", first, second))


def _bad_time(path: str) -> Column:
    written = P.kind("item", path)
    return (written.isNotNull() & (written != "VOID")) & P.iso_time("item", path).isNull()


def _counts(**paths: str) -> dict[str, Column]:
    return {name: P.integer("item", path) for name, path in paths.items()}


def _stripped(*paths: str) -> Column:
    return F.regexp_replace(P.string("item", *paths), r"(?U)^\s+|\s+$", "")


def _reddit() -> Reading:
    data_type = F.lower(_stripped("dataType"))
    is_post = data_type == "post"
    post_of_url = F.regexp_extract(P.string("item", "url"), r"/comments/([A-Za-z0-9]+)(?:[/?#]|$)", 1)
    parent = F.coalesce(
        _stripped("postId"), F.when(post_of_url != "", F.concat(F.lit("t3_"), post_of_url))
    )
    replies = F.coalesce(
        P.integer("item", "numberOfreplies", True), P.integer("item", "numberOfReplies", True)
    )
    native_id = _stripped("id")
    return Reading(
        text=F.when(is_post, _join_blank_line(_stripped("title"), _stripped("body"))).otherwise(
            _stripped("body")
        ),
        native_id=native_id,
        url=P.string("item", "url"),
        handle=P.string("item", "username"),
        published_at=F.coalesce(P.iso_time("item", "createdAt"), P.epoch_time("item", "createdAt", True)),
        engagement={
            "upvotes": P.integer("item", "upVotes", True),
            "comments": P.integer("item", "numberOfComments", True),
            "replies": replies,
        },
        drift={
            "dataType missing or empty": _missing("dataType"),
            "id missing or empty": _missing("id"),
            "unknown dataType": ~data_type.isin("post", "comment"),
        },
        parent=F.when(is_post, native_id).otherwise(parent),
        extra={"is_comment": data_type == "comment"},
    )


def _youtube() -> Reading:
    video = P.string("item", "id")
    count = lambda path: F.when(P.integer("item", path, True) >= 0, P.integer("item", path, True))
    watch = F.concat(F.lit("https://www.youtube.com/watch?v="), video)
    return Reading(
        text=_join_blank_line(P.string("item", "title"), P.string("item", "text")),
        native_id=video,
        url=F.coalesce(P.string("item", "url"), watch),
        handle=P.string("item", "channelName"),
        published_at=P.iso_time("item", "date"),
        engagement={
            "views": count("viewCount"), "likes": count("likes"), "comments": count("commentsCount"),
        },
        drift={
            "id missing or empty": _missing("id"),
            "neither title nor text": _missing("title") & _missing("text"),
        },
    )


def _youtube_comment() -> Reading:
    count = lambda path: F.when(P.integer("item", path, True) >= 0, P.integer("item", path, True))
    return Reading(
        text=P.string("item", "comment"),
        native_id=P.string("item", "cid", "id"),
        url=F.lit(None).cast("string"),
        handle=P.string("item", "author"),
        published_at=F.lit(None).cast("timestamp"),
        engagement={"likes": count("voteCount"), "replies": count("replyCount")},
        drift={
            "comment missing or empty": _missing("comment"),
            "videoId missing or empty": _missing("videoId"),
        },
        parent=P.string("item", "videoId"),
    )


def _first_present(*paths: str) -> tuple[Column, Column]:
    """Text of the first key that is there at all, and whether it has the wrong type."""
    text, wrong = F.lit(None).cast("string"), F.lit(False)
    for path in reversed(paths):
        there = ~_absent(path)
        text = F.when(there, P.string("item", path)).otherwise(text)
        wrong = F.when(there, _wrong_type(path, "STRING")).otherwise(wrong)
    return text, wrong


def _tiktok() -> Reading:
    text, wrong = _first_present("title", "caption", "desc")
    return Reading(
        text=text,
        native_id=P.handle("item", "id"),
        url=P.handle("item", "postPage", "url", "webVideoUrl"),
        handle=P.handle(
            "item", "channel.username", "channel.name", "channel.id", "authorUsername", "author",
            "username",
        ),
        published_at=F.coalesce(
            P.iso_time("item", "uploadedAtFormatted"), P.epoch_time("item", "uploadedAtFormatted"),
            P.iso_time("item", "uploadedAt"), P.epoch_time("item", "uploadedAt"),
        ),
        engagement=_counts(views="views", likes="likes", comments="comments", shares="shares"),
        drift={
            "no text key": _absent("title") & _absent("caption") & _absent("desc"),
            "text is not a string": wrong,
        },
        skips_errors=False,
    )


def _instagram() -> Reading:
    short = P.handle("item", "shortCode")
    post = F.concat(F.lit("https://www.instagram.com/p/"), short, F.lit("/"))
    return Reading(
        text=P.string("item", "caption"),
        native_id=P.handle("item", "id", "shortCode"),
        url=F.coalesce(P.handle("item", "url"), post),
        handle=P.handle("item", "ownerUsername", "ownerId", "owner.username", "owner.id"),
        published_at=F.coalesce(P.iso_time("item", "timestamp"), P.epoch_time("item", "timestamp")),
        engagement=_counts(likes="likesCount", comments="commentsCount", views="videoViewCount"),
        drift={
            "caption absent": _absent("caption"),
            "caption is not a string": _wrong_type("caption", "STRING"),
        },
        skips_errors=False,
    )


def _google_maps() -> Reading:
    stars = P.integer("item", "stars")
    return Reading(
        text=P.string("item", "text"),
        native_id=P.string("item", "reviewId"),
        url=P.string("item", "reviewUrl"),
        handle=P.string("item", "reviewerId", "name"),
        published_at=P.iso_time("item", "publishedAtDate"),
        engagement=_counts(likes="likesCount"),
        rating=stars,
        drift={
            "required key absent": _absent("reviewId") | _absent("text") | _absent("stars")
            | _absent("publishedAtDate"),
            "reviewId missing or empty": _missing("reviewId"),
            "text is not a string": _wrong_type("text", "STRING"),
            "stars is not an integer 1-5": (P.kind("item", "stars") != "VOID")
            & F.coalesce(~stars.between(1, 5), F.lit(True)),
            "publishedAtDate is not ISO 8601": _bad_time("publishedAtDate"),
        },
        entity=True,
        skips_errors=False,
    )


def _facebook() -> Reading:
    recommended = F.try_variant_get("item", "$.isRecommended", "boolean")
    return Reading(
        text=P.string("item", "text"),
        native_id=P.string("item", "id"),
        url=P.string("item", "url"),
        handle=P.string("item", "user.id", "user.name"),
        published_at=P.iso_time("item", "date"),
        engagement=_counts(likes="likesCount", comments="commentsCount"),
        rating=F.when(recommended, 5).when(~recommended, 1),
        drift={
            "required key absent": _absent("text") | _absent("date") | _absent("isRecommended"),
            "text is not a string": _wrong_type("text", "STRING"),
            "isRecommended is not a boolean": _wrong_type("isRecommended", "BOOLEAN"),
            "date is not ISO 8601": _bad_time("date"),
        },
        entity=True,
    )


def _reviews(texts, ratings, authors, nested_url) -> Reading:
    """Trustpilot and G2 share a contract and differ in the order of their fallbacks."""
    def first(paths, read):
        return F.coalesce(*[read(path) for path in paths])

    dates = ("date", "publishedAt", "createdAt")
    date_written = first(dates, lambda p: F.when(P.kind("item", p) != "VOID", P.kind("item", p)))
    date = first(dates, lambda p: F.when(P.kind("item", p) != "VOID", F.coalesce(
        F.try_variant_get("item", f"$.{p}", "string"), F.lit("?"))))
    at = F.date_trunc("second", F.when(
        (date_written == "STRING") & date.rlike(r"^\d{4}-\d{2}-\d{2}"), date.try_cast("timestamp")))
    rated = first(ratings, lambda p: F.when(P.kind("item", p) != "VOID", P.kind("item", p)))
    stars = first(ratings, lambda p: F.when(P.kind("item", p) != "VOID", P.integer("item", p, True)))
    native_id = first(("reviewId", "id"), lambda p: P.string("item", p))
    names = [f"{who}.{name}" for who in authors for name in ("id", "name", "displayName")]
    links = ["source.url", "source.reviewUrl"] if nested_url else []
    return Reading(
        text=_join_blank_line(_stripped("title"), _stripped(*texts)),
        native_id=native_id,
        url=_stripped(*links, "url", "reviewUrl"),
        handle=_stripped(*names, "authorName"),
        published_at=at,
        engagement={},
        rating=stars,
        drift={
            "review id missing or empty": native_id.isNull(),
            "rating is not an integer 1-5": rated.isNotNull()
            & F.coalesce(~stars.between(1, 5), F.lit(True)),
            "date is not ISO 8601": date_written.isNotNull() & at.isNull(),
        },
        entity=True,
        skips_errors=False,
    )


def _trustpilot() -> Reading:
    return _reviews(
        ("text", "content", "body"), ("rating", "stars", "starRating"), ("author", "consumer"), True
    )


def _g2() -> Reading:
    return _reviews(
        ("content", "text", "body"), ("rating", "starRating", "stars"), ("author", "reviewer"), False
    )


def _news() -> Reading:
    return Reading(
        text=_join_blank_line(_stripped("title"), _stripped("snippet")),
        native_id=F.lit(None).cast("string"),
        url=_stripped("url"),
        handle=P.string("item", "site_name"),
        published_at=P.iso_time("item", "date"),
        engagement={},
        drift={"url missing or empty": _missing("url"), "title missing or empty": _missing("title")},
        key_is_url=True,
        skips_errors=False,
    )


# X01. Source name -> reading; ``register`` adds more with the same shape.
READINGS: dict[str, Callable[[], Reading]] = {
    "reddit": _reddit,
    "youtube": _youtube,
    "youtube_comment": _youtube_comment,
    "tiktok": _tiktok,
    "instagram": _instagram,
    "google_maps": _google_maps,
    "facebook": _facebook,
    "trustpilot": _trustpilot,
    "g2": _g2,
    "news": _news,
}


def register(source: str, reading: Callable[[], Reading]) -> None:
    """X01. A source of the user's own, read like the others from then on."""
    READINGS[source] = reading


def brand_terms(terms: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """U06. Brand first, then its aliases, each once."""
    return {brand: list(dict.fromkeys([brand, *more])) for brand, more in terms.items()}


def _table_matched(read: DataFrame, terms: DataFrame, entity: bool) -> DataFrame:
    """Adds ``matched_terms`` by the table of terms (brand, term, place)."""
    if not entity:
        return match_table(read, terms, ["local_seq", "brand", "index"], "_norm", normalized=True)
    known = terms.select(F.col("brand").alias("_known")).distinct()
    none = F.array().cast("array<string>")
    found = F.when(F.col("_known").isNotNull(), F.array(X.normalize("brand"))).otherwise(none)
    return read.join(known, F.col("brand") == F.col("_known"), "left").withColumn("matched_terms", found).drop("_known")


def _matched(terms: Mapping[str, Sequence[str]], entity: bool) -> Column:
    none = F.array().cast("array<string>")
    if entity:
        known = F.col("brand").isin(*terms)
        return F.when(known, F.array(X.normalize("brand"))).otherwise(none)
    out = none
    for brand, words in brand_terms(terms).items():
        found = X.match_terms("_norm", words, normalized=True)
        out = F.when(F.col("brand") == brand, found).otherwise(out)
    return out


def parse(
    items: DataFrame, source: str, terms: Mapping[str, Sequence[str]] | DataFrame, inherit: bool | None = None
) -> DataFrame:
    """SRC02-SRC11. Every item of ``source`` with its mention columns and what became of it.

    Flags: ``drift_reason``, ``error_item``, ``no_text``, ``no_match``, ``cluster_key_fell_back``.
    ``terms`` maps each compared brand to its aliases, or is a table (brand, term, place) as of
    ``terms.brand_terms`` for any number of brands and terms. ``inherit`` (by default reddit only) lets an
    unmatched comment take the terms of its matched post in the same payload.
    """
    r = READINGS[source]()
    inherit = source == "reddit" if inherit is None else inherit
    mine = items.filter(F.col("source") == source)
    error = P.is_error_item() if r.skips_errors else F.lit(False)
    is_object = F.schema_of_variant("item").startswith("OBJECT")
    reason = F.when(F.col("no_list"), "no item list").when(
        ~F.coalesce(is_object, F.lit(False)), "item is not an object"
    )
    for name, broken in r.drift.items():
        reason = reason.when(~error & F.coalesce(broken, F.lit(False)), name)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    pairs = [c for name, count in r.engagement.items() for c in (F.lit(name), count)]
    engagement = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else empty
    read = mine.withColumns(
        {
            "error_item": error,
            "drift_reason": reason,
            "text": r.text,
            "native_id": r.native_id,
            "url": X.normalize_url(r.url),
            "_handle": r.handle,
            "published_at": r.published_at,
            "engagement": engagement,
            "rating": F.lit(None).cast("int") if r.rating is None else r.rating.cast("int"),
            "_parent": F.lit(None).cast("string") if r.parent is None else r.parent,
            **r.extra,
        }
    ).withColumn("_norm", X.normalize("text"))
    if isinstance(terms, DataFrame):
        read, matched = _table_matched(read, terms, r.entity), F.col("matched_terms")
    else:
        matched = _matched(terms, r.entity)
    keyed = read.withColumns(
        {
            "no_text": F.col("drift_reason").isNull() & (F.col("error_item") | F.col("text").isNull()),
            "matched_terms": matched,
            "mention_id": S.mention_id(
                F.lit(source),
                F.col("url")
                if r.key_is_url
                else F.coalesce("native_id", "url", X.text_key("_norm", normalized=True)),
            ),
            "author_hash": S.author_hash(F.lit(source), "_handle"),
            "lang": X.detect_lang("_norm", normalized=True),
            "match_kind": F.lit("entity" if r.entity else "text"),
        }
    )
    if inherit:
        keyed = inherit_terms(keyed)
    usable = F.col("drift_reason").isNull() & ~F.col("no_text")
    return keyed.withColumns(
        {
            "no_match": usable & (F.coalesce(F.size("matched_terms"), F.lit(0)) == 0),
            "cluster_key": S.cluster_key("source", "mention_id", "author_hash", "_parent"),
            "cluster_key_fell_back": usable
            & (F.size("matched_terms") > 0)
            & S.cluster_key_fell_back("source", "_parent"),
            "raw_ref": F.concat(F.col("local_seq").cast("string"), F.lit("#"), F.col("index").cast("string")),
        }
    )


def inherit_terms(parsed: DataFrame) -> DataFrame:
    """J01. Unmatched comments take the terms of their matched post in the same payload."""
    comment = F.coalesce("is_comment", F.lit(False))
    posts = (
        parsed.filter(~comment & (F.size("matched_terms") > 0) & F.col("drift_reason").isNull())
        .groupBy("local_seq", "brand", F.col("native_id").alias("_parent"))
        .agg(F.max_by("matched_terms", "index").alias("_post_terms"))
    )
    joined = parsed.join(posts, ["local_seq", "brand", "_parent"], "left")
    takes = comment & (F.size("matched_terms") == 0) & F.col("_post_terms").isNotNull()
    return joined.withColumns(
        {
            "matched_terms": F.when(takes, F.col("_post_terms")).otherwise(F.col("matched_terms")),
            "match_kind": F.when(takes, "inherited").otherwise(F.col("match_kind")),
        }
    ).drop("_post_terms")


def mentions(parsed: DataFrame, whole_run: bool = True) -> DataFrame:
    """The mentions of parsed items. With ``whole_run`` one drifted item voids its run."""
    # The verdict is generated: a filter on plain columns would be pushed below the texts, which are then read,
    # normalised and matched once for the filter and again for the row.
    is_good = F.col("drift_reason").isNull() & ~F.col("no_text") & ~F.col("no_match")
    names = schemas.columns(schemas.MENTION)
    judged = parsed.select("local_seq", *names, F.explode(F.array(is_good)).alias("_good"))
    good = judged.filter("_good")
    if whole_run:
        bad = parsed.filter("drift_reason is not null").select("local_seq").distinct()
        good = good.join(bad, "local_seq", "left_anti")
    return good.select(*names)


def drifted(parsed: DataFrame) -> DataFrame:
    """SRC12. Items that broke the contract, with the reason and the raw item."""
    return parsed.filter("drift_reason is not null").select(
        "local_seq", "run_id", "brand", "source", "index", F.col("drift_reason").alias("reason"),
        F.to_json("item").alias("raw"),
    )


def run_outcomes(parsed: DataFrame) -> DataFrame:
    """SRC12, SRC13. Abstention reason per run: schema_drift, empty, or null when rows came."""
    sums = parsed.groupBy("local_seq", "brand", "source").agg(
        F.min_by("drift_reason", F.when(F.col("drift_reason").isNotNull(), F.col("index"))).alias("detail"),
        F.count_if(F.col("drift_reason").isNotNull()).alias("n_drift"),
        F.bool_and("error_item").alias("all_errors"),
        F.bool_and("no_text").alias("no_usable_text"),
    )
    empty = F.col("all_errors") | ((F.col("source") == "reddit") & F.col("no_usable_text"))
    return sums.select(
        "local_seq", "brand", "source",
        F.when(F.col("n_drift") > 0, "schema_drift").when(empty, "empty").alias("reason"),
        "detail",
    )


def parse_all(
    items: DataFrame, terms: Mapping[str, Sequence[str]] | DataFrame, sources: Sequence[str] | None = None
) -> DataFrame:
    """U01. The asked sources (all by default), in plan order."""
    keep = [
        *schemas.columns(schemas.MENTION), "local_seq", "index", "item", "drift_reason", "error_item",
        "no_text", "no_match", "cluster_key_fell_back",
    ]
    out = None
    for source in READINGS if sources is None else [s for s in READINGS if s in sources]:
        part = parse(items, source, terms).select(*keep)
        out = part if out is None else out.unionByName(part)
    return out


def resolved_reviews(items: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J09. (items of brands whose entity lookup found something, abstentions of the others)."""
    pairs = entities.filter("entity is not null").select("brand", "source").distinct()
    lost = entities.join(pairs, ["brand", "source"], "left_anti").select(
        F.lit("source").alias("scope"), "brand", "source", F.lit("empty").alias("reason")
    ).distinct()
    return items.join(pairs, ["brand", "source"], "left_semi"), lost
