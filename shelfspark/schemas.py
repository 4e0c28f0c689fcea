"""Explicit schemas as DDL text. Inference is for fixtures only."""

from __future__ import annotations

from pyspark.sql import types as T

NAMED = "array<struct<name:string>>"
TAGS = "array<struct<name:string,weight:int>>"

# Numbers arrive as text or as JSON numbers; both read as string and are cast later.
_PAYLOAD = {
    **dict.fromkeys(
        "title title_japanese title_english synopsis episodes status season year source score scored_by rank "
        "popularity members type".split(),
        "string",
    ),
    **dict.fromkeys("studios genres themes demographics explicit_genres".split(), NAMED),
    "tags": TAGS,
    "images": "struct<jpg:struct<large_image_url:string,image_url:string>,webp:struct<large_image_url:string>>",
}
PAYLOAD = ", ".join(f"{n} {t}" for n, t in _PAYLOAD.items())
CRAWL_LINE = f"mal_id bigint, data struct<{','.join(f'{n}:{t}' for n, t in _PAYLOAD.items())}>"
RAW = "mal_id bigint, source string, payload string, fetched_at timestamp_ntz, expires_at timestamp_ntz"
CATALOG = (
    "mal_id bigint, title string, title_japanese string, synopsis string, episodes int, status string, season string, "
    f"year int, studios array<string>, source string, genres array<string>, tags {TAGS}, score double, "
    "image_url string, sources array<string>, score_mal double, scored_by_mal int, rank_mal int, popularity_mal int, "
    f"score_anilist double, favourites_anilist int, popularity_anilist int, tags_anilist {TAGS}, "
    "description_anilist string, doc_vi string, review_digest string"
)
LIST_PAYLOAD = (
    "data struct<MediaListCollection:struct<lists:array<struct<entries:array<struct<"
    "media:struct<idMal:bigint>,score:double,completedAt:struct<year:int,month:int,day:int>>>>>>>"
)
RATINGS = "user_id int, item_id int, rating int, timestamp bigint"
# The 19 genre flags of the 24-column movie file, in file order.
MOVIE_GENRES = (
    "unknown Action Adventure Animation Children's Comedy Crime Documentary Drama Fantasy Film-Noir Horror Musical "
    "Mystery Romance Sci-Fi Thriller War Western"
).split()
MOVIES = "movie_id int, title string, release_date string, video_release_date string, IMDb_URL string, " + ", ".join(
    f"`{g}` int" for g in MOVIE_GENRES
)
USERS = "user_id int, age int, gender string, occupation string, zip_code string"
WATERMARK = "pipeline string, last_run timestamp_ntz"


def fields(ddl: str) -> list[T.StructField]:
    """The columns of a DDL text; needs a running session."""
    return T.StructType.fromDDL(ddl).fields
