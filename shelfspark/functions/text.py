"""Text expressions: cleaning, language and genre detection, retrieval documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Diacritics that mark a Vietnamese query.
VI_DIACRITICS = (
    "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
)
# Vietnamese stop words, accented then unaccented.
VI_WORDS = [
    "của", "những", "và", "với", "cho", "từ", "này", "kia", "gì", "nào", "không", "có", "là", "một", "người", "phim", "hay",
    "nhất", "giới", "thiệu", "gợi", "ý", "xem", "tôi", "muốn", "tìm", "kiếm", "kinh", "dị", "hài", "hước", "lãng", "mạn",
    "chiến", "đấu", "cua", "nhung", "va", "voi", "cho", "tu", "nay", "kia", "gi", "nao", "khong", "co", "la", "mot", "nguoi",
    "phim", "nhat", "goi", "xem", "toi", "muon", "tim", "kiem", "kinh", "di", "huoc", "lang", "man", "chien", "dau", "vua",
    "thao",
]
# Genre -> query keywords; the first genre with a match wins.
GENRE_KEYWORDS = {
    "Mecha": ["mecha", "robot", "gundam", "evangelion", "votoms"],
    "Isekai": ["isekai", "reincarnat", "transferred to another world", "chuyển sinh", "dị giới"],
    "Romance": ["romance", "love story", "lãng mạn", "tình cảm"],
    "Horror": ["horror", "scary", "kinh dị"],
    "Comedy": ["comedy", "funny", "hài hước", "hài"],
    "Sports": ["sports", "football", "basketball", "thể thao", "bóng đá"],
    "Mystery": ["mystery", "detective", "trinh thám", "bí ẩn"],
    "Fantasy": ["fantasy", "magic", "phép thuật", "giả tưởng"],
    "Sci-Fi": ["sci-fi", "scifi", "science fiction", "viễn tưởng", "không gian"],
    "Slice of Life": ["slice of life", "đời thường"],
    "Action": ["action", "hành động", "chiến đấu"],
    "Drama": ["drama", "chính kịch", "tâm lý"],
}
# The wording of the answer prompt.
SYSTEM_PROMPT = (
    "You are an anime recommendation expert. Use ONLY the candidate information "
    "(Context) below. Pick the 2 titles that best fit the user's request, explain "
    "why each fits, and compare how they differ. Reply in the same language as "
    "the user query. If no candidate fits, say so honestly instead of inventing details."
)
PIN_VI = "Respond ONLY in Vietnamese. Trả lời CHỈ bằng tiếng Việt."
PIN_EN = "Respond ONLY in English."
NO_CANDIDATES = "(no candidates retrieved)"
DEFAULT_TITLE = "Anime "

TITLE_CLAUSE = "(?:title~|title=|similar_to=)([^;]+)"
GENRE_CLAUSE = "(?:genre|genre/theme)=([^;]+)"

_LETTER = "[a-zà-ỹđ]"
_BLANK = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]+"


def collapse_spaces(c: Column) -> Column:
    """Runs of Unicode white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, _BLANK, " "))


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def normalize(c: Column) -> Column:
    """Lower case, single blanks, trimmed; null becomes the empty string."""
    return F.lower(collapse_spaces(F.coalesce(c, F.lit(""))))


def strip_html(c: Column, limit: int | None = None) -> Column:
    """Tags become blanks, blanks collapse; cut to ``limit`` unless None; empty becomes null."""
    plain = collapse_spaces(F.regexp_replace(c, "<[^>]+>", " "))
    return F.nullif(plain if limit is None else F.substring(plain, 1, limit), F.lit(""))


def detect_language(c: Column) -> Column:
    """'vi' when a diacritic or a stop word is present, else 'en'."""
    q = F.lower(c)
    # a whole word of the list: one scan of the text, no array of its words
    stop = f"(?<!{_LETTER})(?:{'|'.join(sorted(set(VI_WORDS)))})(?!{_LETTER})"
    return F.when(q.rlike(f"[{VI_DIACRITICS}]") | q.rlike(stop), "vi").otherwise("en")


def infer_genre(c: Column) -> Column:
    """First genre (in table order) with a keyword inside the query; else null."""
    q = F.lower(c)
    picks = []
    for genre, words in GENRE_KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        picks.append(F.when(hit, F.lit(genre)))
    return F.coalesce(*picks)


def names_of(c: Column) -> Column:
    """A JSON list, or plain text, as an array of non-empty strings."""
    parsed = F.from_json(c, "array<string>")
    value = F.when(parsed.isNotNull(), parsed).when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.filter(value, lambda x: x.isNotNull() & (x != ""))


def parse_titles(c: Column) -> Column:
    """Titles named in an entity cell: ``compare=[a, b]`` or a title clause split on '/'."""
    text = F.coalesce(c, F.lit(""))

    def parts(group: Column, sep: str) -> Column:
        return F.filter(F.transform(F.split(group, sep), lambda x: F.trim(x)), lambda x: x != "")

    compare = "compare=\\[(.*?)\\]"
    return (
        F.when(text.rlike(compare), parts(F.regexp_extract(text, compare, 1), ","))
        .when(text.rlike(TITLE_CLAUSE), parts(F.regexp_extract(text, TITLE_CLAUSE, 1), "/"))
        .otherwise(F.array().cast("array<string>"))
    )


def genre_tokens(c: Column) -> Column:
    """Every genre named in an entity cell, trimmed."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(GENRE_CLAUSE), F.lit(1)), lambda x: F.trim(x))


def number_text(c: Column) -> Column:
    """A double the way the documents print it: 8.5, 9.0."""
    return c.cast("string")


def _labelled(label: str, value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNotNull() & (text != ""), F.concat(F.lit(f"{label}: "), text))


def _nonzero(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != 0), F.concat(F.lit(f"{label}: "), value.cast("string")))


def _joined(label: str, values: Column) -> Column:
    kept = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.concat(F.lit(f"{label}: "), F.array_join(kept, ", ")))


def retrieval_document(
    item_id: Column,
    title: Column,
    title_japanese: Column,
    synopsis: Column,
    episodes: Column,
    status: Column,
    season: Column,
    year: Column,
    studios: Column,
    source: Column,
    genres: Column,
    score: Column,
    tags: Column,
    digest: Column | None = None,
    max_tags: int | None = None,
    max_synopsis: int | None = None,
) -> Column:
    """One text block per item: title, tags, facets, synopsis; empty parts are dropped, nothing else is cut unless asked."""
    shown = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit(DEFAULT_TITLE), item_id.cast("string")))
    alt = F.when((title_japanese != "") & (title_japanese != shown), F.concat(F.lit("Japanese title: "), title_japanese))
    named = F.filter(tags, lambda t: t["name"].isNotNull() & (t["name"] != ""))
    tag_text = F.transform(
        named if max_tags is None else F.slice(named, 1, max_tags),
        lambda t: F.concat(t["name"], F.lit(" ("), F.coalesce(t["weight"], F.lit(0)).cast("string"), F.lit("%)")),
    )
    facets = F.concat_ws(
        " | ",
        _nonzero("Year", year),
        _labelled("Season", season),
        _nonzero("Episodes", episodes),
        _labelled("Status", status),
        _labelled("Source", source),
        _joined("Studios", studios),
        _joined("Genres", genres),
        F.when(score.isNotNull() & (score != 0), F.concat(F.lit("Score: "), number_text(score), F.lit("/10"))),
    )
    body = strip(F.coalesce(synopsis, F.lit("")))
    reviews = strip(F.coalesce(digest, F.lit(""))) if digest is not None else F.lit("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), shown),
        alt,
        F.when(F.size(named) > 0, F.concat(F.lit("Tags: "), F.array_join(tag_text, ", "))),
        F.nullif(facets, F.lit("")),
        F.when(body != "", F.concat(F.lit("Synopsis: "), body if max_synopsis is None else F.substring(body, 1, max_synopsis))),
        F.when(reviews != "", F.concat(F.lit("Audience reception: "), reviews)),
    )


def rerank_text(title: Column, genres: Column, synopsis: Column) -> Column:
    """Title, genres and synopsis in one line, as a pair scorer reads them."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, genres, synopsis)]
    return F.trim(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2]))


def context_block(rank: Column, title: Column, genres: Column, synopsis: Column, year: Column, score: Column) -> Column:
    """One numbered candidate block of the prompt; missing values print as None."""

    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    return F.concat(
        rank.cast("string"), F.lit(". Name: "), shown(title),
        F.lit("\n   Genres: "), shown(genres),
        F.lit("\n   Summary: "), shown(synopsis),
        F.lit("\n   Year: "), shown(year), F.lit(" (score: "), shown(score), F.lit(")"),
    )
