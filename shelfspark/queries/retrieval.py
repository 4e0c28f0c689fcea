"""Retrieval and text queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from shelfspark.functions import text
from shelfspark.operators import metrics, retrieval as op
from shelfspark.plans import golden as gold, tables
from shelfspark.queries import query
from shelfspark.queries.common import CAT, cat_lean, cat_once, with_ctes
from shelfspark.runtime import cut_lineage
from shelfspark.sources import sinks


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def lang_sql(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({c}), '[{text.VI_DIACRITICS}]') OR list_has_any(regexp_extract_all(lower({c}), '[a-zà-ỹđ]+'), "
        f"[{quoted(sorted(set(text.VI_WORDS)))}]) THEN 'vi' ELSE 'en' END"
    )


def genre_sql(c: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + f" THEN '{g}'"
        for g, words in text.GENRE_KEYWORDS.items()
    )
    return f"CASE {whens} END"


# --- text -----------------------------------------------------------------------------


@query("strip_html", """
SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS plain FROM pages""")
def strip_html(spark, d):
    """Whole pages: no cut."""
    return tables.texts(spark, d, "pages").select("page_id", text.strip_html(F.col("html"), None).alias("plain"))


@query("normalize_text", "SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS norm FROM conversations")
def normalize_text(spark, d):
    return tables.texts(spark, d, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("norm"))


@query("detect_language", f"SELECT doc_id, {lang_sql('text')} AS detected FROM documents")
def detect_language(spark, d):
    return tables.texts(spark, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("detected"))


ASK = ["a Robot", "TÌNH CẢM", "sci-fi", "bóng đá", "nothing", "detective magic", "đời thường", "hài", "scary drama", "Isekai"]


@query("infer_genre", f"""
SELECT doc_id, {genre_sql("(text || ' ' || [" + quoted(ASK) + "][doc_id % 10 + 1])")} AS genre FROM documents""")
def infer_genre(spark, d):
    asked = F.concat(F.col("text"), F.lit(" "), tables.pick(ASK, F.col("doc_id") % 10))
    return tables.texts(spark, d, "documents").select("doc_id", text.infer_genre(asked).alias("genre"))


GOLDEN = """
golden AS (SELECT s_suppkey AS id, a.p_name AS a, b.p_name AS b, a.p_type AS t, string_split(a.p_name, ' ')[1] AS word, s_suppkey % 10 AS kind,
    ['score', 'studio', 'year', 'episodes', 'season_status'][s_suppkey // 10 % 5 + 1] AS field
  FROM supplier JOIN part a ON a.p_partkey = s_suppkey * 7 JOIN part b ON b.p_partkey = s_suppkey * 11),
named AS (SELECT id, 1 AS pos, a AS name FROM golden WHERE kind IN (0, 3) UNION ALL SELECT id, 1, trim(substr(a, 2, 6)) FROM golden WHERE kind = 1
  UNION ALL SELECT id, 1, a FROM golden WHERE kind = 2 UNION ALL SELECT id, 2, b FROM golden WHERE kind = 2
  UNION ALL SELECT id, 1, 'Zzyzx Quux' FROM golden WHERE kind IN (8, 9))
"""
RESOLVED = """
idx AS (SELECT key, min(mal_id) AS mal_id FROM (SELECT lower(title) AS key, mal_id FROM cat UNION ALL
  SELECT lower(title_japanese), mal_id FROM cat WHERE title_japanese IS NOT NULL) GROUP BY key),
res AS (SELECT id, pos, mal_id FROM (SELECT n.id, n.pos, i.mal_id, row_number() OVER (PARTITION BY n.id, n.pos
    ORDER BY (key <> lower(name))::INT, length(key), (type <> 'TV')::INT, i.mal_id, key) AS r
  FROM named n JOIN idx i ON contains(key, lower(name)) JOIN cat ON cat.mal_id = i.mal_id) WHERE r = 1),
ex AS (SELECT DISTINCT mal_id, lower(g) AS g FROM (SELECT mal_id, unnest(genres) AS g FROM cat)),
sc AS (SELECT mal_id, title, status, coalesce(score, 0.0) AS score, members FROM cat),
near AS (SELECT * FROM (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY score DESC, members DESC, item) AS rank FROM (
  SELECT DISTINCT res.id, sc.mal_id AS item, sc.score, sc.members FROM res JOIN golden USING (id)
    JOIN (SELECT mal_id, unnest(genres) AS g FROM cat) x ON x.mal_id = res.mal_id JOIN (SELECT mal_id, unnest(genres) AS g FROM cat) y ON x.g = y.g AND x.mal_id <> y.mal_id
    JOIN sc ON sc.mal_id = y.mal_id WHERE kind = 3)) WHERE rank <= 3),
bygenre AS (SELECT * FROM (SELECT id, mal_id AS item, row_number() OVER (PARTITION BY id ORDER BY score DESC, members DESC, mal_id) AS rank FROM (
  SELECT DISTINCT id, mal_id, score, members FROM golden JOIN ex ON contains(g, lower(word)) JOIN sc USING (mal_id) WHERE kind = 4)) WHERE rank <= 3),
done AS (SELECT mal_id AS item, row_number() OVER (ORDER BY score DESC, mal_id) AS rank FROM sc WHERE status = 'Finished Airing')
"""
RELEVANT = """
relv AS (SELECT id, 0 AS intent_no, mal_id AS item FROM res WHERE id % 10 IN (0, 1, 2)
  UNION SELECT id, 0, item FROM near UNION SELECT id, 0, item FROM bygenre
  UNION SELECT id, 0, item FROM golden, done WHERE kind = 7 AND rank <= 3
  UNION SELECT id, 1, mal_id FROM golden JOIN ex ON contains(g, lower(word)) WHERE kind = 5
  UNION SELECT id, 2, mal_id FROM golden JOIN ex ON contains(g, lower(t)) WHERE kind = 5)
"""


@query("parse_titles", with_ctes(GOLDEN, body="SELECT id, pos - 1 AS pos, name FROM named"))
def parse_titles(spark, d):
    rows = tables.golden(spark, d).select("id", F.posexplode(text.parse_titles(F.col("entities"))).alias("pos", "name"))
    return rows


@query("relevance_sets", with_ctes(CAT, GOLDEN, RESOLVED, RELEVANT, body="SELECT * FROM relv"))
def relevance_sets(spark, d):
    return gold.relevance_sets(tables.golden(spark, d), cat_once(spark, d))


@query("golden_genres", with_ctes(CAT, GOLDEN, RESOLVED, body="""
SELECT DISTINCT id AS query, g AS genre FROM res JOIN ex USING (mal_id) WHERE id % 10 IN (0, 1, 2, 3)
UNION SELECT id, g FROM bygenre JOIN ex ON ex.mal_id = item
UNION SELECT id, g FROM (SELECT id, mal_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, members DESC, mal_id) AS r FROM (
  SELECT DISTINCT id, mal_id, score, members FROM golden JOIN ex ON contains(g, lower(word)) JOIN sc USING (mal_id) WHERE kind = 5)) JOIN ex USING (mal_id) WHERE r <= 3"""))
def golden_genres(spark, d):
    return gold.golden_genres(tables.golden(spark, d), cat_once(spark, d))


@query("golden_reference", with_ctes(CAT, GOLDEN, RESOLVED, body="""
, f AS (SELECT mal_id, title, array_to_string(genres, ', ') AS gt, coalesce(score::VARCHAR, 'None') AS s, year, episodes, season, status, studios[1] AS studio FROM cat),
one AS (SELECT res.id, f.* FROM res JOIN f USING (mal_id) WHERE pos = 1), two AS (SELECT res.id, f.* FROM res JOIN f USING (mal_id) WHERE pos = 2),
lst AS (SELECT id, string_agg(title, ', ' ORDER BY rank) AS names, count(*) AS n FROM (
  SELECT id, item, rank FROM near UNION ALL SELECT id, item, rank FROM bygenre UNION ALL SELECT id, item, rank FROM golden, done WHERE kind = 7 AND rank <= 3
  UNION ALL SELECT id, mal_id, r FROM (SELECT id, mal_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, members DESC, mal_id) AS r FROM (
    SELECT DISTINCT id, mal_id, score, members FROM golden JOIN ex ON contains(g, lower(word)) JOIN sc USING (mal_id) WHERE kind = 5)) WHERE r <= 3)
  JOIN cat ON mal_id = item GROUP BY id),
ans AS (SELECT g.id, CASE
    WHEN kind = 0 THEN CASE field WHEN 'score' THEN one.title || ': score ' || one.s || '/10 (? votes)' WHEN 'studio' THEN one.title || ': studio(s) ' || one.studio
      WHEN 'year' THEN one.title || ': year ' || one.year || ' (' || one.season || ')' WHEN 'episodes' THEN one.title || ': ' || one.episodes || ' episodes'
      ELSE one.title || ': status ' || one.status END
    WHEN kind = 1 THEN 'Canonical title: ' || one.title || ' (' || one.year || ', score ' || one.s || ')'
    WHEN kind = 2 THEN one.title || ' (' || one.year || ', ' || one.episodes || ' eps, score ' || one.s || ') VS ' || two.title || ' (' || two.year || ', ' || two.episodes || ' eps, score ' || two.s || ')'
    WHEN kind = 3 THEN 'Base: ' || one.title || ' (' || one.gt || '). Valid same-genre picks from DB: ' || lst.names
    WHEN kind IN (4, 5) THEN 'Top ' || word || ' picks from DB by score: ' || lst.names
    WHEN kind = 7 THEN 'Finished-airing picks from DB: ' || lst.names ELSE '' END AS reference,
    CASE WHEN kind IN (0, 1) THEN 1 WHEN kind = 2 THEN 2 WHEN kind = 3 THEN 1 + lst.n WHEN kind IN (4, 5, 7) THEN lst.n ELSE 0 END AS n_contexts
  FROM golden g LEFT JOIN one ON one.id = g.id LEFT JOIN two ON two.id = g.id LEFT JOIN lst ON lst.id = g.id)
SELECT id, reference, reference = '' AS needs_review, CAST(n_contexts AS INTEGER) AS n_contexts FROM ans"""))
def golden_reference(spark, d):
    rows = gold.golden_reference(tables.golden(spark, d), cat_once(spark, d))
    return rows.select("id", "reference", "needs_review", F.size("contexts").alias("n_contexts"))


DOC_SQL = """
docs AS (SELECT mal_id, concat_ws(chr(10), 'Title: ' || title, 'Japanese title: ' || title_japanese,
  'Tags: ' || tag_names[1] || ' (' || tag_weights[1] || '%), ' || tag_names[2] || ' (' || tag_weights[2] || '%)',
  concat_ws(' | ', 'Year: ' || year, 'Season: ' || season, 'Episodes: ' || episodes, 'Status: ' || status, 'Source: ' || source,
    'Studios: ' || studios[1], 'Genres: ' || array_to_string(genres, ', '), 'Score: ' || score || '/10'),
  'Synopsis: ' || synopsis) AS doc FROM cat)
"""


@query("build_document", with_ctes(CAT, DOC_SQL, body="SELECT mal_id, doc FROM docs"))
def build_document(spark, d):
    return op.with_document(cat_lean(spark, d)).select("mal_id", "doc")


@query("doc_text", with_ctes(CAT, body="SELECT mal_id, trim(title || ' ' || array_to_string(genres, ', ') || ' ' || coalesce(synopsis, '')) AS line FROM cat"))
def doc_text(spark, d):
    genres = F.array_join("genres", ", ")
    return cat_lean(spark, d).select("mal_id", text.rerank_text(F.col("title"), genres, F.col("synopsis")).alias("line"))


@query("names_of", with_ctes(CAT, body="""
SELECT mal_id, CASE WHEN mal_id % 3 = 0 THEN array_to_string(genres, '|') WHEN mal_id % 3 = 1 THEN title ELSE '' END AS names FROM cat"""))
def names_of(spark, d):
    m = F.col("mal_id")
    raw = F.when(m % 3 == 0, F.to_json("genres")).when(m % 3 == 1, F.col("title")).otherwise("")
    return cat_lean(spark, d).select("mal_id", F.array_join(text.names_of(raw), "|").alias("names"))


@query("build_prompts", with_ctes(CAT, body=f"""
, q AS (SELECT item_id AS query, text, {lang_sql('text')} AS lang FROM benchmark),
c AS (SELECT item_id AS query, r AS rank, cat.* FROM benchmark, (SELECT unnest([1, 2, 3]) AS r) JOIN cat ON mal_id = item_id * 3 + r WHERE item_id % 4 <> 0),
b AS (SELECT query, count(*) AS n, string_agg(rank || '. Name: ' || title || chr(10) || '   Genres: ' || array_to_string(genres, ', ') || chr(10) ||
    '   Summary: ' || coalesce(synopsis, 'None') || chr(10) || '   Year: ' || year || ' (score: ' || coalesce(score::VARCHAR, 'None') || ')', chr(10) || chr(10) ORDER BY rank) AS ctx FROM c GROUP BY query)
SELECT query, lang, 'system' AS role, '{text.SYSTEM_PROMPT.replace("'", "''")} ' || CASE lang WHEN 'vi' THEN '{text.PIN_VI}' ELSE '{text.PIN_EN}' END AS content FROM q
UNION ALL SELECT query, lang, 'user', '[User Query]' || chr(10) || text || chr(10) || chr(10) || '[Context - Top ' || coalesce(n, 0) || ' Retrieved Items]' || chr(10) ||
  coalesce(ctx, '{text.NO_CANDIDATES}') FROM q LEFT JOIN b USING (query)"""))
def build_prompts(spark, d):
    b = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    slots = b.filter("query % 4 <> 0").select("query", F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])).alias("rank"))
    cands = slots.withColumn("mal_id", F.col("query") * 3 + F.col("rank")).join(cat_lean(spark, d), "mal_id").select(
        "query", "rank", "title", F.array_join("genres", ", ").alias("genres"), "synopsis", "year", "score"
    )
    out = op.build_prompts(b, cands)
    return out.select("query", "lang", F.explode("messages").alias("m")).select("query", "lang", "m.role", "m.content")


# --- search ---------------------------------------------------------------------------

COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query("vector_search", f"""
SELECT query, item, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query, b.vec_id AS item, {COS.format(a='a.embedding', b='b.embedding')} AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS.format(a='a.embedding', b='b.embedding')}, 9) DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b) WHERE rank <= 10""")
def vector_search(spark, d):
    v = tables.vectors(spark, d)
    return op.vector_search(v, v, 10).withColumn("score", F.round("score", 6))


@query("vector_search_approx")
def vector_search_approx(spark, d):
    v = tables.vectors(spark, d)
    return op.vector_search_approx(v, v, 10)


POINTS = f"""
pts AS (SELECT vec_id AS id, label, embedding AS vector, CASE WHEN vec_id % 4 <> 0 THEN list_reverse(embedding) END AS vector_vi,
  [[{quoted(tables.POINT_GENRES)}][vec_id % 7 + 1], [{quoted(tables.POINT_GENRES)}][vec_id // 7 % 7 + 1]] AS genres, vec_id * 37 % 101 / 10 AS item_score FROM embeddings),
qs AS (SELECT vec_id AS id, [{quoted(tables.LABEL_TEXT)}][label + 1] AS text, embedding AS vector FROM embeddings)
"""


@query("hybrid_search", with_ctes(POINTS, body=f"""
, g AS (SELECT *, {genre_sql('text')} AS genre FROM qs),
s AS (SELECT g.id AS query, p.id AS item, genre, {COS.format(a='g.vector', b='p.vector')} AS score, item_score FROM g, pts p
  WHERE genre IS NULL OR list_has_all(string_split(lower(array_to_string(p.genres, ' ')), ' '), string_split(lower(genre), ' '))),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS r FROM s),
h AS (SELECT *, score + 0.02 * (item_score / 10) AS blend FROM f WHERE r <= CASE WHEN genre IS NULL THEN 5 ELSE 10 END)
SELECT query, item, genre, round(score, 6) AS score, item_score, round(blend, 6) AS blend, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(blend, 9) DESC, r) AS rank FROM h) WHERE rank <= 5"""))
def hybrid_search(spark, d):
    found = op.hybrid_search(tables.vector_queries(spark, d), tables.vector_points(spark, d), 5)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "blend")})


@query("bilingual_search", with_ctes(POINTS, body=f"""
, g AS (SELECT *, {lang_sql('text')} AS lang FROM qs),
s AS (SELECT g.id AS query, p.id AS item, lang, CASE lang WHEN 'vi' THEN {COS.format(a='g.vector', b='p.vector_vi')} ELSE {COS.format(a='g.vector', b='p.vector')} END AS score
  FROM g, pts p WHERE vector_vi IS NOT NULL)
SELECT query, item, round(score, 6) AS score, rank, lang FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM s) WHERE rank <= 10"""))
def bilingual_search(spark, d):
    found = op.bilingual_search(tables.vector_queries(spark, d), tables.vector_points(spark, d), 10)
    return found.withColumn("score", F.round("score", 6))


@query("rerank_blend", """
WITH h AS (SELECT user_id AS query, event_id AS item, round(value / 500, 1) AS score, event_id % 101 / 10 AS item_score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events)
SELECT query, item, rank, row_number() OVER (PARTITION BY query ORDER BY round(score + 0.02 * (item_score / 10), 9) DESC, rank) AS new_rank FROM h""")
def rerank_blend(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    hits = tables.table(spark, d, "events").select(
        F.col("user_id").alias("query"), F.col("event_id").alias("item"), F.round(F.col("value") / 500, 1).alias("score"),
        (F.col("event_id") % 101 / 10).alias("item_score"), F.row_number().over(w).alias("rank"),
    )
    return op.rerank_blend(hits).select("query", "item", "rank", "new_rank")


@query("rerank_model", """
WITH p AS (SELECT item_id AS query, doc_id, doc_id // 40 + 1 AS rank, b.text AS q, d.text AS doc FROM documents d JOIN benchmark b ON doc_id % 40 = item_id),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(q), '[\\p{L}\\p{N}]+')) AS a, regexp_extract_all(lower(doc), '[\\p{L}\\p{N}]+') AS b FROM p),
s AS (SELECT query, doc_id, rank, len(list_intersect(a, b)) / len(a) AS score FROM w)
SELECT query, doc_id, rank, round(score, 6) AS model_score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, rank) AS new_rank, FROM s) WHERE new_rank <= 10""")
def rerank_model(spark, d):
    """Every document is a hit of one benchmark text; whole documents are scored."""
    docs = tables.texts(spark, d, "documents").select("doc_id", F.col("text").alias("doc"))
    asks = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))
    pairs = docs.withColumns(
        {"query": F.col("doc_id") % 40, "rank": (F.floor(F.col("doc_id") / 40) + 1).cast("long")}
    ).join(asks, "query")
    found = op.rerank_model(pairs, 10)
    return found.select("query", "doc_id", "rank", F.round("model_score", 6).alias("model_score"), "new_rank")


@query("translate_queries", f"""
SELECT conv_id, turn, CASE WHEN {lang_sql('text')} = 'vi' THEN 'EN ' || text ELSE text END AS text_en FROM conversations""")
def translate_queries(spark, d):
    """With a stand-in translator that marks what it was sent."""
    rows = tables.texts(spark, d, "conversations").select("conv_id", "turn", "text")
    return op.translate_queries(rows, lambda texts: [f"EN {t}" for t in texts]).drop("text")


@query("translate_docs", with_ctes(CAT, DOC_SQL, body="SELECT mal_id, 'VI ' || doc AS doc_vi FROM docs WHERE mal_id % 2 = 1"))
def translate_docs(spark, d):
    docs = op.with_document(cat_lean(spark, d)).withColumn("doc_vi", F.when(F.col("mal_id") % 2 == 0, "there already"))
    return op.translate_docs(docs, lambda texts: [f"VI {t}" for t in texts])


@query("index_incremental", with_ctes(CAT, body="""
SELECT mal_id AS id, 64 AS dims, title, array_to_string(genres, ', ') AS genres, coalesce(synopsis, '') AS synopsis FROM cat WHERE p_size > 20"""))
def index_incremental(spark, d):
    indexed = tables.table(spark, d, "part").filter("p_size <= 20").select(F.col("p_partkey").alias("mal_id"))
    points = op.index_incremental(cat_lean(spark, d), indexed)
    return points.select("id", F.size("vector").alias("dims"), "payload.title", "payload.genres", "payload.synopsis")


@query("vector_table", with_ctes(CAT, body="""
SELECT mal_id AS id, title, array_to_string(genres, ', ') AS genres, year, score, image_url, coalesce(synopsis, '') AS synopsis FROM cat"""))
def vector_table(spark, d):
    rows = cat_lean(spark, d).withColumn("vector", F.array(F.col("year").cast("float")))
    return sinks.vector_points(rows).select("id", "payload.*").drop("mal_id")


@query("benchmark_report", with_ctes(CAT, GOLDEN, RESOLVED, RELEVANT, body="""
, lst AS (SELECT id AS query, item, row_number() OVER (PARTITION BY id ORDER BY item * 31 % 17, item) AS rank FROM
    (SELECT DISTINCT id, item FROM relv UNION SELECT g.id, p.p_partkey FROM golden g JOIN part p ON p.p_partkey BETWEEN g.id AND g.id + 9)),
top AS (SELECT * FROM lst WHERE rank <= 10), sg AS (SELECT id AS query FROM golden WHERE kind <> 5), mg AS (SELECT id AS query FROM golden WHERE kind = 5),
nrel AS (SELECT id AS query, count(DISTINCT item) AS n_rel FROM relv GROUP BY id),
h AS (SELECT DISTINCT top.query, rank, (relv.item IS NOT NULL)::INTEGER AS hit FROM top LEFT JOIN relv ON relv.id = top.query AND relv.item = top.item),
ideal AS (SELECT n, (SELECT sum(1 / log2(i + 1)) FROM range(1, n + 1) t(i)) AS dcg FROM range(1, 11) s(n)),
a AS (SELECT sg.query, coalesce(max(n_rel), 0) AS n_rel, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) / 5 AS p5, sum(hit) / 10 AS p10,
  sum(CASE WHEN rank <= 5 THEN hit / log2(rank + 1) ELSE 0 END) AS d5, sum(hit / log2(rank + 1)) AS d10, coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0) AS mrr
  FROM sg LEFT JOIN h USING (query) LEFT JOIN nrel USING (query) GROUP BY sg.query),
s AS (SELECT count(*) AS n, round(avg(p5), 4) AS precision_5, round(avg(p10), 4) AS precision_10, round(avg(coalesce(d5 / i5.dcg, 0)), 4) AS ndcg_5,
  round(avg(coalesce(d10 / i10.dcg, 0)), 4) AS ndcg_10, round(avg(mrr), 4) AS mrr
  FROM a LEFT JOIN ideal i5 ON i5.n = least(n_rel, 5) LEFT JOIN ideal i10 ON i10.n = least(n_rel, 10)),
it AS (SELECT DISTINCT id AS query, intent_no FROM relv WHERE intent_no > 0),
met AS (SELECT DISTINCT r.id AS query, r.intent_no FROM relv r JOIN top ON top.query = r.id AND top.item = r.item WHERE rank <= 5 AND intent_no > 0),
ir AS (SELECT query, round(sum((met.query IS NOT NULL)::INTEGER) / count(*), 6) AS v FROM it LEFT JOIN met USING (query, intent_no) GROUP BY query),
mi AS (SELECT round(avg(coalesce(v, 0)), 4) AS intent_recall_5, count(*) AS n_multi FROM mg LEFT JOIN ir USING (query)),
lt AS (SELECT value AS ms, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events),
tm AS (SELECT round(max(CASE WHEN i = least(floor(0.5 * n), n - 1) THEN ms END), 1) AS latency_p50, round(max(CASE WHEN i = least(floor(95 / 100 * n), n - 1) THEN ms END), 1) AS latency_p95 FROM lt)
SELECT * FROM s, mi, tm"""))
def benchmark_report(spark, d):
    """Lists mix each question's relevant items with ten others; latencies are the event values."""
    g = tables.golden(spark, d)
    direct, asked, listed = (cut_lineage(x, "relevant") for x in gold.relevance_parts(g, cat_once(spark, d)))
    others = g.select("id", F.explode(F.sequence(F.col("id"), F.col("id") + 9)).alias("item"))
    known = tables.table(spark, d, "part").select(F.col("p_partkey").alias("item"))
    ranked = gold.mixed_lists(direct, asked, listed, others.join(known, "item", "left_semi"), F.col("item") * 31 % 17, 10)
    ranked = cut_lineage(ranked, "ranked")
    # only single-intent questions are judged by their relevant items, and none of them has a set per genre
    relevant = direct.select(F.col("id").alias("query"), "item").distinct()
    intents = gold.listed_intents(asked, listed, ranked)
    latency = tables.table(spark, d, "events").select(F.col("value").alias("ms"))
    return metrics.benchmark_report(g.select(F.col("id").alias("query"), "intent"), ranked, relevant, intents, latency)
