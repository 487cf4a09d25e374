"""The registered queries in DuckDB SQL, written against the given tables only."""

from __future__ import annotations

from collections.abc import Mapping

from resona.functions import rulesets

from . import adapters as a

NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = "[^" + SPACE[1:]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word_test(text: str, pattern: str, options: str = "i") -> str:
    """A rule as RE2: a word boundary becomes a neighbour that is no word character."""
    parts = []
    for piece in pattern.replace(r")\b|\?", ")\\b\0\\?").split("\0"):
        if piece.startswith(r"\b"):
            piece = rf"(^|{NOT_WORD})" + piece[2:-2] + rf"($|{NOT_WORD})"
        parts.append(piece.replace(r"\w", r"[\p{L}\p{N}_]"))
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(p)}, '{options}')" for p in parts) + ")"


def first_label(text: str, rules: Mapping[str, str], default: str, options: str = "i") -> str:
    tests = " ".join(f"WHEN {word_test(text, p, options)} THEN {quoted(label)}" for label, p in rules.items())
    return f"CASE {tests} ELSE {quoted(default)} END"


def all_labels(text: str, rules: Mapping[str, str]) -> str:
    tests = ", ".join(f"CASE WHEN {word_test(text, p)} THEN {quoted(label)} END" for label, p in rules.items())
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {quoted('^' + SPACE + '+')}, ''), {quoted(SPACE + '+$')}, '')"


def clean(text: str) -> str:
    urls = quoted(f"https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+")
    return f"trim(regexp_replace(regexp_replace(coalesce({text}, ''), {urls}, ' ', 'g'), {quoted(SPACE + '+')}, ' ', 'g'), ' ')"


def sentiment(text: str, positive, negative) -> str:
    """Score of cleaned text by listing its tokens."""
    tokens = f"regexp_extract_all(lower({text}), '[a-z'']+')"

    def hits(words):
        return f"len(list_filter({tokens}, lambda t: list_contains([{', '.join(map(quoted, words))}], t)))"

    return f"CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE ({hits(positive)} - {hits(negative)}) / sqrt(len({tokens})) END"


POSTS = """
lines AS (
  SELECT l_orderkey, sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS lines,
    CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS returned,
    CAST(count(*) FILTER (l_discount > 0.05) AS DOUBLE) AS discounted,
    min(l_suppkey) AS first_supplier
  FROM lineitem GROUP BY l_orderkey),
source AS (
  SELECT *, CAST(o_orderkey AS VARCHAR) AS video_id, n_name AS region,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS ts,
    '#' || c_mktsegment || ' #' || replace(n_name, ' ', '_') || ' ' || o_orderpriority AS title
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN lines ON o_orderkey = l_orderkey),
counts AS (
  SELECT *, CASE WHEN o_orderpriority LIKE '4%' THEN 0.0 ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS play_count,
    coalesce(quantity, 0.0) AS digg_count, coalesce(lines, 0.0) AS comment_count,
    coalesce(returned, 0.0) AS share_count, coalesce(discounted, 0.0) AS collect_count,
    CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 15.0 END AS duration
  FROM source),
posts AS (
  SELECT *, play_count + digg_count + comment_count + share_count + collect_count AS eng_total,
    coalesce(1000.0 * (play_count + digg_count + comment_count + share_count + collect_count) / nullif(play_count, 0), 0.0) AS eng_per_1k_views
  FROM counts),
hashtags AS (
  SELECT DISTINCT video_id, lower(unnest(regexp_extract_all(title, '#[\\p{L}\\p{N}_]+'))) AS hashtag FROM source),
items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_suppkey, l_quantity) - 1 AS i,
    CASE WHEN l_discount <= 0.08 THEN strftime(l_shipdate, '%Y-%m-%d') END AS day FROM lineitem),
comments AS (
  SELECT video_id, video_id || '-' || i AS comment_id, l_returnflag || l_linestatus AS text, l_quantity AS digg_count, l_shipdate AS comment_ts, ts,
    l_suppkey AS supplier, region FROM source s JOIN items USING (l_orderkey)),
images AS (
  SELECT video_id, day AS image_url, CAST(row_number() OVER (PARTITION BY video_id ORDER BY i) AS INTEGER) AS image_idx
  FROM source s JOIN items USING (l_orderkey) WHERE day IS NOT NULL),
post_metrics AS (
  SELECT p.*, coalesce(h.n, 0) AS n_hashtags, coalesce(i.n, 0) AS n_images, coalesce(c.n, 0) AS n_comments_captured,
    coalesce(c.likes, 0.0) AS avg_comment_diggs
  FROM posts p LEFT JOIN (SELECT video_id, count(*) AS n FROM hashtags GROUP BY 1) h USING (video_id)
  LEFT JOIN (SELECT video_id, count(*) AS n FROM images GROUP BY 1) i USING (video_id)
  LEFT JOIN (SELECT video_id, count(*) AS n, avg(digg_count) AS likes FROM comments GROUP BY 1) c USING (video_id))"""

AUTHORS = """
authors AS (
  SELECT CAST(c_custkey AS VARCHAR) AS author_id, c_name AS "user_uniqueId", c_mktsegment AS user_nickname,
    CAST(c_nationkey AS BIGINT) AS "stats_followingCount",
    CAST(floor(abs(c_acctbal)) AS BIGINT) * CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 1000 END AS "stats_followerCount",
    CAST(floor(abs(c_acctbal)) AS BIGINT) + 7 AS "stats_heartCount", c_custkey % 5 AS "stats_videoCount",
    CAST(c_nationkey AS BIGINT) AS "stats_diggCount"
  FROM customer)"""

SCALE = """CASE WHEN {f} <= 1000 THEN 'nano' WHEN {f} <= 10000 THEN 'micro' WHEN {f} <= 100000 THEN 'mid'
  WHEN {f} <= 1000000 THEN 'macro' ELSE 'mega' END"""

ACTIVITY = """
activity AS (
  SELECT CAST(o_custkey AS VARCHAR) AS author_id, CAST(o_orderkey AS VARCHAR) AS video_id, strftime(o_orderdate, '%Y-%m') AS month,
    CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(floor(o_totalprice) AS DOUBLE) AS play_count,
    CAST(length(o_orderpriority) AS DOUBLE) AS digg_count, 1.0 :: DOUBLE AS comment_count,
    CASE WHEN o_orderstatus = 'O' THEN 2.0 ELSE 0.0 END :: DOUBLE AS share_count, 0.0 :: DOUBLE AS collect_count,
    o_orderstatus <> 'F' AS has_video FROM orders),
rated AS (
  SELECT *, play_count + digg_count + comment_count + share_count + collect_count AS eng_total,
    coalesce(1000.0 * (play_count + digg_count + comment_count + share_count + collect_count) / nullif(play_count, 0), 0.0) AS eng_per_1k_views
  FROM activity),
author_history AS (
  SELECT author_id, count(*) AS posts_total, count(DISTINCT month) AS active_months,
    count(*) / count(DISTINCT month) :: DOUBLE AS posts_per_month,
    sum(play_count) AS sum_play, avg(play_count) AS avg_play, sum(digg_count) AS sum_digg, avg(digg_count) AS avg_digg,
    sum(comment_count) AS sum_comment, avg(comment_count) AS avg_comment, sum(share_count) AS sum_share,
    avg(share_count) AS avg_share, sum(collect_count) AS sum_collect, avg(collect_count) AS avg_collect,
    avg(eng_per_1k_views) AS eng_per_1k_views_mean
  FROM rated GROUP BY author_id)"""

NETWORK = """
people AS (SELECT *, 'c' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey),
bought AS (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
of_nation AS (SELECT 'n' || c_nationkey AS author_id, id AS follower_id, c_name AS follower_unique_id, c_mktsegment AS follower_nickname, n_name AS follower_region FROM people),
every_follower AS (
  SELECT 's' || l_suppkey AS author_id, id AS follower_id, c_name AS follower_unique_id, c_mktsegment AS follower_nickname, n_name AS follower_region
  FROM people JOIN bought ON c_custkey = o_custkey UNION ALL SELECT * FROM of_nation),
followers AS (
  SELECT DISTINCT 's' || l_suppkey AS author_id, 'n' || c_nationkey AS follower_id, n_name AS follower_unique_id, 'nation' AS follower_nickname, n_name AS follower_region
  FROM people JOIN bought ON c_custkey = o_custkey UNION ALL SELECT * FROM of_nation),
followings AS (SELECT 's' || s_suppkey AS author_id, 'n' || s_nationkey AS followed_id FROM supplier),
edges AS (
  SELECT DISTINCT least(author_id, other) AS src, greatest(author_id, other) AS dst
  FROM (SELECT author_id, follower_id AS other FROM followers UNION ALL SELECT author_id, followed_id FROM followings)),
vertices AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges UNION SELECT 's' || s_suppkey FROM supplier),
arcs AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
degree AS (SELECT a AS id, count(*) AS degree FROM arcs GROUP BY a)"""

# Every supplier with its customers instead of their nations.
WHOLE_NETWORK = NETWORK.replace("SELECT author_id, follower_id AS other FROM followers", "SELECT author_id, follower_id AS other FROM every_follower")

# Shortest-path counting unrolled over more levels than the graph is wide; the SQL fails if the last one is not empty.
LEVELS = 12


def betweenness_sql() -> str:
    ctes = ["f0 AS MATERIALIZED (SELECT id AS s, id AS v, 1.0 :: DOUBLE AS sigma FROM vertices)"]
    for i in range(1, LEVELS + 1):
        seen = " ".join(
            f"AND NOT EXISTS (SELECT 1 FROM f{j} WHERE f{j}.s = x.s AND f{j}.v = x.v)" for j in range(max(0, i - 2), i)
        )
        ctes.append(
            f"f{i} AS MATERIALIZED (SELECT s, v, sigma FROM (SELECT s, b AS v, sum(sigma) AS sigma FROM f{i - 1} JOIN arcs ON v = a GROUP BY s, b) x WHERE true {seen})"
        )
    ctes.append(f"d{LEVELS} AS MATERIALIZED (SELECT s, v, 0.0 :: DOUBLE AS delta FROM f{LEVELS})")
    for i in range(LEVELS - 1, 0, -1):
        ctes.append(
            f"""d{i} AS MATERIALIZED (SELECT f.s, f.v, coalesce(sum(f.sigma / g.sigma * (1 + d.delta)), 0.0) AS delta
  FROM f{i} f LEFT JOIN arcs ON f.v = a LEFT JOIN f{i + 1} g ON g.s = f.s AND g.v = b LEFT JOIN d{i + 1} d ON d.s = g.s AND d.v = g.v
  GROUP BY f.s, f.v)"""
        )
    union = " UNION ALL ".join(f"SELECT v, delta FROM d{i}" for i in range(1, LEVELS))
    ctes.append(
        f"""central AS MATERIALIZED (SELECT id, coalesce(round(total / ((n - 1) * (n - 2)), 12), 0.0) AS betweenness
  FROM vertices LEFT JOIN (SELECT v, sum(delta) AS total FROM ({union}) GROUP BY v) ON id = v,
  (SELECT CAST(count(*) AS DOUBLE) AS n FROM vertices),
  (SELECT CASE WHEN count(*) > 0 THEN error('the graph is wider than the unrolled levels') END AS too_deep FROM f{LEVELS}))"""
    )
    return ",\n".join(ctes)


def pct_rank(column: str) -> str:
    return f"((rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0) / count({column}) OVER ())"


# The seven sections of a summary text made of a document, and the text itself.
SECTIONS = {
    "overall_mood_tone": strip("source"),
    "overall_narrative_message": strip("text"),
    "prominent_objects_actions": strip("lang || ' and ' || source"),
    "description_storyline": strip("lang || ' ' || doc_id"),
    "music_description": "'tune ' || doc_id",
    "audio_nature": strip("lang"),
    "prominent_audio_content": "CAST(doc_id AS VARCHAR)",
}
MEDIA = """media AS (SELECT *, lang <> 'es' AND doc_id % 10 <> 3 AS filled, concat('Summary.',
  chr(10), '**1. The overall mood:**', chr(10), source, ' ', chr(10), '**2. NARRATIVE message:**', chr(10), text,
  chr(10), '**3. Key events:**', chr(10), lang, ' and ', source, chr(10), '**4. The storyline:**', chr(10), lang, ' ', doc_id,
  chr(10), '**5. Music track:**', chr(10), chr(9), 'tune ', doc_id, chr(10), '**6. Nature of the audio:**', chr(10), lang,
  chr(10), '**7. Spoken content:**', chr(10), doc_id, chr(10)) AS summary FROM documents)"""

SUMMARIES = "summaries AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, source AS content_type, text AS semantic_text, lang FROM documents)"
LABELLED = f"""
{SUMMARIES},
marked AS (SELECT *, {all_labels('semantic_text', a.THEMES)} AS themes, {first_label('semantic_text', a.MOODS, rulesets.MOOD_DEFAULT)} AS mood_label,
  {first_label('semantic_text', a.ACTIONS, rulesets.ACTION_DEFAULT)} AS action_frame FROM summaries),
labelled AS (SELECT *, array_to_string(themes, ', ') AS theme_labels, coalesce(themes[1], '{rulesets.THEME_DEFAULT}') AS primary_theme,
  CAST(len(themes) AS INTEGER) AS n_theme_labels FROM marked)"""
ENRICHED = f"""{LABELLED},
enriched AS (SELECT p.*, coalesce(s.content_type, 'missing_summary') AS content_type, coalesce(s.primary_theme, 'missing_summary') AS primary_theme,
  coalesce(s.mood_label, 'missing_summary') AS mood_label, coalesce(s.action_frame, 'missing_summary') AS action_frame,
  s.n_theme_labels, s.theme_labels FROM post_metrics p LEFT JOIN labelled s USING (video_id))"""
THEME_TABLE = """
themes_table AS (SELECT primary_theme, action_frame, mood_label, count(DISTINCT video_id) AS posts, round(median(play_count), 6) AS median_views,
  round(median(eng_per_1k_views), 6) AS median_eng_per_1k, round(avg(share_count), 6) AS mean_shares,
  round(avg(comment_count), 6) AS mean_comments, sum(share_count) AS total_shares
  FROM enriched GROUP BY 1, 2, 3)"""
HASHTAG_TABLE = """
hashtag_table AS (SELECT hashtag, count(DISTINCT video_id) AS posts, round(median(play_count), 6) AS median_views,
  round(avg(play_count), 6) AS mean_views, round(median(eng_per_1k_views), 6) AS median_eng_per_1k,
  sum(share_count) AS total_shares, sum(comment_count) AS total_comments
  FROM hashtags LEFT JOIN posts USING (video_id) GROUP BY hashtag)"""

EVENTS = """
first_event AS (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1),
timed AS (SELECT CAST(user_id AS VARCHAR) AS video_id, CAST(event_id AS VARCHAR) AS comment_id, event_type AS text,
  CAST(floor(value) AS DOUBLE) AS digg_count, (epoch_us(ts) - epoch_us(first_ts)) / 60000000.0 AS mins_since_post
  FROM events JOIN first_event USING (user_id)),
intents AS (SELECT *, CASE WHEN text IN ('purchase', 'signup') THEN 'buys' WHEN text = 'view' THEN 'looks' ELSE 'general_reaction' END AS rough_intent FROM timed),
pages_of AS (SELECT CAST(user_id AS VARCHAR) AS video_id, CAST(count(*) AS DOUBLE) AS play_count,
  CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS share_count FROM events GROUP BY 1)"""

SCORED = f"""
turns AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(conv_id * 100 + turn AS VARCHAR) AS comment_id, text,
  CAST(turn AS DOUBLE) AS digg_count, {clean('text')} AS cleaned FROM conversations),
measured AS (SELECT *, {sentiment('cleaned', a.POSITIVE, a.NEGATIVE)} AS sentiment_score,
  {first_label('lower(cleaned)', a.EMOTIONS, 'neutral', 'c')} AS emotion_label FROM turns),
scored AS (SELECT *, CASE WHEN sentiment_score > 0.15 THEN 'positive' WHEN sentiment_score < -0.15 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM measured),
sentiment_table AS (SELECT sentiment_label, emotion_label, count(comment_id) AS comments, round(avg(digg_count), 6) AS avg_comment_likes,
  CAST(NULL AS DOUBLE) AS median_mins_since_post FROM scored GROUP BY 1, 2)"""


def terms_sql() -> str:
    stops = ", ".join(quoted(w) for w in a.STOP_WORDS)
    return f"""
words AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{stops}], w)) AS w FROM documents),
grams AS (SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counted AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
size AS (SELECT count(*) AS n FROM documents),
vocabulary AS (SELECT term, count(*) AS df FROM counted GROUP BY 1),
raw AS (SELECT doc_id, term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS r FROM counted JOIN vocabulary USING (term), size WHERE df <= 0.85 * n),
lengths AS (SELECT doc_id, sqrt(sum(r * r)) AS length FROM raw GROUP BY 1),
weights AS MATERIALIZED (SELECT doc_id, term, tf, df, r / length AS weight FROM raw JOIN lengths USING (doc_id))"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "post_engagement": f"""WITH {POSTS} SELECT video_id, play_count, digg_count, comment_count, share_count, collect_count, duration,
  duration > 0 AS has_video, eng_total, round(eng_per_1k_views, 6) AS eng_per_1k_views, '{a.URL_PREFIX}' || video_id AS url FROM posts""",
        "time_features": f"""WITH {POSTS} SELECT video_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m') AS month,
  dayname(ts) AS dow, CAST(hour(ts) AS INTEGER) AS hour FROM posts""",
        "scalar_columns": f"""WITH {POSTS} SELECT video_id, title, region, '0' AS download_count,
  CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE CAST(CAST(floor(epoch(o_orderdate)) AS BIGINT) AS VARCHAR) END AS create_time,
  CASE WHEN o_orderstatus = 'F' THEN '0' ELSE '15' END AS duration,
  CASE WHEN o_orderpriority LIKE '4%' THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS play_count,
  CAST(quantity AS VARCHAR) AS digg_count, CAST(CAST(lines AS BIGINT) AS VARCHAR) AS comment_count,
  CAST(CAST(returned AS BIGINT) AS VARCHAR) AS share_count, CAST(CAST(discounted AS BIGINT) AS VARCHAR) AS collect_count FROM posts""",
        "flatten_struct": """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(o_custkey AS VARCHAR) AS author_id, c_name AS author_unique_id,
  c_mktsegment AS author_nickname, o_orderstatus AS music_id, o_orderpriority AS music_title, o_orderstatus = 'O' AS commerce_adv_promotable
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
        "unify_ids": "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS video_id, o_orderstatus FROM orders",
        "keyed_records": "SELECT CAST(event_id AS VARCHAR) AS author_id, event_type AS kind, CAST(floor(value) AS BIGINT) AS amount FROM events",
        "explode_comments": f"""WITH {POSTS} SELECT video_id, comment_id, text, digg_count, CAST(supplier AS VARCHAR) AS user_id, region AS user_region,
  CAST(floor(epoch(comment_ts)) AS BIGINT) AS comment_epoch,
  round((floor(epoch(comment_ts)) - floor(epoch(ts))) / 60.0, 6) AS mins_since_post FROM comments""",
        "images_indexed": f"WITH {POSTS} SELECT * FROM images",
        "hashtags": f"WITH {POSTS} SELECT * FROM hashtags",
        "post_metrics": f"""WITH {POSTS} SELECT video_id, eng_total, n_hashtags, n_images, n_comments_captured,
  round(avg_comment_diggs, 6) AS avg_comment_diggs FROM post_metrics""",
        "json_export": f"""WITH {POSTS} SELECT video_id, '{{"id":"' || o_custkey || '","unique_id":"' || c_name || '","nickname":"' || c_mktsegment || '"}}' AS author,
  '[' || coalesce((SELECT string_agg(coalesce('"' || day || '"', 'null'), ',' ORDER BY i) FROM items WHERE items.l_orderkey = posts.l_orderkey), '') || ']' AS images,
  '{{"adv_promotable":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || '}}' AS commerce_info FROM posts""",
        "csv_round_trip": "SELECT page_id, url, html FROM pages",
        "authors": f"WITH {AUTHORS} SELECT * FROM authors",
        "author_metrics": f"""WITH {AUTHORS} SELECT author_id, "stats_followingCount" :: DOUBLE AS "stats_followingCount", "stats_followerCount" :: DOUBLE AS "stats_followerCount",
  "stats_heartCount" :: DOUBLE AS "stats_heartCount", "stats_videoCount" :: DOUBLE AS "stats_videoCount", "stats_diggCount" :: DOUBLE AS "stats_diggCount",
  round(coalesce("stats_heartCount" :: DOUBLE / nullif("stats_videoCount", 0), 0), 6) AS avg_hearts_per_video,
  round(coalesce("stats_heartCount" :: DOUBLE / nullif("stats_followerCount", 0), 0), 6) AS hearts_per_follower,
  round(coalesce(1000.0 * "stats_videoCount" / nullif("stats_followerCount", 0), 0), 6) AS videos_per_1k_followers FROM authors""",
        "creator_scale": f"""WITH {AUTHORS} SELECT author_id, {SCALE.format(f='"stats_followerCount"')} AS creator_scale FROM authors""",
        "author_activity": f"""WITH {ACTIVITY} SELECT author_id, video_id, month, hour, play_count, share_count, collect_count, eng_total,
  round(eng_per_1k_views, 6) AS eng_per_1k_views, has_video FROM rated""",
        "authorpost_metrics": f"""WITH {ACTIVITY} SELECT * REPLACE (round(posts_per_month, 6) AS posts_per_month, round(avg_play, 6) AS avg_play,
  round(avg_digg, 6) AS avg_digg, round(avg_comment, 6) AS avg_comment, round(avg_share, 6) AS avg_share, round(avg_collect, 6) AS avg_collect,
  round(eng_per_1k_views_mean, 6) AS eng_per_1k_views_mean) FROM author_history""",
        "network_edges": f"WITH {NETWORK} SELECT * FROM every_follower",
        "network_region_metrics": f"""WITH {NETWORK}, regions AS (SELECT author_id, follower_region, count(*) AS n,
    row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, follower_region) AS r FROM every_follower GROUP BY 1, 2)
  SELECT author_id, CAST(sum(n) AS BIGINT) AS captured, count(*) AS distinct_regions, max(follower_region) FILTER (r = 1) AS top_region,
    max(n) AS top_region_count FROM regions GROUP BY 1""",
        "creator_leverage": f"""WITH {AUTHORS}, {ACTIVITY} SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(o_custkey AS VARCHAR) AS author_id,
  c_name AS author_unique_id, c_mktsegment AS author_nickname, {SCALE.format(f='coalesce("stats_followerCount", 0)')} AS creator_scale,
  "stats_followerCount", "stats_heartCount", posts_total, active_months, round(posts_per_month, 6) AS posts_per_month,
  round(avg_play, 6) AS avg_play, round(avg_share, 6) AS avg_share, round(eng_per_1k_views_mean, 6) AS eng_per_1k_views_mean,
  round(coalesce(avg_play / nullif("stats_followerCount", 0), 0), 6) AS views_per_follower_history
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN authors ON author_id = CAST(o_custkey AS VARCHAR)
  LEFT JOIN author_history USING (author_id)""",
        "graph_edges": f"WITH {WHOLE_NETWORK} SELECT src, dst FROM edges",
        "graph_degree": f"WITH {WHOLE_NETWORK} SELECT id, coalesce(degree, 0) AS degree FROM vertices LEFT JOIN degree USING (id)",
        "connected_components": """WITH tree AS (
    SELECT 'r' || n_regionkey AS root, 'r' || n_regionkey AS id FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
    UNION SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION SELECT 'p' || p_partkey, 'p' || p_partkey FROM part)
  SELECT id, min(id) OVER (PARTITION BY root) AS component_id, count(*) OVER (PARTITION BY root) AS component_nodes FROM tree""",
        "betweenness": f"WITH {NETWORK}, {betweenness_sql()} SELECT id, round(betweenness, 9) AS betweenness FROM central",
        "creator_bridge": f"""WITH RECURSIVE {POSTS}, {NETWORK}, {betweenness_sql()},
reach(id, low) AS (SELECT id, id FROM vertices UNION SELECT b, low FROM reach JOIN arcs ON id = a WHERE low < b),
component AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id),
base AS (SELECT video_id, 's' || coalesce(first_supplier, 0) AS author_id, eng_per_1k_views FROM posts),
nodes AS (SELECT component_id, count(*) AS component_nodes FROM component GROUP BY 1),
joined AS (SELECT video_id, author_id, coalesce(degree, 0) AS network_degree, betweenness AS network_betweenness, component_id, component_nodes,
    coalesce(fs.n, 0) AS captured_followers, coalesce(fg.n, 0) AS captured_followings, CAST(floor(abs(s_acctbal)) AS BIGINT) AS "stats_followerCount", eng_per_1k_views
  FROM base JOIN central ON author_id = central.id LEFT JOIN degree ON author_id = degree.id JOIN component ON author_id = component.id
  JOIN nodes USING (component_id) LEFT JOIN supplier ON author_id = 's' || s_suppkey
  LEFT JOIN (SELECT author_id, count(*) AS n FROM followers GROUP BY 1) fs USING (author_id)
  LEFT JOIN (SELECT author_id, count(*) AS n FROM followings GROUP BY 1) fg USING (author_id))
SELECT video_id, author_id, network_degree, round(network_betweenness, 9) AS network_betweenness, component_id,
  count(*) OVER (PARTITION BY component_id) AS component_size, component_nodes, captured_followers, captured_followings, "stats_followerCount",
  round_even(0.45 * {pct_rank('network_betweenness')} + 0.25 * {pct_rank('network_degree')} + 0.20 * {pct_rank('eng_per_1k_views')}
    + 0.10 * {pct_rank('"stats_followerCount"')}, 3) AS bridge_score FROM joined""",
        "region_performance": f"""WITH {POSTS} SELECT region, count(DISTINCT video_id) AS posts, sum(play_count) AS total_views,
  round(median(play_count), 6) AS median_views, sum(share_count) AS total_shares, sum(comment_count) AS total_comments,
  round(median(eng_per_1k_views), 6) AS median_eng_per_1k FROM posts GROUP BY region""",
        "hashtag_performance": f"WITH {POSTS}, {HASHTAG_TABLE} SELECT * FROM hashtag_table",
        "content_type_performance": f"""WITH {POSTS}, {SUMMARIES} SELECT s.content_type, count(DISTINCT video_id) AS posts,
  round(median(play_count), 6) AS median_views, round(median(eng_per_1k_views), 6) AS median_eng_per_1k,
  round(avg(share_count), 6) AS mean_shares, round(avg(comment_count), 6) AS mean_comments
  FROM posts LEFT JOIN summaries s USING (video_id) GROUP BY 1""",
        "theme_performance": f"WITH {POSTS}, {ENRICHED}, {THEME_TABLE} SELECT * FROM themes_table",
        "messaging_recommendations": f"""WITH {POSTS}, {ENRICHED},
grouped AS (SELECT primary_theme, action_frame, content_type, count(DISTINCT video_id) AS posts, median(play_count) AS median_views,
  median(eng_per_1k_views) AS median_eng_per_1k, median(share_count) AS median_shares FROM enriched WHERE play_count >= 1000 GROUP BY 1, 2, 3),
ranked AS (SELECT *, {pct_rank('median_views')} AS v, {pct_rank('median_eng_per_1k')} AS e, {pct_rank('median_shares')} AS s FROM grouped)
SELECT primary_theme, action_frame, content_type, posts, round(median_views, 6) AS median_views, round(median_eng_per_1k, 6) AS median_eng_per_1k,
  round(median_shares, 6) AS median_shares, round(v, 6) AS views_rank_pct, round(e, 6) AS eng_rank_pct, round(s, 6) AS share_rank_pct,
  round_even(0.40 * e + 0.35 * v + 0.25 * s, 3) AS opportunity_score FROM ranked""",
        "min_views_fallback": f"WITH {POSTS} SELECT video_id, play_count FROM posts",
        "exact_medians": """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median_price,
  round(median(l_quantity), 6) AS median_quantity FROM lineitem GROUP BY 1, 2""",
        "pct_rank_large": f"""SELECT l_orderkey, l_linenumber, round({pct_rank('l_extendedprice')}, 9) AS price_pct,
  round({pct_rank('l_quantity')}, 9) AS quantity_pct FROM lineitem""",
        "top_label": """SELECT user_id, event_type AS top_type, n AS top_count FROM (SELECT user_id, event_type, count(*) AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""",
        "theme_labels": f"WITH {LABELLED} SELECT video_id, theme_labels, primary_theme, mood_label, action_frame, n_theme_labels FROM labelled",
        "default_rule_labels": f"""WITH {SUMMARIES}, cleaned AS (SELECT *, {clean('semantic_text')} AS c FROM summaries),
measured AS (SELECT *, {sentiment('c', rulesets.POSITIVE_WORDS, rulesets.NEGATIVE_WORDS)} AS score FROM cleaned)
SELECT video_id, array_to_string({all_labels('semantic_text', rulesets.THEME_RULES)}, ', ') AS theme_labels,
  {first_label('semantic_text', rulesets.MOOD_RULES, rulesets.MOOD_DEFAULT)} AS mood_label,
  {first_label('semantic_text', rulesets.ACTION_RULES, rulesets.ACTION_DEFAULT)} AS action_frame,
  {first_label('lower(semantic_text)', rulesets.INTENT_RULES, rulesets.INTENT_DEFAULT, 'c')} AS rough_intent,
  {first_label('lower(c)', rulesets.EMOTION_RULES, rulesets.EMOTION_DEFAULT, 'c')} AS emotion_label,
  CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  round(score, 6) AS sentiment_score FROM measured""",
        "section_extract": f"WITH {MEDIA} SELECT doc_id, {', '.join(f'{v} AS {n}' for n, v in SECTIONS.items())} FROM documents",
        "summary_tables": f"""WITH {MEDIA},
summaries AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 0 END :: BIGINT AS n_image_files,
  coalesce(lang = 'en', false) AS has_local_video, coalesce(lang IN ('en', 'fr'), false) AS has_local_audio,
  CASE lang WHEN 'en' THEN 'video' WHEN 'fr' THEN 'images_audio' WHEN 'de' THEN 'images_music' ELSE 'unknown' END AS content_type,
  {', '.join(f'CASE WHEN filled THEN {v} END AS {n}' for n, v in SECTIONS.items())},
  CASE WHEN filled THEN array_to_string(list_filter([{SECTIONS['overall_narrative_message']}, {SECTIONS['prominent_objects_actions']}, {SECTIONS['overall_mood_tone']}, {strip('summary')}],
    lambda x: x IS NOT NULL AND x <> ''), ' ') ELSE '' END AS semantic_text FROM media),
marked AS (SELECT *, {all_labels('semantic_text', a.THEMES)} AS themes, {first_label('semantic_text', a.MOODS, rulesets.MOOD_DEFAULT)} AS mood_label,
  {first_label('semantic_text', a.ACTIONS, rulesets.ACTION_DEFAULT)} AS action_frame FROM summaries)
SELECT * EXCLUDE (themes), array_to_string(themes, ', ') AS theme_labels, coalesce(themes[1], '{rulesets.THEME_DEFAULT}') AS primary_theme,
  CAST(len(themes) AS INTEGER) AS n_theme_labels FROM marked""",
        "raw_json_source": f"""WITH {POSTS}, counted AS (SELECT video_id, title, CASE WHEN o_orderpriority LIKE '4%' THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS play_count,
  CAST(o_custkey AS VARCHAR) AS author_id, o_orderstatus = 'O' AS promotable, CAST(count(i) AS INTEGER) AS comments, CAST(count(day) AS INTEGER) AS images,
  CAST(min_by(l_suppkey, i) AS VARCHAR) AS first_user FROM source s LEFT JOIN items USING (l_orderkey) GROUP BY ALL)
SELECT {', '.join(f'CASE WHEN CAST(video_id AS BIGINT) % 7 <> 2 THEN {c} END AS {c}' for c in ('video_id', 'title', 'play_count', 'author_id', 'promotable', 'comments', 'images', 'first_user'))} FROM counted""",
        "records_and_parents": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'p' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS author_id, o_totalprice AS price
  FROM orders, range(2)""",
        "single_cluster": """SELECT '7' AS video_id, CAST(0 AS INTEGER) AS cluster_id, 'single cluster' AS cluster_name, '' AS cluster_terms, CAST(1 AS BIGINT) AS posts,
  n_regionkey :: DOUBLE AS median_views, n_regionkey :: DOUBLE AS total_views, n_regionkey :: DOUBLE AS median_eng_per_1k, n_regionkey :: DOUBLE AS total_shares,
  n_regionkey :: DOUBLE AS total_comments FROM nation WHERE n_nationkey = 7""",
        "clean_text": f"""SELECT page_id, {clean("url || chr(10) || chr(9) || html || chr(10) || chr(9) || '  see ' || url || ' or www.x.org/a  '")} AS clean FROM pages""",
        "media_flags": """SELECT CAST(doc_id AS VARCHAR) AS video_id, CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 0 END :: BIGINT AS n_image_files,
  lang = 'en' AS has_local_video, lang IN ('en', 'fr') AS has_local_audio,
  CASE lang WHEN 'en' THEN 'video' WHEN 'fr' THEN 'images_audio' WHEN 'de' THEN 'images_music' ELSE 'unknown' END AS content_type FROM documents""",
        "posts_enriched": f"""WITH {POSTS}, {ENRICHED} SELECT video_id, n_hashtags, content_type, primary_theme, mood_label, action_frame,
  n_theme_labels, theme_labels FROM enriched""",
        "comment_intent_summary": f"""WITH {EVENTS} SELECT rough_intent, count(comment_id) AS comments, round(avg(digg_count), 6) AS avg_comment_likes,
  round(median(mins_since_post), 6) AS median_mins_since_post FROM intents GROUP BY 1""",
        "post_comment_intents": f"""WITH {EVENTS}, ranked AS (SELECT video_id, rough_intent, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, rough_intent) AS r
  FROM intents GROUP BY 1, 2),
per_post AS (SELECT video_id, count(comment_id) AS captured_comments, round(avg(digg_count), 6) AS avg_comment_likes,
  count(*) FILTER (mins_since_post <= 60) AS early_comments_60m FROM intents GROUP BY 1)
SELECT video_id, captured_comments, avg_comment_likes, early_comments_60m, rough_intent AS top_comment_intent, play_count, share_count
  FROM per_post JOIN ranked USING (video_id) LEFT JOIN pages_of USING (video_id) WHERE r = 1""",
        "text_intents": f"""SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS comment_id,
  {first_label('lower(text)', a.INTENTS, rulesets.INTENT_DEFAULT, 'c')} AS rough_intent FROM conversations""",
        "sentiment_scores": f"WITH {SCORED} SELECT video_id, comment_id, sentiment_label, round(sentiment_score, 6) AS sentiment_score, emotion_label FROM scored",
        "sentiment_summary": f"WITH {SCORED} SELECT * FROM sentiment_table",
        "post_comment_sentiment": f"""WITH {SCORED}, {EVENTS}, ranked AS (SELECT video_id, emotion_label, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, emotion_label) AS r
  FROM scored GROUP BY 1, 2),
per_post AS (SELECT video_id, count(comment_id) AS comments_scored, round(avg(sentiment_score), 6) AS avg_sentiment_score,
  round(avg((sentiment_label = 'positive') :: INT), 6) AS pct_positive, round(avg((sentiment_label = 'negative') :: INT), 6) AS pct_negative FROM scored GROUP BY 1)
SELECT video_id, comments_scored, avg_sentiment_score, pct_positive, pct_negative, emotion_label AS top_emotion, play_count, share_count
  FROM per_post JOIN ranked USING (video_id) LEFT JOIN pages_of USING (video_id) WHERE r = 1""",
        "emotion_pivot": f"""WITH {SCORED} SELECT emotion_label, {', '.join(f"CAST(coalesce(sum(comments) FILTER (sentiment_label = '{s}'), 0) AS BIGINT) AS {s}" for s in ('negative', 'neutral', 'positive'))}
  FROM sentiment_table GROUP BY 1""",
        "tfidf_weights": f"WITH {terms_sql()} SELECT doc_id, term, tf, df, round(weight, 9) AS weight FROM weights",
        "cluster_terms": f"""WITH {terms_sql()},
sizes AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1),
centres AS MATERIALIZED (SELECT lang, term, sum(weight) / docs AS centre FROM weights JOIN documents USING (doc_id) JOIN sizes USING (lang) GROUP BY lang, term, docs),
top AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(centre, 10) DESC, term) AS r FROM centres),
near AS (SELECT lang, doc_id, round(sum(weight * centre), 10) AS near FROM weights JOIN documents USING (doc_id) JOIN centres USING (lang, term) GROUP BY 1, 2),
closest AS (SELECT lang, doc_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY near DESC, doc_id) AS r FROM near) WHERE r = 1)
SELECT lang, string_agg(term, ', ' ORDER BY r) FILTER (r <= 8) AS cluster_terms, string_agg(term, ' / ' ORDER BY r) FILTER (r <= 3) AS cluster_name,
  any_value(representative) AS representative FROM top JOIN closest USING (lang) WHERE r <= 8 GROUP BY lang""",
        "cluster_performance": f"""WITH {POSTS}, {SUMMARIES} SELECT CAST(length(lang) AS INTEGER) AS cluster_id, lang AS cluster_name, count(DISTINCT s.video_id) AS posts,
  round(median(play_count), 6) AS median_views, coalesce(sum(play_count), 0) AS total_views, round(median(eng_per_1k_views), 6) AS median_eng_per_1k,
  coalesce(sum(share_count), 0) AS total_shares, coalesce(sum(comment_count), 0) AS total_comments
  FROM summaries s LEFT JOIN posts USING (video_id) GROUP BY 1, 2""",
        "semantic_cluster_checks": f"""WITH {POSTS}, {SUMMARIES}, kept AS (SELECT video_id FROM summaries WHERE length({clean('semantic_text')}) > 20)
  SELECT count(*) AS docs, count(DISTINCT video_id) AS distinct_docs, CAST(0 AS BIGINT) AS surplus_representatives, count(DISTINCT video_id) AS posts,
    sum(coalesce(play_count, 0)) AS total_views FROM kept LEFT JOIN posts USING (video_id)""",
        "cluster_counts": """WITH sizes AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY 1),
counts AS (SELECT *, CAST(CASE WHEN n_docs < 4 THEN greatest(1, n_docs) ELSE least(8, greatest(2, round_even(sqrt(n_docs), 0))) END AS INTEGER) AS clusters FROM sizes),
tries AS (SELECT *, CAST(greatest(0, least(clusters + 2, n_docs) - 2) AS INTEGER) AS tried FROM counts)
SELECT lang, n_docs, clusters, tried, CAST(CASE WHEN tried > 0 THEN tried + 1 ELSE 0 END AS INTEGER) AS most FROM tries""",
        "cluster_text": f"""SELECT doc_id, {clean("coalesce(text, '') || ' ' || coalesce(' see www.x.org/a ' || source, '')")} AS cluster_text FROM documents""",
        "snapshot": f"""WITH {POSTS}, {ENRICHED} SELECT video_id, strftime(ts, '%Y-%m-%d') AS date, region, content_type, primary_theme, action_frame, mood_label,
  play_count, share_count, comment_count, round(eng_per_1k_views, 6) AS eng_per_1k_views FROM enriched""",
        "totals": f"""WITH {POSTS} SELECT count(*) AS posts, CAST(sum(n_comments_captured) AS BIGINT) AS captured_comments,
  (SELECT count(*) FROM documents) AS summary_rows FROM post_metrics""",
        "message_frames": f"""WITH {POSTS}, {ENRICHED}, {THEME_TABLE} SELECT primary_theme || ' | ' || action_frame AS message_frame, mood_label, median_views
  FROM themes_table ORDER BY median_views DESC, primary_theme, action_frame, mood_label LIMIT 8""",
        "hashtags_multi_post": f"""WITH {POSTS}, {HASHTAG_TABLE} SELECT * FROM hashtag_table WHERE posts >= 2 ORDER BY median_eng_per_1k DESC, hashtag LIMIT 15""",
        "rounding": """SELECT l_orderkey, l_linenumber, round_even(CAST(l_quantity AS DOUBLE) / 2, 0) AS half, round_even(CAST(l_orderkey AS DOUBLE) / 16, 3) AS part,
  round_even((2.0 * CAST(l_orderkey AS DOUBLE) + 1) / 2000, 3) AS decimal_half FROM lineitem""",
        "content_kind": """SELECT event_id, CASE WHEN event_type = 'view' THEN 'video' WHEN event_type = 'click' AND value > 20 THEN 'images_audio'
  WHEN value > 20 THEN 'images_music' ELSE 'unknown' END AS content_type FROM events""",
        "manifest": f"""WITH {POSTS}, {NETWORK} SELECT "table", 'core' AS category, rows, CAST(cols AS INTEGER) AS cols FROM (
  SELECT 'posts' AS "table", (SELECT count(*) FROM posts) AS rows, 20 AS cols
  UNION ALL SELECT 'posts_author', (SELECT count(*) FROM posts), 4 UNION ALL SELECT 'posts_music', (SELECT count(*) FROM posts), 3
  UNION ALL SELECT 'posts_commerce', (SELECT count(*) FROM posts), 2
  UNION ALL SELECT 'posts_comments', (SELECT count(*) FROM comments), 10 UNION ALL SELECT 'posts_images', (SELECT count(*) FROM images), 3
  UNION ALL SELECT 'posts_hashtags', (SELECT count(*) FROM hashtags), 2 UNION ALL SELECT 'post_metrics', (SELECT count(*) FROM posts), 24
  UNION ALL SELECT 'authors', (SELECT count(*) FROM customer), 8 UNION ALL SELECT 'author_metrics', (SELECT count(*) FROM customer), 9
  UNION ALL SELECT 'authorposts', (SELECT count(*) FROM orders), 18 UNION ALL SELECT 'authorfavorites', (SELECT count(*) FROM orders), 18
  UNION ALL SELECT 'authorpost_metrics', (SELECT count(DISTINCT o_custkey) FROM orders), 15
  UNION ALL SELECT 'authorfollowers', (SELECT count(*) FROM every_follower), 5 UNION ALL SELECT 'authorfollowings', (SELECT count(*) FROM followings), 3
  UNION ALL SELECT 'authorfollowers_metrics', (SELECT count(DISTINCT author_id) FROM every_follower), 5
  UNION ALL SELECT 'authorfollowings_metrics', (SELECT count(*) FROM supplier), 5)""",
    }
    for name, column, condition in (
        ("reach", "play_count", "true"),
        ("engagement_efficiency", "eng_per_1k_views", "play_count >= 1000"),
        ("shares", "share_count", "true"),
    ):
        sql[f"top_posts_by_{name}"] = (
            f"WITH {POSTS} SELECT video_id, play_count, share_count, round(eng_per_1k_views, 6) AS eng_per_1k_views FROM posts "
            f"WHERE {condition} ORDER BY posts.{column} DESC, video_id LIMIT 20"
        )
    return sql
