"""The queries that SQL can express, for DuckDB, by plain comparison instead of the operators' methods."""

from __future__ import annotations

from .licenses import HEADER, LICENCE_FILE, NOTICES
from .repeated_lines import LEAST_WORDS
from .secret_ledger import BASE, MORE

WORD = r"'[^\x20\x09-\x0D]+'"


def words(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"(SELECT {key}, regexp_extract_all({lowered}, {WORD}) AS w FROM {table})"


REPEATED_LINES = f"""
WITH lines AS (SELECT doc_id, i - 1 AS i, all_lines[i] AS line, len(regexp_extract_all(all_lines[i], {WORD})) AS w
  FROM (SELECT doc_id, all_lines, unnest(range(1, len(all_lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS all_lines FROM documents))),
kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM lines WHERE w > 0),
windows AS (
  SELECT a.doc_id, a.p AS p, min(b.p) AS q FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.w >= {LEAST_WORDS} GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.p), b.p FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.c - a.c + a.w >= {LEAST_WORDS} GROUP BY 1, 3),
runs AS (SELECT x.doc_id, x.p, x.q, string_agg(line, chr(10) ORDER BY k.p) AS run FROM windows x JOIN kept k ON k.doc_id = x.doc_id AND k.p BETWEEN x.p AND x.q GROUP BY 1, 2, 3),
later AS (SELECT doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS r FROM runs) WHERE r > 1),
gone AS (SELECT DISTINCT k.doc_id, k.i, k.w FROM kept k JOIN later x ON k.doc_id = x.doc_id AND k.p BETWEEN x.p AND x.q)
SELECT d.doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, CAST(count(i) AS INTEGER) AS n_removed,
  CAST(coalesce(sum(w), 0) AS BIGINT) AS removed_words, coalesce(string_agg(i, ',' ORDER BY i), '') AS removed
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id GROUP BY d.doc_id, text"""

TEST_ITEMS = f"""
WITH item_words AS (SELECT item_id, w, least(5, len(w)) AS k FROM {words('benchmark', 'item_id')} WHERE len(w) > 0),
item_runs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS run FROM item_words),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_runs GROUP BY 1),
doc_runs AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS run
  FROM {words('documents', 'doc_id')}, (SELECT DISTINCT k FROM item_words) WHERE len(w) >= k)
SELECT doc_id, item_id, n_item, count(*) AS matched, count(*) / n_item AS containment
FROM doc_runs JOIN item_runs USING (k, run) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item"""

COMPONENTS = f"""
WITH RECURSIVE sets AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM {words('documents', 'doc_id')}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sets a JOIN sets b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 90 * (s.n + t.n - common)),
arcs AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, low FROM reach JOIN arcs ON id = x WHERE low < y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(low) AS component_id FROM reach GROUP BY 1) ON id = d.doc_id"""


def licences_sql() -> str:
    notices = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(NOTICES))
    terms = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

    def cosine(vectors: str, keys: str) -> str:
        return f"""(SELECT {keys}, template, licence, round(dot / norm, 9) AS cosine
    FROM (SELECT {keys}, template, sum(tf * coalesce(idf, unseen) * unit) AS dot FROM {vectors} LEFT JOIN rarity USING (term) CROSS JOIN total JOIN units USING (term) GROUP BY ALL)
    JOIN (SELECT {keys}, sqrt(sum((tf * coalesce(idf, unseen)) ** 2)) AS norm FROM {vectors} LEFT JOIN rarity USING (term) CROSS JOIN total GROUP BY ALL) USING ({keys})
    JOIN notices USING (template))"""

    return f"""
WITH notices(template, licence, notice) AS (VALUES {notices}),
notice_terms AS (SELECT template, unnest({terms.format('notice')}) AS term FROM notices),
total AS (SELECT count(text) AS n, ln(1 + count(text)) + 1 AS unseen FROM documents),
tokens AS MATERIALIZED (SELECT doc_id, line, unnest({terms.format('content')}) AS term
  FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM documents)),
held AS (SELECT term, count(DISTINCT doc_id) AS df FROM tokens WHERE term IN (SELECT term FROM notice_terms) GROUP BY 1),
rarity AS MATERIALIZED (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM notice_terms) LEFT JOIN held USING (term), total),
weights AS (SELECT template, term, count(*) * any_value(idf) AS weight FROM notice_terms JOIN rarity USING (term) GROUP BY 1, 2),
units AS MATERIALIZED (SELECT template, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY template)) AS unit FROM weights),
line_tf AS MATERIALIZED (SELECT doc_id, line, term, count(*) AS tf FROM tokens GROUP BY ALL),
text_tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
headers AS (SELECT doc_id, arg_min(licence, (-cosine, template)) AS licence, max(cosine) AS cosine FROM {cosine('line_tf', 'doc_id, line')} WHERE cosine >= {HEADER} GROUP BY 1),
files AS (SELECT doc_id, arg_min(licence, (-cosine, template)) AS licence, max(cosine) AS cosine FROM {cosine('text_tf', 'doc_id')} WHERE cosine >= {LICENCE_FILE} GROUP BY 1),
holders AS (SELECT source, lang, arg_min(licence, (-cosine, licence)) AS licence FROM files JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, coalesce(h.licence, f.licence, u.licence) AS licence, round(coalesce(h.cosine, f.cosine), 6) AS cosine,
  CASE WHEN h.licence IS NOT NULL THEN 'header' WHEN f.licence IS NOT NULL THEN 'file' WHEN u.licence IS NOT NULL THEN 'inherited' END AS found
FROM documents LEFT JOIN headers h USING (doc_id) LEFT JOIN files f USING (doc_id) LEFT JOIN holders u USING (source, lang)"""


def vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry."""
    assigned = """(SELECT vec_id, row, label, p, list, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
    SELECT x.*, b.e, list_sum(list_transform(list_zip(list, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM pieces x JOIN {books} b USING (p)) GROUP BY ALL)"""
    moves = ""
    for i in range(rounds):
        moves += f"""sums{i} AS (SELECT p, e, list(mean ORDER BY place) AS entry FROM (
  SELECT p, e, place, CAST(floor(sum(value) / count(*)) AS BIGINT) AS mean FROM (
    SELECT p, e, unnest(range(1, len(list) + 1)) AS place, unnest(list) AS value FROM {assigned.format(books=f'books{i}')}) GROUP BY ALL) GROUP BY ALL),
books{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.entry, b.entry) AS entry FROM books{i} b LEFT JOIN sums{i} s USING (p, e)),
"""
    return f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0),
pieces AS MATERIALIZED (SELECT vec_id, row, label, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS list FROM kept, range({parts}) r(p)),
seeds AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}),
books0 AS MATERIALIZED (SELECT p, e, list AS entry FROM pieces JOIN seeds USING (row)),
{moves}finals AS MATERIALIZED {assigned.format(books=f'books{rounds}')},
codes AS (SELECT row, vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM finals GROUP BY ALL),
digest AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest"""


TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def search_sql(k: int = 20) -> str:
    """Every item against every document that shares a term."""

    def terms(table: str, key: str) -> str:
        lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"(SELECT {key}, unnest(regexp_extract_all({lowered}, {TERM})) AS term FROM {table})"

    return f"""
WITH tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM {terms('documents', 'doc_id')} GROUP BY ALL),
lengths AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY 1),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, total),
wanted AS (SELECT item_id, term, count(*) AS times FROM {terms('benchmark', 'item_id')} GROUP BY ALL),
scores AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {k}"""


def secrets_sql() -> str:
    """Every rule over every text."""
    scans = []
    for place, rule in enumerate(BASE + MORE):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        scans.append(f"""SELECT row, {place} AS place, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(met) + 1), lambda i: {{
    'first': list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(met[1:i - 1], lambda g: length(g))), 0), 'met': met[i], 'value': value[i]}})) AS s
  FROM (SELECT row, string_split_regex(text, {pattern}) AS gap, regexp_extract_all(text, {pattern}) AS met, regexp_extract_all(text, {pattern}, {rule.group}) AS value FROM texts)
  WHERE len(met) > 0""")
    lowest = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(BASE + MORE))
    item = "kind || ':' || first || ':' || last"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
met AS ({' UNION ALL '.join(scans)}),
spans AS (SELECT row, place, kind, CAST(s.first AS BIGINT) AS first, CAST(s.first + length(s.met) AS BIGINT) AS last FROM met WHERE length(s.value) >= CASE place {lowest} END)
SELECT doc_id, {counts}, sha256(coalesce(string_agg({item}, ',' ORDER BY first, place) FILTER (place < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({item}, ',' ORDER BY first, place) FILTER (kind IS NOT NULL), '') AS spans
FROM texts LEFT JOIN spans USING (row) GROUP BY row, doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_repeated_lines": REPEATED_LINES,
        "op4_licenses": licences_sql(),
        "op7_decontamination": TEST_ITEMS,
        "op8_shingle_join": COMPONENTS,
        "op11_vector_codes": vector_codes_sql(),
        "op12_treap_search": search_sql(),
        "op13_secret_ledger": secrets_sql(),
    }
