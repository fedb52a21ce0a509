"""DuckDB SQL of the queries that go through files, streams and the caller's own models."""

from __future__ import annotations

from sparkrecall.plans.oracle import CLASSIFIED, CONTEXTS, EPOCH, EVT, HEADER, HISTORY, ITEMISED, KEPT_JSON, MARKER, MSG, NORM, PAGES, ROUNDS, SEGMENT, SQL as OTHER, VEC

SQL: dict[str, str] = {}


def embedded(name: str, source: str, keys: str, text: str, dims: int = 64) -> str:
    """CTE `name` (keys, place, value): the hashed-bigram vector of each row's text, where it is not zero, as 32-bit floats."""
    return f"""
{name}_pairs AS (
  SELECT {keys}, CAST(unicode(substr(lower({text}), i, 1)) AS BIGINT) * 2654435761 + CAST(unicode(substr(lower({text}), i + 1, 1)) AS BIGINT) * 40503 + 7 AS g
  FROM (SELECT *, unnest(range(1, CAST(length({text}) AS BIGINT))) AS i FROM {source} WHERE length({text}) >= 2)),
{name}_counts AS (
  SELECT {keys}, CAST(((g & 4294967295) >> 8) % {dims} AS INTEGER) AS place, CAST(sum(1 - 2 * (g & 1)) AS DOUBLE) AS s FROM {name}_pairs GROUP BY ALL HAVING sum(1 - 2 * (g & 1)) <> 0),
{name} AS (SELECT {keys}, place, CAST(s / sqrt(sum(s * s) OVER (PARTITION BY {keys})) AS FLOAT) AS value FROM {name}_counts)"""


SQL["s1_read_requests"] = f"""WITH {ITEMISED}, {MSG.replace('msg AS', 'plain AS')}
SELECT p.request_id, p.user_id, p.session_id, 1 AS recent_rounds_full, CAST({EPOCH} + 60 * max(p.round_no) AS BIGINT) AS at, CAST(count(*) AS INTEGER) AS n_messages,
  coalesce(string_agg(m.role || ': ' || m.text, chr(10) ORDER BY m.turn) FILTER (m.text <> ''), '') AS text
FROM msg m JOIN plain p ON m.conv_id = p.conv_id AND m.turn = p.turn GROUP BY ALL"""
SQL["s2_sessions"] = OTHER["r1_build_rounds"]
SQL["s3_memories"] = f"SELECT 'v' || vec_id AS id, 'u' || label AS user_id, 'memory ' || vec_id AS data, 'h' || vec_id AS hash, CAST(len(embedding) AS INTEGER) AS dims, CAST({EPOCH} AS BIGINT) AS created FROM embeddings"
SQL["s4_contexts"] = f"""WITH {CONTEXTS} SELECT hash, user_id, session_id, round_id, {KEPT_JSON} AS kept_message, omitted AS omitted_messages, kept_text,
  CAST({EPOCH + 3600 + 86400} AS BIGINT) AS expires FROM contexts"""
ENTRIES = f"""{PAGES},
entries AS (
  SELECT request_id, user_id, page_id, k AS pos, 'file' AS type, NULL AS role, NULL AS content, url AS original_url, CASE WHEN length(url) % 3 <> 0 THEN dest ELSE url END AS local_path FROM dests, (VALUES (1), (2)) t(k)
  UNION ALL SELECT request_id, user_id, page_id, 3, 'message', CASE WHEN page_id % 5 <> 0 THEN 'user' ELSE 'unknown' END, 'see ' || link, NULL, NULL FROM dests WHERE page_id % 4 <> 0),
dated AS (SELECT *, CAST({EPOCH} + page_id AS BIGINT) AS at, strftime(make_timestamp(({EPOCH} + page_id) * 1000000), '%Y-%m-%d') AS day FROM entries)"""
SQL["s5_journal_files"] = SQL["w4_stream_journal"] = f'WITH {ENTRIES} SELECT request_id, user_id, day, pos, type, role, content, original_url, local_path, "at" FROM dated'
SQL["s6_ingest_attachments"] = """SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'raw/' || page_id END AS local_path, CASE WHEN page_id % 3 <> 0 THEN CAST(strlen(coalesce(html, '')) + 1 AS BIGINT) ELSE -1 END AS length,
  CASE WHEN page_id % 3 <> 0 THEN md5(encode(coalesce(html, '')) || '\\x00'::BLOB) END AS digest FROM pages""".replace("\\\\", "\\")
SQL["j5_journal"] = f"""WITH {ENTRIES}, a AS (SELECT user_id, count(DISTINCT url) AS attachments, max(dest) AS last_dest FROM dests GROUP BY user_id)
SELECT d.user_id, count(*) AS entries, count(content) AS messages, min(day) AS first_day, any_value(attachments) AS attachments, any_value(last_dest) AS last_dest FROM dated d JOIN a ON a.user_id = d.user_id GROUP BY d.user_id"""

SEGMENTS = f"""{EVT}, texts AS (SELECT event_id, concat_ws(' ', event_type, props) AS text FROM events),
gaps AS (SELECT *, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY ts, round_no) AS gap FROM evt),
seg AS (SELECT *, {SEGMENT} AS segment FROM gaps)"""
SQL["w1_stream_sessions"] = f"""WITH {SEGMENTS}, l AS (SELECT *, max(segment) OVER (PARTITION BY user_id) AS last FROM seg),
kept AS (SELECT * FROM l WHERE segment = last QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, round_id DESC) <= 50)
SELECT user_id, session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, round_id) AS INTEGER) AS round_no, round_id, text AS first_user_text FROM kept k JOIN texts t ON t.event_id = k.event_id"""
SQL["w2_stream_session_windows"] = f"""WITH {SEGMENTS}
SELECT user_id, session_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 86400000000 AS expires_us, count(*) AS rounds FROM seg GROUP BY user_id, session_id, segment
HAVING epoch_us(max(ts)) + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) // 1000 * 1000 - 3600000000"""
SQL["w3_stream_memories"] = OTHER["l14_apply_actions"]
SQL["w5_stream_fact_dedup"] = f"SELECT DISTINCT source AS user_id, sha256(source || chr(0) || {NORM}) AS doc_id FROM documents"

SQL["u1_batch_extractor"] = f"""WITH {MSG} SELECT request_id, user_id, 0 AS fact_pos, string_agg('user: ' || text, chr(10) ORDER BY turn) AS fact FROM msg WHERE role = 'user' AND text <> ''
GROUP BY request_id, user_id"""
ASKED = f"""{MSG}, calls AS (SELECT request_id, user_id, 'Today is 2024-05-06.' AS system, 'Input:' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM msg WHERE text <> '' GROUP BY request_id, user_id)"""
SQL["u1_model_extractor"] = f"WITH {ASKED} SELECT request_id, 0 AS fact_pos, said AS fact, length(system) AS input_tokens, length(said) AS output_tokens, length(system) + length(said) AS total_tokens FROM calls"
SQL["u2_embedder"] = "SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS first, 2 AS dims FROM conversations WHERE text <> ''"
SQL["u3_model_decider"] = f"""WITH s AS ({OTHER['l8_similar_memories']}), f AS (SELECT 'r' || label AS request_id, 'u' || label AS user_id, 'fact ' || min(vec_id) AS fact FROM embeddings WHERE vec_id % 20 = 0 GROUP BY label)
SELECT s.request_id, 0 AS pos, f.user_id, s.id, f.fact AS text, 'UPDATE' AS event, s.text AS old_memory, CAST(7 AS BIGINT) AS total_tokens FROM s JOIN f ON f.request_id = s.request_id WHERE s.pos = 1"""
SQL["u4_strategies"] = f"""WITH {CLASSIFIED} SELECT 'reversible' AS strategy, request_id, round_no, {MARKER} AS marker, TRUE AS kept FROM compressed
UNION ALL SELECT 'omit', request_id, round_no, '[previous response omitted]', FALSE FROM compressed"""
SQL["u5_recall_module"] = f"WITH {HISTORY} SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round_no, part) - 1 AS INTEGER) AS pos, role, content FROM parts"
SQL["u5_store_modules"] = f"""WITH {ENTRIES}, a AS (SELECT user_id, count(DISTINCT url) AS attachments FROM dests GROUP BY user_id)
SELECT d.request_id, d.user_id, CAST(2 AS BIGINT) AS total_tokens, any_value(attachments) AS attachments, count(*) AS entries FROM dated d JOIN a ON a.user_id = d.user_id GROUP BY d.request_id, d.user_id"""

SQL["l5_embed_texts"] = f"WITH {embedded('vectors', 'conversations', 'conv_id, turn', 'text')} SELECT conv_id, turn, place, round(CAST(value AS DOUBLE), 5) AS value FROM vectors"
SQL["l18_recall_as_of"] = f"""WITH {EVT}, texts AS (SELECT event_id, concat_ws(' ', event_type, props) AS text FROM events), stores AS (SELECT * FROM evt WHERE event_type <> 'signup'), asks AS (SELECT * FROM evt WHERE event_type = 'signup'),
g AS (SELECT *, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM stores),
s AS (SELECT *, sum(CASE WHEN gap >= 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM g),
seen AS (SELECT a.round_id AS request_id, s.event_id, s.segment, s.tm, a.tm AS now, row_number() OVER (PARTITION BY a.round_id ORDER BY s.ts DESC, s.event_id DESC) AS k,
  max(s.segment) OVER (PARTITION BY a.round_id) AS last, max(s.tm) OVER (PARTITION BY a.round_id) AS last_at FROM asks a JOIN s ON s.user_id = a.user_id AND s.ts <= a.ts)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY k DESC) - 1 AS INTEGER) AS pos, 'user' AS role, text AS content
FROM seen JOIN texts t ON t.event_id = seen.event_id WHERE segment = last AND k <= 5 AND now - last_at < 86400"""
LINES = f"""lines AS (SELECT request_id, user_id, round_no, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM msg WHERE role = 'user'),
facts AS (SELECT request_id, user_id, trim(line) AS fact, row_number() OVER (PARTITION BY request_id ORDER BY turn, k) - 1 AS pos, sha256(user_id || chr(0) || {NORM.replace('text', 'line')}) AS id FROM lines WHERE regexp_matches(line, '\\S'))"""
SQL["l18_recall_embedded"] = f"""WITH {HISTORY}, {LINES}, mem AS (SELECT id, user_id, min(fact) AS data FROM facts GROUP BY id, user_id),
{embedded('mv', 'mem', 'id, user_id', 'data')}, queries AS (SELECT a.conv_id, 'r' || a.conv_id AS request_id, 'u' || (a.conv_id % 50) AS user_id, query_text FROM asked a WHERE query_text <> ''),
{embedded('qv', 'queries', 'request_id, user_id', 'query_text')},
mn AS (SELECT id, sqrt(sum(CAST(value AS DOUBLE) * value)) AS n FROM mv GROUP BY id), qn AS (SELECT request_id, sqrt(sum(CAST(value AS DOUBLE) * value)) AS n FROM qv GROUP BY request_id),
dots AS (SELECT q.request_id, q.user_id, m.id, sum(CAST(q.value AS DOUBLE) * m.value) AS d FROM qv q JOIN mv m ON q.user_id = m.user_id AND q.place = m.place GROUP BY ALL),
ranked AS (SELECT d.*, round(1 + d / (mn.n * qn.n), 12) AS score FROM dots d JOIN mn ON mn.id = d.id JOIN qn ON qn.request_id = d.request_id),
found AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank FROM ranked QUALIFY rank <= 10),
everything AS (
  SELECT f.request_id, f.user_id, 's' || substr(f.request_id, 2) AS session_id, 0 AS round_no, 0 AS part, 'system' AS role, {HEADER} || string_agg('- ' || data, chr(10) ORDER BY rank) AS content
  FROM found f JOIN mem ON mem.id = f.id WHERE score >= 1.2 GROUP BY f.request_id, f.user_id
  UNION ALL SELECT request_id, user_id, session_id, round_no, part, role, content FROM parts)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round_no, part) - 1 AS INTEGER) AS pos, role, content FROM everything"""
SQL["l19_store_memories"] = f"""WITH {MSG}, {LINES}, {VEC}, {embedded('fv', 'facts', 'request_id, user_id, pos', 'fact')},
norms AS (SELECT request_id, pos, sqrt(sum(CAST(value AS DOUBLE) * value)) AS n FROM fv GROUP BY ALL),
scores AS (SELECT f.request_id, f.pos, m.vec_id, round(1 + sum(CAST(f.value AS DOUBLE) * m.v[f.place + 1]) / (any_value(norms.n) * any_value(sqrt(list_dot_product(m.v, m.v)))), 12) AS score
  FROM fv f JOIN norms ON norms.request_id = f.request_id AND norms.pos = f.pos JOIN vec m ON m.user_id = f.user_id GROUP BY ALL),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY request_id, pos ORDER BY score DESC, 'v' || vec_id) = 1),
calls AS (SELECT request_id, max(round_no) AS "at" FROM msg GROUP BY request_id),
acts AS (SELECT f.*, c."at", CASE WHEN b.score >= 1.8 THEN b.vec_id END AS target FROM facts f JOIN norms n ON n.request_id = f.request_id AND n.pos = f.pos JOIN calls c ON c.request_id = f.request_id
  LEFT JOIN best b ON b.request_id = f.request_id AND b.pos = f.pos),
ups AS (SELECT target, max_by(CASE WHEN length('memory ' || target) > length(fact) THEN 'memory ' || target ELSE fact END, ("at", request_id, pos)) AS data FROM acts WHERE target IS NOT NULL GROUP BY target)
SELECT v.id, v.user_id, coalesce(u.data, 'memory ' || v.vec_id) AS data FROM vec v LEFT JOIN ups u ON u.target = v.vec_id
UNION ALL SELECT id, user_id, max_by(fact, ("at", request_id, pos)) FROM acts WHERE target IS NULL GROUP BY id, user_id"""
SQL["l19_store_usage"] = f"""WITH {ASKED}, own AS (SELECT DISTINCT 'u' || label AS user_id FROM embeddings), every AS (SELECT DISTINCT request_id FROM msg)
SELECT e.request_id, CAST(coalesce(length(system), 0) + CASE WHEN o.user_id IS NOT NULL THEN 5 ELSE 0 END AS BIGINT) AS input_tokens, CAST(coalesce(length(said), 0) + CASE WHEN o.user_id IS NOT NULL THEN 2 ELSE 0 END AS BIGINT) AS output_tokens,
  CAST(coalesce(length(system) + length(said), 0) + CASE WHEN o.user_id IS NOT NULL THEN 7 ELSE 0 END AS BIGINT) AS total_tokens
FROM every e LEFT JOIN calls c ON c.request_id = e.request_id LEFT JOIN own o ON o.user_id = c.user_id"""
