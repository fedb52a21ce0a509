"""DuckDB SQL of the queries over stored tables, of exact stores, remembered models and indexed searches."""

from __future__ import annotations

from sparkrecall.plans.oracle import ACTIONS, EPOCH, MSG, SQL as OTHER, VEC
from sparkrecall.plans.oracle_io import LINES, SQL as FILES, embedded

SQL: dict[str, str] = {}

BUCKET = "CAST('0x' || substr(md5(user_id), 1, 8) AS BIGINT) % 16"
ACTED = "user_id IN ('u1', 'u4')"

SQL["l14_pruned_merge"] = f"""WITH {ACTIONS}, mine AS (SELECT * FROM steps WHERE {ACTED}),
own AS (SELECT *, max(pos) FILTER (event = 'DELETE') OVER (PARTITION BY vec_id) AS gone, max(pos) FILTER (event = 'UPDATE') OVER (PARTITION BY vec_id) AS changed FROM mine),
merged AS (
  SELECT id, user_id, coalesce(max(text) FILTER (event = 'UPDATE' AND pos = changed), 'memory ' || vec_id) AS data, 'h' || vec_id AS hash, CAST({EPOCH} AS BIGINT) AS created,
    CAST(CASE WHEN max(changed) IS NOT NULL THEN {EPOCH + 60} ELSE {EPOCH} END AS BIGINT) AS updated FROM own WHERE gone IS NULL GROUP BY vec_id, id, user_id
  UNION ALL SELECT sha256(user_id || chr(0) || text), user_id, text, sha256(user_id || chr(0) || text), {EPOCH + 60}, {EPOCH + 60} FROM mine WHERE event = 'ADD'
  UNION ALL SELECT id, user_id, 'memory ' || vec_id, 'h' || vec_id, {EPOCH}, {EPOCH} FROM vec WHERE NOT {ACTED}),
touched AS (SELECT DISTINCT {BUCKET} AS b FROM mine)
SELECT id, user_id, data, hash, created, updated, CASE WHEN {BUCKET} IN (SELECT b FROM touched) THEN 2 ELSE 1 END AS version FROM merged"""
SQL["w3_durable_merge"] = OTHER["l14_apply_actions"]
SQL["l19_store_log"] = OTHER["l19_store_rounds"]
SQL["l19_store_exact"] = f"""WITH RECURSIVE {MSG}, {LINES}, {VEC},
texts AS (SELECT fact AS t FROM facts UNION SELECT 'memory ' || vec_id FROM vec), {embedded('tv', 'texts', 't', 't')},
emb AS (SELECT k.t, list(CAST(coalesce(tv.value, 0) AS DOUBLE) ORDER BY p) AS e FROM (SELECT DISTINCT t FROM tv) k CROSS JOIN range(64) g(p) LEFT JOIN tv ON tv.t = k.t AND tv.place = p GROUP BY k.t),
calls AS (SELECT request_id, row_number() OVER (PARTITION BY user_id ORDER BY max(round_no), request_id) AS wave FROM msg GROUP BY request_id, user_id),
f AS (SELECT facts.request_id, facts.user_id, pos, fact, facts.id AS doc_id, wave, e FROM facts JOIN emb ON emb.t = fact JOIN calls ON calls.request_id = facts.request_id),
state AS (
  SELECT CAST(0 AS BIGINT) AS wave, user_id, id, 'memory ' || vec_id AS data, v FROM vec
  UNION ALL SELECT 0, NULL, NULL, NULL, NULL
  UNION ALL (
    WITH nxt AS (SELECT max(wave) + 1 AS wave FROM state),
    cur AS (SELECT f.* FROM f JOIN nxt ON f.wave = nxt.wave),
    best AS (
      SELECT c.request_id, c.pos, p.id, p.data, round(1 + list_dot_product(c.e, p.v) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(p.v, p.v))), 12) AS score
      FROM cur c JOIN state p ON p.user_id = c.user_id QUALIFY row_number() OVER (PARTITION BY c.request_id, c.pos ORDER BY score DESC, p.id) = 1),
    acts AS (
      SELECT c.user_id, c.pos, CASE WHEN b.id = c.doc_id THEN 'NONE' WHEN b.score >= 1.8 THEN 'UPDATE' ELSE 'ADD' END AS event, CASE WHEN b.id <> c.doc_id AND b.score >= 1.8 THEN b.id ELSE c.doc_id END AS id,
        CASE WHEN b.id <> c.doc_id AND b.score >= 1.8 AND length(b.data) > length(c.fact) THEN b.data ELSE c.fact END AS text FROM cur c LEFT JOIN best b ON b.request_id = c.request_id AND b.pos = c.pos),
    fold AS (
      SELECT user_id, id, max(pos) FILTER (event = 'ADD') AS a, max_by(text, pos) FILTER (event = 'ADD') AS added, max(pos) FILTER (event = 'UPDATE') AS u, max_by(text, pos) FILTER (event = 'UPDATE') AS updated
      FROM acts WHERE event <> 'NONE' GROUP BY user_id, id),
    new AS (SELECT user_id, id, CASE WHEN u IS NOT NULL AND (a IS NULL OR u > a) THEN updated ELSE added END AS data FROM fold)
    SELECT nxt.wave, p.user_id, p.id, p.data, p.v FROM state p CROSS JOIN nxt LEFT JOIN fold ON fold.id = p.id WHERE fold.id IS NULL AND nxt.wave <= (SELECT max(wave) FROM f)
    UNION ALL SELECT nxt.wave, n.user_id, n.id, n.data, emb.e FROM new n JOIN emb ON emb.t = n.data CROSS JOIN nxt WHERE nxt.wave <= (SELECT max(wave) FROM f)))
SELECT id, user_id, data FROM state WHERE id IS NOT NULL AND wave = (SELECT max(wave) FROM state)"""
SQL["l7_index_recall"] = "SELECT 'q' || vec_id AS request_id, CAST(least(10, (SELECT count(*) FROM embeddings)) AS BIGINT) AS n_hits, TRUE AS reached FROM embeddings WHERE vec_id % 20 = 0"
SQL["u1_model_cache"] = """SELECT md5(coalesce(text, '')) AS digest, count(*) AS "rows", CAST(1 AS BIGINT) AS calls
FROM (SELECT text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT text FROM documents WHERE doc_id % 3 <> 1) GROUP BY 1"""
SQL["r11_stored_contexts"] = OTHER["r11_retrieve_contexts"]
SQL["s5_journal_table"] = SQL["w4_durable_journal"] = FILES["s5_journal_files"]
SQL["w1_stream_from_table"] = FILES["w1_stream_sessions"]
