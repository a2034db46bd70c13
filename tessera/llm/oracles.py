"""DuckDB SQL for the registered queries that SQL can express over whole tables.

The others are held against plain versions or accuracy in the tests: op1 and op5 (learned), op2 and op7 (a tokenizer's ids),
op9 (expectation-maximisation), and the pipeline, which holds two of them.
"""

from .chat import CLOSE, LEARN_CLOSE, LEARN_OPEN, OPEN, ROLE_END

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x{20}\x{09}-\x{0D}]+"
PLAIN = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"


def low(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def escaped(c: str) -> str:
    c = rf"regexp_replace(coalesce({c}, ''), '\\', '\\\\', 'g')"
    return rf"regexp_replace({c}, '([\[<])(/?(?:INST\]|ROLE\]|s>))', '\1\\\2', 'g')"


OP3 = f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(t)
), marked AS (
    SELECT *, CASE WHEN role = 'assistant' THEN '{LEARN_OPEN}' || {escaped('role')} || '{ROLE_END}' || {escaped('text')} || '{LEARN_CLOSE}'
        ELSE '{OPEN}' || {escaped('role')} || '{ROLE_END}' || {escaped('text')} || '{CLOSE}' END AS part FROM said
), chats AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(length(part)) AS chars
    FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM chats
"""

OP4 = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({low('text')}, '{PLAIN}'), []) AS w FROM documents
), i AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({low('text')}, '{PLAIN}') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[j:j + 9], ' ') AS words FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j) WHERE len(w) > 0
), own AS (
    SELECT r, size, j, array_to_string(w[j:j + size - 1], ' ') AS words FROM d, (SELECT DISTINCT size FROM windows), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS j)
), hits AS (
    SELECT r, j, size, item FROM own JOIN windows USING (size, words)
), cover AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(j, j + size)) AS p FROM (SELECT DISTINCT r, j, size FROM hits)) GROUP BY r
), found AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN found USING (r)
"""

OP6 = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{SPACED}'), []) AS w FROM documents
), windows AS (
    SELECT r, j, array_to_string(w[j:j + 34], ' ') AS words FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS j)
), again AS (
    SELECT words FROM windows GROUP BY words HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT r, unnest(range(j, j + 35)) AS p FROM windows SEMI JOIN again USING (words)
), each AS (
    SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: Five hex digits are four digits of base 32.
BASE32 = "array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || sha1(payload)[(k // 4) * 5 + 1:(k // 4) * 5 + 5])::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1]), '')"

OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, {BASE32} AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""

OP10 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all({low('text')}, '{SPACED}'), []) AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, array_to_string(w[j:j + 4], ' ') AS shingle FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j) WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT v, root FROM reach JOIN links ON u = id
), roots AS (
    SELECT id, min(root) AS component_id FROM reach GROUP BY id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN sizes USING (doc_id) JOIN roots ON id = doc_id
"""

OP12 = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)
), s AS (
    SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, CAST(list_dot_product(a.x, e.x) AS BIGINT) AS score FROM e a, e WHERE a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
"""

ORACLE_SQL = {"op3_chat": OP3, "op4_decontamination": OP4, "op6_substring_dedup": OP6, "op8_warc": OP8, "op10_near_dedup": OP10, "op12_hard_negatives": OP12}
