"""DuckDB SQL for the registered queries, over the same tables."""

V_ENTRIES = """
SELECT e.vec_id AS id, coalesce(d.text, concat('vector ', e.vec_id)) AS raw_text, e.embedding,
  CASE e.label % 5 WHEN 0 THEN 'observation' WHEN 1 THEN 'decision' WHEN 2 THEN 'action_item'
       WHEN 3 THEN 'reference' ELSE 'project_note' END AS entry_type,
  CASE WHEN e.vec_id % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_value(coalesce(d.lang, 'xx'), coalesce(d.source, 'none')) END AS topics,
  CASE WHEN e.vec_id % 3 = 0 THEN list_value(coalesce(d.source, 'none')) ELSE CAST([] AS VARCHAR[]) END AS projects,
  concat('src_', coalesce(d.lang, 'xx')) AS source_client,
  CAST(coalesce(l.quality, 0.5) AS DOUBLE) AS relevance_score,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(e.vec_id) AS created_at
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id
"""

V_USAGE = """
SELECT *, prompt_tokens + completion_tokens AS total_tokens,
  CAST(round((CASE WHEN provider = 'openai' AND model = 'm0' THEN 0.15 * prompt_tokens + 0.60 * completion_tokens
                   WHEN provider = 'openai' THEN 0.50 * prompt_tokens + 1.50 * completion_tokens
                   WHEN provider = 'nvidia' AND model = 'm0' THEN 0.20 * (prompt_tokens + completion_tokens)
                   ELSE 0 END) / 1000.0, 8) AS DECIMAL(12, 8)) AS estimated_cost
FROM (
  SELECT event_id AS id,
    CASE user_id % 3 WHEN 0 THEN 'ollama' WHEN 1 THEN 'openai' ELSE 'nvidia' END AS provider,
    concat('m', CAST(user_id % 2 AS STRING)) AS model,
    CASE event_type WHEN 'click' THEN 'classify' WHEN 'view' THEN 'extract' WHEN 'signup' THEN 'embed' ELSE 'chat' END AS operation,
    CAST(floor(value * 10) AS INT) AS prompt_tokens,
    CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS completion_tokens,
    ts + to_days(10) AS created_at
  FROM events)
"""

V_RESPONSES = """
SELECT l.doc_id AS request_id, 'classify' AS operation, a.attempt,
  CASE
    WHEN l.doc_id % 8 = 1 AND a.attempt = 1 THEN 'no json here'
    WHEN l.doc_id % 8 = 2 THEN concat('Sure. {"label": " STORE ", "confidence": "0.', CAST(l.doc_id % 10 AS STRING), '"} done')
    WHEN l.doc_id % 8 = 3 THEN '{"label": "banana", "confidence": 7}'
    WHEN l.doc_id % 8 = 4 THEN '{"label": "chit_chat"}'
    WHEN l.doc_id % 8 = 5 THEN '{"label": "store", "confidence": "high"}'
    WHEN l.doc_id % 8 = 6 THEN '{"label": null, "confidence": 0.4}'
    WHEN l.doc_id % 8 = 7 THEN '{"label": "store", "confidence": '
    ELSE concat('```json ', '{"label": "', CASE WHEN l.quality = 1 THEN 'store' ELSE 'system_noise' END, '", "confidence": 0.9, "reason": "r"}', ' ```')
  END AS raw,
  CAST(10 + l.doc_id % 50 AS INT) AS prompt_eval_count, CAST(5 + a.attempt AS INT) AS eval_count
FROM labels l CROSS JOIN (SELECT 1 AS attempt UNION ALL SELECT 2 UNION ALL SELECT 3) a
WHERE a.attempt = 1 OR l.doc_id % 8 IN (1, 5, 7)
"""

V_VEC_DUP = """
SELECT vec_id AS id, 0 AS variant, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings
UNION ALL SELECT vec_id + 1000000, 1, list_concat([CAST(embedding[1] AS DOUBLE) + 0.15], CAST(embedding[2:] AS DOUBLE[])) FROM embeddings WHERE vec_id % 10 = 0
UNION ALL SELECT vec_id + 2000000, 2, list_concat([CAST(embedding[1] AS DOUBLE) + 0.30], CAST(embedding[2:] AS DOUBLE[])) FROM embeddings WHERE vec_id % 10 = 0
"""

# Block -> JSON; null where there is no block or it does not parse.
JSON_OF = r"""
TRY_CAST(CASE WHEN regexp_matches(raw, '(?s)```(?:json)?\s*(\{.*?\})\s*```') THEN regexp_extract(raw, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1)
     WHEN regexp_matches(raw, '(?s)\{.*\}') THEN regexp_extract(raw, '(?s)\{.*\}') END AS JSON)
"""

ATTEMPTS = f"""
SELECT request_id, operation, attempt, status, prompt_eval_count, eval_count,
  CASE WHEN status = 'good' THEN label END AS label,
  CASE WHEN status = 'good' THEN greatest(0.0, least(1.0, conf)) END AS confidence,
  CASE WHEN status = 'good' THEN coalesce(j->>'$.reason', '') END AS reason
FROM (
  SELECT *, CASE WHEN j IS NULL THEN 'failed' WHEN lt <> 'VARCHAR' OR ct IN ('NULL', 'ARRAY', 'OBJECT') THEN 'fatal'
                 WHEN conf IS NULL THEN 'failed' ELSE 'good' END AS status
  FROM (
    SELECT *, CASE WHEN lt IS NULL THEN 'uncertain'
                   WHEN lower(trim(j->>'$.label')) IN ('store', 'too_short', 'chit_chat', 'system_noise', 'uncertain') THEN lower(trim(j->>'$.label'))
                   ELSE 'uncertain' END AS label,
      CASE WHEN ct IS NULL THEN 0.5 ELSE TRY_CAST(j->>'$.confidence' AS DOUBLE) END AS conf
    FROM (SELECT *, json_type(j, '$.label') AS lt, json_type(j, '$.confidence') AS ct
          FROM (SELECT *, {JSON_OF} AS j FROM responses))))
"""

# First good or fatal attempt per request; NULL attempt when there is none.
RESOLVED = """
SELECT r.request_id, f.attempt, coalesce(f.status, 'failed') AS status, f.label, f.confidence, f.reason
FROM (SELECT DISTINCT request_id FROM attempts) r
LEFT JOIN (SELECT * FROM attempts WHERE status <> 'failed'
           QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY attempt) = 1) f USING (request_id)
"""

GATE = f"""
responses AS ({V_RESPONSES}), attempts AS ({ATTEMPTS}), resolved AS ({RESOLVED}),
gate AS (SELECT request_id, attempt, status, status = 'fatal' AS fatal,
  CASE status WHEN 'failed' THEN 'uncertain' WHEN 'good' THEN label END AS label,
  CASE status WHEN 'failed' THEN 0.0 WHEN 'good' THEN confidence END AS confidence,
  CASE status WHEN 'failed' THEN 'Classifier unavailable: no usable answer' WHEN 'good' THEN reason END AS reason,
  status = 'failed' OR (status = 'good' AND label IN ('store', 'uncertain')) AS should_store
  FROM resolved)
"""

V_EXTRACTS = r"""
SELECT doc_id AS request_id, n_chars,
  CASE doc_id % 5
    WHEN 0 THEN concat('{"entry_type": " Decision ", "topics": ["', lang, '", " ", null, "', source, '", "', lang, '"], "people": "nobody", "projects": [7, 0, false, ""]}')
    WHEN 1 THEN concat('Here: ```json', chr(10), '{"entry_type": "memo", "topics": [], "action_items": [" do ', n_chars, ' things "]}', chr(10), '``` and {x}')
    WHEN 2 THEN concat('{"entry_type": 3, "topics": {"a": 1}, "projects": ["', source, '"]}')
    WHEN 3 THEN '{"entry_type": "reference"'
    ELSE concat('ok {"people": ["', chr(160), lang, '\t", true], "entry_type": "PROJECT_NOTE"} bye') END AS raw
FROM documents
"""


def _tags(name):
    """Stripped, non-blank elements of a JSON list; falsy elements dropped."""
    items = f"""list_filter(list_transform(
        CASE WHEN json_type(j, '$.{name}') = 'ARRAY' THEN json_extract(j, '$.{name}[*]') ELSE CAST([] AS JSON[]) END,
        lambda x: CASE WHEN CAST(x AS VARCHAR) IN ('null', '0', 'false') THEN '' ELSE
             regexp_replace(x->>'$', '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') END), lambda y: y <> '')"""
    return f"coalesce({items}, CAST([] AS VARCHAR[]))"


METADATA = f"""
SELECT request_id, n_chars,
  CASE WHEN json_type(j, '$.entry_type') = 'VARCHAR'
        AND lower(trim(j->>'$.entry_type')) IN ('observation', 'decision', 'action_item', 'reference', 'project_note')
       THEN lower(trim(j->>'$.entry_type')) ELSE 'observation' END AS entry_type,
  {_tags('topics')} AS topics, {_tags('people')} AS people,
  {_tags('projects')} AS projects, {_tags('action_items')} AS action_items
FROM (SELECT *, {JSON_OF} AS j FROM ({V_EXTRACTS}))
"""

# Greedy admission of `cand` (id, pos, embedding) against `held` (embedding): ids kept.
ADMISSION = """
fresh AS MATERIALIZED (SELECT c.id, c.pos, c.embedding FROM cand c WHERE NOT EXISTS (
  SELECT 1 FROM held h WHERE list_cosine_similarity(CAST(h.embedding AS DOUBLE[]), c.embedding) > 0.98)),
near AS MATERIALIZED (SELECT b.id, list(a.id) AS earlier FROM fresh a JOIN fresh b
  ON (a.pos < b.pos OR (a.pos = b.pos AND a.id < b.id))
  AND list_cosine_similarity(a.embedding, b.embedding) > 0.98 GROUP BY b.id),
ordered AS MATERIALIZED (SELECT f.id, coalesce(n.earlier, CAST([] AS BIGINT[])) AS earlier,
  row_number() OVER (ORDER BY f.pos, f.id) AS n FROM fresh f LEFT JOIN near n USING (id)),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept
  UNION ALL SELECT o.n, CASE WHEN list_has_any(w.kept, o.earlier) THEN w.kept ELSE list_append(w.kept, o.id) END
  FROM walk w JOIN ordered o ON o.n = w.n + 1),
kept AS (SELECT unnest(kept) AS id FROM walk WHERE n = (SELECT max(n) FROM walk))
"""

SIM = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
ISO_ENTRY = "strftime(created_at, '%Y-%m-%dT%H:%M:%S')"


def _list(name):
    return f"array_to_string({name}, '|')"


def _search(where, limit, vec_id=0):
    return f"""
WITH e AS ({V_ENTRIES}), q AS (SELECT embedding FROM embeddings WHERE vec_id = {vec_id})
SELECT id, raw_text, entry_type, {_list('topics')} AS topics, {_list('projects')} AS projects, source_client,
  relevance_score, {ISO_ENTRY} AS created_at, round(sim, 6) AS similarity_score
FROM (SELECT e.*, {SIM} AS sim FROM e, q WHERE {where}) ORDER BY sim DESC, id LIMIT {limit}
"""


def _search_many(condition, limit):
    return f"""
WITH e AS ({V_ENTRIES}), q AS (SELECT vec_id AS query_id, v.embedding, x.entry_type, d.source AS project
  FROM embeddings v LEFT JOIN ({V_ENTRIES}) x ON x.id = v.vec_id LEFT JOIN documents d ON d.doc_id = v.vec_id)
SELECT q.query_id, e.id, e.entry_type, {SIM} AS sim,
  row_number() OVER (PARTITION BY q.query_id ORDER BY round({SIM}, 12) DESC, e.id) AS rank
FROM e JOIN q ON {condition} QUALIFY rank <= {limit}
"""


def _recent(days, where):
    return f"""
SELECT id, raw_text, entry_type, {_list('topics')} AS topics, {_list('projects')} AS projects, source_client,
  relevance_score, {ISO_ENTRY} AS created_at
FROM ({V_ENTRIES}) WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL {days} DAY AND {where}
ORDER BY created_at DESC, id LIMIT 50
"""


_IN_WINDOW = "created_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 14 DAY"


def _top(column, name):
    return f"""SELECT x AS {name}, count(*) AS cnt FROM (SELECT unnest({column}) AS x FROM ({V_ENTRIES})
WHERE {_IN_WINDOW}) GROUP BY x ORDER BY cnt DESC, x LIMIT 10"""


_USAGE_WINDOW = f"(SELECT * FROM ({V_USAGE}) WHERE created_at >= TIMESTAMP '2024-02-08 12:00:00' - INTERVAL 14 DAY)"
_COST = "round(CAST(coalesce(sum(estimated_cost), 0) AS DOUBLE), 6)"
_SUMS = f"""coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt, coalesce(sum(completion_tokens), 0)::BIGINT AS completion,
  coalesce(sum(total_tokens), 0)::BIGINT AS tokens, {_COST} AS cost, count(*) AS requests"""


def _to_date(unit):
    return f"""SELECT coalesce(sum(total_tokens), 0)::BIGINT AS tokens, {_COST} AS cost FROM ({V_USAGE})
WHERE created_at >= date_trunc('{unit}', TIMESTAMP '2024-02-08 12:00:00')"""


_BUDGET = """SELECT 50.0::DOUBLE AS monthly_limit, cost AS monthly_spent, pct AS percent_used,
  CASE WHEN pct >= 100 THEN 'exceeded' WHEN pct >= 80 THEN 'warning' ELSE 'ok' END AS status
FROM (SELECT cost, round_even(cost / 50.0 * 100, 1) AS pct FROM ({}))""".format(_to_date("month"))

_ALERT = """CASE WHEN cost / 50.0 >= 1.0 THEN 'exceeded' WHEN cost / 50.0 >= 0.8 THEN 'warning' END"""

_NEWEST = "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"
_BLANK = r"regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') = ''"
USER_TURNS = f"SELECT * FROM (SELECT * FROM conversations {_NEWEST}) WHERE role = 'user' AND NOT {_BLANK}"
ASSISTANT_TURNS = f"""SELECT * FROM (SELECT * FROM conversations WHERE role = 'assistant' AND text <> '' {_NEWEST})
WHERE NOT {_BLANK}"""

BLOCKS = f"""
e AS ({V_ENTRIES}), q AS (SELECT u.conv_id, v.embedding FROM ({USER_TURNS}) u JOIN embeddings v ON v.vec_id = u.conv_id),
hits AS (SELECT q.conv_id, e.*, round_even({SIM}, 4) AS score,
    row_number() OVER (PARTITION BY q.conv_id ORDER BY {SIM} DESC, e.id) AS rank
  FROM e, q QUALIFY rank <= 3),
blocks AS (SELECT conv_id, count(*) AS memories, string_agg(concat('[', entry_type, ']',
    CASE WHEN len(topics) > 0 THEN concat(' Topics: ', array_to_string(topics, ', ')) ELSE '' END,
    ' (', strftime(created_at, '%Y-%m-%d'), ')', chr(10), raw_text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS block
  FROM hits WHERE score >= 0.3 GROUP BY conv_id)
"""

_ID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"

# Everything a capture run decides, per request.
CAPTURE = f"""
WITH RECURSIVE {GATE}, meta AS ({METADATA}),
vec AS (SELECT l.doc_id AS request_id, list_concat([CAST(CAST(CAST(e.embedding[1] AS DOUBLE) + (l.doc_id % 4) * 0.15 AS FLOAT) AS DOUBLE)],
    CAST(e.embedding[2:] AS DOUBLE[])) AS embedding
  FROM documents l JOIN embeddings e ON e.vec_id = l.doc_id - l.doc_id % 4),
asked AS (SELECT d.doc_id AS request_id, g.attempt, coalesce(g.status, 'failed') AS status, coalesce(g.fatal, false) AS fatal,
    CASE WHEN g.request_id IS NULL THEN 'uncertain' ELSE g.label END AS label,
    CASE WHEN g.request_id IS NULL THEN 0.0 ELSE g.confidence END AS confidence,
    CASE WHEN g.request_id IS NULL THEN 'Classifier unavailable: no usable answer' ELSE g.reason END AS reason,
    coalesce(g.should_store, true) AS should_store
  FROM documents d LEFT JOIN gate g ON g.request_id = d.doc_id),
judged AS (SELECT g.*, m.* EXCLUDE (request_id), v.embedding, d.text, concat('src_', d.lang) AS source_client, md5(CAST(g.request_id AS VARCHAR)) AS h,
    TIMESTAMP '2024-03-01 00:00:00' + to_minutes(g.request_id) AS created_at,
    CASE WHEN fatal THEN 'error' WHEN NOT should_store THEN 'filtered' WHEN v.embedding IS NULL THEN 'error' ELSE 'candidate' END AS state
  FROM asked g JOIN documents d ON d.doc_id = g.request_id LEFT JOIN meta m USING (request_id) LEFT JOIN vec v USING (request_id)),
held AS (SELECT embedding FROM ({V_ENTRIES})),
cand AS (SELECT request_id AS id, created_at AS pos, embedding FROM judged WHERE state = 'candidate'),
{ADMISSION},
outcomes AS (SELECT j.*, CASE WHEN state <> 'candidate' THEN state WHEN k.id IS NOT NULL THEN 'stored' ELSE 'duplicate' END AS outcome
  FROM judged j LEFT JOIN kept k ON k.id = j.request_id)
"""

_OUTCOMES = CAPTURE + f"""
SELECT request_id, outcome, outcome = 'stored' AS stored, CASE WHEN outcome = 'stored' THEN {_ID} END AS id,
  CASE outcome WHEN 'stored' THEN concat('Stored as ', entry_type, ' (confidence ', printf('%.2f', confidence), ')')
    WHEN 'duplicate' THEN 'Near-duplicate entry already exists (cosine similarity > 0.98)'
    WHEN 'filtered' THEN concat('Filtered by relevance gate: ', label, ' — ', reason)
    ELSE CASE WHEN fatal THEN 'Error: unusable label or confidence in classifier answer'
              ELSE 'Error: embedding failed after 3 attempts: no usable answer' END END AS reason
FROM outcomes
"""

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0)"
_STRIP = r"regexp_replace(text, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')"
_COURTESIES = ("hello hi hey welcome greetings good morning day evening night thanks thank you please cheers sorry yes no ok okay sure "
               "fine nice great bye goodbye farewell").split()
_SPACED = f"concat(' ', array_to_string({WORDS}, ' '), ' ')"
_TYPE_SQL = f"""CASE
  WHEN regexp_matches({_SPACED}, ' (must|should|ought to|have to|has to|todo|remember to) ') THEN 'action_item'
  WHEN regexp_matches({_SPACED}, ' (choose|chosen|decide|decided|select|selected|prefer|opt for|settle on) ') THEN 'decision'
  WHEN regexp_matches({_SPACED}, ' (project|roadmap|phase|iteration|deadline|release plan) ') THEN 'project_note'
  WHEN regexp_matches({_SPACED}, ' (chapter|section|page|manual|appendix|footnote|http|https|see also) ') THEN 'reference'
  ELSE 'observation' END"""

_USAGE_ROWS = """
SELECT concat_ws('/', CAST(a.request_id AS VARCHAR), 'classify', CAST(a.attempt AS VARCHAR)) AS id, 'ollama' AS provider,
  'unknown' AS model, 'classify' AS operation, a.prompt_eval_count AS prompt_tokens, a.eval_count AS completion_tokens
FROM attempts a JOIN resolved r ON r.request_id = a.request_id AND a.attempt <= coalesce(r.attempt, 3)
"""

ORACLES = {
    "search_topk": _search("true", 10),
    "search_by_type": _search("entry_type = 'decision'", 20),
    "search_by_project": _search("list_contains(projects, 'src1')", 50),
    "search_many": f"""SELECT query_id, rank, id, entry_type, round(sim, 6) AS similarity_score
FROM ({_search_many('true', 3)})""",
    "search_many_filtered": f"""SELECT query_id, rank, id, round(sim, 6) AS similarity_score
FROM ({_search_many('e.entry_type = q.entry_type AND list_contains(e.projects, q.project)', 5)})""",
    "ann_search_all_lists": f"""SELECT query_id, id, round(sim, 6) AS similarity_score, rank
FROM ({_search_many('true', 3)})""",
    "json_output": f"""SELECT * REPLACE (CAST(id AS VARCHAR) AS id, round_even(similarity_score, 4) AS similarity_score)
FROM ({_search('true', 10, 1)})""",
    "recent_entries": _recent(7, "true"),
    "recent_by_type": _recent(10, "entry_type = 'reference' AND list_contains(projects, 'src1')"),
    "stats_summary": f"""SELECT count(*) FILTER ({_IN_WINDOW}) AS total_in_window,
  strftime(max(created_at) FILTER ({_IN_WINDOW}), '%Y-%m-%dT%H:%M:%S') AS most_recent, count(*) AS total_all_time
FROM ({V_ENTRIES})""",
    "stats_by_type": f"SELECT entry_type, count(*) AS cnt FROM ({V_ENTRIES}) WHERE {_IN_WINDOW} GROUP BY entry_type",
    "stats_top_topics": _top("topics", "topic"),
    "stats_top_projects": _top("projects", "project"),
    "store_stats": f"""
WITH v AS ({V_ENTRIES}), t AS (SELECT entry_type, count(*) AS cnt FROM v WHERE {_IN_WINDOW} GROUP BY entry_type),
a AS ({_top('topics', 'topic')}), p AS ({_top('projects', 'project')})
SELECT count(*) FILTER ({_IN_WINDOW}) AS total_in_window,
  strftime(max(created_at) FILTER ({_IN_WINDOW}), '%Y-%m-%dT%H:%M:%S') AS most_recent, count(*) AS total_all_time,
  (SELECT string_agg(concat(entry_type, '=', cnt), '|' ORDER BY cnt DESC, entry_type) FROM t) AS by_entry_type,
  (SELECT string_agg(concat(topic, '=', cnt), '|' ORDER BY cnt DESC, topic) FROM a) AS top_topics,
  (SELECT string_agg(concat(project, '=', cnt), '|' ORDER BY cnt DESC, project) FROM p) AS top_projects
FROM v""",
    "usage_cost": f"SELECT id, total_tokens, round(CAST(estimated_cost AS DOUBLE), 6) AS estimated_cost FROM ({V_USAGE})",
    "usage_summary": f"""SELECT coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, {_COST} AS total_cost,
  count(*) AS total_requests FROM {_USAGE_WINDOW}""",
    "usage_today": _to_date("day"),
    "usage_month": _to_date("month"),
    "usage_by_provider": f"SELECT provider, tokens, cost, requests FROM (SELECT provider, {_SUMS} FROM {_USAGE_WINDOW} GROUP BY provider)",
    "usage_by_model": f"""SELECT provider, model, prompt, completion, tokens AS total, cost, requests
FROM (SELECT provider, model, {_SUMS} FROM {_USAGE_WINDOW} GROUP BY provider, model)""",
    "usage_by_operation": f"SELECT operation, tokens, requests FROM (SELECT operation, {_SUMS} FROM {_USAGE_WINDOW} GROUP BY operation)",
    "usage_daily": f"""SELECT day, tokens, cost
FROM (SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, {_SUMS} FROM {_USAGE_WINDOW} GROUP BY day)""",
    "usage_budget": _BUDGET,
    "usage_alert": f"""SELECT 50.0::DOUBLE AS monthly_limit, cost AS monthly_spent, {_ALERT} AS alert
FROM ({_to_date('month')}) WHERE cost / 50.0 >= 0.8""",
    "token_sections": f"""
WITH u AS (SELECT *, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM {_USAGE_WINDOW})
SELECT 'summary' AS section, NULL AS provider, NULL AS model, NULL AS operation, NULL AS day, {_SUMS} FROM u
UNION ALL SELECT 'by_provider', provider, NULL, NULL, NULL, {_SUMS} FROM u GROUP BY provider
UNION ALL SELECT 'by_model', provider, model, NULL, NULL, {_SUMS} FROM u GROUP BY provider, model
UNION ALL SELECT 'by_operation', NULL, NULL, operation, NULL, {_SUMS} FROM u GROUP BY operation
UNION ALL SELECT 'daily', NULL, NULL, NULL, day, {_SUMS} FROM u GROUP BY day""",
    "token_report": f"""
WITH u AS (SELECT *, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day FROM {_USAGE_WINDOW}),
t AS ({_to_date('day')}), m AS ({_to_date('month')}), b AS ({_BUDGET}),
p AS (SELECT provider, {_SUMS} FROM u GROUP BY provider), pm AS (SELECT provider, model, {_SUMS} FROM u GROUP BY provider, model),
o AS (SELECT operation, {_SUMS} FROM u GROUP BY operation), d AS (SELECT day, {_SUMS} FROM u GROUP BY day)
SELECT s.tokens AS total_tokens, s.cost AS total_cost, s.requests AS total_requests, t.tokens AS today_tokens, t.cost AS today_cost,
  m.tokens AS month_tokens, m.cost AS month_cost,
  (SELECT string_agg(concat_ws('=', provider, tokens, CAST(round(cost * 1000, 0) AS BIGINT), requests), '|' ORDER BY tokens DESC, provider) FROM p) AS by_provider,
  (SELECT string_agg(concat_ws('=', provider, model, prompt, completion, tokens, requests), '|' ORDER BY tokens DESC, provider, model) FROM pm) AS by_model,
  (SELECT string_agg(concat_ws('=', operation, tokens, requests), '|' ORDER BY tokens DESC, operation) FROM o) AS by_operation,
  (SELECT string_agg(concat_ws('=', day, tokens), '|' ORDER BY day) FROM d) AS daily,
  b.monthly_limit, b.monthly_spent, b.percent_used, b.status
FROM (SELECT {_SUMS} FROM u) s, t, m, b""",
    "parse_gate": f"""WITH responses AS ({V_RESPONSES}) SELECT request_id, attempt, status, label,
  round(confidence, 6) AS confidence, reason FROM ({ATTEMPTS})""",
    "parse_metadata": f"""SELECT request_id, entry_type, {_list('topics')} AS topics, {_list('people')} AS people,
  {_list('projects')} AS projects, {_list('action_items')} AS action_items FROM ({METADATA})""",
    "resolve_attempts": f"""WITH {GATE} SELECT r.request_id, r.attempt, r.status, count(*) AS used
FROM resolved r JOIN attempts a ON a.request_id = r.request_id AND a.attempt <= coalesce(r.attempt, 3)
GROUP BY ALL""",
    "gate_results": f"WITH {GATE} SELECT request_id, fatal, label, round(confidence, 6) AS confidence, reason, should_store FROM gate",
    "response_usage": f"WITH {GATE} {_USAGE_ROWS}",
    "inference_requests": f"""WITH {GATE}, pass AS (SELECT d.* FROM documents d JOIN gate g ON g.request_id = d.doc_id WHERE should_store)
SELECT doc_id AS request_id, 'classify' AS operation, md5(concat('Gate: ', text, ' ?')) AS prompt_md5 FROM documents
UNION ALL SELECT doc_id, 'extract', md5(concat('Tags: ', text, ' !')) FROM pass
UNION ALL SELECT doc_id, 'embed', md5(text) FROM pass""",
    "dup_against_store": f"""WITH v AS ({V_VEC_DUP}) SELECT id FROM v b WHERE variant > 0 AND EXISTS (
  SELECT 1 FROM v s WHERE s.variant = 0 AND list_cosine_similarity(s.embedding, b.embedding) > 0.98)""",
    "dedupe_batch": f"""
WITH RECURSIVE cand AS (SELECT id, id AS pos, embedding FROM ({V_VEC_DUP})), held AS (SELECT embedding FROM embeddings WHERE false),
{ADMISSION}
SELECT c.id, k.id IS NOT NULL AS admitted FROM cand c LEFT JOIN kept k ON k.id = c.id""",
    "user_turns": f"SELECT conv_id, turn, role, text FROM ({USER_TURNS})",
    "assistant_turns": f"SELECT conv_id, turn, role, text FROM ({ASSISTANT_TURNS})",
    "capture_turns": f"""SELECT concat(conv_id, '/', turn) AS request_id, text,
  CASE role WHEN 'user' THEN 'open_webui_user' ELSE 'open_webui_assistant' END AS source_client,
  '2024-03-01T00:00:00+00:00' AS created_at
FROM (SELECT * FROM ({USER_TURNS}) UNION ALL SELECT * FROM ({ASSISTANT_TURNS}))""",
    "memory_blocks": f"WITH {BLOCKS} SELECT conv_id, block, memories FROM blocks",
    "augment_chats": f"""WITH {BLOCKS},
firsts AS (SELECT conv_id, turn, role, block FROM conversations JOIN blocks USING (conv_id)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)
SELECT c.conv_id, c.turn, c.role, concat(c.text, CASE WHEN f.role = 'system'
  THEN concat(chr(10), chr(10), '--- Memories ---', chr(10), f.block) ELSE '' END) AS text
FROM conversations c LEFT JOIN firsts f ON f.conv_id = c.conv_id AND f.turn = c.turn
UNION ALL SELECT conv_id, turn - 1, 'system', concat('Memories:', chr(10), chr(10), block) FROM firsts WHERE role <> 'system'""",
    "capture_outcomes": _OUTCOMES,
    "capture_entries": CAPTURE + f"""
SELECT {_ID} AS id, text AS raw_text, entry_type, {_list('topics')} AS topics, {_list('people')} AS people,
  {_list('projects')} AS projects, {_list('action_items')} AS action_items, source_client,
  round(confidence, 6) AS relevance_score, concat({ISO_ENTRY}, '+00:00') AS created_at
FROM outcomes WHERE outcome = 'stored'""",
    "capture_usage": CAPTURE + f"""
SELECT u.*, concat(strftime(TIMESTAMP '2024-03-01 00:00:00' + to_minutes(CAST(split_part(u.id, '/', 1) AS BIGINT)), '%Y-%m-%dT%H:%M:%S'), '+00:00') AS created_at
FROM ({_USAGE_ROWS}
  UNION ALL SELECT concat(request_id, '/extract/1'), 'ollama', 'unknown', 'extract', CAST(n_chars AS INT), 20 FROM judged WHERE state <> 'filtered' AND NOT fatal
  UNION ALL SELECT concat(request_id, '/embed/1'), 'ollama', 'unknown', 'embed', 12, 0 FROM judged
    WHERE state <> 'filtered' AND NOT fatal AND embedding IS NOT NULL) u""",
    "seed_entries": f"""
WITH RECURSIVE cand AS (SELECT id, id AS pos, embedding FROM ({V_VEC_DUP})), held AS (SELECT embedding FROM embeddings WHERE false),
{ADMISSION}
SELECT {_ID} AS id, CAST(rid AS VARCHAR) AS raw_text, 'reference' AS entry_type, 'seeded' AS topics, '' AS people, 'memlake' AS projects,
  '' AS action_items, 'seed' AS source_client, 1.0::DOUBLE AS relevance_score, '2024-03-01T00:00:00+00:00' AS created_at
FROM (SELECT id AS rid, md5(CAST(id AS VARCHAR)) AS h FROM kept)""",
    "quarantine": """
SELECT id, entry_type, CASE WHEN entry_type NOT IN ('observation', 'decision', 'action_item', 'reference', 'project_note') THEN 'unknown entry_type'
  WHEN length(src) > 100 THEN 'source_client too long' END AS fault
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 6 WHEN 5 THEN lang WHEN 4 THEN 'observation' ELSE 'decision' END AS entry_type,
        repeat(source, CASE WHEN doc_id % 10 = 3 THEN 30 ELSE 1 END) AS src FROM documents)""",
    "store_roundtrip": f"""
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_date, source_client, count(*) AS entries, round(sum(relevance_score), 6) AS score
FROM ({V_ENTRIES}) WHERE source_client <> 'src_fr' GROUP BY ALL""",
    "rule_gate": f"""
SELECT request_id, label, CASE WHEN label = 'store' THEN 0.75 ELSE 0.9 END::DOUBLE AS confidence, label = 'store' AS should_store
FROM (SELECT doc_id AS request_id, CASE
    WHEN regexp_matches({_STRIP}, '(?i)^[^\\p{{L}}]*(trace|debug|info|notice|warn|warning|error|severe|fatal|critical)\\s*[\\]):|=-]') THEN 'system_noise'
    WHEN length({_STRIP}) < 400 AND len({WORDS}) > 0 AND len(list_filter({WORDS}, lambda w: NOT list_contains({_COURTESIES}, w))) = 0 THEN 'chit_chat'
    WHEN len({WORDS}) < 4 THEN 'too_short' ELSE 'store' END AS label FROM documents)""",
    "rule_metadata": f"""
WITH terms AS (SELECT DISTINCT lang AS term, 'topics' AS kind FROM documents UNION SELECT source, 'projects' FROM documents
  UNION SELECT array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: concat(upper(w[1]), w[2:])), ' '), 'people' FROM nation
  UNION SELECT array_to_string(string_split(text, ' ')[1:2], ' '), 'projects' FROM benchmark),
runs AS (SELECT term, kind, array_to_string(list_filter(regexp_split_to_array(lower(term), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0), ' ') AS run FROM terms),
found AS (SELECT DISTINCT d.doc_id, t.term, t.kind FROM (SELECT doc_id, {_SPACED} AS spaced FROM documents) d JOIN runs t
  ON t.run <> '' AND contains(d.spaced, concat(' ', t.run, ' ')))
SELECT doc_id AS request_id, {_TYPE_SQL} AS entry_type,
  coalesce((SELECT string_agg(term, '|' ORDER BY term) FROM found f WHERE f.doc_id = d.doc_id AND kind = 'topics'), '') AS topics,
  coalesce((SELECT string_agg(term, '|' ORDER BY term) FROM found f WHERE f.doc_id = d.doc_id AND kind = 'people'), '') AS people,
  coalesce((SELECT string_agg(term, '|' ORDER BY term) FROM found f WHERE f.doc_id = d.doc_id AND kind = 'projects'), '') AS projects,
  md5(CASE WHEN {_TYPE_SQL} = 'action_item' THEN {_STRIP} ELSE '' END) AS action_items_md5
FROM documents d""",
    "hashed_vectors": f"""
WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents),
c AS (SELECT doc_id, CAST(concat('0x', substr(md5(word), 1, 7)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM c GROUP BY doc_id)
SELECT doc_id, CAST(bucket AS INT) AS bucket, round(CAST(CAST(n / len AS FLOAT) AS DOUBLE), 4) AS weight FROM c JOIN l USING (doc_id)""",
    "stream_daily": f"""SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, sum(total_tokens)::BIGINT AS tokens, {_COST} AS cost
FROM ({V_USAGE}) GROUP BY day""",
    "stream_usage": f"""
SELECT s.total_tokens, m.cost AS month_cost, CASE WHEN {_ALERT} IS NOT NULL THEN 50.0::DOUBLE END AS monthly_limit, {_ALERT} AS alert
FROM ({_to_date('month')}) m, (SELECT sum(total_tokens)::BIGINT AS total_tokens FROM {_USAGE_WINDOW}) s""",
    "stream_capture": _OUTCOMES,
}



def _cos(a, b):
    return f"round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 12)"


# Lists of entries by nearest centroid: the first vector of each label.
LISTS = f"""
e AS MATERIALIZED ({V_ENTRIES}),
c AS MATERIALIZED (SELECT label AS list_id, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
l AS MATERIALIZED (SELECT e.id, e.embedding, c.list_id FROM e, c
  QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY {_cos('e.embedding', 'c.embedding')} DESC, c.list_id) = 1)
"""

# Crowded lists give way to two each: the row least like the centroid, and the row least like that one.
SPLIT_LISTS = LISTS + f""",
crowded AS (SELECT list_id, row_number() OVER (ORDER BY list_id) AS n FROM (
  SELECT list_id FROM l GROUP BY list_id HAVING count(*) > (SELECT count(*) // 10 FROM e))),
far AS MATERIALIZED (SELECT l.list_id, l.embedding FROM l JOIN crowded USING (list_id) JOIN c USING (list_id)
  QUALIFY row_number() OVER (PARTITION BY l.list_id ORDER BY {_cos('l.embedding', 'c.embedding')}, l.id) = 1),
farther AS MATERIALIZED (SELECT l.list_id, l.embedding FROM l JOIN far f USING (list_id)
  QUALIFY row_number() OVER (PARTITION BY l.list_id ORDER BY {_cos('l.embedding', 'f.embedding')}, l.id) = 1),
child AS MATERIALIZED (SELECT k.list_id AS parent, (SELECT max(list_id) + 1 FROM c) + 2 * (k.n - 1) + s.side AS list_id,
    CASE s.side WHEN 0 THEN f.embedding ELSE g.embedding END AS embedding
  FROM crowded k JOIN far f USING (list_id) JOIN farther g USING (list_id), (SELECT 0 AS side UNION ALL SELECT 1) s),
c2 AS MATERIALIZED (SELECT list_id, embedding FROM c WHERE list_id NOT IN (SELECT list_id FROM crowded)
  UNION ALL SELECT list_id, embedding FROM child),
l2 AS MATERIALIZED (SELECT id, embedding, list_id FROM l WHERE list_id NOT IN (SELECT list_id FROM crowded)
  UNION ALL SELECT l.id, l.embedding, h.list_id FROM l JOIN child h ON h.parent = l.list_id
  QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY {_cos('l.embedding', 'h.embedding')} DESC, h.list_id) = 1)
"""


def _probed(lists, known, probes):
    """Queries with the lists they probe."""
    return f"""
p AS MATERIALIZED (SELECT q.vec_id AS query_id, q.embedding, c.list_id FROM embeddings q, {known} c
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cos('q.embedding', 'c.embedding')} DESC, c.list_id) <= {probes}),
h AS MATERIALIZED (SELECT p.query_id, l.id, list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS sim
  FROM p JOIN {lists} l USING (list_id))"""


def _ann(with_, lists, known):
    return f"""WITH {with_}, {_probed(lists, known, 4)}
SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY round(sim, 12) DESC, h.id) AS rank, h.id, e.entry_type,
  {_list('e.topics')} AS topics, {_list('e.projects')} AS projects, e.source_client, e.relevance_score,
  strftime(e.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, round(sim, 6) AS similarity_score
FROM h JOIN e ON e.id = h.id JOIN e o ON o.id = h.query_id
WHERE h.id <> h.query_id AND e.created_at <= o.created_at + INTERVAL 10 DAY QUALIFY rank <= 3"""


def _hook(own):
    """Chats with memories from the store that holds their own captured message, or leaves it out."""
    mine = "" if own else "AND s.id <> q.entry_id"
    return f"""
SELECT c.conv_id, c.turn, c.role, concat(c.text, CASE WHEN f.role = 'system'
  THEN concat(chr(10), chr(10), '--- Memories ---', chr(10), f.block) ELSE '' END) AS text, {own} AS own
FROM conversations c LEFT JOIN firsts_{own} f ON f.conv_id = c.conv_id AND f.turn = c.turn
UNION ALL SELECT conv_id, turn - 1, 'system', concat('Memories:', chr(10), chr(10), block), {own} FROM firsts_{own} WHERE role <> 'system'
""", f"""
hits_{own} AS (SELECT q.conv_id, s.*, round_even({SIM.replace('e.', 's.')}, 4) AS score,
    row_number() OVER (PARTITION BY q.conv_id ORDER BY round({SIM.replace('e.', 's.')}, 12) DESC, s.id) AS rank
  FROM after s, q WHERE true {mine} QUALIFY rank <= 3),
blocks_{own} AS (SELECT conv_id, string_agg(concat('[', entry_type, ']',
    CASE WHEN len(topics) > 0 THEN concat(' Topics: ', array_to_string(topics, ', ')) ELSE '' END,
    ' (', strftime(created_at, '%Y-%m-%d'), ')', chr(10), raw_text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank) AS block
  FROM hits_{own} WHERE score >= 0.3 GROUP BY conv_id),
firsts_{own} AS (SELECT conv_id, turn, role, block FROM conversations JOIN blocks_{own} USING (conv_id)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)"""


ORACLES |= {
    "chat_hook": f"""
WITH RECURSIVE e AS MATERIALIZED ({V_ENTRIES}),
q AS MATERIALIZED (SELECT conv_id, text, request_id, {_ID} AS entry_id, embedding FROM (
  SELECT u.conv_id, u.text, concat(u.conv_id, '/', u.turn) AS request_id, md5(concat(u.conv_id, '/', u.turn)) AS h,
    list_concat([CAST(CAST(CAST(v.embedding[1] AS DOUBLE) + 0.45 AS FLOAT) AS DOUBLE)], CAST(v.embedding[2:] AS DOUBLE[])) AS embedding
  FROM ({USER_TURNS}) u JOIN embeddings v ON v.vec_id = u.conv_id)),
cand AS (SELECT conv_id AS id, row_number() OVER (ORDER BY request_id) AS pos, embedding FROM q),
held AS (SELECT embedding FROM e), {ADMISSION},
after AS MATERIALIZED (SELECT CAST(id AS VARCHAR) AS id, raw_text, CAST(embedding AS DOUBLE[]) AS embedding, entry_type, topics, created_at FROM e
  UNION ALL SELECT entry_id, text, embedding, 'observation', CAST([] AS VARCHAR[]), TIMESTAMP '2024-03-01 00:00:00'
  FROM q WHERE conv_id IN (SELECT id FROM kept)), {_hook(True)[1]}, {_hook(False)[1]}
{_hook(True)[0]} UNION ALL {_hook(False)[0]}""",
    "ann_search": _ann(LISTS, "l", "c"),
    "ann_search_split": _ann(SPLIT_LISTS, "l2", "c2"),
    "ann_recall": f"""WITH {LISTS}, x AS MATERIALIZED ({_search_many('true', 3).replace('WITH e AS (' + V_ENTRIES + '), q AS', 'WITH q AS')})
""" + " UNION ALL ".join(f"""(WITH {_probed('l', 'c', n)}, b AS (SELECT query_id, id FROM h
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, id) <= 3)
  SELECT {n} AS probes, count(*) AS wanted, count(b.id) AS found, round(count(b.id) / count(*), 6) AS recall
  FROM x LEFT JOIN b ON b.query_id = x.query_id AND b.id = x.id)""" for n in (1, 2, 4, 8)),
    "dup_against_store_cells": ORACLES["dup_against_store"],
    "dedupe_batch_tiled": ORACLES["dedupe_batch"],
    "search_many_parts": ORACLES["search_many"],
    "search_many_filtered_parts": f"""
WITH e AS MATERIALIZED ({V_ENTRIES}), h AS (SELECT q.id AS query_id, e.id, {SIM} AS sim FROM e JOIN e q
  ON e.entry_type = q.entry_type AND e.id <> q.id AND e.created_at <= q.created_at + INTERVAL 10 DAY)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, id) AS rank, id,
  round(sim, 6) AS similarity_score FROM h QUALIFY rank <= 5""",
    "stream_capture_batches": ORACLES["stream_capture"],
    "stream_alerts": f"""SELECT CAST(month AS VARCHAR) AS month, alert, 50.0::DOUBLE AS monthly_limit
FROM (SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, CAST(sum(estimated_cost) AS DOUBLE) AS spent FROM ({V_USAGE}) GROUP BY ALL),
  (VALUES ('warning', 0.8), ('exceeded', 1.0)) l(alert, share) WHERE spent >= share * 50.0""",
    "store_compacted": f"""
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_date, source_client, entry_type, count(*) AS entries,
  round(sum(relevance_score), 6) AS score, 1 AS batches, true AS fewer_files FROM ({V_ENTRIES}) GROUP BY ALL""",
    "rule_metadata_parts": ORACLES["rule_metadata"],
    "search_clamped": _search("true", 50),
    "usage_cost_exact": f"SELECT id, total_tokens, CAST(estimated_cost AS VARCHAR) AS estimated_cost FROM ({V_USAGE})",
}
