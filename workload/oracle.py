"""DuckDB SQL giving the same rows as the registered queries."""

from __future__ import annotations

from eventlane.functions.injection import PATTERNS
from eventlane.functions.signing import normalize_text, pads
from workload.fixtures import PHRASES, SECRETS

ORACLE: dict[str, str] = {}


def _phrase(number: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES[:-1]))
    return f"(CASE {number} % 5 {whens} ELSE '{PHRASES[-1]}' END)"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _hmac(secret: str, body: str) -> str:
    ipad, opad = (p.hex() for p in pads(secret))
    return f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({body}))))"


V = "VARCHAR"

EVENTS = """ev AS (
  SELECT event_id AS seq, user_id, event_type AS kind, value, props, ts,
         CAST(floor(epoch(ts)) AS BIGINT) AS ep FROM events)"""

# Requests, their parsed body (null when not JSON) and headers.
REQUESTS = f"""{EVENTS},
raw AS (
  SELECT seq, user_id, kind, ep,
    CASE seq % 4 WHEN 0 THEN 'github' WHEN 1 THEN ' Linear ' WHEN 2 THEN 'EXAMPLE' ELSE 'unknown' END AS source_raw,
    CASE WHEN seq % 37 <> 0 THEN 'd-' || user_id || '-' || kind END AS h_delivery,
    CASE seq % 4 WHEN 0 THEN (CASE WHEN seq % 3 = 0 THEN 'pull_request' ELSE 'issues' END) WHEN 2 THEN 'Ticket' END AS h_event,
    (ep - CASE WHEN seq % 7 = 0 THEN 300 ELSE 10 END) * 1000 AS sent,
    {_phrase('seq')} AS ph
  FROM ev),
req AS (
  SELECT *, lower(trim(source_raw)) AS source,
    CASE WHEN seq % 13 = 0 THEN '{{bad json' WHEN seq % 4 = 0 THEN
      '{{"action":"' || kind || '","pull_request":{{"number":' || user_id || ',"body":"' || ph
      || '"}},"repository":{{"full_name":"org/repo' || (user_id % 10) || '","id":7}}}}'
    WHEN seq % 4 = 1 THEN
      '{{"type":"Issue","action":"' || kind || '","webhookTimestamp":' || sent || ',"data":{{"id":"issue-' || user_id
      || '","team":{{"key":"ENG"}},"description":"' || ph || '"}}}}'
    WHEN seq % 4 = 2 THEN
      '{{"type":"Ticket","action":"Open","tenant":"t' || (user_id % 5) || '","data":{{"id":"' || user_id || '"}},"note":["' || ph || '"]}}'
    ELSE '[1,2]' END AS body
  FROM raw),
signed AS (
  SELECT *, CASE WHEN json_valid(body) THEN body END AS j,
    CASE WHEN seq % 53 = 0 THEN NULL WHEN seq % 11 = 0 THEN 'sha256=00ff'
      WHEN seq % 4 = 0 THEN 'sha256=' || {_hmac(SECRETS['github'], 'body')}
      WHEN seq % 4 = 1 THEN 'sha256=' || {_hmac(SECRETS['linear'], 'body')}
      WHEN seq % 4 = 2 THEN ' sha256=example-TOKEN ' END AS h_sig,
    CASE seq % 4 WHEN 0 THEN {_hmac(SECRETS['github'], 'body')} WHEN 1 THEN {_hmac(SECRETS['linear'], 'body')}
      WHEN 2 THEN '{normalize_text(SECRETS['example'])}' END AS wanted
  FROM req),
keyed AS (
  SELECT *,
    CASE source
      WHEN 'github' THEN h_event || coalesce('.' || (j->>'$.action'), '')
      WHEN 'linear' THEN lower(j->>'$.type') || coalesce('.' || lower(j->>'$.action'), '')
      WHEN 'example' THEN lower(h_event) || coalesce('.' || lower(j->>'$.action'), '') END AS event_type,
    CASE WHEN source <> 'unknown' THEN source || ':' || h_delivery || ':' || coalesce(j->>'$.action', 'unknown') || ':' || coalesce(
      CASE source WHEN 'github' THEN j->>'$.pull_request.number' ELSE j->>'$.data.id' END, 'unknown') END AS dedup_key,
    CASE source
      WHEN 'github' THEN 'cooldown-github-' || replace(j->>'$.repository.full_name', '/', '-') || '-' || (j->>'$.pull_request.number')
      WHEN 'linear' THEN 'cooldown-linear-' || (j->>'$.data.team.key') || '-' || (j->>'$.data.id')
      WHEN 'example' THEN 'cooldown-example-' || (j->>'$.tenant') || '-' || (j->>'$.data.id') END AS cooldown_key
  FROM signed)"""


def _fold(name: str, rows: str, ttl: int) -> str:
    """CTEs giving ``{name}_ok(seq)``: rows accepted per key, each blocking the next ``ttl`` seconds."""
    return f"""{name}_first AS (SELECT k, t, min(seq) AS seq FROM ({rows}) GROUP BY k, t),
{name}_walk AS (
  SELECT k, min(t) AS t FROM {name}_first GROUP BY k
  UNION ALL
  SELECT w.k, min(f.t) FROM {name}_walk w JOIN {name}_first f ON f.k = w.k AND f.t >= w.t + {ttl} GROUP BY w.k),
{name}_ok AS (SELECT f.seq FROM {name}_first f JOIN {name}_walk w ON f.k = w.k AND f.t = w.t)"""


ORACLE["event_type"] = f"WITH {REQUESTS} SELECT seq, source, event_type FROM keyed"
ORACLE["keys"] = f"WITH {REQUESTS} SELECT seq, dedup_key, cooldown_key FROM keyed"
ORACLE["source_enabled"] = f"""WITH {REQUESTS} SELECT seq, source AS source_name,
  CASE WHEN source IN ('github','linear') THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN source IN ('github','linear') THEN 200 ELSE 404 END AS http_code,
  CASE WHEN source NOT IN ('github','linear') THEN 'not found' END AS reason FROM req"""
ORACLE["payload_size"] = f"""WITH {REQUESTS} SELECT CASE WHEN big THEN 'rejected' ELSE 'accepted' END AS status,
  CASE WHEN big THEN 413 ELSE 200 END AS http_code, CASE WHEN big THEN 'payload too large' END AS reason, count(*) AS requests
  FROM (SELECT octet_length(encode(body)) > 150 AS big FROM req) GROUP BY ALL"""

AUTH_REASON = """CASE WHEN source = 'unknown' THEN NULL
  WHEN h_sig IS NULL THEN CASE source WHEN 'example' THEN 'missing example token' ELSE 'missing ' || source || ' signature' END
  WHEN replace(lower(regexp_replace(trim(h_sig), '^sha256=', '')), ' ', '') <> wanted
    THEN CASE source WHEN 'example' THEN 'invalid example token' ELSE 'invalid ' || source || ' signature' END END"""
ORACLE["signature"] = f"""WITH {REQUESTS} SELECT seq, CASE WHEN reason IS NULL THEN 200 ELSE 401 END AS http_code, reason
  FROM (SELECT seq, {AUTH_REASON} AS reason FROM signed)"""
ORACLE["adapter_token"] = """SELECT event_id, CASE WHEN coalesce(
    CASE WHEN event_id % 3 = 0 THEN 'tok-' || (user_id % 3) END, 'tok-' || (user_id % 2)) = 'tok-1' THEN 200 ELSE 401 END AS http_code
  FROM events"""
ORACLE["json_gates"] = f"""WITH {REQUESTS} SELECT seq,
  CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 400 ELSE 200 END AS http_code,
  CASE WHEN j IS NULL THEN 'invalid json payload' WHEN json_type(j) <> 'OBJECT' THEN 'invalid payload' END AS reason FROM signed"""
ORACLE["timestamp_window"] = f"""WITH {REQUESTS} SELECT seq, CAST(j->>'$.webhookTimestamp' AS BIGINT) // 1000 AS sent_epoch,
  CASE WHEN j IS NULL OR abs(ep - CAST(j->>'$.webhookTimestamp' AS BIGINT) // 1000) > 60 THEN 401 ELSE 200 END AS http_code
  FROM signed WHERE source = 'linear'"""
ORACLE["source_topic"] = f"""WITH {REQUESTS} SELECT seq, CASE source WHEN 'linear' THEN 'events.LINEAR' ELSE 'webhooks.' || source END AS topic FROM req"""
ORACLE["wildcard"] = """SELECT p_partkey, contains(p_type, 'ST') AS middle, starts_with(p_type, 'P') AS prefix,
  suffix(p_type, '_L') AS literal, false AS empty,
  starts_with(p_name, substr(p_name, 1, 3)) AND suffix(substr(p_name, 4), right(p_name, 2)) AS by_column,
  starts_with(p_name, 'a_') AS by_literal FROM part"""
ORACLE["client_ip"] = f"""WITH {EVENTS} SELECT seq, CASE WHEN user_id % 4 < 2 THEN CASE seq % 3
    WHEN 0 THEN '203.0.113.' || (user_id % 200) WHEN 1 THEN '198.51.100.' || (user_id % 200) ELSE '192.0.2.' || (user_id % 200) END
    ELSE '10.0.' || (user_id % 4) || '.' || (user_id % 8) END AS client_ip,
  '10.0.' || (user_id % 4) || '.' || (user_id % 8) AS peer_only FROM ev"""

DEDUP_ROWS = "SELECT dedup_key AS k, ep AS t, seq FROM keyed WHERE dedup_key IS NOT NULL"
ORACLE["dedup_ttl"] = f"""WITH RECURSIVE {REQUESTS}, {_fold('d', DEDUP_ROWS, 604800)}
  SELECT seq, CASE WHEN dedup_key IS NULL OR seq IN (SELECT seq FROM d_ok) THEN 'accept' ELSE 'duplicate' END AS decision FROM keyed"""
ORACLE["stream_dedup"] = ORACLE["dedup_ttl"]
ORACLE["cooldown"] = f"""WITH RECURSIVE {REQUESTS}, {_fold('d', DEDUP_ROWS, 259200)},
  {_fold('c', 'SELECT cooldown_key AS k, ep AS t, seq FROM keyed WHERE cooldown_key IS NOT NULL AND seq IN (SELECT seq FROM d_ok)', 36000)}
  SELECT seq, CASE WHEN dedup_key IS NULL THEN 'accept' WHEN seq NOT IN (SELECT seq FROM d_ok) THEN 'duplicate'
    WHEN cooldown_key IS NULL OR seq IN (SELECT seq FROM c_ok) THEN 'accept' ELSE 'cooldown' END AS decision FROM keyed"""
ORACLE["rate_limit_source"] = f"""WITH {REQUESTS}
  SELECT seq, row_number() OVER (PARTITION BY source, ep // 3600 ORDER BY ep, seq) <= 3 AS within_limit FROM req"""
ORACLE["stream_rate_limit"] = ORACLE["rate_limit_source"]
# Token bucket walked row by row: limit 20, so a token returns every 3000 ms.
ORACLE["rate_limit_ip"] = f"""WITH RECURSIVE {EVENTS},
  o AS (SELECT seq, '10.0.' || (user_id % 4) || '.' || (user_id % 8) AS ip, ep AS t,
          row_number() OVER (PARTITION BY user_id % 4, user_id % 8 ORDER BY ep, seq) AS rn FROM ev),
  w AS (
    SELECT ip, rn, seq, true AS pass, t + 6000 AS tat FROM o WHERE rn = 1
    UNION ALL
    SELECT o.ip, o.rn, o.seq, o.t >= w.tat - 60000,
      CASE WHEN o.t >= w.tat - 60000 THEN greatest(w.tat, o.t) + 3000 ELSE w.tat END
    FROM w JOIN o ON o.ip = w.ip AND o.rn = w.rn + 1)
  SELECT seq, pass AS within_ip_limit FROM w"""

ROUTE = """CASE
  WHEN source = 'github' AND starts_with(event_type, 'pull_request.') THEN 'r-pr'
  WHEN suffix(event_type, '.click') THEN 'r-click'
  WHEN source = 'linear' AND starts_with(event_type, 'issue.') THEN 'r-linear'
  WHEN source = 'example' AND event_type = 'ticket.open' THEN 'r-ticket'
  WHEN source = 'github' AND starts_with(event_type, 'issues.e') AND suffix(event_type, 'r') THEN 'r-late' END"""
TOPIC = "coalesce('webhooks.core.' || substr(route_key, 3), 'webhooks.' || source)"
ORACLE["route_serve"] = f"""WITH {REQUESTS} SELECT seq, route_key, {TOPIC} AS topic FROM (SELECT *, {ROUTE} AS route_key FROM keyed)"""

# The whole serve path, gate by gate.
DECIDED = f"""{REQUESTS},
plugged AS (
  SELECT * REPLACE (CASE event_type WHEN 'issue.error' THEN 'issue.failed' ELSE event_type END AS event_type) FROM keyed),
routed AS (SELECT *, {ROUTE} AS route_key, {AUTH_REASON} AS auth_reason FROM plugged),
limited AS (
  SELECT *, CASE WHEN source <> 'unknown' THEN
    row_number() OVER (PARTITION BY source, ep // 3600 ORDER BY ep, seq) > 3 ELSE false END AS over_limit
  FROM routed),
blocked AS (
  SELECT *, CASE
    WHEN source = 'unknown' THEN '404:not found'
    WHEN over_limit THEN '429:source rate limit exceeded'
    WHEN auth_reason IS NOT NULL THEN '401:' || auth_reason
    WHEN j IS NULL THEN '400:invalid json payload'
    WHEN source = 'linear' AND abs(ep - CAST(j->>'$.webhookTimestamp' AS BIGINT) // 1000) > 60
      THEN '401:linear webhook rejected due to timestamp window check'
    WHEN h_delivery IS NULL THEN '400:missing ' || CASE source WHEN 'github' THEN 'X-GitHub-Delivery'
      WHEN 'linear' THEN 'Linear-Delivery' ELSE 'X-Example-Delivery' END END AS stop FROM limited),
{_fold('d', 'SELECT dedup_key AS k, ep AS t, seq FROM blocked WHERE stop IS NULL', 604800)},
{_fold('c', 'SELECT cooldown_key AS k, ep AS t, seq FROM blocked WHERE stop IS NULL AND cooldown_key IS NOT NULL AND seq IN (SELECT seq FROM d_ok)', 30)},
decided AS (
  SELECT seq, ep, source, event_type, dedup_key, route_key, j, ph, kind, user_id, sent, CASE WHEN stop IS NOT NULL THEN stop
    WHEN seq NOT IN (SELECT seq FROM d_ok) THEN '200:duplicate'
    WHEN cooldown_key IS NOT NULL AND seq NOT IN (SELECT seq FROM c_ok) THEN '200:cooldown'
    WHEN route_key IS NULL THEN '400:no matching serve route' END AS verdict FROM blocked),
outcome AS (
  SELECT *, CASE WHEN verdict IS NULL THEN 'accepted' WHEN verdict LIKE '200:%' THEN 'ignored' ELSE 'rejected' END AS status,
    CAST(coalesce(substr(verdict, 1, 3), '200') AS INTEGER) AS http_code, substr(verdict, 5) AS reason FROM decided)"""
ORACLE["gate_status"] = f"WITH RECURSIVE {DECIDED} SELECT seq, status, http_code, reason FROM outcome"
ORACLE["flagship"] = f"""WITH RECURSIVE {DECIDED} SELECT source, status, http_code, reason, route_key,
  count(*) AS requests, min(ep) AS first_epoch FROM outcome GROUP BY ALL"""

_FIELD = "CASE source WHEN 'github' THEN 'pull_request.body' WHEN 'linear' THEN 'data.description' ELSE 'note.0' END"
_HITS = "CASE seq % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE 0 END"
_OBJECTS = "j IS NOT NULL AND json_type(j) = 'OBJECT'"
_HIT_SUM = " + ".join(f"CAST(regexp_matches(ph, '(?i){_quoted(p)}') AS INTEGER)" for p in PATTERNS)
ORACLE["injection_hits"] = f"""WITH {REQUESTS} SELECT * FROM (SELECT seq, {_FIELD} AS field, {_HIT_SUM} AS count FROM signed
  WHERE {_OBJECTS} AND length(ph) > 10) WHERE count > 0"""
ORACLE["leaves"] = f"""WITH {REQUESTS}
  SELECT seq, {_FIELD} AS path, ph AS leaf_text FROM signed WHERE {_OBJECTS} AND length(ph) > 10
  UNION ALL SELECT seq, 'data.id', j->>'$.data.id' FROM signed WHERE source = 'linear' AND j IS NOT NULL AND length(j->>'$.data.id') > 10
  UNION ALL SELECT seq, 'repository.full_name', j->>'$.repository.full_name' FROM signed
    WHERE source = 'github' AND j IS NOT NULL AND length(j->>'$.repository.full_name') > 10"""
_FLAGS = f"""CASE WHEN {_HITS} > 0 THEN '"_flags":[{{"count":1,"field":"' || {_FIELD} || '"}}],' ELSE '' END"""
_MARKED = f"""'{{' || {_FLAGS} || '"_sanitized":true,' || CASE source
    WHEN 'github' THEN '"action":"' || kind || '","pull_request":{{"body":"' || ph || '","number":' || user_id
      || '}},"repository":{{"full_name":"org/repo' || (user_id % 10) || '","id":7}}}}'
    WHEN 'linear' THEN '"action":"' || kind || '","data":{{"description":"' || ph || '","id":"issue-' || user_id
      || '","team":{{"key":"ENG"}}}},"type":"Issue","webhookTimestamp":' || sent || '}}'
    ELSE '"action":"Open","data":{{"id":"' || user_id || '"}},"note":["' || ph || '"],"tenant":"t' || (user_id % 5)
      || '","type":"Ticket"}}' END"""
ORACLE["sanitized"] = f"""WITH {REQUESTS} SELECT seq, {_MARKED} AS payload_json FROM signed WHERE {_OBJECTS}"""


def _uuid(expr: str) -> str:
    d = f"sha256({expr})"
    return (
        f"substr({d},1,8) || '-' || substr({d},9,4) || '-4' || substr({d},14,3) || '-' || "
        f"translate(substr({d},17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr({d},18,3) || '-' || substr({d},21,12)"
    )


_SEP = "chr(31)"
ORACLE["built_envelopes"] = f"""WITH RECURSIVE {DECIDED},
  ids AS (SELECT *, {_uuid(f"source || {_SEP} || dedup_key || {_SEP} || seq")} AS id, {_uuid(f"'trace' || {_SEP} || source || {_SEP} || seq")} AS trace,
    {TOPIC} AS topic, {_MARKED} AS payload FROM outcome WHERE status = 'accepted')
  SELECT topic, id AS key, event_type, md5('{{"id":"' || id || '","source":"' || source || '","event_type":"' || event_type
    || '","received_at":"' || strftime(make_timestamp(ep * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '","payload":' || payload
    || ',"meta":{{"trace_id":"' || trace || '","ingress_adapter":"http-in","route_key":"' || route_key
    || '","flags":["landed"]}}}}') AS value_md5 FROM ids"""
ORACLE["stream_gates"] = f"""WITH {REQUESTS}, p AS (
  SELECT * REPLACE (CASE event_type WHEN 'issue.error' THEN 'issue.failed' ELSE event_type END AS event_type) FROM keyed),
  r AS (SELECT *, {ROUTE} AS route_key, {AUTH_REASON} AS auth_reason FROM p),
  v AS (SELECT *, CASE WHEN source = 'unknown' THEN NULL WHEN auth_reason IS NOT NULL THEN '401:' || auth_reason
    WHEN j IS NULL THEN '400:invalid json payload'
    WHEN source = 'linear' AND abs(ep - CAST(j->>'$.webhookTimestamp' AS BIGINT) // 1000) > 60
      THEN '401:linear webhook rejected due to timestamp window check'
    WHEN h_delivery IS NULL THEN '400:missing ' || CASE source WHEN 'github' THEN 'X-GitHub-Delivery'
      WHEN 'linear' THEN 'Linear-Delivery' ELSE 'X-Example-Delivery' END END AS stop FROM r)
  SELECT seq, source, event_type, dedup_key, {TOPIC} AS topic, CAST(substr(stop, 1, 3) AS INTEGER) AS http_code, substr(stop, 5) AS reason FROM v"""

# --- texts --------------------------------------------------------------------

TEXTS = f"""whole AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents
  UNION ALL SELECT 'conversations', conv_id * 100 + turn, text FROM conversations
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
texts AS (SELECT origin, id, text || ' ' || {_phrase('id')} AS text FROM whole)"""
_SCANS = " UNION ALL ".join(
    f"SELECT origin, {i} AS pattern_id, count(*) AS texts FROM texts WHERE regexp_matches(text, '(?i){_quoted(p)}') GROUP BY origin"
    for i, p in enumerate(PATTERNS)
)
ORACLE["scan_text"] = f"WITH {TEXTS} {_SCANS}"
# The three redaction rules.
_ASSIGN = r"(?i)\b([A-Z0-9_]*(SECRET|TOKEN|PASSWORD|PRIVATE_KEY|SASL)[A-Z0-9_]*)=([^\s]+)"
_BEARER = r"(?i)(authorization\s*:\s*bearer\s+)([^\s]+)"
_PEM = "-----BEGIN [A-Z ]+PRIVATE KEY-----.*?-----END [A-Z ]+PRIVATE KEY-----"


def _redact(expr: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace({expr}, '{_ASSIGN}', '\1=[REDACTED]', 'g'), "
        rf"'{_BEARER}', '\1[REDACTED]', 'g'), '{_PEM}', '[REDACTED_PRIVATE_KEY]', 'gs')"
    )


LINES = f"""{EVENTS}, lines AS (SELECT kind AS source, ts, seq AS line_no, CASE seq % 4
  WHEN 0 THEN 'HMAC_SECRET_X=abc' || seq || ' rest' WHEN 1 THEN 'Authorization: Bearer tok.' || seq || ' end'
  WHEN 2 THEN '6,' || seq || ',' || (seq * 1000) || ',-;message body ' || seq ELSE props END AS line FROM ev)"""
ORACLE["redact"] = f"WITH {LINES} SELECT line_no, {_redact('line')} AS line FROM lines"
ORACLE["redact_documents"] = f"""WITH {TEXTS}, m AS (SELECT origin, id, {_redact(
    "text || CASE WHEN id % 3 = 0 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'abc' || chr(10) || 'def' || chr(10) || '-----END RSA PRIVATE KEY-----' ELSE '' END"
)} AS masked FROM texts) SELECT origin, id, md5(masked) AS masked_md5, length(masked) AS masked_chars FROM m"""
ORACLE["redact_map"] = """SELECT 'api_Token_' || event_type AS name, '[REDACTED]' AS setting, count(*) AS settings FROM events GROUP BY ALL
  UNION ALL SELECT 'REGION', event_type, count(*) FROM events GROUP BY ALL"""
# Longest whole-character prefix of at most 97 bytes: found among all prefix lengths.
ORACLE["truncated"] = """WITH p AS (
    SELECT doc_id, text, octet_length(encode(text)) AS n,
      list_max(list_filter(range(0, 98), lambda i: octet_length(encode(substr(text, 1, i))) <= 97)) AS keep FROM documents)
  SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END) AS chars_md5,
    length(CASE WHEN n > 100 THEN substr(text, 1, keep) || '...' ELSE text END) AS byte_cut_chars,
    md5(CASE WHEN n > 100 THEN substr(text, 1, keep) || '...' ELSE text END) AS bytes_md5 FROM p"""
ORACLE["backoff_schedule"] = """SELECT l_linenumber,
  max(CAST(least(200 * power(2, l_linenumber - 1), 5000) AS BIGINT)) AS publish_ms,
  max(CAST(least(power(2, l_linenumber - 1), 30) AS BIGINT)) AS delivery_s,
  max(CAST(least(9 * power(2, least((l_linenumber - 1) * 40, 31)), 9000000000) AS BIGINT)) AS capped_exponent,
  count(*) AS lines FROM lineitem GROUP BY l_linenumber"""
ORACLE["kmsg"] = f"""WITH {LINES} SELECT line_no, CASE WHEN line_no % 4 = 2 THEN
  'seq=' || line_no || ' level=6 ktime_us=' || (line_no * 1000) || ' flags=- msg=message body ' || line_no
  ELSE 'raw=' || line END AS parsed FROM lines"""
ORACLE["safe_keys"] = """SELECT c_custkey,
  regexp_replace(c_name || ' / ' || c_mktsegment, '[^A-Za-z0-9._-]+', '_', 'g') AS event_file,
  regexp_replace(c_name || ' / ' || c_mktsegment, '[^A-Za-z0-9_-]', '_', 'g') AS file_name FROM customer"""

# --- topic log -------------------------------------------------------------------

_PAYLOAD_TAIL = """'"}},"n":'"""
LOG = f"""{EVENTS},
parts AS (
  SELECT *, CASE seq % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'linear' ELSE 'example' END AS source,
    CASE WHEN seq % 9 = 0 THEN 'opened' WHEN seq % 9 = 3 THEN 'closed' WHEN seq % 9 = 1 THEN 'remove' ELSE 'created' END AS action,
    CASE WHEN seq % 7 = 0 THEN 'Project' ELSE 'Issue' END AS typ, CASE WHEN seq % 6 = 0 THEN 'robot[bot]' ELSE 'dev' END AS login,
    strftime(make_timestamp(ep * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM ev),
log AS (
  SELECT *, 'webhooks.' || source AS topic, kind || '.' || action AS event_type, seq % 41 NOT IN (0, 1, 2, 3) AS ok,
    '{{"action":"' || action || '","data":{{"labels":["a",null],"userId":"u' || (user_id % 10) || '"}},"n":' || user_id
      || ',"sender":{{"login":"' || login || '"}},"type":"' || typ || '"}}' AS payload,
    CASE WHEN seq % 2 = 0 THEN 't-' || user_id END AS trace FROM parts)"""
_WIRE = """'{"id":"e-' || seq || '","source":"' || source || '","event_type":"' || event_type || '","received_at":"' || stamp
  || '","payload":' || payload || CASE WHEN seq % 2 = 0 THEN ',"meta":{"trace_id":"' || trace || '","flags":["f0"]}' ELSE '' END || '}'"""
_SORTED = """'{"event_type":"' || event_type || '","id":"e-' || seq || '"' || CASE WHEN seq % 2 = 0
  THEN ',"meta":{"flags":["f0"],"trace_id":"' || trace || '"}' ELSE '' END || ',"payload":' || payload
  || ',"received_at":"' || stamp || '","source":"' || source || '"}'"""
_DECODE_ERROR = """CASE seq % 41 WHEN 0 THEN 'missing payload' WHEN 1 THEN 'invalid json' WHEN 2 THEN 'invalid envelope' WHEN 3 THEN 'invalid json' END"""
ORACLE["required_field"] = f"""WITH {LOG} SELECT seq, true AS second_label, false AS third_label, true AS login, false AS missing FROM log WHERE ok"""
ORACLE["loop_guard"] = f"""WITH {LOG} SELECT seq, source FROM log WHERE ok AND CASE source
  WHEN 'github' THEN login = 'dev' AND action IN ('opened', 'created')
  WHEN 'linear' THEN typ = 'Issue' AND action <> 'remove' AND user_id % 10 <> 3 ELSE true END"""
ORACLE["decode_envelope"] = f"""WITH {LOG} SELECT seq, {_DECODE_ERROR} AS decode_error,
  CASE WHEN ok THEN 'e-' || seq END AS id, CASE WHEN ok THEN source END AS source, CASE WHEN ok THEN event_type END AS event_type,
  CASE WHEN ok THEN stamp END AS received_at, CASE WHEN ok THEN trace END AS trace_id,
  CASE WHEN ok AND seq % 2 = 0 THEN 'f0' END AS flags FROM log"""
ORACLE["encode_envelope"] = f"WITH {LOG} SELECT seq, {_WIRE} AS value FROM log WHERE ok"
ORACLE["kafka_ingress"] = f"""WITH {LOG} SELECT seq, CASE WHEN ok THEN source WHEN seq % 41 = 2 THEN 'x' END AS source,
  CASE WHEN ok THEN event_type WHEN seq % 41 = 2 THEN 'y' END AS event_type,
  CASE seq % 41 WHEN 0 THEN 'missing payload' WHEN 1 THEN 'invalid json' WHEN 3 THEN 'invalid json' END AS parse_error,
  CASE WHEN ok THEN payload WHEN seq % 41 = 2 THEN 'null' END AS payload_json FROM log"""
ORACLE["ws_frames"] = f"""WITH {LOG} SELECT seq, CASE WHEN ok THEN event_type WHEN seq % 41 = 2 THEN 'y' END AS event_type,
  CASE WHEN seq % 41 IN (0, 1, 3) THEN 'parse websocket frame JSON' END AS parse_error,
  CASE WHEN ok THEN md5(payload) WHEN seq % 41 = 2 THEN
    md5('{{"event_type":"y","id":' || seq || ',"payload":null,"received_at":"z","source":"x"}}') END AS payload_md5 FROM log"""
ORACLE["prevalidated"] = f"""WITH {LOG}, c AS (SELECT seq, CASE WHEN ok THEN source ELSE 'x' END AS source, ok,
    CASE WHEN NOT ok AND seq % 5 <> 0 THEN 'y' WHEN seq % 5 <> 0 THEN event_type
      WHEN source = 'linear' THEN lower(typ) || '.' || action END AS event_type FROM log WHERE ok OR seq % 41 = 2),
  v AS (SELECT *, CASE WHEN source NOT IN ('github', 'linear') THEN 'source ''' || source || ''' is not enabled'
      WHEN event_type IS NULL THEN 'derive event_type failed' END AS reason, {ROUTE} AS route_key FROM c)
  SELECT seq, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason,
    CASE WHEN reason IS NULL THEN {TOPIC} END AS topic, CASE WHEN reason IS NULL THEN event_type END AS event_type,
    CASE WHEN reason IS NULL THEN 'kafka-in' END AS ingress_adapter FROM v"""
ORACLE["mcp_calls"] = f"""WITH {LOG}, c AS (SELECT seq, CASE WHEN ok THEN source ELSE 'x' END AS source,
    octet_length(encode(CASE WHEN ok THEN payload ELSE 'null' END)) > 110 AS big FROM log WHERE ok OR seq % 41 = 2)
  SELECT seq, source, CASE WHEN big THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN big THEN 413 ELSE 200 END AS http_code, NULL AS parse_error FROM c
  UNION ALL SELECT seq, NULL, NULL, NULL, CASE seq % 41 WHEN 0 THEN 'missing payload' ELSE 'invalid json' END FROM log WHERE NOT ok AND seq % 41 <> 2"""
ORACLE["decode_dlq"] = f"""WITH {LOG}
  SELECT seq, strftime(make_timestamp((ep + 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS failed_at, 'forward failed: ' || (seq % 3) AS error,
    'e-' || seq AS id, NULL AS decode_error FROM log WHERE ok
  UNION ALL SELECT seq, NULL, NULL, NULL, coalesce({_DECODE_ERROR.replace('invalid envelope', 'invalid dead letter')}, 'invalid dead letter') FROM log"""
# Steps number the destinations over the whole route list.
STEPS = """steps AS (
  SELECT r.*, log.* FROM log JOIN (VALUES (0, 's-all', 'agent', true), (1, 's-all', 'bus', true), (2, 's-all', 'audit', false),
      (3, 's-github', 'agent', true), (4, 's-example', 'tool', false)) r(step, route_id, adapter_id, required)
    ON CASE route_id WHEN 's-all' THEN kind = 'click' OR action = 'opened'
      WHEN 's-github' THEN source = 'github' ELSE source = 'example' AND contains(event_type, 'up.') END
  WHERE ok)"""
ORACLE["route_smash"] = f"WITH {LOG}, {STEPS} SELECT seq, step, route_id, adapter_id, required FROM steps"
ORACLE["destination_plugins"] = f"""WITH {LOG}, {STEPS} SELECT seq, step,
  CASE WHEN adapter_id = 'agent' AND event_type = 'click.opened' THEN 'click.fresh' ELSE event_type END AS event_type,
  CASE WHEN adapter_id = 'agent' THEN 'f0,agent' WHEN seq % 2 = 0 THEN 'f0' END AS flags,
  CASE adapter_id WHEN 'audit' THEN 'smash adapter ''audit'' plugin require_payload_field missing ''/absent'''
    WHEN 'tool' THEN 'no adapter configured for ''tool''' END AS plugin_error FROM steps"""
ORACLE["no_output"] = f"""WITH {LOG}, {STEPS} SELECT seq,
  CASE WHEN source = 'linear' AND kind = 'view' THEN 'no active smash destinations' ELSE 'no matching smash route' END
    || ' for topic ''' || topic || ''' and event ''' || event_type || '''' AS reason, 'dlq' AS outcome
  FROM log WHERE ok AND seq NOT IN (SELECT seq FROM steps)"""
ORACLE["kafka_keys"] = f"WITH {LOG} SELECT seq, 'e-' || seq AS event_id, source, CAST(NULL AS {V}) AS none FROM log WHERE ok"
ORACLE["shape_http"] = f"""WITH {LOG}, p AS (SELECT *, CASE WHEN octet_length(encode(payload)) > 128 THEN substr(payload, 1, 125) || '...' ELSE payload END AS cut FROM log WHERE ok)
  SELECT seq, '{{"source":"' || source || '","eventType":"' || event_type || '","id":"e-' || seq || '","receivedAt":"' || stamp
    || '","payload":"' || replace(cut, '"', '\\"') || '"}}' AS body FROM p"""
ORACLE["shape_tool"] = f"""WITH {LOG}, s AS (SELECT seq, {_SORTED} AS envelope FROM log WHERE ok)
  SELECT seq, '{{"arguments":{{"envelope":' || envelope || '}},"tool":"ingest"}}' AS plain,
    '{{"id":"1","jsonrpc":"2.0","method":"tools/call","params":{{"arguments":{{"envelope":' || envelope
    || '}},"name":"ingest"}}}}' AS jsonrpc FROM s"""
ORACLE["dlq_summary"] = f"""WITH {LOG} SELECT source, event_type, 'forward failed: ' || (seq % 3) AS error, count(*) AS dead_letters,
  max(strftime(make_timestamp((ep + 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ')) AS last_failed_at FROM log WHERE ok GROUP BY ALL"""
ORACLE["replay_dlq"] = f"""WITH {LOG} SELECT 'webhooks.core' AS topic, 'e-' || seq AS key, md5({_WIRE}) AS value_md5
  FROM log WHERE ok AND seq % 3 = 1"""
ORACLE["replay_topic"] = f"""WITH {LOG} SELECT 'webhooks.retry' AS topic, 'e-' || seq AS key FROM log
  WHERE source = 'github' AND ep BETWEEN epoch(TIMESTAMP '2024-01-10') AND epoch(TIMESTAMP '2024-01-20')"""
ORACLE["relay_fan_in"] = f"""WITH {LOG} SELECT 'e-' || seq AS key, CASE WHEN ok THEN 'webhooks.core' ELSE topic END AS topic,
  {_DECODE_ERROR} AS problem FROM log"""
ORACLE["trace_event"] = f"""WITH {LOG}, r AS (SELECT 'e-' || seq AS id, seq, ep AS epoch, event_type AS detail FROM log WHERE ok AND trace = 't-7')
  SELECT 0 AS stage_order, 'source' AS stage, id, epoch, detail FROM r
  UNION ALL SELECT 1, 'core', id, epoch, detail FROM r WHERE seq % 3 <> 0
  UNION ALL SELECT 2, 'delivery', id, epoch, 'sent' FROM r WHERE seq % 4 <> 0"""

# --- delivery ----------------------------------------------------------------------

# One row per order and line; the given table repeats some line numbers.
_ITEMS = """items AS (SELECT l_orderkey, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS l_linenumber FROM lineitem)"""
D_STEPS = f"""{_ITEMS}, dsteps AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber AS INTEGER) AS step, 'r' || (l_partkey % 5) AS route_id,
  'a' || (l_suppkey % 7) AS adapter_id, l_linenumber % 3 <> 0 AS required, l_partkey % 11 = 0 AS failed,
  CASE WHEN l_partkey % 11 = 0 THEN 'destination returned ' || CASE WHEN l_partkey % 2 = 0 THEN '503' ELSE '404' END END AS error FROM items),
broken AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step) AS rn FROM dsteps WHERE required AND failed),
settled AS (SELECT d.id, CASE WHEN b.id IS NULL THEN 'commit' ELSE 'dlq' END AS outcome, b.step AS failed_step,
  'required destination adapter ''' || b.adapter_id || ''' failed on route ''' || b.route_id || ''': ' || b.error AS reason,
  d.planned_steps, d.optional_failures
  FROM (SELECT id, count(*) AS planned_steps, count(*) FILTER (NOT required AND failed) AS optional_failures FROM dsteps GROUP BY id) d
  LEFT JOIN broken b ON b.id = d.id AND b.rn = 1)"""
ORACLE["settle"] = f"WITH {D_STEPS} SELECT * FROM settled"
ORACLE["executed_steps"] = f"""WITH {D_STEPS} SELECT d.id, d.step, d.failed FROM dsteps d JOIN settled s ON s.id = d.id
  WHERE s.failed_step IS NULL OR d.step <= s.failed_step"""
TRIES = """tries AS (SELECT l_orderkey AS id, l_linenumber AS attempt, 'a' || (l_orderkey % 7) AS adapter_id,
  CASE l_partkey % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN NULL ELSE 200 END AS http_status,
  CASE WHEN l_partkey % 6 = 3 THEN CASE WHEN l_partkey % 4 = 1 THEN 'timeout' ELSE 'request: ValueError' END END AS error FROM items)"""
ORACLE["attempt_outcome"] = f"""WITH {_ITEMS}, {TRIES}, last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt DESC) AS rn FROM tries),
  c AS (SELECT id, CAST(attempt AS INTEGER) AS attempts, http_status, coalesce('destination returned ' || http_status, error) AS detail,
    CASE WHEN http_status = 200 THEN 'success'
      WHEN coalesce(http_status IN (503, 429), error = 'timeout') THEN CASE WHEN attempt >= 5 THEN 'exhausted' ELSE 'pending' END
      ELSE 'permanent' END AS outcome FROM last WHERE rn = 1)
  SELECT id, attempts, http_status, outcome, CASE outcome WHEN 'exhausted' THEN 'forward failed after ' || attempts || ' attempts: ' || detail
    WHEN 'permanent' THEN 'forward failed permanently: ' || detail END AS error FROM c"""
ORACLE["reconcile"] = f"""WITH {D_STEPS}, core AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey % 10 <> 0)
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'core' AS missing FROM orders WHERE o_custkey % 10 = 0
  UNION ALL SELECT id, 'delivery' FROM core WHERE id NOT IN (SELECT id FROM settled WHERE failed_step IS NULL OR failed_step <> 2)"""

# --- reports ---------------------------------------------------------------------------

ORACLE["metrics"] = f"""WITH RECURSIVE {DECIDED}, {D_STEPS}, {TRIES},
  rows AS (
    SELECT 'serve_ingress_events_total' AS metric, 'http-in' AS adapter, source, NULL AS topic, NULL AS reason FROM outcome WHERE status = 'accepted'
    UNION ALL SELECT 'serve_publish_success_total', NULL, NULL, {TOPIC}, NULL FROM outcome WHERE status = 'accepted'
    UNION ALL SELECT 'serve_publish_failure_total', NULL, NULL, {TOPIC}, reason FROM outcome WHERE reason = 'no matching serve route'
    UNION ALL SELECT 'smash_consume_events_total', NULL, NULL, 'webhooks.' || CASE seq % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'linear' ELSE 'example' END, NULL FROM ev
    UNION ALL SELECT 'smash_egress_success_total', adapter_id, NULL, NULL, NULL FROM tries WHERE http_status = 200
    UNION ALL SELECT 'smash_egress_failure_total', adapter_id, NULL, NULL, coalesce(error, CAST(http_status AS VARCHAR)) FROM tries WHERE coalesce(http_status, 0) <> 200
    UNION ALL SELECT 'smash_commit_total', NULL, NULL, 'webhooks.core', NULL FROM settled WHERE outcome = 'commit'
    UNION ALL SELECT 'smash_dlq_total', NULL, NULL, 'webhooks.dlq', NULL FROM settled WHERE outcome = 'dlq')
  SELECT metric, adapter, source, topic, reason, count(*) AS value FROM rows GROUP BY ALL"""
ORACLE["latency_histogram"] = """SELECT l_returnflag AS adapter, CASE """ + " ".join(
    f"WHEN l_partkey * 7 <= {b} THEN {float(b)}" for b in (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 20000)
) + """ END::DOUBLE AS le, count(*) AS events, count(*) FILTER (l_suppkey % 9 = 0) AS errors FROM lineitem GROUP BY ALL"""
ORACLE["consumer_lag"] = f"""WITH {LOG}, p AS (SELECT topic, CAST(user_id % 3 AS INTEGER) AS partition, max(seq) + 1 AS end_offset,
    max(seq) FILTER (ep < epoch(TIMESTAMP '2024-01-25')) + 1 AS committed FROM log GROUP BY ALL)
  SELECT 'relay' AS "group", topic, partition, end_offset, committed, end_offset - committed AS lag FROM p WHERE committed IS NOT NULL"""
ORACLE["tail_logs"] = f"""WITH {LINES} SELECT source, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, line_no DESC) AS rn FROM lines) WHERE rn <= 100"""
ORACLE["top_events"] = f"""WITH {EVENTS} SELECT seq AS "offset", 'e-' || seq AS key FROM ev WHERE seq % 3 = 0 ORDER BY seq DESC LIMIT 5"""
ORACLE["log_manifest"] = """SELECT event_type AS name, CASE WHEN event_type <> 'error' THEN 'journal/' || event_type || '.log' END AS file,
  event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'journalctl not available' END AS error, count(*) AS lines FROM events GROUP BY event_type"""

# --- health --------------------------------------------------------------------------------

BEATS = f"""{EVENTS}, beats AS (SELECT seq, user_id, ep, 'h' || (user_id % 20) AS host,
  strftime(make_timestamp(ep * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS "timestamp" FROM ev),
br AS (SELECT b.*, n, CASE WHEN (seq + n) % 17 = 0 THEN 'D' WHEN (seq + n) % 19 = 0 THEN 'Zl' ELSE 'Sl' END AS state,
  (seq + n) % 13 = 0 AS closed, (seq + n) % 34 <> 0 AS alive FROM beats b, (VALUES (1), (2)) t(n)),
found AS (
  SELECT host, "timestamp", ep, seq, n * 10 AS pos, 'critical' AS severity, 'firecracker_' || n || '_stuck' AS event,
    'firecracker ' || n || ' process state=' || state || '; restarting firecracker@' || n || '.service' AS message FROM br WHERE alive AND state <> 'Sl'
  UNION ALL SELECT host, "timestamp", ep, seq, n * 10 + 1, 'critical', 'kafka_port_down_' || n,
    'broker ' || n || ' at 172.30.0.1' || n || ':9092 is down' FROM br WHERE closed
  UNION ALL SELECT host, "timestamp", ep, seq, 30, 'critical', 'firecracker_relay_stuck',
    'firecracker relay process state=Z; restarting firecracker@relay.service' FROM beats WHERE seq % 31 = 0
  UNION ALL SELECT host, "timestamp", ep, seq, 31, 'critical', 'relay_port_down', 'relay port 172.30.0.20:8080 is down' FROM beats WHERE seq % 29 = 0
  UNION ALL SELECT host, "timestamp", ep, seq, 32, 'warning', 'relay_health_failed', 'relay health check failed at http://relay/health' FROM beats WHERE seq % 27 = 0
  UNION ALL SELECT host, "timestamp", ep, seq, 33, 'warning', 'required_service_down_firecracker-network.service',
    'required service firecracker-network.service is failed' FROM beats WHERE seq % 23 = 0),
alerts AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS INTEGER) AS rule FROM found)"""
ORACLE["health_rules"] = f"""WITH {BEATS} SELECT host, "timestamp", rule, severity, event, message FROM alerts"""
ORACLE["recovered"] = f"""WITH {BEATS} SELECT host, "timestamp", count(*) AS recovered, 'watchdog recovered ' || count(*) || ' services' AS message
  FROM alerts GROUP BY host, "timestamp" """
ORACLE["alert_throttle"] = f"""WITH RECURSIVE {BEATS}, one AS (SELECT event, ep AS epoch, count(*) AS alerts, min(seq) AS seq FROM alerts GROUP BY ALL),
  {_fold('a', 'SELECT event AS k, epoch AS t, seq FROM one', 21600)},
  sent AS (SELECT f.k, f.t FROM a_first f JOIN a_walk w ON f.k = w.k AND f.t = w.t)
  SELECT event, epoch, alerts, (event, epoch) IN (SELECT (k, t) FROM sent) AS sent FROM one"""
ORACLE["heartbeat_gaps"] = f"""WITH {BEATS}, g AS (SELECT host, ep AS epoch, ep - lag(ep) OVER (PARTITION BY host ORDER BY ep) AS gap_seconds FROM beats)
  SELECT *, (gap_seconds // 3600) || 'h ' || ((gap_seconds % 3600) // 60) || 'm' AS gap_text FROM g WHERE gap_seconds IS NOT NULL"""
ORACLE["latest_status"] = f"""WITH {BEATS}, l AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ep DESC, seq DESC) AS rn FROM beats)
  SELECT host, "timestamp" AS last_heartbeat, ep % 100000 AS uptime_seconds, (user_id * 1000) // 1024 AS available_mb, 4096::BIGINT AS total_mb,
    '0.1 0.2 0.3' AS load, 'ok:' || CASE WHEN seq % 29 = 0 THEN 'closed' ELSE 'open' END || ':active' AS relay,
    '1=ok:' || CASE WHEN (seq + 1) % 13 = 0 THEN 'closed' ELSE 'open' END || ':active, 2=ok:' ||
    CASE WHEN (seq + 2) % 13 = 0 THEN 'closed' ELSE 'open' END || ':active' AS brokers, 'ok' AS external FROM l WHERE rn = 1"""
ORACLE["probe_mismatch"] = """SELECT event_id, CASE WHEN event_type = 'view' THEN '404' ELSE '401' END AS expected,
  CASE WHEN user_id % 7 = 0 THEN '000' WHEN user_id % 2 = 0 THEN '404' ELSE '401' END AS observed FROM events
  WHERE CASE WHEN event_type = 'view' THEN '404' ELSE '401' END <> CASE WHEN user_id % 7 = 0 THEN '000' WHEN user_id % 2 = 0 THEN '404' ELSE '401' END"""

# --- sources and sinks -----------------------------------------------------------------------

ORACLE["stream_cooldown"] = ORACLE["cooldown"]
ORACLE["stream_decisions"] = ORACLE["gate_status"]
ORACLE["stream_rate_limit_ip"] = ORACLE["rate_limit_ip"]
ORACLE["requests_round_trip"] = ORACLE["rate_limit_source"]
ORACLE["topic_round_trip"] = ORACLE["decode_envelope"]
ORACLE["output_topic"] = f"WITH {LOG} SELECT 'webhooks.out' AS topic, 'e-' || seq AS key, md5({_WIRE}) AS value_md5 FROM log WHERE ok"
ORACLE["dlq_round_trip"] = ORACLE["dlq_summary"]
ORACLE["quarantined"] = f"WITH {LOG} SELECT seq, {_DECODE_ERROR} AS decode_error FROM log WHERE NOT ok"
ORACLE["heartbeats_round_trip"] = ORACLE["recovered"]
ORACLE["logs_round_trip"] = """SELECT event_type AS name, 'journal/' || event_type || '.log' AS file, true AS success,
  least(count(*), 300) AS lines, count(*) AS read, count(*) FILTER (event_id % 9 <> 0) AS dated FROM events GROUP BY event_type"""
ORACLE["fanout_accounting"] = f"""WITH {LOG}, {STEPS},
  sent AS (SELECT seq, step, route_id, adapter_id, required, CASE (seq + 3 * step) % 8
      WHEN 0 THEN 'forward failed permanently: destination returned 404'
      WHEN 1 THEN 'forward failed after ' || (1 + (seq + step) % 3) || ' attempts: destination returned 503'
      WHEN 2 THEN 'forward failed after ' || (1 + (seq + step) % 3) || ' attempts: timeout' END AS error FROM steps),
  broken AS (SELECT * FROM sent WHERE required AND error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY step) = 1),
  judged AS (SELECT log.seq, topic, ok, event_type, kind, source, b.seq IS NOT NULL AS failed, b.adapter_id, b.route_id, b.error,
      log.seq IN (SELECT seq FROM steps) AS reached FROM log LEFT JOIN broken b ON b.seq = log.seq)
  SELECT seq AS record, CASE WHEN ok THEN 'e-' || seq END AS id, topic,
    CASE WHEN NOT ok THEN 'undecodable' WHEN NOT reached THEN 'error' WHEN failed THEN 'dlq' ELSE 'commit' END AS outcome,
    CASE WHEN NOT ok THEN {_DECODE_ERROR}
      WHEN NOT reached THEN CASE WHEN source = 'linear' AND kind = 'view' THEN 'no active smash destinations' ELSE 'no matching smash route' END
        || ' for topic ''' || topic || ''' and event ''' || event_type || ''''
      WHEN failed THEN 'required destination adapter ''' || adapter_id || ''' failed on route ''' || route_id || ''': ' || error END AS reason
  FROM judged"""
ORACLE["batch_sink"] = f"""WITH {LOG} SELECT seq % 3 AS batch_id, 'webhooks.dlq' AS topic, 'e-' || seq AS key, 'kept' AS error FROM log WHERE ok"""
