"""The named queries in SQL over the base tables, for side-by-side checks."""

from __future__ import annotations

FEED = """
raw AS (
  SELECT 'peer-' || (user_id % 3) AS peer_id, event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, props,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 71 = 0 THEN 'PATCH' WHEN event_type = 'error' THEN 'del'
         WHEN event_type = 'click' THEN 'put' ELSE 'PUT' END AS op_raw,
    CASE WHEN event_id % 89 <> 0 THEN 'user.' || user_id END AS key,
    CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_id % 83 = 0 THEN sha256('x' || props) ELSE sha256(props) END AS hash_raw,
    CASE WHEN event_id % 73 <> 0 THEN props END AS data_raw
  FROM events),
typed AS (
  SELECT *, CASE WHEN upper(op_raw) = 'PUT' THEN 'PUT' WHEN upper(op_raw) IN ('DEL', 'DELETE') THEN 'DELETE' END AS op FROM raw),
parsed AS (
  SELECT peer_id, event_id, ms, event_id AS seq, ms || '-' || event_id AS stream_id, op, key, user_id,
    CASE WHEN op = 'PUT' THEN hash_raw END AS hash, CASE WHEN op = 'PUT' THEN data_raw END AS data,
    op = 'PUT' AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS has_meta,
    CASE WHEN op_raw IS NULL THEN 'missing_op' WHEN op IS NULL THEN 'unknown_op' WHEN key IS NULL THEN 'missing_key'
         WHEN op = 'PUT' AND data_raw IS NULL THEN 'missing_data'
         WHEN op = 'PUT' AND hash_raw <> sha256(data_raw) THEN 'hash_mismatch' END AS reject_reason
  FROM typed),
good AS (SELECT * FROM parsed WHERE reject_reason IS NULL),
applicable AS (SELECT *, CASE WHEN has_meta THEN event_id END AS version FROM good
               WHERE op = 'DELETE' OR (data IS NOT NULL AND hash IS NOT NULL)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS nth FROM applicable),
pending AS (SELECT key, op, hash, data, version, ms, seq FROM ranked WHERE nth = 1),
held AS (SELECT key AS object_id, data AS content, hash AS content_hash, version FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS old FROM applicable WHERE event_id % 10 <> 3)
  WHERE old = 1 AND op = 'PUT'),
surviving AS (SELECT * FROM pending p WHERE NOT (p.op = 'PUT' AND EXISTS (
    SELECT 1 FROM held h WHERE h.object_id = p.key AND h.content_hash = p.hash))),
lim AS (SELECT peer_id, arg_min(stream_id, (ms, seq)) AS oldest_id, arg_max(stream_id, (ms, seq)) AS newest_id,
    arg_min(ms, (ms, seq)) AS oldest_ms, arg_max(ms, (ms, seq)) AS newest_ms, count(*) AS length FROM parsed GROUP BY peer_id),
peers AS (SELECT DISTINCT peer_id FROM raw UNION SELECT 'peer-3'),
stated AS (SELECT peer_id, CASE WHEN peer_id = 'peer-2' THEN 'Backoff' ELSE 'Connected' END AS state FROM peers),
cursors AS (SELECT 'peer-0' AS peer_id, arg_max(stream_id, (ms, seq)) AS stream_id, arg_max(ms, (ms, seq)) AS cursor_ms
    FROM parsed WHERE peer_id = 'peer-0' AND seq % 2 = 0 AND seq < 500 HAVING count(*) > 0
  UNION ALL SELECT 'peer-1', '1000-5', 1000),
resumed AS (SELECT peer_id, coalesce(stream_id, '0') AS stream_id, cursor_ms FROM peers LEFT JOIN cursors USING (peer_id)),
outcomes AS (SELECT 'peer-' || (user_id % 3) AS peer_id, event_id AS pos, event_type <> 'error' AS ok, event_type AS kind, value FROM events),
last_ok AS (SELECT peer_id, max(pos) FILTER (WHERE ok) AS last_ok, max(pos) AS last_at FROM outcomes GROUP BY peer_id),
runs AS (SELECT peer_id, last_ok, last_at,
    count(*) FILTER (WHERE NOT ok AND (last_ok IS NULL OR pos > last_ok)) AS failures
  FROM outcomes JOIN last_ok USING (peer_id) GROUP BY ALL),
checked AS (SELECT r.peer_id, r.stream_id, l.oldest_id, l.newest_id, coalesce(l.length, 0) AS length,
    r.stream_id <> '0' AND l.oldest_id IS NOT NULL AND r.cursor_ms < l.oldest_ms AS gap,
    CASE WHEN r.stream_id <> '0' AND l.newest_id IS NOT NULL THEN greatest(l.newest_ms - r.cursor_ms, 0) END AS lag_ms
  FROM resumed r LEFT JOIN lim l USING (peer_id)),
health AS (SELECT s.peer_id, s.state,
    CASE WHEN coalesce(r.failures, 0) >= 1 THEN 'Open' ELSE 'Closed' END AS circuit, coalesce(r.failures, 0) AS failures, c.lag_ms,
    coalesce(r.failures, 0) >= 1 OR s.state <> 'Connected' AS unhealthy
  FROM stated s LEFT JOIN runs r USING (peer_id) LEFT JOIN checked c USING (peer_id))
"""


def _node(name: str, below: str) -> str:
    return f"""
{name} AS (SELECT parent AS path, sha256(unhex(string_agg(hex(encode(segment)) || hash, '' ORDER BY segment))) AS hash,
    CASE WHEN contains(parent, '.') THEN regexp_replace(parent, '[.][^.]*$', '') ELSE '' END AS parent_,
    regexp_extract(parent, '[^.]*$') AS segment_ FROM {below} GROUP BY parent)"""


def _levels(side: str, text: str, where: str) -> str:
    """Levels 4 (leaves) to 0 of one side's tree."""
    out = f"""
{side}4 AS (SELECT lang || '.' || source || '.k' || (doc_id // 1000) || '.' || doc_id AS path, sha256({text}) AS hash,
    lang || '.' || source || '.k' || (doc_id // 1000) AS parent, doc_id::VARCHAR AS segment FROM documents WHERE {where})"""
    for level in (3, 2, 1, 0):
        out += "," + _node(f"{side}{level}_", f"{side}{level + 1}")
        out += f",\n{side}{level} AS (SELECT path, hash, parent_ AS parent, segment_ AS segment FROM {side}{level}_)"
    return out


_TEXT = "coalesce(text, '')"
ALL = _levels("m", _TEXT, "true")
LOCAL = _levels("l", _TEXT, "doc_id % 41 <> 0")
REMOTE = _levels("r", f"CASE WHEN doc_id % 37 = 0 THEN 'changed ' || {_TEXT} ELSE {_TEXT} END", "doc_id % 31 <> 0")
DIFFS = """
diffs AS (SELECT coalesce(l.path, r.path) AS key, CASE WHEN r.path IS NULL THEN 'delete' ELSE 'fetch' END AS action
  FROM l4 l FULL JOIN r4 r ON l.path = r.path WHERE l.hash IS DISTINCT FROM r.hash),
plan AS (SELECT key, action FROM diffs ORDER BY CASE action WHEN 'fetch' THEN 0 ELSE 1 END, key LIMIT 60),
by_peer AS (SELECT 'peer-' || (regexp_extract(key, '[0-9]+$')::BIGINT % 3) AS peer_id, key, action FROM diffs),
per AS (SELECT peer_id, count(*) FILTER (WHERE action = 'fetch') AS f FROM by_peer GROUP BY peer_id),
room AS (SELECT peer_id, f, greatest(40 - coalesce(sum(f) OVER (ORDER BY peer_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM per),
ranked AS (SELECT *, row_number() OVER (PARTITION BY peer_id, action ORDER BY key) AS nth FROM by_peer JOIN room USING (peer_id)),
peer_plan AS (SELECT peer_id, key, action FROM ranked WHERE nth <= CASE action WHEN 'fetch' THEN least(f, room) ELSE greatest(room - f, 0) END)
"""


def feed(query: str) -> str:
    return f"WITH {FEED} {query}"


def tree(query: str) -> str:
    return f"WITH {ALL} {query}"


def two_trees(query: str) -> str:
    return f"WITH {LOCAL}, {REMOTE}, {DIFFS} {query}"


CLOSINGS = f"""WITH RECURSIVE {FEED},
line AS (SELECT peer_id, ms // 40000 AS ms, seq, CASE WHEN op = 'DELETE' OR hash IS NOT NULL THEN key END AS key,
    row_number() OVER (PARTITION BY peer_id ORDER BY ms // 40000, seq) AS n FROM good),
walk AS (
  SELECT peer_id, n, ms AS began, n AS head, CASE WHEN key IS NULL THEN [] ELSE [key] END AS keys FROM line WHERE n = 1
  UNION ALL
  SELECT l.peer_id, l.n, CASE WHEN w.fresh THEN l.ms ELSE w.began END, CASE WHEN w.fresh THEN l.n ELSE w.head END,
    CASE WHEN l.key IS NULL THEN w.kept WHEN list_contains(w.kept, l.key) THEN w.kept ELSE list_append(w.kept, l.key) END
  FROM (SELECT x.*, y.ms AS next_ms, len(x.keys) >= 4 OR y.ms - x.began >= 50 AS fresh,
      CASE WHEN len(x.keys) >= 4 OR y.ms - x.began >= 50 THEN [] ELSE x.keys END AS kept
    FROM walk x JOIN line y ON y.peer_id = x.peer_id AND y.n = x.n + 1) w JOIN line l ON l.peer_id = w.peer_id AND l.n = w.n + 1)
SELECT w.peer_id, min(l.ms) AS first_ms, arg_min(l.seq, l.n) AS first_seq, max(l.ms) AS last_ms, arg_max(l.seq, l.n) AS last_seq,
  count(*) AS events, max(len(w.keys)) AS keys, max(len(w.keys)) >= 4 AS full
FROM walk w JOIN line l USING (peer_id, n) GROUP BY w.peer_id, w.head"""

QUERIES: dict[str, str] = {
    "cdc_parse_valid": feed("""SELECT peer_id, stream_id, ms, seq, op, key, hash, data,
        CASE WHEN has_meta THEN 'application/json' END AS content_type, CASE WHEN has_meta THEN event_id END AS version,
        CASE WHEN has_meta THEN ms END AS updated_at FROM good"""),
    "cdc_reject_reasons": feed("SELECT reject_reason, count(*) AS n FROM parsed WHERE reject_reason IS NOT NULL GROUP BY 1"),
    "cdc_rejected_entries": feed("SELECT peer_id, stream_id, reject_reason FROM parsed WHERE reject_reason IS NOT NULL"),
    "cdc_latest_wins": feed("SELECT key, op, hash, version, ms, seq FROM pending"),
    "cdc_latest_wins_window": feed("SELECT key, op, hash, version, ms, seq FROM pending"),
    "cdc_currency_skip": feed("SELECT p.key, p.hash FROM pending p JOIN held h ON h.object_id = p.key AND h.content_hash = p.hash WHERE p.op = 'PUT'"),
    "cdc_surviving": feed("SELECT key, op, hash FROM surviving"),
    "batch_result_counts": feed("""SELECT (SELECT count(*) FROM pending) AS total,
        (SELECT count(*) FROM pending) - (SELECT count(*) FROM surviving) AS skipped,
        (SELECT count(*) FROM surviving WHERE op = 'PUT') AS submitted,
        (SELECT count(*) FROM surviving WHERE op = 'DELETE') AS deleted, 0::BIGINT AS errors, true AS success"""),
    "apply_snapshot": feed("""SELECT coalesce(s.key, h.object_id) AS object_id, CASE WHEN s.op IS NULL THEN h.content ELSE s.data END AS content,
        CASE WHEN s.op IS NULL THEN h.content_hash ELSE s.hash END AS content_hash,
        CASE WHEN s.op IS NULL THEN h.version ELSE s.version END AS version
        FROM held h FULL JOIN surviving s ON h.object_id = s.key WHERE s.op IS NULL OR s.op = 'PUT'"""),
    "stream_bounds": feed("SELECT peer_id, oldest_id, newest_id, length FROM lim"),
    "read_after_cursor": feed("""SELECT stream_id, ms, seq FROM parsed
        WHERE ms > 1704672000000 OR (ms = 1704672000000 AND seq > 0)"""),
    "first_n_after_cursor": feed("""SELECT stream_id, ms, seq FROM parsed WHERE ms > 1704672000000 OR (ms = 1704672000000 AND seq > 0)
        ORDER BY ms, seq LIMIT 100"""),
    "trim_gap_by_peer": feed("""SELECT peer_id, stream_id, oldest_id,
        CASE WHEN gap THEN 'trimmed' WHEN stream_id = '0' AND length = 0 THEN 'empty' ELSE 'events' END AS status,
        CASE WHEN gap THEN oldest_id ELSE stream_id END AS read_from, coalesce(gap, false) AS inclusive FROM checked"""),
    "cursor_resume": feed("SELECT peer_id, stream_id FROM resumed"),
    "cursor_flush": feed("""SELECT peer_id, arg_max(stream_id, seq) AS stream_id, arg_max(ms, seq) AS updated_at FROM parsed
        GROUP BY peer_id HAVING NOT (peer_id = 'peer-2' AND max(seq) % 5 = 0)"""),
    "lag_by_peer": feed("SELECT peer_id, lag_ms FROM checked"),
    "position_functions": """WITH p(a, b, a_ms, a_seq, a_time, compared, lag) AS (VALUES
        ('1000-0', '2000-0', 1000, 0, 1000, -1, 1000), ('1000-99', '1000-100', 1000, 99, 1000, -1, 0), ('0', '1000-0', 0, 0, NULL, -1, NULL),
        ('0', '0', 0, 0, NULL, 0, NULL), ('1000000005000-0', '1000000000000-0', 1000000005000, 0, 1000000005000, 1, 0),
        ('1000000000000-0', 'invalid', 1000000000000, 0, 1000000000000, 1, NULL), ('a-b-c', '5', 0, 0, NULL, -1, NULL),
        ('7-x', '7-0', 7, 0, 7, 0, 0), (' 5', '5.7', 0, 0, NULL, 0, NULL), ('', '-', 0, 0, NULL, 0, NULL),
        ('18446744073709551616-1', '3-1', 0, 1, NULL, -1, NULL))
        SELECT a, b, a_ms::BIGINT AS a_ms, a_seq::BIGINT AS a_seq, a_time::BIGINT AS a_time, compared, lag::BIGINT AS lag FROM p""",
    "trace_context": feed("""SELECT stream_id, lpad(event_id::VARCHAR, 32, '0') AS trace_id,
        lpad(user_id::VARCHAR, 16, '0') AS parent_span_id FROM good WHERE has_meta"""),
    "merkle_root": tree("SELECT hash FROM m0"),
    "merkle_level1": tree("SELECT path, hash FROM m1"),
    "merkle_level2": tree("SELECT path, hash FROM m2"),
    "merkle_level3": tree("SELECT path, hash FROM m3"),
    "merkle_children": tree("SELECT segment, hash FROM m2 WHERE parent = 'en'"),
    "clean_branches": tree("SELECT path, hash FROM m3 WHERE path NOT IN (SELECT parent FROM m4 WHERE segment::BIGINT % 97 = 0)"),
    "root_compare": two_trees("""SELECT (SELECT hash FROM l0) AS local_hash, (SELECT hash FROM r0) AS remote_hash,
        CASE WHEN (SELECT hash FROM l0) = (SELECT hash FROM r0) THEN 'in_sync' ELSE 'differs' END AS verdict"""),
    "merkle_divergent_branches": two_trees("""SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'delete' ELSE 'fetch' END AS action
        FROM l2 l FULL JOIN r2 r ON l.path = r.path WHERE l.hash IS DISTINCT FROM r.hash"""),
    "divergent_keys": two_trees("SELECT key, action FROM diffs"),
    "divergent_keys_by_leaf": two_trees("SELECT key, action FROM diffs"),
    "local_only_leaves": two_trees("""SELECT l.path FROM l4 l WHERE NOT EXISTS (SELECT 1 FROM r3 r WHERE r.path = l.parent)
        OR l.parent IN (SELECT path FROM l3 WHERE path LIKE 'de.%')"""),
    "key_set_differences": two_trees("""SELECT 'local' AS side, path FROM (SELECT path, hash FROM l4 EXCEPT SELECT path, hash FROM r4)
        UNION ALL SELECT 'remote', path FROM (SELECT path, hash FROM r4 EXCEPT SELECT path, hash FROM l4)"""),
    "repair_plan_budgeted": two_trees("SELECT key, action FROM plan"),
    "repair_plan_by_peer": two_trees("SELECT peer_id, key, action FROM peer_plan"),
    "repair_operations": two_trees("""SELECT p.key, CASE WHEN p.action = 'fetch' AND r.hash IS NOT NULL THEN 'PUT' ELSE 'DELETE' END AS op,
        CASE WHEN p.action = 'fetch' THEN r.hash END AS hash FROM plan p LEFT JOIN r4 r ON r.path = p.key"""),
    "repair_stats": two_trees("""SELECT (SELECT count(*) FROM (SELECT unnest(['peer-0', 'peer-1', 'peer-2', 'peer-3']))) AS peers_checked,
        4 - (SELECT count(DISTINCT peer_id) FROM peer_plan WHERE action = 'fetch') AS peers_in_sync, count(*) AS items_fetched,
        count(*) FILTER (WHERE action = 'fetch') AS items_submitted, count(*) FILTER (WHERE action = 'delete') AS items_deleted,
        0::BIGINT AS errors FROM peer_plan"""),
    "repair_report_only": two_trees("SELECT key, action FROM diffs WHERE action = 'fetch'"),
    "consecutive_failures": feed("SELECT peer_id, last_ok, last_at, failures FROM runs"),
    "peer_health": feed("SELECT peer_id, state, circuit, failures, lag_ms, unhealthy FROM health"),
    "health_summary": feed("""SELECT count(*) AS peers, count(*) FILTER (WHERE state = 'Connected') AS connected,
        count(*) FILTER (WHERE circuit = 'Open') AS circuits_open, max(lag_ms) AS max_lag_ms, bool_or(NOT unhealthy) AS any_healthy,
        string_agg(peer_id, ',' ORDER BY peer_id) FILTER (WHERE unhealthy) AS unhealthy_peers,
        count(*) FILTER (WHERE state = 'Connected') > 0 AS ready, count(*) FILTER (WHERE state = 'Connected') > 0 AS healthy FROM health"""),
    "eligible_peers": feed("SELECT peer_id FROM stated WHERE state = 'Connected' AND peer_id <> 'peer-1'"),
    "idle_peers": feed("""SELECT s.peer_id FROM stated s LEFT JOIN last_ok l USING (peer_id), (SELECT max(pos) AS now FROM outcomes) n
        WHERE state = 'Connected' AND (l.last_ok IS NULL OR n.now - l.last_ok >= 2)"""),
    "slo_violations": feed("""SELECT kind, count(*) FILTER (WHERE value > 100) AS stream_read, count(*) FILTER (WHERE value * 3 > 500) AS peer_op,
        count(*) FILTER (WHERE value * 2 > 200) AS batch_flush, count(*) FILTER (WHERE value * 400 > 30000) AS lag FROM outcomes GROUP BY kind"""),
    "backoff_schedule": """SELECT n AS failures, least(5000.0::DOUBLE * pow(2, n), 300000.0::DOUBLE) AS repair_ms,
        CASE WHEN n <= 0 THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE * pow(2, n - 1), 30000.0::DOUBLE) END AS retry_ms,
        CASE WHEN n <= 0 THEN 500.0::DOUBLE ELSE least(500.0::DOUBLE * pow(1.5, n - 1), 30000.0::DOUBLE) END AS startup_ms
        FROM (SELECT unnest(range(0, 16)) AS n)""",
    "circuit_counters": feed("""SELECT circuit, count(*) AS calls, count(*) FILTER (WHERE result = 'success') AS successes,
        count(*) FILTER (WHERE result = 'failure') AS failures, count(*) FILTER (WHERE result = 'rejected') AS rejections,
        (count(*) FILTER (WHERE result = 'failure'))::DOUBLE / count(*) AS failure_rate,
        count(*) FILTER (WHERE result = 'rejected') > 0 AND count(*) FILTER (WHERE result = 'rejected') > count(*) FILTER (WHERE result = 'success') AS likely_open
        FROM (SELECT CASE WHEN kind IN ('view', 'click') THEN 'read' ELSE 'write' END AS circuit,
          CASE WHEN NOT ok THEN 'failure' WHEN kind = 'signup' THEN 'rejected' ELSE 'success' END AS result FROM outcomes) GROUP BY circuit"""),
    "retryable_errors": """SELECT kind, kind IN ('Redis', 'PeerConnection', 'SyncEngine') AS retryable FROM (SELECT unnest(
        ['Redis', 'PeerConnection', 'SyncEngine', 'Config', 'Decompression', 'Shutdown']) AS kind)""",
    "metric_rollup": feed("""SELECT peer_id, kind, count(*) AS counter, arg_max(value, pos) AS gauge, min(value) AS least, max(value) AS most,
        count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 100) AS le_100 FROM outcomes GROUP BY ALL"""),
    "batch_windows": feed("SELECT peer_id, ms // 50 AS batch, count(*) AS events, count(DISTINCT key) AS keys FROM good GROUP BY ALL"),
    "batch_closings": CLOSINGS,
    "peer_items": """SELECT 'user.' || user_id AS key, CASE WHEN max(event_id) % 3 = 0 THEN replace(arg_max(props, event_id), ': ', ':')
        WHEN max(event_id) % 3 = 1 THEN 'payload-' || max(event_id) END AS content FROM events GROUP BY user_id""",
    "node_hashes": tree("SELECT path, lower(hash) AS hash FROM m1 WHERE length(hash) = 64"),
    "stream_apply_equivalence": feed("SELECT key AS object_id, hash AS content_hash FROM pending WHERE op = 'PUT'"),
    "stream_cursor_table": feed("SELECT peer_id, newest_id AS stream_id FROM lim"),
    "peer_string_items": """SELECT user_id::VARCHAR AS key, CASE user_id % 5 WHEN 0 THEN '"say \\"' || user_id || '\\" ü/"'
        WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN 'null' WHEN 3 THEN NULL ELSE '["a", ' || user_id END AS content
        FROM (SELECT DISTINCT user_id FROM events)""",
    "peer_root": tree("SELECT lower(hash) AS hash FROM m0"),
    "peer_children": tree("""SELECT parent, segment, lower(hash) AS hash FROM m1 UNION ALL SELECT parent, segment, lower(hash) FROM m2"""),
    "cdc_typed_metadata": """WITH v(n, whole, version, updated_at, trace_parent) AS (VALUES (0, true, '5', -7, NULL), (1, false, NULL, NULL, NULL),
        (2, false, NULL, NULL, NULL), (3, false, NULL, NULL, NULL), (4, false, NULL, NULL, NULL), (5, false, NULL, NULL, NULL),
        (6, true, '18446744073709551615', 1, NULL), (7, false, NULL, NULL, NULL), (8, false, NULL, NULL, NULL), (9, true, '5', 1, '00-a-b-01'),
        (10, false, NULL, NULL, NULL), (11, false, NULL, NULL, NULL), (12, false, NULL, NULL, NULL), (13, false, NULL, NULL, NULL),
        (14, false, NULL, NULL, NULL)) SELECT n, whole, version, updated_at::BIGINT AS updated_at, trace_parent FROM v""",
    "cdc_compressed_entries": """WITH v(key, plain, reject_reason) AS (VALUES ('k0', '', NULL), ('k1', 'hello hello hello', NULL), ('k2', '{"a":1}', NULL),
        ('k3', NULL, 'bad_frame'), ('k4', NULL, 'bad_frame'), ('k5', '(µ/', NULL), ('k6', '', NULL))
        SELECT key, CASE WHEN key = 'k5' THEN 3 ELSE strlen(plain) END AS bytes, CASE WHEN key = 'k5' THEN sha256(unhex('28b52f'))
        ELSE sha256(plain) END AS sha, reject_reason FROM v""",
    "adaptive_batch_trace": """SELECT * FROM (VALUES (0, 60, 200, true), (1, 70, 200, true), (2, 0, 180, false), (3, 0, 162, false), (4, 50, 324, true),
        (5, 49, 324, false), (6, 55, 648, true), (7, 0, 584, false)) AS t(read, events, size, catching_up)""",
    "stream_observed_batches": feed("SELECT count(*)::BIGINT AS events_read, count(reject_reason)::BIGINT AS events_rejected, max(ms) AS newest_ms FROM parsed"),
    "circuit_states": feed("""SELECT peer_id, failures, CASE WHEN failures >= 1 AND (SELECT min(last_at) + 1 FROM runs) - last_at < 1
        THEN 'Open' ELSE 'Closed' END AS circuit FROM runs"""),
}
