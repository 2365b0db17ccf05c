"""The catalogue's queries in DuckDB SQL, written from the feeds' definitions rather than from messages."""

from __future__ import annotations

from ebbflow.catalog import BAD, CHUNK, MIDDLE, NOW_MS, POP, SLICES

BATCH, DAY, P = 1_000_000_000_000, 86_400_000, 1_000_000_000

# Feed of events: changes (ev), heartbeats (hb); pos orders like (step, tx).
EV = f"""
ev AS (SELECT event_id AS tx, user_id, user_id % 3 AS part, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS b,
  (epoch_us(ts) // 1000) - CASE WHEN event_id % 97 = 0 THEN 172800000 ELSE 0 END AS step,
  CASE WHEN event_type = 'error' THEN 'erase' ELSE 'update' END AS kind, event_type, CAST(round(value * 100) AS BIGINT) AS cents, props FROM events),
ch AS (SELECT *, b * {BATCH} + tx AS off, CAST(step AS HUGEINT) * {P} + tx AS pos, '[' || user_id || ']' AS kj FROM ev),
mx AS (SELECT max(b) AS last FROM ev),
bs AS (SELECT unnest(range(0, last + 1)) AS b FROM mx),
ps AS (SELECT unnest(range(0, 3)) AS part),
hb AS (SELECT b, part, epoch_ms(TIMESTAMP '2024-01-01') + (b + 1) * {DAY} - part * 3600000 AS step FROM bs CROSS JOIN ps WHERE NOT (part = 2 AND b % 5 = 4)),
hp AS (SELECT *, CAST(step AS HUGEINT) * {P} AS pos, b * {BATCH} + {BATCH - 1} AS off FROM hb)"""

PLAN = (
    EV
    + """,
gr AS (SELECT b, part, max(pos) OVER (PARTITION BY part ORDER BY b) AS hbp FROM bs CROSS JOIN ps LEFT JOIN hp USING (b, part)),
qs AS (SELECT b, CASE WHEN count(hbp) = 3 THEN min(hbp) END AS q FROM gr GROUP BY b),
pl AS (SELECT b, q, coalesce(max(q) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ckpt FROM qs),
fr AS (SELECT ch.* FROM ch JOIN pl USING (b) WHERE pos >= ckpt),
cut AS (SELECT min(b) AS rb, ckpt, q FROM pl WHERE q > ckpt GROUP BY ckpt, q),
pd AS (SELECT fr.*, CASE WHEN cut.rb IS NOT NULL THEN greatest(fr.b, cut.rb) END AS ab FROM fr LEFT JOIN cut ON pos >= ckpt AND pos < q),
w AS (SELECT *, row_number() OVER (ORDER BY ab, pos, off) AS g FROM pd WHERE rb_ok(ab))"""
).replace("rb_ok(ab)", "ab IS NOT NULL")

LATE = (
    EV
    + """,
al AS (SELECT off, part, step, tx, pos, kj, kind, user_id, NULL AS h FROM ch UNION ALL SELECT off, part, step, 0, pos, NULL, 'resolved', NULL, pos FROM hp),
sn AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY part ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lh FROM al),
lt AS (SELECT * FROM sn WHERE kind <> 'resolved' AND pos < lh)"""
)

COMMANDS = """,
cm AS (SELECT kj, step, tx, CASE (tx // 97) % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'apply' ELSE 'wait' END AS action, tx AS o FROM ch WHERE tx % 97 = 0
  UNION ALL SELECT kj, step, tx, 'apply', tx + 1000000 FROM ch WHERE tx % 97 = 0 AND tx % 2 = 0),
dc AS (SELECT kj, step, tx, arg_max(action, o) AS action FROM cm WHERE action IN ('skip', 'apply') GROUP BY kj, step, tx)"""

FOLD = """,
pb AS (SELECT user_id, ab, arg_max(kind, g) AS last, max(CASE WHEN kind = 'erase' THEN g END) AS eg FROM w GROUP BY user_id, ab),
pk AS (SELECT user_id, arg_max(last, ab) AS op, max(CASE WHEN last = 'erase' THEN ab END) AS d, max(eg) AS e FROM pb GROUP BY user_id),
lv AS (SELECT w.* FROM w JOIN pb USING (user_id, ab) JOIN pk USING (user_id) WHERE kind = 'update' AND op = 'update' AND {alive}),
nt AS (SELECT user_id, arg_max(event_type, g) AS t, arg_max(cents, g) FILTER (WHERE event_type <> 'view') AS v,
  arg_max(props, g) FILTER (WHERE event_type IN ('purchase', 'signup')) AS p, count(*) FILTER (WHERE event_type <> 'view') AS nv, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS np FROM lv GROUP BY user_id)"""
REFERENCE = FOLD.format(alive="(d IS NULL OR ab > d) AND (eg IS NULL OR g > eg)")
EXACT = FOLD.format(alive="(e IS NULL OR g > e)")

BASE = ",\nba AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, 'base' AS bt, CAST(c_custkey AS BIGINT) AS bv, '{}' AS bp FROM customer WHERE c_custkey % 2 = 0)"


def _merged(gone: str) -> str:
    return f"""
SELECT coalesce(ba.user_id, nt.user_id) AS user_id, coalesce(nt.t, bt) AS last_type,
  CASE WHEN nv > 0 THEN v WHEN {gone} IS NULL THEN bv END AS last_value, CASE WHEN np > 0 THEN p WHEN {gone} IS NULL THEN bp END AS props
FROM ba FULL JOIN nt ON ba.user_id = nt.user_id LEFT JOIN pk ON pk.user_id = coalesce(ba.user_id, nt.user_id) WHERE pk.op IS NULL OR pk.op = 'update'"""


FINAL = "SELECT user_id, t AS last_type, v AS last_value, p AS props FROM nt"

# Feed of orders and lines.
OL = f"""
oc AS (SELECT o_orderkey AS k, n, CASE WHEN n = 2 THEN 'erase' ELSE 'update' END AS kind, (epoch_us(o_orderdate) // 1000) + n * 15 * {DAY} AS step,
    CASE WHEN n = 0 THEN o_orderstatus ELSE 'C' END AS status, CASE WHEN n = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS total, o_orderpriority AS prio
  FROM orders CROSS JOIN (SELECT unnest(range(0, 3)) AS n) WHERE n = 0 OR (n = 1 AND o_orderstatus = 'P') OR (n = 2 AND o_orderstatus = 'F' AND o_orderkey % 10 = 0)),
ob AS (SELECT *, make_timestamp(step * 1000) AS moment, k * 3 + n AS nth, CAST(step AS HUGEINT) * {P} + k AS pos FROM oc),
lc AS (SELECT l_orderkey AS k, l_linenumber AS ln, CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'erase' ELSE 'update' END AS kind, (epoch_us(l_shipdate) // 1000) AS step,
    CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_returnflag AS flag, l_partkey * 100000 + l_suppkey AS nth, l_shipdate AS moment FROM lineitem),
lb AS (SELECT *, CAST(step AS HUGEINT) * {P} + k AS pos FROM lc),
o AS (SELECT *, (year(moment) - 1995) * 12 + month(moment) - 1 AS b FROM ob),
l AS (SELECT *, (year(moment) - 1995) * 12 + month(moment) - 1 AS b FROM lb),
tg AS (SELECT 'orders' AS tb, kind, '[' || k || ']' AS kj, upper(hex(encode('orders' || k))) AS fk, CAST(k AS VARCHAR) AS raw FROM o
  UNION ALL SELECT 'lines', kind, '[' || k || ',' || ln || ']', upper(hex(encode('lines' || k || ln))), CAST(k AS VARCHAR) || ln FROM l)"""

# All partitions of both topics reach the month's end but one, which stays a day behind.
SALES = (
    OL
    + f""",
bs AS (SELECT unnest(range(0, 96)) AS b),
pl AS (SELECT b, (epoch_ms(CAST(DATE '1995-01-01' + INTERVAL (b + 1) MONTH AS TIMESTAMP)) - {DAY})::HUGEINT * {P} AS q,
  CASE WHEN b = 0 THEN 0 ELSE (epoch_ms(CAST(DATE '1995-01-01' + INTERVAL (b) MONTH AS TIMESTAMP)) - {DAY})::HUGEINT * {P} END AS ckpt FROM bs),
oa AS (SELECT o.*, greatest(o.b, c.b) AS ab FROM o JOIN pl f ON f.b = o.b AND o.pos >= f.ckpt JOIN pl c ON o.pos >= c.ckpt AND o.pos < c.q),
la AS (SELECT l.*, greatest(l.b, c.b) AS ab FROM l JOIN pl f ON f.b = l.b AND l.pos >= f.ckpt JOIN pl c ON l.pos >= c.ckpt AND l.pos < c.q),
ow AS (SELECT *, row_number() OVER (ORDER BY ab, pos, nth) AS g FROM oa), lw AS (SELECT *, row_number() OVER (ORDER BY ab, pos, nth) AS g FROM la),
op AS (SELECT k, ab, arg_max(kind, g) AS last, max(CASE WHEN kind = 'erase' THEN g END) AS eg FROM ow GROUP BY k, ab),
ok AS (SELECT k, arg_max(last, ab) AS op, max(CASE WHEN last = 'erase' THEN ab END) AS d FROM op GROUP BY k),
ol AS (SELECT ow.* FROM ow JOIN op USING (k, ab) JOIN ok USING (k) WHERE kind = 'update' AND op = 'update' AND (d IS NULL OR ab > d) AND (eg IS NULL OR g > eg)),
lp AS (SELECT k, ln, ab, arg_max(kind, g) AS last, max(CASE WHEN kind = 'erase' THEN g END) AS eg FROM lw GROUP BY k, ln, ab),
lk AS (SELECT k, ln, arg_max(last, ab) AS op, max(CASE WHEN last = 'erase' THEN ab END) AS d FROM lp GROUP BY k, ln),
ll AS (SELECT lw.* FROM lw JOIN lp USING (k, ln, ab) JOIN lk USING (k, ln) WHERE kind = 'update' AND op = 'update' AND (d IS NULL OR ab > d) AND (eg IS NULL OR g > eg))"""
)

SETS = "CASE event_type WHEN 'purchase' THEN '`last_type`, `last_value`, `props`' WHEN 'signup' THEN '`last_type`, `last_value`, `props`' WHEN 'view' THEN '`last_type`' ELSE '`last_type`, `last_value`' END"
SYNC = (
    PLAN
    + """,
rb AS (SELECT min(b) AS rb FROM pl WHERE q IS NOT NULL),
sm AS (SELECT max(pos) AS m FROM hp, rb WHERE b <= rb.rb),
sy AS (SELECT min(b) AS b, min(q) AS q, any_value(m) AS m FROM pl, sm WHERE q > m)"""
)
STATES = """
st AS (SELECT n_name AS id, CAST(n_nationkey * 10 AS BIGINT) AS step_id, CAST(0 AS BIGINT) AS tx_id, CASE WHEN n_nationkey % 6 = 0 THEN 'FATAL_ERROR' ELSE 'OK' END AS state, 'RUN' AS stage, n_nationkey FROM nation WHERE n_nationkey % 2 = 0)"""


def _step(x: str) -> str:
    return f"CAST({x} // {P} AS BIGINT)"


def _tx(x: str) -> str:
    return f"CAST({x} % {P} AS BIGINT)"


def _with(ctes: str, query: str) -> str:
    return f"WITH {ctes.strip()}\n{query.strip()}"


# Late changes in full, their text, and the micro-batch that brings them.
TEXT = f"'late ' || kind || ' on events_cdc/' || part || ': key ' || kj || ', position [' || step || ', ' || tx || '], last heartbeat [' || {_step('lh')} || ', 0]'"
SLICED = (
    LATE
    + f""",
lx AS (SELECT lt.*, {TEXT} AS text, (off // {BATCH}) * {SLICES} // (last + 1) AS slice FROM lt, mx),
tr AS (SELECT off AS since, lh AS line, slice, 'late on events_cdc/' || part || ' at ' || off || ': ' || text AS why FROM lx ORDER BY slice, part, off LIMIT 1),
ps1 AS (SELECT part, min(slice_of) AS passed FROM (SELECT sn.part, (sn.off // {BATCH}) * {SLICES} // (last + 1) AS slice_of, sn.pos, sn.kind FROM sn, mx) x, tr WHERE kind = 'resolved' AND pos > line GROUP BY part),
en AS (SELECT CASE WHEN count(*) = 3 THEN greatest(max(passed), any_value(slice)) ELSE 99 END AS stop_slice FROM ps1, tr)"""
)
# The streaming replica over the feed without late changes: the first micro-batch holds heartbeats of all partitions; the scan ends
# with the first quorum beyond its furthest one.
STREAMED = LATE + f""",
sl AS (SELECT ch.*, (off // {BATCH}) * {SLICES} // (last + 1) AS slice FROM ch, mx WHERE off NOT IN (SELECT off FROM lt)),
hs AS (SELECT hp.*, (off // {BATCH}) * {SLICES} // (last + 1) AS slice FROM hp, mx),
ss AS (SELECT unnest(range(0, {SLICES})) AS slice),
gs AS (SELECT slice, part, max(m) OVER (PARTITION BY part ORDER BY slice) AS m FROM ss CROSS JOIN ps LEFT JOIN (SELECT slice, part, max(pos) AS m FROM hs GROUP BY slice, part) USING (slice, part)),
qz AS (SELECT slice, CASE WHEN count(m) = 3 THEN min(m) END AS q, max(m) AS furthest FROM gs GROUP BY slice),
sc AS (SELECT min(slice) AS full_slice, arg_min(furthest, slice) AS line FROM qz WHERE q IS NOT NULL),
sy AS (SELECT min(qz.slice) AS sync_slice, arg_min(q, qz.slice) AS sync FROM qz, sc WHERE q > line),
qq AS (SELECT slice, q, coalesce(max(q) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ckpt FROM qz, sy WHERE slice >= sync_slice),
fs AS (SELECT sl.* FROM sl LEFT JOIN qq USING (slice) WHERE pos >= coalesce(ckpt, 0)),
ax AS (SELECT fs.*, CASE WHEN fs.slice < full_slice THEN fs.slice ELSE (SELECT min(qq.slice) FROM qq WHERE qq.slice >= fs.slice AND qq.q > fs.pos) END AS at_slice FROM fs, sc),
cx AS (SELECT ax.*, CASE WHEN at_slice <= sync_slice THEN (row_number() OVER (PARTITION BY at_slice ORDER BY pos, off) - 1) // {CHUNK} ELSE 0 END AS chunk FROM ax, sy WHERE at_slice IS NOT NULL),
w AS (SELECT *, at_slice * 1000000 + chunk AS ab, row_number() OVER (ORDER BY at_slice, chunk, pos, off) AS g FROM cx)"""

# Messages of the feed of orders and lines, character by character.
SIZES = OL + """,
ms AS (SELECT 1 AS stream_id, CASE n WHEN 0 THEN '{"update":{"status":"' || status || '","total":' || total || ',"priority":"' || prio || '"}' WHEN 1 THEN '{"update":{"status":"' || status || '"}' ELSE '{"erase":{}' END
    || ',"key":[' || k || '],"ts":[' || step || ',' || k || ']}' AS v FROM o
  UNION ALL SELECT 2, CASE kind WHEN 'update' THEN '{"update":{"qty":' || qty || ',"price":' || price || ',"flag":"' || flag || '"}' ELSE '{"erase":{}' END || ',"key":[' || k || ',' || ln || '],"ts":[' || step || ',' || k || ']}' FROM l)"""

BLOCKED = "upper('01' || hex(encode('orders' || o_orderkey)))"

ORACLES = {
    "changelog_scan": _with(EV, "SELECT 'events_cdc' AS topic, part AS partition, off AS \"offset\", kind FROM ch UNION ALL SELECT 'events_cdc', part, off, 'resolved' FROM hp"),
    "topic_layout": "SELECT 'events_cdc' AS topic, CAST(3 AS BIGINT) AS partitions UNION ALL SELECT 'orders_cdc', 2 UNION ALL SELECT 'lines_cdc', 4",
    "classify_messages": _with(EV, f"SELECT kind, count(*) AS n FROM ch GROUP BY kind UNION ALL SELECT 'resolved', count(*) FROM hp UNION ALL SELECT 'malformed', {len(BAD)}"),
    "parse_changes": _with(EV, 'SELECT off AS "offset", step, tx AS tx_id, kind, user_id FROM ch'),
    "image_select": _with(EV, f"SELECT off AS \"offset\", {SETS} AS column_set FROM ch WHERE kind = 'update'"),
    "parse_heartbeats": _with(EV, "SELECT b AS batch, part AS partition, step, CAST(0 AS BIGINT) AS tx_id FROM hp"),
    "route_tables": _with(OL, 'SELECT tb AS "table", kind, count(*) AS n FROM tg GROUP BY tb, kind'),
    "key_text": _with(OL, 'SELECT tb AS "table", kj AS key_json, count(*) AS n FROM tg GROUP BY tb, kj'),
    "filter_key": _with(OL, "SELECT tb AS \"table\", '01' || fk AS filter_key, count(*) AS n FROM tg GROUP BY tb, fk"),
    "typed_conversion": _with(EV, "SELECT off AS \"offset\", user_id, event_type AS last_type, CASE WHEN event_type <> 'view' THEN cents END AS last_value, CASE WHEN event_type IN ('purchase', 'signup') THEN props END AS props FROM ch WHERE kind = 'update'"),
    "row_build": _with(OL, f"SELECT b * {BATCH} + nth AS \"offset\", k AS l_orderkey, ln AS l_linenumber, qty, price, flag FROM l WHERE kind = 'update'"),
    "schema_violations": _with(EV, "SELECT off AS \"offset\", CASE WHEN event_type IN ('purchase', 'signup') THEN 'unknown column props' ELSE 'bad value for column last_value' END AS violation FROM ch WHERE event_type IN ('purchase', 'signup') OR (event_type = 'click' AND cents NOT BETWEEN -32768 AND 32767)"),
    "column_sets": _with(EV, f"SELECT {SETS} AS column_set, count(*) AS n FROM ch WHERE kind = 'update' GROUP BY ALL"),
    "drop_stale": _with(PLAN, 'SELECT off AS "offset" FROM fr'),
    "drop_stale_heartbeats": _with(PLAN, "SELECT b AS batch, part AS partition FROM hp JOIN pl USING (b) WHERE pos >= ckpt"),
    "blocked_keys_scan": f"SELECT {BLOCKED} AS filter_key FROM orders WHERE o_orderkey % 7 = 0",
    "blocked_keys_upsert": f"SELECT DISTINCT 'main' AS instance, {BLOCKED} AS filter_key FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0",
    "key_filter": _with(OL, "SELECT kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM o WHERE k % 7 <> 0 GROUP BY kind"),
    "out_of_order": _with(LATE, f'SELECT off AS "offset", step, tx AS tx_id, {_step("lh")} AS hb_step, CAST(0 AS BIGINT) AS hb_tx_id FROM lt'),
    "command_scan": _with(EV + COMMANDS, "SELECT 'events_cdc' AS topic, kj AS key_json, step, tx AS tx_id, action, o AS \"offset\" FROM cm"),
    "command_decisions": _with(EV + COMMANDS, "SELECT 'events_cdc' AS topic, kj AS key_json, step, tx AS tx_id, action FROM dc"),
    "problem_resolution": _with(LATE + COMMANDS, "SELECT off AS \"offset\", coalesce(action, 'dead_letter') AS decision FROM lt LEFT JOIN dc USING (kj, step, tx)"),
    "dead_letters": _with(LATE + COMMANDS, f"SELECT off AS \"offset\", kj AS key_json, step, tx AS tx_id, {_step('lh')} AS hb_step, 'late ' || kind || ' on events_cdc/' || part || ': key ' || kj || ', position [' || step || ', ' || tx || '], last heartbeat [' || {_step('lh')} || ', 0]' AS text FROM lt LEFT JOIN dc USING (kj, step, tx) WHERE action IS NULL"),
    "stop_diagnostics": _with(LATE + """,
tr AS (SELECT off AS since, lh AS line FROM lt ORDER BY off LIMIT 1),
dr AS (SELECT sn.*, line, coalesce(max(CASE WHEN kind = 'resolved' AND pos > line THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM sn, tr WHERE off >= since)""", "SELECT off AS \"offset\", step, tx AS tx_id FROM dr WHERE done = 0 AND kind <> 'resolved' AND pos < line"),
    "last_heartbeat": _with(EV, f"SELECT 0 AS stream_id, part AS partition, {_step('max(pos)')} AS step, CAST(0 AS BIGINT) AS tx_id FROM hp GROUP BY part"),
    "max_heartbeat": _with(EV, f"SELECT {_step('max(pos)')} AS step, CAST(0 AS BIGINT) AS tx_id FROM hp"),
    "quorum_ready": _with(EV, "SELECT count(DISTINCT part) AS heartbeats, count(DISTINCT part) = 3 AS ready FROM hp"),
    "quorum": _with(PLAN, f"SELECT {_step('max(q)')} AS step, {_tx('max(q)')} AS tx_id FROM pl"),
    "sync_quorum": _with(SYNC, f"SELECT b AS batch, {_step('m')} AS scan_step, {_tx('m')} AS scan_tx, {_step('q')} AS sync_step, {_tx('q')} AS sync_tx FROM sy"),
    "quorum_schedule": _with(PLAN, f"SELECT b AS batch, {_step('q')} AS step, {_tx('q')} AS tx_id FROM pl WHERE q > ckpt"),
    "missing_heartbeats": _with(EV, "SELECT b AS batch, 0 AS stream_id, part AS partition FROM bs CROSS JOIN ps WHERE part = 2 AND b % 5 = 4"),
    "ready_changes": _with(PLAN, 'SELECT off AS "offset" FROM ch WHERE pos < (SELECT max(q) FROM pl)'),
    "pending_changes": _with(PLAN, 'SELECT off AS "offset" FROM ch WHERE pos >= (SELECT max(q) FROM pl)'),
    "global_order": _with(EV, 'SELECT off AS "offset", row_number() OVER (ORDER BY pos, off) AS place FROM ch'),
    "global_order_rows": _with(EV, "SELECT off AS \"offset\", row_number() OVER (ORDER BY pos, off) AS place, step, tx AS tx_id, kind, user_id, CASE WHEN kind = 'update' THEN event_type END AS last_type FROM ch"),
    "pop_top_n": _with(EV, f'SELECT off AS "offset" FROM ch ORDER BY pos, off LIMIT {POP}'),
    "pop_top_n_below": _with(PLAN, f'SELECT off AS "offset" FROM ch WHERE pos < (SELECT q FROM pl WHERE b = {MIDDLE}) ORDER BY pos, off LIMIT {POP}'),
    "initial_scan_chunk": _with(EV, f'SELECT "offset" FROM (SELECT off AS "offset", (row_number() OVER (ORDER BY pos, off) - 1) // {CHUNK} AS c FROM ch) WHERE c = 1'),
    "initial_scan_chunks": _with(EV, f'SELECT chunk, count(*) AS n, min(off) AS first_offset FROM (SELECT off, (row_number() OVER (ORDER BY pos, off) - 1) // {CHUNK} AS chunk FROM ch) GROUP BY chunk'),
    "net_changes": _with(PLAN, "SELECT user_id, arg_max(kind, g) AS op FROM w GROUP BY user_id"),
    "net_deletes": _with(PLAN, "SELECT kj AS key_json FROM w GROUP BY kj HAVING arg_max(kind, g) = 'erase'"),
    "column_overlay": _with(PLAN + REFERENCE, "SELECT user_id, 'last_type' AS \"column\", t AS value FROM nt UNION ALL SELECT user_id, 'last_value', CAST(v AS VARCHAR) FROM nt WHERE nv > 0 UNION ALL SELECT user_id, 'props', p FROM nt WHERE np > 0"),
    "modification_counts": _with(OL, "SELECT tb AS \"table\", count(*) AS n FROM tg WHERE NOT (tb = 'orders' AND CAST(raw AS BIGINT) % 7 = 0) GROUP BY tb"),
    "apply_upsert": _with(EV + ", w AS (SELECT *, 0 AS ab, row_number() OVER (ORDER BY pos, off) AS g FROM ch WHERE kind = 'update')" + REFERENCE + BASE, _merged("pk.d")),
    "apply_delete": _with(PLAN + BASE, "SELECT user_id, bt AS last_type, bv AS last_value, bp AS props FROM ba WHERE user_id NOT IN (SELECT user_id FROM w GROUP BY user_id HAVING arg_max(kind, g) = 'erase')"),
    "multi_table_commit": _with(SALES, f"""
SELECT 'orders' AS "table", CAST(k AS VARCHAR) AS k1, '' AS k2, arg_max(status, g) AS c1, CAST(arg_max(total, g) FILTER (WHERE n = 0) AS VARCHAR) AS c2, arg_max(prio, g) FILTER (WHERE n = 0) AS c3 FROM ol GROUP BY k
UNION ALL SELECT 'lines', CAST(k AS VARCHAR), CAST(ln AS VARCHAR), CAST(arg_max(qty, g) AS VARCHAR), CAST(arg_max(price, g) AS VARCHAR), arg_max(flag, g) FROM ll GROUP BY k, ln
UNION ALL SELECT 'checkpoint', CAST({_step('max(q)')} AS VARCHAR), '0', NULL, NULL, NULL FROM pl"""),
    "replay_run": _with(PLAN + REFERENCE, FINAL),
    "replay_run_exact": _with(PLAN + EXACT + BASE, _merged("pk.e")),
    "replay_on_base": _with(PLAN + REFERENCE + BASE, _merged("pk.d")),
    "stage_transition": _with(SYNC, f"SELECT 'RUN' AS stage, {_step('q')} AS step, {_tx('q')} AS tx_id, count(*) AS changes, CAST(count(*) // {CHUNK} + 1 AS BIGINT) AS chunks FROM ch, sy WHERE ch.b <= sy.b AND pos < q GROUP BY q"),
    "recovery_replay": _with(PLAN + REFERENCE, FINAL),
    "state_init": _with(STATES, "SELECT id, step_id, tx_id, state, stage FROM st UNION ALL SELECT n_name, 0, 0, 'OK', 'INITIAL_SCAN' FROM nation WHERE n_nationkey % 2 = 1"),
    "state_lookup": _with(STATES, "SELECT id, CASE WHEN state <> 'OK' THEN 'state is FATAL_ERROR: late change' END AS problem FROM st"),
    "state_checkpoint": _with(STATES, "SELECT id, CASE WHEN n_nationkey % 4 = 0 THEN 999 ELSE step_id END AS step_id, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey AS BIGINT) ELSE tx_id END AS tx_id, state, stage FROM st"),
    "lease_transition": """SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 1 OR n_nationkey * 100 <= 1000 THEN 'me' ELSE 'you' END AS owner,
  CASE WHEN n_nationkey % 3 <> 1 OR n_nationkey * 100 <= 1000 THEN CAST(1020 AS BIGINT) ELSE CAST(n_nationkey AS BIGINT) * 100 END AS deadline FROM nation""",

    "request_size": _with(SIZES, "SELECT stream_id, CAST(sum(strlen(v)) AS BIGINT) AS bytes FROM ms GROUP BY stream_id"),
    "throughput": _with(PLAN, f"SELECT pl.b AS batch, count(*) AS changes, count(*) / (CAST({_step('any_value(q)')} - {_step('any_value(ckpt)')} AS DOUBLE) / 1000) AS per_second FROM pd JOIN pl ON pl.b = pd.ab GROUP BY pl.b"),
    "type_conversions": """SELECT * FROM (VALUES ('Bool', 'true'), ('Int8', '-128'), ('Int16', '300'), ('Int32', '5'), ('Int64', '9'), ('Uint8', '255'), ('Uint16', '65535'), ('Uint32', '4294967295'),
  ('Uint64', '18446744073709551615'), ('Float', '1.5'), ('Double', '1000.0'), ('Date', '2022-01-08'), ('Timestamp', CAST(epoch_us(TIMESTAMP '2024-01-02 03:04:05.000006') AS VARCHAR)), ('Interval', '7'), ('String', base64(encode('hi'))),
  ('Uuid', lower('123E4567-e89b-12d3-a456-426614174000')), ('Utf8', 'x'), ('Yson', '<a>b'), ('Json', '{}'), ('TzDate', '2024-01-02,UTC'), ('TzDatetime', '2024-01-02T03:04:05,UTC'), ('TzTimestamp', '2024-01-02T03:04:05.1,UTC')) t(type, good),
  (SELECT CAST(NULL AS VARCHAR) AS bad)""",
    "stream_late": _with(SLICED, "SELECT off AS \"offset\", 'late' AS reason, text FROM lx"),
    "stream_violations": _with(SLICED, "SELECT off AS \"offset\", 'late' AS reason, text FROM lx UNION ALL SELECT off, 'violation', CASE WHEN event_type IN ('purchase', 'signup') THEN 'unknown column props' ELSE 'bad value for column last_value' END FROM ch WHERE off NOT IN (SELECT off FROM lx) AND (event_type IN ('purchase', 'signup') OR (event_type = 'click' AND cents NOT BETWEEN -32768 AND 32767))"),
    "stream_stop": _with(SLICED, "SELECT off AS \"offset\", 'FATAL_ERROR' AS state, why AS last_msg, CAST(0 AS BIGINT) AS step FROM lx, tr, en WHERE lx.slice BETWEEN tr.slice AND stop_slice"),
    "stream_table": _with(STREAMED + REFERENCE, FINAL + f" UNION ALL SELECT -1, 'RUN', {_step('max(q)')}, 'OK' FROM qq"),
    "replication_lag": _with(PLAN, f"SELECT b AS batch, greatest(0, {NOW_MS} - {_step('q')}) AS lag_ms FROM pl WHERE q > ckpt"),
}
