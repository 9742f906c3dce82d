"""DuckDB SQL for the queries of the registry."""

from __future__ import annotations

from tidemark.config import DIMENSIONS, MCC_RISK, SCALE


def transactions(codes: list[str], below: float) -> str:
    listed = ", ".join(f"'{c}'" for c in codes)
    return f"""
tx AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS customer, o.o_totalprice / 40 AS amount, floor(epoch(o.o_orderdate))::BIGINT AS ts,
         substr(o.o_orderpriority, 1, 1) IN ('1', '2') AS online, o.o_orderstatus = 'F' AS card, coalesce(l.n, 0) AS installments,
         coalesce('S' || l.s::VARCHAR, '') AS merchant, coalesce([{listed}][p.p_size % {len(codes)} + 1], '') AS mcc,
         coalesce(abs(s.s_acctbal), 0.0) AS merchant_avg, coalesce(abs(c.c_acctbal) / 10, 0.0) AS km
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, l_suppkey AS s, l_partkey AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) = 1) l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON p.p_partkey = l.p LEFT JOIN supplier s ON s.s_suppkey = l.s LEFT JOIN customer c ON c.c_custkey = o.o_custkey
), hist AS (
  SELECT *, coalesce(avg(amount) OVER w, 0.0) AS cavg, count(*) OVER (PARTITION BY customer ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n24,
         list_contains(list(merchant) OVER w, merchant) AND merchant <> '' AS known, lag(ts) OVER o AS last_ts, lag(amount) OVER o AS last_amount
  FROM tx WINDOW o AS (PARTITION BY customer ORDER BY ts, id), w AS (PARTITION BY customer ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


def _fixed(x: str) -> str:
    return f"floor(least(greatest(({x})::DOUBLE, 0.0), 1.0) * {SCALE}.0 + 0.5)::INTEGER"


def features() -> str:
    risk = " ".join(f"WHEN '{c}' THEN {int(r * SCALE + 0.5)}" for c, r in MCC_RISK.items())
    q = [
        _fixed("amount / 10000.0"), _fixed("installments / 12.0"),
        f"CASE WHEN cavg > 0 THEN {_fixed('amount / cavg / 10.0')} ELSE 0 END",
        _fixed("floor((ts % 86400) / 3600.0) / 23.0"), _fixed("(floor(ts / 86400.0)::BIGINT + 3) % 7 / 6.0"),
        f"CASE WHEN last_ts IS NULL THEN -{SCALE} ELSE {_fixed('(ts - last_ts) / 60.0 / 1440.0')} END",
        f"CASE WHEN last_ts IS NULL THEN -{SCALE} ELSE {_fixed('abs(amount - last_amount) / 10 / 1000.0')} END",
        _fixed("km / 1000.0"), _fixed("n24 / 20.0"), f"CASE WHEN online THEN {SCALE} ELSE 0 END", f"CASE WHEN card THEN {SCALE} ELSE 0 END",
        f"CASE WHEN coalesce(known, false) THEN 0 ELSE {SCALE} END", f"CASE rpad(substr(mcc, 1, 4), 4, '0') {risk} ELSE {SCALE // 2} END", _fixed("merchant_avg / 10000.0"),
    ]
    listed = ", ".join(f"{x} AS q{i}" for i, x in enumerate(q))
    tag = "(last_ts IS NOT NULL)::INTEGER + (NOT coalesce(known, false))::INTEGER * 2 + online::INTEGER * 4 + card::INTEGER * 8"
    return f"feat AS (SELECT id, customer, ts, {tag} AS tag, {listed} FROM hist)"


def oracles(k: int, width: int, codes: list[str], below: float, there: list[int]) -> dict[str, str]:
    base = transactions(codes, below)
    feat = f"WITH {base}, {features()}"
    names = ", ".join(f"q{i}" for i in range(DIMENSIONS))
    distance = " + ".join(f"(q.q{i} - r.q{i})::BIGINT * (q.q{i} - r.q{i})" for i in range(DIMENSIONS))
    scored = f"""{feat}, ref AS (
  SELECT f.customer AS ref_id, (c.c_acctbal < {below})::INTEGER AS label, {names} FROM (
    SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts DESC, id DESC) AS r FROM feat) f JOIN customer c ON c.c_custkey = f.customer WHERE r = 1
), ranked AS (
  SELECT q.id, r.label, row_number() OVER (PARTITION BY q.id ORDER BY {distance}, r.ref_id) AS rn FROM feat q, ref r
), vote AS (
  SELECT id, sum(label)::INTEGER AS frauds FROM ranked WHERE rn <= {k} GROUP BY id
)"""
    emb = f"""WITH e AS (
  SELECT vec_id AS id, label::INTEGER AS label, (label % 2)::INTEGER AS tag, list_transform(embedding, lambda x: greatest(least(round_even(x::DOUBLE * {SCALE}, 0), 32767), -32768)::INTEGER) AS q FROM embeddings
)"""
    pair = "list_sum(list_transform(list_zip(a.q, b.q), lambda z: (z[1] - z[2])::BIGINT * (z[1] - z[2])))::BIGINT"
    near = lambda join: f"""{emb}, p AS (SELECT a.id, b.id AS ref_id, b.label, {pair} AS d FROM e a JOIN e b ON {join}),
 n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref_id)::INTEGER AS rn FROM p QUALIFY rn <= {k})"""  # noqa: E731
    exact, parted = near("true"), near("a.tag = b.tag")
    voted = "SELECT id, sum((label >= 5)::INTEGER)::INTEGER AS frauds, sum((label >= 5)::INTEGER) / 5.0::DOUBLE AS fraud_score, sum((label >= 5)::INTEGER) < 3 AS approved FROM n GROUP BY id"
    there_list = ", ".join(map(str, there))
    rates = ", ".join(f"('{c}', {r!r}::DOUBLE, {int(r * SCALE + 0.5)})" for c, r in MCC_RISK.items())
    square = "list_sum(list_transform(list_zip(a.q, b.q), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])))"
    events = "WITH r AS (SELECT event_id % 3 = 0 AS fraud, value >= 100 AS denied, event_type <> 'error' AS fine, value, user_id FROM events)"
    counts = "count(*) FILTER (fine AND fraud AND denied) AS tp, count(*) FILTER (fine AND NOT fraud AND NOT denied) AS tn, count(*) FILTER (fine AND NOT fraud AND denied) AS fp, count(*) FILTER (fine AND fraud AND NOT denied) AS fn, count(*) FILTER (NOT fine) AS err, count(*) AS n"
    boxed = f"{emb}, v AS (SELECT tag, label AS cluster_id, unnest(q) AS x, unnest(range(0, {width})) AS i FROM e), b AS (SELECT tag, cluster_id, i, min(x) AS low, max(x) AS high FROM v GROUP BY ALL)"
    return {
        "fraud_score_orders": f"{scored} SELECT id, frauds, frauds / 5.0::DOUBLE AS fraud_score, frauds < 3 AS approved FROM vote",
        "features_orders": f"{feat} SELECT id, {names} FROM feat",
        "request_tag": f"{feat} SELECT tag, count(*)::BIGINT AS n, sum(tag & 3)::BIGINT AS short_tags FROM feat GROUP BY tag",
        "knn_exact_embeddings": f"{exact} SELECT id, rn, ref_id, d FROM n",
        "kernel_knn": f"{exact} SELECT id, rn, ref_id, d FROM n",
        "partitioned_knn": f"{parted} SELECT id, rn, ref_id, d FROM n",
        "knn_vote": f"{exact} {voted}",
        "knn_majority": f"{exact}, c AS (SELECT id, label, count(*)::BIGINT AS n FROM n GROUP BY ALL) SELECT id, label, n FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1",
        "mcc_lookup": f"SELECT p_partkey, mcc, CASE mcc {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {int(r * SCALE + 0.5)}' for c, r in MCC_RISK.items())} ELSE {SCALE // 2} END::INTEGER AS risk FROM (SELECT p_partkey, [{', '.join(f'{chr(39)}{c}{chr(39)}' for c in codes)}][p_size % {len(codes)} + 1] AS mcc FROM part)",
        "known_merchant": f"WITH {base} SELECT id, coalesce(known, false) AS known FROM hist",
        "cluster_bbox": f"{boxed} SELECT b.tag, b.cluster_id, any_value(s.n)::BIGINT AS n, (max(low) FILTER (i = 0))::INTEGER AS low0, (max(high) FILTER (i = 0))::INTEGER AS high0, sum(low)::INTEGER AS low_sum, sum(high)::INTEGER AS high_sum FROM b JOIN (SELECT tag, label, count(*) AS n FROM e GROUP BY ALL) s ON s.tag = b.tag AND s.label = b.cluster_id GROUP BY b.tag, b.cluster_id",
        "cluster_sizes": f"{emb} SELECT tag, label AS cluster_id, count(*)::BIGINT AS n, coalesce(sum(count(*)) OVER (PARTITION BY tag ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e GROUP BY tag, label",
        "nearest_centroid": f"""{emb}, o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY tag) AS n FROM e),
 k AS (SELECT *, greatest(1, floor(sqrt(n)))::BIGINT AS k FROM o), c AS (SELECT tag, pos // (n // k) AS c, q FROM k WHERE pos % (n // k) = 0 AND pos // (n // k) < k)
 SELECT a.id AS ref_id, a.tag, arg_min(b.c, {pair} * 100000 + b.c)::INTEGER AS cluster_id FROM e a JOIN c b ON a.tag = b.tag GROUP BY a.id, a.tag""",
        "bbox_lower_bound": f"""{boxed}, l AS (SELECT a.id, b.cluster_id, sum(greatest(b.low - a.q[b.i + 1], a.q[b.i + 1] - b.high, 0)::BIGINT * greatest(b.low - a.q[b.i + 1], a.q[b.i + 1] - b.high, 0))::BIGINT AS lb FROM e a JOIN b ON a.tag = b.tag GROUP BY ALL)
 SELECT id, cluster_id, lb FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY lb, cluster_id) <= 3""",
        "ivf_search": f"{parted} {voted}",
        "probe_and_repair": f"""{boxed}, l AS (SELECT a.id, b.tag, b.cluster_id, sum(greatest(b.low - a.q[b.i + 1], a.q[b.i + 1] - b.high, 0)::BIGINT * greatest(b.low - a.q[b.i + 1], a.q[b.i + 1] - b.high, 0))::BIGINT AS lb FROM e a JOIN b ON a.tag = b.tag GROUP BY ALL),
 c AS (SELECT id, cluster_id FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY lb, cluster_id) <= 2),
 p AS (SELECT a.id, b.id AS ref_id, (b.label >= 5)::INTEGER AS label, EXISTS (FROM c WHERE c.id = a.id AND c.cluster_id = b.label) AS probed, {pair} AS d FROM e a JOIN e b ON a.tag = b.tag),
 f AS (SELECT id, sum(label) AS frauds, count(*) AS n FROM (SELECT * FROM p WHERE probed QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, ref_id) <= {k}) GROUP BY id),
 x AS (SELECT id, sum(label) AS frauds FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, ref_id) <= {k}) GROUP BY id)
 SELECT x.id, CASE WHEN f.n = {k} AND f.frauds IN (0, {k}) THEN f.frauds ELSE x.frauds END::INTEGER AS frauds FROM x LEFT JOIN f ON f.id = x.id""",
        "centroid_step": f"""{emb}, o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY tag) AS n FROM e),
 k AS (SELECT *, greatest(1, floor(sqrt(n)))::BIGINT AS k FROM o), s AS (SELECT tag, pos // (n // k) AS c, q FROM k WHERE pos % (n // k) = 0 AND pos // (n // k) < k),
 one AS (SELECT a.id, a.tag, arg_min(b.c, {pair} * 100000 + b.c) AS c FROM e a JOIN s b ON a.tag = b.tag GROUP BY a.id, a.tag),
 v AS (SELECT one.tag, one.c, unnest(e.q) AS x, unnest(range(0, {width})) AS i FROM one JOIN e ON e.id = one.id), g AS (SELECT tag, c, i, avg(x) AS x FROM v GROUP BY ALL), m AS (SELECT tag, c, list(x ORDER BY i) AS q FROM g GROUP BY ALL),
 b AS (SELECT s.tag, s.c, coalesce(m.q, s.q::DOUBLE[]) AS q FROM s LEFT JOIN m ON m.tag = s.tag AND m.c = s.c), d AS (SELECT a.id, a.tag, b.c, {square} AS d FROM e a JOIN b ON a.tag = b.tag)
 SELECT id AS ref_id, tag, c::INTEGER AS cluster_id FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1""",
        "corpus_index": f"""{feat}, ref AS (SELECT f.*, (c.c_acctbal < {below})::INTEGER AS label FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts DESC, id DESC) AS r FROM feat) f JOIN customer c ON c.c_custkey = f.customer WHERE r = 1)
 SELECT ((q5 >= 0)::INTEGER + (q11 > {SCALE // 2})::INTEGER * 2 + (q9 > {SCALE // 2})::INTEGER * 4 + (q10 > {SCALE // 2})::INTEGER * 8)::INTEGER AS tag, label, count(*)::BIGINT AS n, {", ".join(f"sum(q{i})::BIGINT AS q{i}" for i in range(DIMENSIONS))} FROM ref GROUP BY ALL""",
        "risk_file": f"""WITH r(mcc, risk, fixed) AS (VALUES {rates}), p AS (SELECT [{', '.join(f"'{c}'" for c in codes)}][p_size % {len(codes)} + 1] AS mcc, count(*) AS n FROM part GROUP BY 1)
 SELECT r.mcc, r.risk, r.fixed::INTEGER AS fixed, coalesce(p.n, 0)::BIGINT AS parts FROM r LEFT JOIN p ON p.mcc = r.mcc""",
        "routed_requests": f"{feat} SELECT tag AS own, CASE WHEN tag IN ({there_list}) THEN tag WHEN tag & 7 IN ({there_list}) THEN tag & 7 WHEN tag & 3 IN ({there_list}) THEN tag & 3 END::INTEGER AS tag, count(*)::BIGINT AS n FROM feat GROUP BY ALL",
        "http_framing": """WITH r AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'reject' ELSE 'score' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events),
 w AS (SELECT user_id, 'wait' AS action, 0 AS k, count(*) AS place FROM events WHERE user_id % 3 = 0 GROUP BY user_id)
 SELECT user_id, action, count(*)::BIGINT AS n, sum(k)::BIGINT AS keys, max(place)::INTEGER AS last FROM (SELECT user_id, action, CASE WHEN action = 'ready' THEN 0 ELSE event_id END AS k, place FROM r UNION ALL FROM w) GROUP BY ALL""",
        "judged_results": """WITH r AS (SELECT event_id % 3 = 0 AS fraud, value >= 100 AS denied, event_type <> 'error' AND event_id % 7 <> 0 AS fine FROM events)
 SELECT """ + counts + " FROM r",
        "score_record": """WITH r AS (SELECT event_type, event_id % 3 = 0 AS fraud, value >= (CASE WHEN event_type = 'error' THEN 100 ELSE 0 END) + (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 100000 END) AS denied FROM events),
 c AS (SELECT event_type, count(*) FILTER (NOT fraud AND denied) AS fp, count(*) FILTER (fraud AND NOT denied) AS fn, count(*) AS n FROM r GROUP BY event_type), t AS (SELECT *, (fp + fn) / n::DOUBLE > 0.15 AS cut, fp + 3 * fn AS e FROM c)
 SELECT event_type, CASE WHEN NOT cut THEN round(1000.0::DOUBLE * log10(1.0 / greatest(e / n::DOUBLE, 0.001)), 6) END::DOUBLE AS rate_component, CASE WHEN NOT cut THEN round(-300.0::DOUBLE * log10(1.0 + e), 6) END::DOUBLE AS absolute_penalty, cut AS cut_triggered FROM t""",
        "confusion_matrix": f"{events} SELECT {counts} FROM r",
        "p99_latency": f"{events} SELECT round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS total, count(*) FILTER (fraud) AS fraud_count, round(count(*) FILTER (fraud) / count(*)::DOUBLE, 9) AS fraud_rate FROM r",
        "contest_score": f"""{events}, c AS (SELECT user_id, {counts}, quantile_cont(value, 0.99) AS p99 FROM r GROUP BY user_id), s AS (SELECT *, fp + 3 * fn + 5 * err AS e, (fp + fn + err) / n::DOUBLE AS rate FROM c),
 t AS (SELECT *, CASE WHEN rate > 0.15 THEN -3000.0 ELSE 1000.0 * log10(1.0 / greatest(e / n::DOUBLE, 0.001)) - 300.0 * log10(1.0 + e) END AS ds, CASE WHEN p99 > 2000 THEN -3000.0 ELSE 1000.0 * log10(1000.0 / greatest(p99, 1.0)) END AS ls FROM s)
 SELECT user_id, e::BIGINT AS e, round(rate, 6)::DOUBLE AS failure_rate, round(ds::DOUBLE, 6) AS detection_score, round(ls::DOUBLE, 6) AS latency_score, round((ds + ls)::DOUBLE, 6) AS final_score FROM t""",
        "json_parse_events": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
        "checked_bodies": "SELECT event_id, event_id % 25 >= 5 AS valid, CASE WHEN event_id % 25 >= 5 THEN printf('%.2f', value)::DOUBLE ELSE 0.0 END AS amount, CASE WHEN event_id % 25 >= 5 THEN 3 ELSE 0 END::INTEGER AS installments FROM events",
        "iso_epoch": "SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS weekday FROM events",
        "stream_score": f"""{scored} SELECT 200 AS status, '{{"approved":' || (frauds < 3)::VARCHAR || ',"fraud_score":' || (frauds / 5.0::DOUBLE)::VARCHAR || '}}' AS response, count(*)::BIGINT AS n FROM vote GROUP BY ALL""",
    }
