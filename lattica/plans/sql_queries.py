"""Queries as SQL: one text for Spark and DuckDB where both read it alike, else one for each.

Sums of doubles are rounded, because their order differs between engines.
"""

from __future__ import annotations

#: name -> SQL that both engines run.
SAME: dict[str, str] = {
    "a01_table_scan": "SELECT r_regionkey, r_name FROM region",
    "a05_values": "SELECT o_orderkey, k, s, x FROM orders JOIN (VALUES (0, 'a', 1.5), (1, 'b', 2.5), (2, NULL, NULL)) AS t(k, s, x) ON o_orderkey % 3 = k",
    "b01_calc": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.05",
    "b02_select_all": "SELECT * FROM nation",
    "b03_filter_three_valued": "SELECT c_custkey FROM customer WHERE (c_acctbal > 0 OR NULL) AND NOT (c_mktsegment = 'BUILDING' AND c_nationkey < 5)",
    "b04_rename": "SELECT k, name FROM (SELECT n_nationkey AS k, n_name AS name FROM nation) t",
    "b09_comparisons": "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part",
    "b10_is_null": "SELECT d.doc_id, l.quality IS NULL AS unlabelled, l.quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "b11_is_true": "SELECT d.doc_id, (l.toxic = 1) IS TRUE AS t, (l.toxic = 1) IS FALSE AS f, (l.toxic = 1) IS NOT TRUE AS nt, (l.toxic = 1) IS NOT FALSE AS nf FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "b12_and_or_not": "SELECT doc_id, (quality = 1 AND toxic = 1) AS a, (quality = 1 OR toxic = 1) AS o, NOT quality = 1 AS n FROM labels",
    "b13_in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "b14_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "b14_not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "b14_not_in_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey > 10 THEN o_custkey END FROM orders)",
    "b15_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "b16_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "b17_cast": "SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR(20)) AS k, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_quantity AS INT) AS q, CAST(l_linenumber AS SMALLINT) AS s FROM lineitem",
    "b19_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "c01_inner_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10",
    "c02_left_join": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000",
    "c02_right_join": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 250000",
    "c02_full_join": "SELECT d.doc_id AS doc_id, l.doc_id AS label_id, l.quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id + 3",
    "c03_single_row_join": "SELECT o_orderkey, round(o_totalprice - m, 2) AS above FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS m FROM orders) t WHERE o_totalprice > m * 1.5",
    "c04_cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "c22_semi_join": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "c22_anti_join": "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_quantity > 45)",
    "d01_group_aggregate": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "d01_global_aggregate_empty": "SELECT count(*) AS n, sum(l_linenumber) AS s, max(l_quantity) AS m FROM lineitem WHERE l_quantity < 0",
    "d03_count": "SELECT count(*) AS n, count(l.quality) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "d04_sum_int": "SELECT l_returnflag, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag",
    "d05_sum0": "SELECT l_returnflag, coalesce(sum(CASE WHEN l_quantity < 0 THEN l_linenumber END), 0) AS s0 FROM lineitem GROUP BY l_returnflag",
    "d07_min_max": "SELECT event_type, min(value) AS lo, max(value) AS hi, min(ts) AS first_ts, max(ts) AS last_ts, min(props) AS p FROM events GROUP BY event_type",
    "d10_moments": "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs FROM lineitem GROUP BY l_returnflag",
    "d12_distinct_aggregates": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber) AS s, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "d13_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "d14_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "d15_rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "d17_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "o02_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
    "o07_top_k": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
    "u01_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "u02_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "u04_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "u04_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "u05_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "u05_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "f03_abs_ceil_floor": "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer",
    "f06_exp_ln_log10": "SELECT p_partkey, round(exp(p_size / 10.0), 6) AS e, round(ln(p_size + 1), 9) AS l, round(log10(p_size + 1), 9) AS g FROM part",
    "f08_power_sqrt": "SELECT p_partkey, round(power(p_size, 1.5), 6) AS p, round(sqrt(p_size), 9) AS s FROM part",
    "f10_mod": "SELECT o_orderkey, (o_orderkey - 500) % 7 AS m FROM orders",
    "f11_trigonometry": "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(cot(p_size + 0.5), 6) AS ct, round(asin(p_size / 100.0), 9) AS a, round(acos(p_size / 100.0), 9) AS ac, round(atan(p_size), 9) AS at1 FROM part",
    "f12_degrees_radians_sign": "SELECT c_custkey, round(degrees(c_acctbal), 4) AS d, round(radians(c_acctbal), 9) AS r, CAST(sign(c_acctbal) AS INT) AS s FROM customer",
    "f13_round": "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 0) AS r0, round(CAST(l_quantity AS INT), -1) AS r1 FROM lineitem",
    "f16_concat_operator": "SELECT c_custkey, c_name || '-' || c_mktsegment AS s, concat(c_name, '/', c_mktsegment) AS t FROM customer",
    "f18_concat_ws": "SELECT d.doc_id, concat_ws('|', d.lang, CAST(l.quality AS VARCHAR(5)), '', d.source) AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "f20_like": r"SELECT p_partkey FROM part WHERE p_name LIKE '%e_n%' AND p_type NOT LIKE 'X!%%' ESCAPE '!'",
    "f22_strings": "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, length(c_name) AS n, position('#' IN c_name) AS p, substring(c_name, 3, 5) AS s, replace(c_mktsegment, 'I', 'i') AS r FROM customer",
    "f35_nullif_coalesce": "SELECT d.doc_id, coalesce(l.quality, -1) AS q, nullif(d.lang, 'en') AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "f36_between": "SELECT o_orderkey, o_totalprice BETWEEN 50000 AND 100000 AS b, o_totalprice NOT BETWEEN 50000 AND 100000 AS nb FROM orders",
    "w01_over_unbounded": "SELECT event_id, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "w02_over_rows": "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS s, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "w25_ranking": "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "x02_tpch_q3": "SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate",
    "x03_tpch_q10": "SELECT c_custkey, c_name, n_name, round(c_acctbal, 2) AS acctbal, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name, c_acctbal",
    "x04_weblog": "SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 WHERE d.n_chars > 1000 AND NOT EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND x.toxic = 1)",
    "x13_union_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, value FROM events WHERE value > 50",
}

#: name -> (Spark SQL, DuckDB SQL).
PAIRS: dict[str, tuple[str, str]] = {
    "a18_sequence": ("SELECT id AS i, count(o_orderkey) AS n FROM range(1000) LEFT JOIN orders ON o_custkey % 1000 = id GROUP BY id", "SELECT range AS i, count(o_orderkey) AS n FROM range(1000) LEFT JOIN orders ON o_custkey % 1000 = range GROUP BY range"),
    "b18_composite_access": ("SELECT s.k AS k, s.v AS v FROM (SELECT named_struct('k', r_regionkey, 'v', r_name) AS s FROM region)", "SELECT r_regionkey AS k, r_name AS v FROM region"),
    "b20_literals": ("SELECT o_orderkey, DATE'2020-02-03' AS d, TIMESTAMP_NTZ'2020-02-03 04:05:06' AS ts, 1.25D AS x, CAST(NULL AS INT) AS n, true AS b FROM orders", "SELECT o_orderkey, DATE '2020-02-03' AS d, TIMESTAMP '2020-02-03 04:05:06' AS ts, 1.25::DOUBLE AS x, NULL::INT AS n, true AS b FROM orders"),
    "c05_lateral_explode": ("SELECT doc_id, word FROM documents LATERAL VIEW explode(split(text, ' ')) t AS word", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents"),
    "c06_unnest": ("SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
    "c19_window_join": ("SELECT a.event_id AS a, b.event_id AS b FROM (SELECT *, window(ts, '10 minutes').start AS w FROM events WHERE event_type = 'click') a JOIN (SELECT *, window(ts, '10 minutes').start AS w FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.w = b.w", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND time_bucket(INTERVAL '10 minutes', a.ts) = time_bucket(INTERVAL '10 minutes', b.ts) WHERE a.event_type = 'click' AND b.event_type = 'purchase'"),
    "d09_avg_int_legacy": ("SELECT l_returnflag, CAST(sum(l_linenumber) div count(l_linenumber) AS BIGINT) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS a FROM lineitem GROUP BY l_returnflag"),
    "d16_grouping_standard": ("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g, grouping_id(o_orderstatus, o_orderpriority) AS gid, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g, grouping(o_orderstatus, o_orderpriority) AS gid, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "f01_arithmetic": ("SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 1 AS s, o_orderkey * 2 AS m, (o_orderkey - 1000) div 7 AS d, -o_orderkey AS n FROM orders", "SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 1 AS s, o_orderkey * 2 AS m, CAST(trunc((o_orderkey - 1000) / 7.0) AS BIGINT) AS d, -o_orderkey AS n FROM orders"),
    "f02_interval_arithmetic": ("SELECT event_id, ts + INTERVAL '90' MINUTE AS a, ts - INTERVAL '2' DAY AS b, ts + INTERVAL '1' MONTH AS c FROM events", "SELECT event_id, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 2 DAY AS b, ts + INTERVAL 1 MONTH AS c FROM events"),
    "f05_floor_to": ("SELECT event_id, CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS f, CAST(CASE WHEN date_trunc('DAY', ts) = ts THEN ts ELSE date_trunc('DAY', ts) + INTERVAL 1 DAY END AS TIMESTAMP_NTZ) AS c FROM events", "SELECT event_id, date_trunc('hour', ts) AS f, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS c FROM events"),
    "f07_log_base": ("SELECT p_partkey, round(log(2, p_size + 1), 9) AS l FROM part", "SELECT p_partkey, round(ln(p_size + 1) / ln(2), 9) AS l FROM part"),
    "f14_constants": ("SELECT c_custkey, round(c_acctbal * e(), 4) AS e, round(c_acctbal * pi(), 4) AS p FROM customer", "SELECT c_custkey, round(c_acctbal * exp(1), 4) AS e, round(c_acctbal * pi(), 4) AS p FROM customer"),
    "f15_bin": ("SELECT p_partkey, bin(p_size) AS b FROM part", "SELECT p_partkey, bin(p_size) AS b FROM part"),
    "f19_pad": ("SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 4, '*') AS r FROM nation", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 4, '*') AS r FROM nation"),
    "f21_trim": ("SELECT n_nationkey, trim(BOTH 'A' FROM n_name) AS b, trim(LEADING 'A' FROM n_name) AS l, trim(TRAILING 'A' FROM n_name) AS t FROM nation", "SELECT n_nationkey, trim(n_name, 'A') AS b, ltrim(n_name, 'A') AS l, rtrim(n_name, 'A') AS t FROM nation"),
    "f22_overlay_initcap": ("SELECT n_nationkey, overlay(n_name PLACING 'xy' FROM 2 FOR 1) AS o, initcap(lower(n_name)) AS i FROM nation", "SELECT n_nationkey, substr(n_name, 1, 1) || 'xy' || substr(n_name, 3) AS o, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS i FROM nation"),
    "f23_hashes": ("SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha2(text, 256) AS s2 FROM documents", "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2 FROM documents"),
    "f24_extract": ("SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(QUARTER FROM o_orderdate) AS q, extract(MONTH FROM o_orderdate) AS m, extract(WEEK FROM o_orderdate) AS w, extract(DAY FROM o_orderdate) AS d, extract(DOY FROM o_orderdate) AS doy, CAST(ceil(year(o_orderdate) / 100) AS BIGINT) AS c, CAST(ceil(year(o_orderdate) / 1000) AS BIGINT) AS k, extract(HOUR FROM o_orderdate) AS h, extract(MINUTE FROM o_orderdate) AS mi FROM orders", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, extract(month FROM o_orderdate) AS m, extract(week FROM o_orderdate) AS w, extract(day FROM o_orderdate) AS d, extract(doy FROM o_orderdate) AS doy, extract(century FROM o_orderdate) AS c, extract(millennium FROM o_orderdate) AS k, extract(hour FROM o_orderdate) AS h, extract(minute FROM o_orderdate) AS mi FROM orders"),
    "f27_timestampadd": ("SELECT o_orderkey, CAST(timestampadd(MONTH, 1, o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(timestampadd(DAY, -3, o_orderdate) AS TIMESTAMP_NTZ) AS d FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 3 DAY AS d FROM orders"),
    "f30_parse_temporal": ("SELECT o_orderkey, to_date(date_format(o_orderdate, 'yyyy/MM/dd'), 'yyyy/MM/dd') AS d FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders"),
    "f32_arrays": ("SELECT vec_id, CAST(get(embedding, 0) AS DOUBLE) AS a, get(embedding, 9999) IS NULL AS past, size(embedding) AS n, array(1, vec_id)[1] AS v FROM embeddings", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, embedding[10000] IS NULL AS past, len(embedding) AS n, vec_id AS v FROM embeddings"),
    "f33_maps": ("SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey)['a'] AS a, map('a', 1)['z'] AS z, size(map('a', 1, 'b', 2)) AS n FROM nation", "SELECT n_nationkey, n_nationkey AS a, NULL::INT AS z, 2 AS n FROM nation"),
    "f34_row": ("SELECT r.x AS x, r.y AS y FROM (SELECT struct(n_nationkey AS x, n_name AS y) AS r FROM nation)", "SELECT n_nationkey AS x, n_name AS y FROM nation"),
    "f39_json": ("SELECT event_id, get_json_object(to_json(named_struct('t', event_type, 'v', user_id)), '$.t') AS t FROM events", "SELECT event_id, event_type AS t FROM events"),
    "w03_over_range": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW), 4) AS s FROM events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 4) AS s FROM events"),
    "w05_tumble": ("SELECT w.start AS s, w.end AS e, event_type, count(*) AS n, round(sum(value), 3) AS v FROM (SELECT window(ts, '30 minutes') AS w, event_type, value FROM events) GROUP BY w, event_type", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS s, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS e, event_type, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY ALL"),
    "w07_hop": ("SELECT w.start AS s, event_type, count(*) AS n FROM (SELECT window(ts, '1 hour', '20 minutes') AS w, event_type FROM events) GROUP BY w, event_type", "SELECT time_bucket(INTERVAL 20 MINUTE, ts) - to_minutes(20 * k) AS s, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL"),
    "w09_session": ("SELECT user_id, w.start AS s, w.end AS e, count(*) AS n FROM (SELECT user_id, session_window(ts, '10 minutes') AS w FROM events) GROUP BY user_id, w", "WITH a AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS f FROM events), b AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 10 MINUTE AS e, count(*) AS n FROM b GROUP BY user_id, g"),
    "w13_tumble_offset": ("SELECT w.start AS s, count(*) AS n FROM (SELECT window(ts, '1 hour', '1 hour', '15 minutes') AS w FROM events) GROUP BY w", "SELECT time_bucket(INTERVAL 1 HOUR, ts, INTERVAL 15 MINUTE) AS s, count(*) AS n FROM events GROUP BY ALL"),
    "w15_session_dynamic_gap": ("SELECT user_id, w.start AS s, count(*) AS n FROM (SELECT user_id, session_window(ts, CASE WHEN user_id % 2 = 0 THEN '5 minutes' ELSE '20 minutes' END) AS w FROM events) GROUP BY user_id, w", "WITH a AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + CASE WHEN user_id % 2 = 0 THEN INTERVAL 5 MINUTE ELSE INTERVAL 20 MINUTE END THEN 1 ELSE 0 END AS f FROM events), b AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, min(ts) AS s, count(*) AS n FROM b GROUP BY user_id, g"),
    "x01_wordcount": ("SELECT word, count(*) AS n FROM (SELECT explode(split(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word"),
    "x11_top_speed": ("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '10' MINUTE PRECEDING AND CURRENT ROW) AS top FROM events", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) AS top FROM events"),
    "x15_state_machine": ("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE event_type = 'purchase' AND (prev IS NULL OR prev = 'purchase')", "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE event_type = 'purchase' AND (prev IS NULL OR prev = 'purchase')"),
}
