"""Statements over the star and order tables, through cleaning, translation and guard; and their SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.plans.sql import generate, reading_session, run_statement

TABLES = ("transaction_flow", "institution_info", "merchant_info", "account_info", "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name -> (statement as it arrives, the same for DuckDB where it differs)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "sql_recent_topk": (
        "```sql\nSELECT t.transaction_id, t.transaction_amount, t.ingest_time FROM transaction_flow t JOIN institution_info i ON t.institution_id = i.institution_id WHERE t.transaction_type = 'REFUND' AND i.institution_type = 'BANK' ORDER BY t.transaction_time DESC, t.transaction_id DESC, t.ingest_time DESC LIMIT 10;\n``` The answer follows.",
        "SELECT t.transaction_id, t.transaction_amount, t.ingest_time FROM transaction_flow t JOIN institution_info i ON t.institution_id = i.institution_id WHERE t.transaction_type = 'REFUND' AND i.institution_type = 'BANK' ORDER BY t.transaction_time DESC, t.transaction_id DESC, t.ingest_time DESC LIMIT 10",
    ),
    "sql_sum_month": ("SQLQuery: SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY year(o_orderdate), month(o_orderdate);", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2"),
    "sql_count_threshold": ("SELECT COUNT(*) AS n FROM `transaction_flow` WHERE transaction_amount > 1000 AND status = 'SUCCESS'", "SELECT COUNT(*) AS n FROM transaction_flow WHERE transaction_amount > 1000 AND status = 'SUCCESS'"),
    "sql_avg_by_category": ("SELECT m.merchant_category, ROUND(AVG(CAST(t.transaction_amount AS DOUBLE)), 4) AS avg_amount FROM transaction_flow t JOIN merchant_info m ON t.merchant_id = m.merchant_id WHERE t.status = 'SUCCESS' GROUP BY m.merchant_category", None),
    "sql_having_topk": ("SELECT l_suppkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 10 ORDER BY revenue DESC, l_suppkey LIMIT 20", None),
    "sql_max_fewshot": ("SELECT MAX(transaction_amount) AS max_amount, MIN(transaction_amount) AS min_amount FROM transaction_flow;", "SELECT MAX(transaction_amount) AS max_amount, MIN(transaction_amount) AS min_amount FROM transaction_flow"),
    "sql_left_join_null": ("SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL", None),
    "sql_right_join": ("SELECT n.n_name, COUNT(s.s_suppkey) AS n_suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name", None),
    "sql_full_join": ("SELECT coalesce(m.k, a.k) AS k, m.n AS n_customers, a.n AS n_suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) m FULL OUTER JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY s_nationkey) a ON m.k = a.k", None),
    "sql_semi": ("SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')", None),
    "sql_anti": ("SELECT a.account_id FROM account_info a WHERE NOT EXISTS (SELECT 1 FROM transaction_flow t WHERE t.account_id = a.account_id)", None),
    "sql_in_subquery": ("SELECT transaction_type, COUNT(*) AS n FROM transaction_flow WHERE merchant_id IN (SELECT merchant_id FROM merchant_info WHERE merchant_type = 'RETAIL') GROUP BY transaction_type", None),
    "sql_exists_corr": ("SELECT o.o_custkey, o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_totalprice = (SELECT MAX(x.o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)", None),
    "sql_rollup": (
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority WITH ROLLUP",
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    ),
    "sql_self_role_join": ("SELECT p.account_type AS payer_type, q.account_type AS payee_type, COUNT(*) AS n FROM transaction_flow t JOIN account_info p ON t.account_id = p.account_id JOIN account_info q ON t.counterparty_id = q.account_id GROUP BY p.account_type, q.account_type", None),
    "sql_union_distinct": ("SELECT institution_id AS id FROM institution_info UNION SELECT merchant_id FROM merchant_info UNION SELECT account_id FROM transaction_flow", None),
    "sql_union_all": ("SELECT k, COUNT(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) u GROUP BY k", None),
    "sql_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "sql_except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "sql_cte": ("WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c.c_mktsegment, COUNT(*) AS n, ROUND(MAX(b.total), 2) AS top FROM big b JOIN customer c ON c.c_custkey = b.o_custkey GROUP BY c.c_mktsegment", None),
    "sql_recursive_cte": ("WITH RECURSIVE d(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM d WHERE n < 31) SELECT d.n AS day, COUNT(e.event_id) AS n_events FROM d LEFT JOIN events e ON day(e.ts) = d.n GROUP BY d.n", None),
    "sql_window_rank": ("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 3", None),
    "sql_window_frames": ("SELECT event_id, LAG(event_id) OVER w AS prev_id, SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, NTILE(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "sql_range_join": ("SELECT r.lo, COUNT(*) AS n FROM (SELECT 0 AS lo, 100000 AS hi UNION ALL SELECT 100000, 200000 UNION ALL SELECT 200000, 1000000) r JOIN orders o ON o.o_totalprice >= r.lo AND o.o_totalprice < r.hi GROUP BY r.lo", None),
    "sql_asof": (
        "SELECT x.event_id, x.before_id FROM (SELECT event_id, event_type, MAX(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_id FROM events) x WHERE x.event_type = 'purchase'",
        None,
    ),
    "sql_case_like": ("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS size_class, COUNT(DISTINCT p_brand) AS n_brands, COUNT(*) AS n FROM part WHERE p_type LIKE '%A%' OR p_name IS NOT NULL GROUP BY 1", None),
    "sql_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "sql_group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_date_functions": (
        "SELECT DATE_FORMAT(ts, '%Y-%m-%d %H') AS hour, COUNT(*) AS n, MAX(DATEDIFF(ts, DATE_SUB(ts, INTERVAL 3 DAY))) AS d FROM events GROUP BY DATE_FORMAT(ts, '%Y-%m-%d %H')",
        "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, COUNT(*) AS n, 3 AS d FROM events GROUP BY 1",
    ),
    "sql_string_functions": (
        "SELECT c_custkey, CONCAT(UPPER(c_mktsegment), '-', SUBSTRING(c_name, 1, 4)) AS tag, LENGTH(c_name) AS bytes, CHAR_LENGTH(c_name) AS chars, REPLACE(c_name, 'C', 'c') AS r FROM customer",
        "SELECT c_custkey, CONCAT(UPPER(c_mktsegment), '-', SUBSTRING(c_name, 1, 4)) AS tag, strlen(c_name) AS bytes, length(c_name) AS chars, REPLACE(c_name, 'C', 'c') AS r FROM customer",
    ),
    "sql_math_null_division": ("SELECT o_orderkey, o_totalprice / (o_custkey % 2) AS ratio, FLOOR(SQRT(o_totalprice)) AS root, MOD(o_orderkey, 7) AS m, ABS(0 - o_custkey) AS a FROM orders", "SELECT o_orderkey, o_totalprice / nullif(o_custkey % 2, 0) AS ratio, CAST(FLOOR(SQRT(o_totalprice)) AS BIGINT) AS root, o_orderkey % 7 AS m, ABS(0 - o_custkey) AS a FROM orders"),
    "sql_json": ("SELECT event_type, SUM(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type", "SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type"),
    "sql_json_extract": (
        "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k, props->>'$.k' AS t FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, props->>'$.k' AS t FROM events",
    ),
    "sql_regexp": (
        "SELECT c_custkey, c_name FROM customer WHERE c_name REGEXP 'customer#0+1[0-9]*$' AND c_mktsegment NOT REGEXP '^B'",
        "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '(?i)customer#0+1[0-9]*$') AND NOT regexp_matches(c_mktsegment, '(?i)^B')",
    ),
    "sql_approximate": ("SELECT l_returnflag, ABS(APPROX_COUNT_DISTINCT(l_partkey) - COUNT(DISTINCT l_partkey)) <= 0.2 * COUNT(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag", None),
    "sql_cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE n.n_regionkey <> r.r_regionkey", None),
    "sql_join_using": ("SELECT a.k, a.n AS n_orders, b.n AS n_lines FROM (SELECT o_orderkey AS k, COUNT(*) AS n FROM orders GROUP BY o_orderkey) a JOIN (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) b USING (k)", None),
    "sql_except_parts": ("SELECT s_nationkey * 7 AS k FROM supplier EXCEPT SELECT n_nationkey FROM nation", None),
    "sql_left_join_unmatched": ("SELECT n.n_nationkey, n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal < 0", None),
    "sql_stddev": ("SELECT l_returnflag, ROUND(STDDEV_POP(l_quantity), 6) AS sd, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag", None),
}
#: Questions through the offline generator.
QUESTIONS = {
    "nl_average_success": ("Average amount of success transactions", "SELECT AVG(CAST(transaction_amount AS DOUBLE)) AS value FROM transaction_flow WHERE status = 'SUCCESS'"),
    "nl_total_by_category": ("Total amount of success payments for each merchant category", "SELECT m.merchant_category AS grp, SUM(t.transaction_amount) AS value FROM transaction_flow t JOIN merchant_info m ON t.merchant_id = m.merchant_id WHERE t.transaction_type = 'PAYMENT' AND t.status = 'SUCCESS' GROUP BY 1"),
    "nl_count_month": ("2023年5月退款有多少笔", "SELECT COUNT(*) AS value FROM transaction_flow WHERE transaction_type = 'REFUND' AND year(transaction_time) = 2023 AND month(transaction_time) = 5"),
}


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = reading_session(spark)
        named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        return run_statement(s, text, {t: s.read.parquet(f"{sf}/{t}.parquet") for t in named})

    return run


QUERIES = {k: _statement(v[0]) for k, v in STATEMENTS.items()} | {k: _statement(generate(v[0])) for k, v in QUESTIONS.items()}
SQL = {k: v[1] or v[0] for k, v in STATEMENTS.items()} | {k: v[1] for k, v in QUESTIONS.items()}
SQL["nl_average_success"] = "SELECT CAST(round(AVG(CAST(transaction_amount AS DOUBLE)), 6) AS DECIMAL(19,6)) AS value FROM transaction_flow WHERE status = 'SUCCESS'"
