"""Queries pN_... of the general data operators, with SQL for DuckDB where it can state them."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.keys import is_blank, match_key, match_word
from tessel.operators.current import current_facts, current_rows
from tessel.operators.features import feature_blocks, open_blocks, type_features
from tessel.operators.hierarchy import TREE, Hierarchy
from tessel.operators.references import deletions_of, orphan_references, parents_of
from tessel.operators.rolling import daily, rolling_totals

FIELDS = {"merchant_id": "merchant", "institution_id": "institution", "account_id": "account", "counterparty_id": "account"}
STATUSES = ("SUCCESS", "FAILED", "PENDING")
FIRST, LAST = date(2023, 1, 1), date(2024, 12, 31)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# 1 ---------------------------------------------------------------------------


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    h = Hierarchy(read(spark, sf, "document_node"))
    return h.nodes.where(F.col("status") != TREE).select(F.col("g").alias("file_id"), F.col("v").cast("int").alias("node_index"))


def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    h = Hierarchy(read(spark, sf, "document_node"))
    path = h.paths().select("g", "v", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))
    return h.nodes.join(path, ["g", "v"], "left").select(
        F.col("g").alias("file_id"), F.col("v").alias("node_index"), F.when(F.col("status") == TREE, "tree").otherwise("loop").alias("status"), "depth", "root", "path", (F.col("size") - 1).alias("n_descendants")
    )


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return Hierarchy(read(spark, sf, "document_node")).descendants().select(F.col("g").alias("file_id"), F.col("v").alias("node_index"), "descendant")


_LINKS = """
WITH RECURSIVE own AS (SELECT file_id AS g, node_index AS v, min(parent_index) AS p FROM document_node GROUP BY 1, 2),
claims AS (SELECT g, v, min(p) AS p FROM (SELECT file_id AS g, unnest(children_indices) AS v, node_index AS p FROM document_node) GROUP BY 1, 2),
links AS (SELECT o.g, o.v, coalesce(o.p, c.p) AS p FROM own o LEFT JOIN claims c USING (g, v)),
ends AS (SELECT l.g, l.v, CASE WHEN o.v IS NOT NULL THEN l.p END AS p FROM links l LEFT JOIN own o ON o.g = l.g AND o.v = l.p),
down AS (
  SELECT g, v, v AS root, 0 AS depth, CAST(v AS VARCHAR) AS path, [v] AS above FROM ends WHERE p IS NULL
  UNION ALL
  SELECT e.g, e.v, d.root, d.depth + 1, d.path || '/' || e.v, list_append(d.above, e.v) FROM ends e JOIN down d ON e.g = d.g AND e.p = d.v
)
"""
P1_SQL = {
    "p1_found": _LINKS + "SELECT g AS file_id, v AS node_index FROM ends ANTI JOIN down USING (g, v)",
    "p1_hierarchy": _LINKS
    + """, below AS (SELECT g, unnest(above) AS v, count(*) - 1 AS n FROM down GROUP BY 1, 2)
SELECT e.g AS file_id, CAST(e.v AS BIGINT) AS node_index, CASE WHEN d.v IS NULL THEN 'loop' ELSE 'tree' END AS status, CAST(d.depth AS BIGINT) AS depth,
 CAST(d.root AS BIGINT) AS root, d.path, CAST(b.n AS BIGINT) AS n_descendants
FROM ends e LEFT JOIN down d USING (g, v) LEFT JOIN below b USING (g, v)""",
    "p1_descendants": _LINKS + "SELECT g AS file_id, CAST(a AS BIGINT) AS node_index, CAST(v AS BIGINT) AS descendant FROM (SELECT g, v, unnest(above) AS a FROM down) WHERE a <> v",
}

# 4 ---------------------------------------------------------------------------


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda x: read(spark, sf, x)
    parents = [
        parents_of(t("merchant_info"), "merchant", "merchant_id", "register_time"),
        parents_of(t("institution_info"), "institution", "institution_id", "create_time"),
        parents_of(t("account_info"), "account", "account_id", "create_time"),
    ]
    return orphan_references(t("transaction_flow"), FIELDS, "transaction_id", "transaction_time", parents, deletions_of(t("record_deletion")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select(F.col("id").alias("transaction_id"), F.col("field").alias("ref_field"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per referenced table and month: references of distinct transactions, and the unsound ones by reason."""
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM").alias("month")
    events = read(spark, sf, "transaction_flow").select(F.col("transaction_id").alias("id"), F.date_format("transaction_time", "yyyy-MM").alias("month"), *[(~is_blank(F.col(f))).cast("int").alias(f) for f in FIELDS])
    # one row a transaction with a flag for each field, then a few rows a month
    held = events.groupBy("id", "month").agg(*[F.max(f).alias(f) for f in FIELDS]).groupBy("month").agg(*[F.sum(f).alias(f) for f in FIELDS])
    kinds = sorted(set(FIELDS.values()))
    of = lambda k: reduce(Column.__add__, [F.coalesce(f, F.lit(0)) for f, x in FIELDS.items() if x == k])
    held = held.select("month", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), of(k).cast("long").alias("n_references")) for k in kinds])).alias("h")).select("month", "h.*").where("n_references > 0")
    bad = _orphans(spark, sf).groupBy("kind", month).agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "created_later", "deleted")])
    zero = F.lit(0).cast("long")
    return held.join(bad, ["kind", "month"], "left").select(
        F.concat("kind", F.lit("_info")).alias("ref_table"), "month", "n_references", *[F.coalesce(c, zero).alias(c) for c in ("n_missing", "n_created_later", "n_deleted")]
    )


_WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12288)"
_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def key_sql(c: str) -> str:
    return f"nullif(upper(trim(translate({c}, '{_WIDE}', '{_PLAIN}'), {_WS})), '')"


_P4 = f"""
WITH parents AS (
  SELECT 'merchant' AS kind, {key_sql("merchant_id")} AS k, min(register_time) AS c FROM merchant_info GROUP BY 1, 2 UNION ALL
  SELECT 'institution', {key_sql("institution_id")}, min(create_time) FROM institution_info GROUP BY 1, 2 UNION ALL
  SELECT 'account', {key_sql("account_id")}, min(create_time) FROM account_info GROUP BY 1, 2),
dels AS (SELECT entity AS kind, {key_sql("record_id")} AS k, deleted_time AS a, restored_time AS b FROM record_deletion),
refs AS (
  SELECT DISTINCT transaction_id AS id, transaction_time AS t, field, kind, k FROM (
  {" UNION ALL ".join(f"SELECT transaction_id, transaction_time, '{f}' AS field, '{kind}' AS kind, {key_sql(f)} AS k FROM transaction_flow" for f, kind in FIELDS.items())})
  WHERE k IS NOT NULL),
bad AS (
  SELECT r.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.c > r.t THEN 'created_later'
    WHEN EXISTS (SELECT 1 FROM dels d WHERE d.kind = r.kind AND d.k = r.k AND d.a <= r.t AND (d.b IS NULL OR d.b > r.t)) THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.k = r.k)
"""
P4_SQL = {
    "p4_found": _P4 + "SELECT id AS transaction_id, field AS ref_field FROM bad WHERE reason IS NOT NULL",
    "p4_report": _P4
    + """SELECT kind || '_info' AS ref_table, strftime(t, '%Y-%m') AS month, count(*) AS n_references,
 count(*) FILTER (WHERE reason = 'missing') AS n_missing, count(*) FILTER (WHERE reason = 'created_later') AS n_created_later, count(*) FILTER (WHERE reason = 'deleted') AS n_deleted
FROM bad GROUP BY 1, 2""",
}

# 5 ---------------------------------------------------------------------------


def _features(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "transaction_flow")
    account, kind, status = match_key(F.col("account_id")), match_word(F.col("transaction_type")), match_word(F.col("status"))
    ordered = sorted(STATUSES)  # codes in the order of the words, any other status below them
    code = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in ordered]), status), F.lit(0)).cast("int")
    now = current_facts(events.where(account.isNotNull()), "transaction_id", "ingest_time", {"account": account, "kind": kind}, {"at": F.col("transaction_time"), "amount": F.col("transaction_amount")}, code)
    now = now.withColumn("status", F.when(F.col("code") > 0, F.element_at(F.array(*[F.lit(s) for s in ordered]), F.greatest("code", F.lit(1)))))
    long = type_features(now, "account", "kind", "at", "amount", "status", str(LAST), STATUSES)
    accounts = read(spark, sf, "account_info").select("account_id", match_key(F.col("account_id")).alias("account_key"))
    kinds = events.select("transaction_type").distinct().select(match_word(F.col("transaction_type")).alias("kind"))  # one column, a row a spelling
    return feature_blocks(long, accounts, "account_key", kinds=kinds).drop("account_key")


def current_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """The current row of each transaction."""
    words = {"kind": match_word(F.col("transaction_type")), "status": match_word(F.col("status"))}
    return current_rows(read(spark, sf, "transaction_flow"), "transaction_id", "ingest_time", status=words["status"], kind=words["kind"], at=F.col("transaction_time")).withColumnRenamed("id", "transaction_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = open_blocks(_features(spark, sf), "account_id")
    return rows.where("n >= 3 and n_success = 0").select("account_id", F.col("kind").alias("transaction_type"))


def p5_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per account with a map of type to features in each block."""
    return _features(spark, sf)


def p5_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The same features, one row per account and type."""
    rows = open_blocks(_features(spark, sf), "account_id")
    return rows.select("account_id", F.col("kind").alias("transaction_type"), "n", F.col("total").cast("double").alias("total"), "recency_days", "n_success", "n_failed", "n_pending", "n_other")


_P5 = f"""
WITH cur AS (SELECT transaction_id, {key_sql("account_id")} AS k, upper(trim(transaction_type, {_WS})) AS kind, upper(trim(status, {_WS})) AS st, transaction_time AS t, transaction_amount AS amt
  FROM transaction_flow QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY ingest_time DESC, upper(trim(status, {_WS})) DESC) = 1),
f AS (SELECT a.account_id, kind AS transaction_type, count(*) AS n, CAST(sum(amt) AS DOUBLE) AS total, CAST(date_diff('day', CAST(max(t) AS DATE), DATE '{LAST}') AS INT) AS recency_days,
 count(*) FILTER (WHERE st = 'SUCCESS') AS n_success, count(*) FILTER (WHERE st = 'FAILED') AS n_failed, count(*) FILTER (WHERE st = 'PENDING') AS n_pending,
 count(*) FILTER (WHERE st IS NULL OR st NOT IN ('SUCCESS', 'FAILED', 'PENDING')) AS n_other
 FROM cur JOIN account_info a ON {key_sql("a.account_id")} = k WHERE kind <> '' GROUP BY 1, 2)
"""
P5_SQL = {
    "p5_found": _P5 + "SELECT account_id, transaction_type FROM f WHERE n >= 3 AND n_success = 0",
    "p5_profile": _P5 + "SELECT * FROM f",
    "current_transactions": f"""
SELECT transaction_id, upper(trim(status, {_WS})) AS status, upper(trim(transaction_type, {_WS})) AS kind, transaction_time AS at
FROM transaction_flow QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY ingest_time DESC, upper(trim(status, {_WS})) DESC) = 1""",
}

# 6 ---------------------------------------------------------------------------


def _merchant_days(spark: SparkSession, sf: str, windows: tuple[int, ...], measures: tuple[str, ...]) -> DataFrame:
    merchant = match_key(F.col("merchant_id"))
    now = current_facts(read(spark, sf, "transaction_flow").where(merchant.isNotNull()), "transaction_id", "ingest_time", {"merchant": merchant}, {"at": F.col("transaction_time"), "amount": F.col("transaction_amount")})
    days = daily(now, "merchant", "at", "amount")
    merchants = read(spark, sf, "merchant_info").select("merchant_id", match_key(F.col("merchant_id")).alias("k")).where("k is not null").dropDuplicates(["k"])
    spelt = merchants.join(days, F.col("k") == F.col("entity"), "left").select(F.col("merchant_id").alias("entity"), "days").where("days is not null")
    return rolling_totals(merchants.select("merchant_id"), "merchant_id", spelt, FIRST, LAST, windows, measures)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """With none in 30 days, one in 31 days means that the 30 days ending the day before hold one."""
    rows = _merchant_days(spark, sf, (30, 31), ("count",))
    return rows.where("count_30 = 0 and count_31 > 0").select("merchant_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p6_rolling(spark: SparkSession, sf: str) -> DataFrame:
    rows = _merchant_days(spark, sf, (7, 30), ("count", "total", "avg"))
    return rows.select("merchant_id", "day", *[x for w in (7, 30) for x in (f"count_{w}", F.col(f"total_{w}").cast("double").alias(f"total_{w}"), f"avg_{w}")])


_P6 = f"""
WITH cur AS (SELECT {key_sql("merchant_id")} AS k, CAST(transaction_time AS DATE) AS day, transaction_amount AS amt
  FROM transaction_flow QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY ingest_time DESC, transaction_amount DESC) = 1),
d AS (SELECT k, day, count(*) AS n, count(amt) AS c, sum(amt) AS s FROM cur GROUP BY 1, 2),
cal AS (SELECT merchant_id, {key_sql("merchant_id")} AS k, CAST(g.day AS DATE) AS day FROM merchant_info, generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) g(day)),
x AS (SELECT merchant_id, cal.day, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(s, 0) AS s FROM cal LEFT JOIN d ON d.k = cal.k AND d.day = cal.day),
w AS (SELECT merchant_id, day,
 sum(n) OVER w7 AS n7, sum(s) OVER w7 AS s7, sum(c) OVER w7 AS c7, sum(n) OVER w30 AS n30, sum(s) OVER w30 AS s30, sum(c) OVER w30 AS c30
 FROM x WINDOW w7 AS (PARTITION BY merchant_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY merchant_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""
P6_SQL = {
    "p6_found": _P6 + ", l AS (SELECT *, lag(n30) OVER (PARTITION BY merchant_id ORDER BY day) AS before FROM w) SELECT merchant_id, strftime(day, '%Y-%m-%d') AS day FROM l WHERE n30 = 0 AND before > 0",
    "p6_rolling": _P6
    + """SELECT merchant_id, day, CAST(n7 AS BIGINT) AS count_7, CAST(s7 AS DOUBLE) AS total_7, CAST(s7 AS DOUBLE) / nullif(c7, 0) AS avg_7,
 CAST(n30 AS BIGINT) AS count_30, CAST(s30 AS DOUBLE) AS total_30, CAST(s30 AS DOUBLE) / nullif(c30, 0) AS avg_30 FROM w""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p4_found, p4_report, p5_found, p5_features, p5_profile, current_transactions, p6_found, p6_rolling)}
SQL = P1_SQL | P4_SQL | P5_SQL | P6_SQL
