"""The catalog of tables: schemas, comments, prompt text, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DecimalType(15, 2), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


#: The finance star (S3).
STAR = {
    "transaction_flow": _schema(
        ("transaction_id", _S, False), ("merchant_id", _S, False), ("institution_id", _S, False), ("account_id", _S, False), ("counterparty_id", _S, False),
        ("transaction_amount", _D, False), ("transaction_type", _S, False), ("transaction_time", _TS, False), ("status", _S, False), ("remark", _S, True),
    ),
    "institution_info": _schema(
        ("institution_id", _S, False), ("institution_name", _S, False), ("institution_type", _S, False), ("license_no", _S, True), ("legal_entity", _S, True),
        ("contact_phone", _S, True), ("contact_email", _S, True), ("status", _S, False), ("create_time", _TS, False),
    ),
    "merchant_info": _schema(
        ("merchant_id", _S, False), ("merchant_name", _S, False), ("merchant_type", _S, False), ("merchant_category", _S, True), ("legal_person", _S, True),
        ("business_license", _S, True), ("settlement_account", _S, True), ("status", _S, False), ("register_time", _TS, False),
    ),
    "account_info": _schema(("account_id", _S, False), ("account_name", _S, False), ("account_type", _S, False), ("bank_name", _S, True), ("bank_account_no", _S, True), ("status", _S, False), ("create_time", _TS, False)),
}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Table, Description, Fields of a catalog file (S1); a missing or unreadable file is a ValueError."""
    try:
        return spark.read.csv(path, header=True, multiLine=True, escape='"').select("Table", "Description", "Fields")
    except Exception as x:  # noqa: BLE001
        raise ValueError(f"can't read the catalog: {x}") from x


def prompt_text(description: Column, table: Column, fields: Column) -> Column:
    """One table as prompt text, fields split at every comma."""
    rows = F.array_join(F.transform(F.split(fields, ","), lambda f: F.concat(F.lit("  - "), F.trim(f), F.lit("\n"))), "")
    listed = F.when(fields.isNotNull(), F.concat(F.lit("字段描述:\n"), rows)).otherwise(F.lit("字段描述: 无可用描述\n"))
    return F.concat(F.lit("表名: "), table, F.lit("\n描述: "), description, F.lit("\n"), listed, F.lit("\n"))


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """(table, ordinal, column, comment): fields split only where the next name: begins."""
    parts = F.split("Fields", ",(?=[A-Za-z_]\\w*:)")
    return catalog.where("Fields is not null").select(F.col("Table").alias("table"), F.posexplode(parts).alias("ordinal", "f")).select("table", "ordinal", F.trim(F.substring_index("f", ":", 1)).alias("column"), F.regexp_replace("f", "^[^:]*:", "").alias("comment"))


def select_tables(catalog: DataFrame, question: str) -> list[str]:
    """Tables whose name, description or fields share a word or a pair of Chinese characters with the question (F15, L1): the offline stand-in for a model. All if none does."""
    import re

    q = question.lower()
    keys = set(re.findall(r"[a-z_][a-z_0-9]{2,}", q)) | {a + b for a, b in zip(q, q[1:], strict=False) if "一" <= a <= "鿿" and "一" <= b <= "鿿"}
    words = F.array(*[F.lit(k) for k in sorted(keys)]) if keys else F.array().cast("array<string>")
    text = F.lower(F.concat_ws(" ", "Table", "Description", "Fields"))
    rows = catalog.select("Table", F.size(F.filter(words, lambda w: F.contains(text, w))).alias("n")).collect()  # a catalog is a handful of tables
    hit = [r["Table"] for r in sorted(rows, key=lambda r: (-r["n"], r["Table"])) if r["n"]]
    return hit or sorted(r["Table"] for r in rows)


def register(spark: SparkSession, sf: str, tables: list[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)


def create_statement(name: str, schema: T.StructType, folder: str) -> str:
    """DDL of an empty table at ``folder`` (S3)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    return f"CREATE TABLE {name} ({fields}) USING parquet LOCATION '{folder}'"


def insert_statements(name: str, schema: T.StructType, rows: list, batch: int = 100) -> list[str]:
    """INSERT statements of at most ``batch`` rows each."""

    def literal(v, kind: T.DataType) -> str:
        if v is None:
            return "NULL"
        if isinstance(kind, T.StringType):
            return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{kind.simpleString()}'{v}'" if isinstance(kind, T.TimestampNTZType) else str(v)

    values = ["(" + ", ".join(literal(r[f.name], f.dataType) for f in schema) + ")" for r in rows]
    return [f"INSERT INTO {name} VALUES " + ", ".join(values[i : i + batch]) for i in range(0, len(values), batch)]
