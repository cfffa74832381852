"""Statements from questions to answers: clean, translate, guard, run, shape."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession

from tessel.functions.text import SQL_FENCE, SQL_KEYWORDS, SQL_PREFIX

# cleaning -----------------------------------------------------------------------


def clean_statement(text: str, strict: bool = False) -> str:
    """The statement in a model's reply. Unlike the column function clean_sql it keeps a leading WITH and leaves string literals alone (Q2, Q3), unless ``strict``."""
    text = re.sub(SQL_FENCE, r"\1", text, flags=re.DOTALL)
    text = re.sub(r"^\s*" + SQL_PREFIX, "", text, flags=re.IGNORECASE)
    start = re.search(r"\bSELECT\b" if strict else r"\b(?:WITH|SELECT)\b", text, re.IGNORECASE)
    parts, ended = [], False
    for s, literal in pieces(text[start.start() :] if start else text):
        if literal:
            parts.append(s)
            continue
        s, semi, _ = s.partition(";")
        s = re.sub(r"\s+", " ", s.replace("`", ""))
        s = re.sub(rf"\b({'|'.join(SQL_KEYWORDS)})\b", r"\n\1", s, flags=re.IGNORECASE)
        parts.append(s)
        if semi:
            ended = True
            break
    out = re.sub(r"\n\s*\n", "\n", re.sub(r"[ \t]+\n", "\n", "".join(parts))).strip()
    return out + (";" if ended else "")


def pieces(sql: str) -> list[tuple[str, bool]]:
    """(text, whether it is a string literal) in order."""
    out, at = [], 0
    for m in re.finditer(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", sql):
        out += [(sql[at : m.start()], False), (m[0], True)]
        at = m.end()
    return [*out, (sql[at:], False)]


# dialect ------------------------------------------------------------------------

#: Percent codes of date patterns.
DATE_CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%i": "mm", "%s": "ss", "%S": "ss", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%p": "a", "%T": "HH:mm:ss"}


def insensitive(held: list[str], mark: str) -> str:
    """A kept pattern literal that takes no notice of case, as MySQL's doesn't."""
    k = int(mark.strip("\x00"))
    held[k] = held[k][0] + "(?i)" + held[k][1:]
    return mark


def to_spark(sql: str) -> str:
    """A MySQL statement as Spark takes it: limits, group_concat, date patterns and intervals, byte lengths, JSON paths, REGEXP without regard to case. Literals stay, but for date and REGEXP patterns."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    s = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", keep, sql.strip().rstrip(";"))
    s = re.sub(r"\blimit\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", s, flags=re.I)
    s = re.sub(r"\bgroup_concat\s*\(\s*(distinct\s+)?([^()]*?)(?:\s+order\s+by\s+([^()]*?))?(?:\s+separator\s+(\x00\d+\x00))?\s*\)", lambda m: f"listagg({m[1] or ''}cast({m[2]} as string), {m[4] or repr(',')})" + (f" within group (order by {m[3]})" if m[3] else ""), s, flags=re.I)
    s = re.sub(r"\bdate_(sub|add)\s*\(\s*([^(),]+|[^(),]*\([^()]*\)[^(),]*)\s*,\s*interval\s+(\S+)\s+(\w+)\s*\)", lambda m: f"({m[2]} {'-' if m[1].lower() == 'sub' else '+'} interval {m[3]} {m[4]})", s, flags=re.I)
    column = r"([A-Za-z_][\w.]*)"
    s = re.sub(column + r"\s*->>\s*(\x00\d+\x00)", r"get_json_object(\1, \2)", s)
    s = re.sub(column + r"\s*->\s*(\x00\d+\x00)", r"get_json_object(\1, \2)", s)
    s = re.sub(r"\bjson_unquote\s*\(\s*(json_extract\s*\([^()]*\)|get_json_object\([^()]*\))\s*\)", r"\1", s, flags=re.I)
    s = re.sub(r"\bjson_extract\s*\(", "get_json_object(", s, flags=re.I)
    s = re.sub(r"\b(not\s+)?regexp\s+(?:binary\s+)?(\x00\d+\x00)", lambda m: f"{m[1] or ''}RLIKE {insensitive(held, m[2])}", s, flags=re.I)
    s = re.sub(r"(?<!\w)length\s*\(", "octet_length(", s, flags=re.I)
    s = re.sub(r"\bchar_octet_length\(", "char_length(", s, flags=re.I)

    def pattern(m: re.Match) -> str:
        k = int(m[2])
        for a, b in DATE_CODES.items():
            held[k] = held[k].replace(a, b)
        return m[0]

    re.sub(r"\b(date_format|str_to_date)\s*\(.*?,\s*\x00(\d+)\x00\s*\)", pattern, s, flags=re.I)
    s = re.sub(r"\bstr_to_date\s*\(", "to_timestamp(", s, flags=re.I)
    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], s)


# guard --------------------------------------------------------------------------

#: Kinds of plan nodes that only read.
READ_ONLY = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedRelation", "UnresolvedInlineTable", "OneRowRelation", "UnresolvedWith", "UnresolvedHaving", "Window", "WithWindowDefinition", "Generate", "LateralJoin", "Pivot", "UnresolvedHint", "UnionLoop", "ResolvedInlineTable", "LocalRelation", "UnresolvedTableValuedFunction",
}


class NotAllowed(ValueError):
    """The statement does something else than read."""


#: Functions that call into the JVM, read files, or hold a worker up.
FORBIDDEN = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "raise_error", "assert_true", "sleep", "current_user", "session_user", "user", "version", "current_catalog", "current_database", "current_schema"}


def guard(spark: SparkSession, sql: str) -> None:
    """Raises NotAllowed unless every node of the parsed statement, also below WITH and in subqueries of expressions, is in READ_ONLY, and every function it calls is one of Spark's own that is not FORBIDDEN."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as x:  # noqa: BLE001
        raise NotAllowed(f"not a statement: {str(x)[:200]}") from x
    builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.functionSet()
    tables = spark._jvm.org.apache.spark.sql.catalyst.analysis.TableFunctionRegistry.functionSet()
    names = {f.funcName().lower() for found in (builtin, tables) for f in _each(found.toSeq())}

    def call(parts: list[str]) -> None:
        name = parts[-1].lower()
        if len(parts) > 1 or name in FORBIDDEN or name not in names:
            raise NotAllowed(f"function {'.'.join(parts)} is not allowed")

    def look(x) -> None:
        kind = x.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            call([str(p) for p in _each(x.nameParts())])
        if kind in SUBQUERIES:
            walk(x.plan())
        for y in _each(x.children()):
            look(y)

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in READ_ONLY:
            raise NotAllowed(f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            for c in _each(node.cteRelations()):
                walk(c.productElement(1))
        if kind == "UnresolvedTableValuedFunction":
            call([str(p) for p in _each(node.name())])
        for x in _each(node.expressions()):
            look(x)
        for below in _each(node.children()):
            walk(below)

    walk(plan)


#: Expressions that hold a plan.
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def reading_session(spark: SparkSession) -> SparkSession:
    """A session of its own for statements: a division by zero is null, as where they come from; its views and settings leave the caller's alone."""
    s = spark.newSession()
    s.conf.set("spark.sql.ansi.enabled", "false")
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        s.conf.set(k, spark.conf.get(k))
    return s


def run_statement(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Clean, translate, guard and run a statement over ``tables`` or the session's own views (L3)."""
    sql = to_spark(clean_statement(text))
    guard(spark, sql)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


# generation ----------------------------------------------------------------------


class CannotTranslate(ValueError):
    """The question is outside the grammar."""


class SqlGenerator(Protocol):
    def __call__(self, question: str, tables: list[str]) -> str: ...


_AGGREGATES = (("average|\\bmean\\b|平均", "AVG"), ("total|sum|总额|总计|总和|合计", "SUM"), ("highest|largest|max|最高|最大", "MAX"), ("lowest|smallest|min|最低|最小", "MIN"), ("how many|count|number of|多少笔|几笔|笔数|数量", "COUNT"))
_GROUPS = (("merchant categor|商户类别", "m.merchant_category"), ("merchant type|商户类型", "m.merchant_type"), ("institution|机构", "i.institution_name"), ("account type|账户类型", "a.account_type"), ("month|每月|按月", "date_format(t.transaction_time, '%Y-%m')"), ("status|状态", "t.status"), ("type|交易类型", "t.transaction_type"))
_JOINS = {"m": "JOIN merchant_info m ON t.merchant_id = m.merchant_id", "i": "JOIN institution_info i ON t.institution_id = i.institution_id", "a": "JOIN account_info a ON t.account_id = a.account_id"}


def generate(question: str, tables: list[str] | None = None) -> str:
    """A statement for a question of the grammar: [latest n] or [aggregate] of transactions, by type, status, institution and year or month, [per group] [top n]. The offline stand-in for a model (L2); everything else is CannotTranslate."""
    q = question.lower()
    where, used = [], set()
    for words, value in (("refund|退款", "REFUND"), ("payment|支付交易|付款", "PAYMENT"), ("transfer|转账", "TRANSFER"), ("withdraw|提现", "WITHDRAW")):
        if re.search(words, q):
            where.append(f"t.transaction_type = '{value}'")
    for words, value in (("success|成功", "SUCCESS"), ("fail|失败", "FAILED"), ("pending|处理中", "PENDING")):
        if re.search(words, q):
            where.append(f"t.status = '{value}'")
    if m := re.search(r"(?:at|in|of)?\s*institution\s+([\w一-鿿]+)|(机构\d+)", question, re.I):
        where.append(f"i.institution_name = '{m[1] or m[2]}'")
        used.add("i")
    if m := re.search(r"(\d{4})\s*(?:年|-|/)\s*(\d{1,2})\s*月?", q):
        where.append(f"year(t.transaction_time) = {int(m[1])} AND month(t.transaction_time) = {int(m[2])}")
    elif m := re.search(r"\b(20\d\d)\b|(20\d\d)年", q):
        where.append(f"year(t.transaction_time) = {int(m[1] or m[2])}")
    if m := re.search(r"(?:over|above|more than|超过|大于)\s*(\d+(?:\.\d+)?)", q):
        where.append(f"t.transaction_amount > {m[1]}")
    top = re.search(r"(?:latest|most recent|last|top|first|最近|最新|前)\s*(?:的)?\s*(\d+|one|two|three|five|ten|两|三|五|十)?", q)
    numbers = {"one": 1, "two": 2, "three": 3, "five": 5, "ten": 10, "两": 2, "三": 3, "五": 5, "十": 10, None: 1}
    n = (int(top[1]) if top[1] and top[1].isdigit() else numbers[top[1]]) if top else None
    agg = next((f for words, f in _AGGREGATES if re.search(words, q)), None)
    group = None
    if m := re.search(r"(?:\bper\b|\bby\b|for each|各|每个|按)(.*)", q):
        group = next((c for words, c in _GROUPS if re.search(words, m[1])), None)
    if group:
        used |= {group[0]} & set(_JOINS)
    cond = f" WHERE {' AND '.join(where)}" if where else ""
    if agg:
        value = "COUNT(*)" if agg == "COUNT" else f"{agg}(t.transaction_amount)"
        select, tail = (f"{group} AS grp, {value} AS value", f" GROUP BY {group} ORDER BY value DESC, grp" + (f" LIMIT {n}" if n else "")) if group else (f"{value} AS value", "")
    elif top:
        select, tail = "t.transaction_id, t.transaction_amount", f" ORDER BY t.transaction_time DESC, t.transaction_id LIMIT {n}"
    else:
        raise CannotTranslate(question)
    joins = "".join(f" {_JOINS[k]}" for k in sorted(used))
    return f"SELECT {select} FROM transaction_flow t{joins}{cond}{tail};"


# answers -------------------------------------------------------------------------


def shape_answer(rows: list[Row]) -> str:
    """无结果 without rows; a string for one value or one column; a list for one row; a list of lists for more (L4)."""
    plain = [["" if v is None else str(v) for v in r] for r in rows]
    if not plain:
        return "无结果"
    if len(plain[0]) == 1:
        return ", ".join(r[0] for r in plain)
    return str(plain[0]) if len(plain) == 1 else str(plain)


@dataclass(frozen=True)
class Answer:
    answer: str
    sql_query: str
    complete: bool = True


def ask(spark: SparkSession, question: str, tables: dict[str, DataFrame] | None = None, generator: SqlGenerator = generate, most_rows: int = 1000) -> Answer:
    """A question to its answer and statement (L5). Answers are read by people: of a longer result ``most_rows`` rows are shown and ``complete`` is false; run_statement gives all."""
    sql = clean_statement(generator(question, sorted(tables or {})))
    rows = run_statement(spark, sql, tables).limit(most_rows + 1).collect()
    return Answer(shape_answer(rows[:most_rows]), sql, len(rows) <= most_rows)
