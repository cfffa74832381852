"""Scalar tools: calculator, dates, currency, parameters of tools."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Iterator
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# calculator -----------------------------------------------------------------------

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: None}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
#: The functions and constants of expressions.
_FUNCTIONS = {"abs": abs, "round": round, "min": min, "max": max, "sum": sum, "pow": None, "len": len, "sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "log10": math.log10, "exp": math.exp}
_CONSTANTS = {"pi": math.pi, "e": math.e}
#: Bits that a power may have.
POWER_BITS = 4096


def _power(a, b):
    if isinstance(a, int) and isinstance(b, int) and b > 0 and abs(a) > 1 and b * abs(a).bit_length() > POWER_BITS:
        raise ValueError("power too large")
    return a**b


def _eval(node):
    if isinstance(node, ast.Expression):
        return _eval(node.body)
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
        return node.value
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        f = _BINARY[type(node.op)] or _power
        return f(_eval(node.left), _eval(node.right))
    if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
        return _UNARY[type(node.op)](_eval(node.operand))
    if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
        values = [_eval(x) for x in (node.left, *node.comparators)]
        return all(_COMPARE[type(o)](a, b) for o, a, b in zip(node.ops, values, values[1:], strict=False))
    if isinstance(node, ast.List | ast.Tuple):
        return [_eval(x) for x in node.elts]
    if isinstance(node, ast.Name) and node.id in _CONSTANTS:
        return _CONSTANTS[node.id]
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "math" and node.attr in _CONSTANTS:
        return _CONSTANTS[node.attr]
    if isinstance(node, ast.Call) and not node.keywords:
        name = node.func.attr if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id == "math" else getattr(node.func, "id", None)
        if name in _FUNCTIONS:
            return (_FUNCTIONS[name] or _power)(*[_eval(x) for x in node.args])
    raise ValueError("expression not allowed")


def calculate(expression: str | None) -> dict[str, str | bool | None]:
    """success, result, type, error of an arithmetic expression; ^, × and ÷ are understood. Only the operators and functions above are allowed."""
    try:
        value = _eval(ast.parse((expression or "").replace("^", "**").replace("×", "*").replace("÷", "/").strip(), mode="eval"))
        return {"success": True, "result": str(value), "type": type(value).__name__, "error": None}
    except ZeroDivisionError:
        return {"success": False, "result": None, "type": None, "error": "division by zero"}
    except Exception as x:  # noqa: BLE001 - any failure is the tool's answer
        return {"success": False, "result": None, "type": None, "error": str(x) or type(x).__name__}


def calculate_column(c: Column) -> Column:
    """calculate() over a column as a struct, in Arrow batches, each distinct expression once per batch."""

    @F.pandas_udf("success boolean, result string, type string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            done = {x: calculate(x) for x in s.dropna().unique()}
            yield pd.DataFrame([done.get(x) or calculate(None) for x in s], columns=["success", "result", "type", "error"])

    return run(c)


def compile_expression(expression: str) -> Column:
    """The expression over numbers as a Column of doubles, for use inside plans; names of columns may stand for numbers."""

    def go(n) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            return F.lit(_CONSTANTS[n.id]) if n.id in _CONSTANTS else F.col(n.id)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -go(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = go(n.left), go(n.right)
            match n.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return F.try_divide(a, b)
                case ast.Mod():
                    return F.pmod(a, b)
                case ast.Pow():
                    return F.pow(a, b)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            named = {"abs": F.abs, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "log": F.log, "log10": F.log10, "exp": F.exp, "min": F.least, "max": F.greatest, "pow": F.pow}
            if n.func.id in named:
                return named[n.func.id](*[go(x) for x in n.args])
        raise ValueError("expression not allowed")

    return go(ast.parse(expression.replace("^", "**").replace("×", "*").replace("÷", "/"), mode="eval").body)


def exact_product(a: Column, b: Column) -> Column:
    """Product of integers up to 38 digits."""
    return a.cast("decimal(38,0)") * b.cast("decimal(38,0)")


# dates ------------------------------------------------------------------------------

#: Names of patterns, Chinese weekdays.
DATE_PATTERNS = {
    "YYYY-MM-DD": "yyyy-MM-dd",
    "YYYY-MM-DD HH:MM:SS": "yyyy-MM-dd HH:mm:ss",
    "YYYY-MM-DD HH:MM": "yyyy-MM-dd HH:mm",
    "YYYY/MM/DD": "yyyy/MM/dd",
    "DD-MM-YYYY": "dd-MM-yyyy",
    "MM/DD/YYYY": "MM/dd/yyyy",
    "YYYY年MM月DD日": "yyyy年MM月dd日",
    "YYYY年MM月DD日 HH时MM分SS秒": "yyyy年MM月dd日 HH时mm分ss秒",
    "FULL": "EEEE, MMMM dd, yyyy HH:mm:ss",
    "RFC_822": "EEE, dd MMM yyyy HH:mm:ss",
    "ISO": "yyyy-MM-dd'T'HH:mm:ss",
}
WEEKDAYS = ["星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日"]


def chinese_weekday(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ts) + 1)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def date_fields(ts: Column) -> Column:
    """The nine fields of the date tool for a moment without zone, read as UTC."""
    return F.struct(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso_format"),
        F.date_format(ts, "yyyy-MM-dd").alias("date_only"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("readable_format"),
        F.date_format(ts, "yyyy年MM月dd日 HH时mm分ss秒").alias("chinese_format"),
        F.unix_timestamp(ts.cast("timestamp")).alias("timestamp"),
        F.date_format(ts, "EEEE").alias("weekday"),
        chinese_weekday(ts).alias("weekday_chinese"),
        F.dayofyear(ts).alias("day_of_year"),
        is_weekend(ts).alias("is_weekend"),
    )


def current_date(now: Column, pattern: str | None = None) -> Column:
    """JSON of date_fields, or ``now`` by a named pattern; an unknown name raises ValueError (Q25)."""
    if pattern is None:
        return F.to_json(date_fields(now))
    java = DATE_PATTERNS.get(pattern.strip().upper())
    if java is None:
        raise ValueError(f"no date pattern {pattern!r}")
    return F.date_format(now, java)


# currency and parameters -------------------------------------------------------------


def fx_convert(amount: Column, rate: Column, stored_amount: Column, stored: Column) -> Column:
    """round(amount * rate, 2), but the stored value for the stored amount."""
    return F.when(amount == stored_amount, stored).otherwise(F.round(amount * rate, 2))


def yuan_to_usd(text: Column, rate: float = 0.1202) -> Column:
    """The amount before 亿元人民币 in a text times ``rate``, two decimals, halves up, as exact decimals; 0.00 without one."""
    n = F.regexp_extract(text, "(\\d+\\.?\\d*) 亿元人民币", 1)
    return F.round(F.coalesce(F.when(n != "", n.cast("decimal(24,6)")), F.lit(0).cast("decimal(24,6)")) * F.lit(Decimal(str(rate))).cast("decimal(10,6)"), 2).cast("decimal(34,2)").cast("string")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.upper(a), F.upper(b))


def parameter_type(description: Column) -> Column:
    """Type of a tool's parameter by words of its description."""
    d = F.lower(description)
    return F.when(d.rlike("number|int|float|integer"), "number").when(d.rlike("boolean|bool"), "boolean").when(d.rlike("array|list"), "array").otherwise("string")


def exact_integer(text: str) -> Decimal:
    """An integer of any length as a decimal, for results beyond long."""
    with localcontext() as c:
        c.prec = max(28, len(text))
        return Decimal(text)
