"""Column functions on text: cleaning, headings, tables, overlaps, options.

All are JVM expressions, so filters and projections around them stay in one
code-generated stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------

SQL_KEYWORDS = [
    "SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "JOIN", "LEFT JOIN", "RIGHT JOIN", "INNER JOIN",
    "OUTER JOIN", "UNION", "VALUES", "INSERT", "UPDATE", "DELETE",
]
GLYPH_NAMES = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "period": ".", "comma": ",", "colon": ":", "hyphen": "-", "percent": "%", "dollar": "$", "space": " ", "plus": "+", "minus": "-",
    "slash": "/", "asterisk": "*", "lparen": "(", "rparen": ")", "parenright": ")", "parenleft": "(", "wedge.1_E": "",
}
GLYPH_SUFFIXES = [".pl.tnum", ".tnum.pl", ".pl", ".tnum", ".case", ".sups"]
HEADING_PATTERNS = [
    r"^\d+\.?\d*\.?\d*\s+",
    r"^第[一二三四五六七八九十\d]+[章節条款部分]\s*",
    r"^[一二三四五六七八九十]+[、\.]\s*",
    r"^[A-Z][A-Z\s]*$",
    r"^[A-Z][a-z\s]+$",
]
TABLE_HEADER_WORDS = [
    "名称", "姓名", "编号", "序号", "代码", "标识", "标号", "ID", "Code", "Name", "类型", "分类", "种类", "类别", "性质", "属性", "特征", "Type", "Category", "项目", "内容", "描述",
    "说明", "备注", "注释", "详情", "Item", "Description", "数量", "金额", "价格", "费用", "成本", "总计", "小计", "合计", "Amount", "Price", "Cost", "Total", "Sum", "Count",
    "Quantity", "日期", "时间", "年份", "月份", "期间", "开始", "结束", "截止", "Date", "Time", "Year", "Month", "Period", "Start", "End", "状态", "结果", "等级", "级别",
    "评分", "得分", "排名", "排序", "Status", "Result", "Level", "Grade", "Score", "Rank", "地址", "位置", "区域", "部门", "单位", "公司", "机构", "组织", "Address",
    "Location", "Department", "Company", "Organization", "电话", "邮箱", "联系", "手机", "Phone", "Email", "Contact", "负责人", "联系人", "经办人", "申请人", "审批人",
    "操作员", "Manager", "Contact", "Operator", "Applicant", "Approver", "流程", "步骤", "阶段", "环节", "操作", "处理", "审核", "审批", "Process", "Step", "Stage",
    "Operation", "Review", "Approval", "参数", "配置", "规格", "型号", "版本", "尺寸", "重量", "容量", "Parameter", "Config", "Specification", "Model", "Version",
    "Size", "比例", "百分比", "占比", "增长率", "完成率", "达成率", "通过率", "准确率", "Ratio", "Percentage", "Rate", "Growth", "Completion", "accuracy", "质量", "安全", "风险",
    "问题", "缺陷", "异常", "故障", "Quality", "Safety", "Risk", "Issue", "Defect", "Exception", "计划", "目标", "任务", "指标", "要求", "标准", "规范", "Plan", "Target",
    "Task", "Indicator", "Requirement", "Standard", "资源", "材料", "设备", "工具", "软件", "系统", "平台", "Resource", "Material", "Equipment", "Tool", "Software",
    "System", "权限", "角色", "职位", "岗位", "职责", "权利", "义务", "Permission", "Role", "Position", "Responsibility", "Authority",
]
#: Reply fences and prefixes of statements.
SQL_FENCE = r"```(?:sql|SQL|SQLQuery|mysql|postgresql)?\s*(.*?)\s*```"
SQL_PREFIX = r"(?:SQL\s*Query|SQLQuery|MySQL|PostgreSQL|SQL)\s*:\s*"
#: Beginnings of headings and their levels; capitals are level 1, everything else level 2.
LEVEL_PATTERNS = [
    (r"^\d+\.\d+\.\d+", 3),
    (r"^\d+\.\d+", 2),
    (r"^\d+\.?", 1),
    (r"^第[一二三四五六七八九十\d]+章", 1),
    (r"^第[一二三四五六七八九十\d]+節", 2),
    (r"^[一二三四五六七八九十]+[、\.]", 2),
]
OVERLAP_MARKS = "。！？\n.!?;；:：，,"
LLM_HIDDEN_KEYS = [
    "category_depth", "languages", "filetype", "last_modified", "parent_node_id", "chunk_index", "is_child_node",
    "parent_text_length", "chunk_start", "chunk_end", "matched_children",
]

# cleaning -----------------------------------------------------------------------

_SPACE = "\\s\\u3000"


def strip_space(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def clean_text(c: Column) -> Column:
    """Runs of blank lines become one, ends stripped (X2, as meant)."""
    return strip_space(F.regexp_replace(c, "\\n\\s*\\n+", "\n\n"))


def normalize_space(c: Column) -> Column:
    """Words separated by single blanks."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def drop_extension(c: Column) -> Column:
    """A name without its last extension."""
    return F.regexp_replace(c, "\\.[^.]*$", "")


def clean_sql(c: Column) -> Column:
    """The first SELECT statement of a model's reply, on lines by keyword."""
    c = F.regexp_replace(c, f"(?s){SQL_FENCE}", "$1")
    c = F.regexp_replace(c, f"(?i)^{SQL_PREFIX}", "")
    first = F.regexp_extract(c, "(?is)(SELECT.*?;)", 1)
    c = F.when(first != "", first).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, "`([^`]*)`", "$1"), "\\s+", " ")
    words = "|".join(rf"\b{w}\b" for w in SQL_KEYWORDS)
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(c, f"(?i)({words})", "\n$1"), "^\\s+|\\s+$", "")), "\\n\\s*\\n", "\n")


_GLYPH = "/(" + "|".join(k.replace(".", "\\.") for k in GLYPH_NAMES) + ")(" + "|".join(s.replace(".", "\\.") for s in GLYPH_SUFFIXES) + ")"


def clean_glyphs(c: Column) -> Column:
    """Glyph codes left by text extraction as the characters they name."""
    tail = "(" + "|".join(s.replace(".", "\\.") for s in GLYPH_SUFFIXES) + ")"
    c = reduce(lambda x, kv: F.regexp_replace(x, "/" + kv[0].replace(".", "\\.") + tail, kv[1].replace("$", "\\$")), GLYPH_NAMES.items(), c)
    return F.regexp_replace(F.regexp_replace(c, "glyph<[^>]*>", ""), "/([A-Z])\\.cap", "$1")


def count_glyphs(c: Column) -> Column:
    """How many codes clean_glyphs replaces."""
    return F.regexp_count(c, F.lit(_GLYPH)) + F.regexp_count(c, F.lit("glyph<[^>]*>")) + F.regexp_count(c, F.lit("/([A-Z])\\.cap"))


def glyph_corrections(c: Column, most: int = 30) -> Column:
    """The first ``most`` codes found, in order."""
    return F.slice(F.regexp_extract_all(c, F.lit(f"({_GLYPH}|glyph<[^>]*>|/[A-Z]\\.cap)"), F.lit(1)), 1, most)


# headings and tables ------------------------------------------------------------


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_likely_heading(c: Column) -> Column:
    """Short text that is numbered, in capitals, or under 50 characters with a capital first (X4); empty text is none."""
    first = F.substring(c, 1, 1)
    shaped = reduce(lambda a, p: a | c.rlike(p), HEADING_PATTERNS[1:], c.rlike(HEADING_PATTERNS[0]))
    return (c != "") & (F.length(c) <= 100) & (shaped | is_upper(c) | ((F.length(c) < 50) & is_upper(first)))


def infer_heading_level(c: Column) -> Column:
    """Level by numbering, 1 for capitals, else 2."""
    numbered = reduce(lambda x, p: x.when(c.rlike(p[0]), p[1]), LEVEL_PATTERNS[1:], F.when(c.rlike(LEVEL_PATTERNS[0][0]), LEVEL_PATTERNS[0][1]))
    return numbered.when(is_upper(c), 1).otherwise(2)


def detect_heading_level(c: Column, most: int = 6) -> Column:
    """Number of parts of a leading dotted number; null without one."""
    number = F.regexp_extract(c, "^\\s*(\\d+(?:\\.\\d+){0,10})[\\.\\s]+", 1)
    return F.when(number != "", F.least(F.size(F.split(number, "\\.")), F.lit(most)))


def header_score(cells: Column) -> Column:
    """Share of the cells that look like column titles, blank cells left out; null without any."""
    full = F.filter(F.transform(cells, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    named = lambda x: F.exists(F.array(*[F.lit(w) for w in TABLE_HEADER_WORDS]), lambda w: F.contains(x, w))
    brief = lambda x: (F.length(x) <= 10) & ~x.rlike("^\\d+$") & x.rlike("[\\p{L}]")
    score = F.aggregate(F.transform(full, lambda x: F.when(named(x), 1.0).when(brief(x), 0.5).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(full) > 0, score / F.size(full))


def is_table_header(cells: Column) -> Column:
    return F.coalesce(header_score(cells) > 0.6, F.lit(False))


def is_table_line(c: Column) -> Column:
    """At least two pipes."""
    return F.regexp_count(c, F.lit("\\|")) >= 2


def table_cells(c: Column) -> Column:
    """Cells of a piped line, outer pipes being optional (Q9)."""
    return F.transform(F.split(F.regexp_replace(F.trim(c), "^\\||\\|$", ""), "\\|"), lambda x: F.trim(x))


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table, the first as its header; rows without text are dropped."""
    kept = F.filter(rows, lambda r: F.exists(r, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.coalesce(F.trim(x), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(kept, F.lit(0)), lambda x: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(kept) == 0, "").otherwise(F.array_join(F.concat(F.array(line(F.get(kept, F.lit(0))), rule), F.transform(F.slice(kept, 2, 1 << 30), line)), "\n"))


def table_text(markdown: Column, blocks: Column, instead: bool) -> Column:
    """Markdown, the serialized blocks, or both with a line between."""
    text = F.array_join(blocks, "\n")
    both = text if instead else F.concat(F.coalesce(markdown, F.lit("")), F.lit("\nDescription of the table entities:\n"), text)
    return F.when(blocks.isNull(), F.coalesce(markdown, F.lit(""))).otherwise(both)


def ends_with_colon(text: Column, kind: Column) -> Column:
    """Text-like blocks that announce what follows."""
    return F.coalesce(kind.isin("paragraph", "text", "section_header", "page_header", "caption") & F.rtrim(text).endswith(":"), F.lit(False))


# chunks -------------------------------------------------------------------------


def with_titles(titles: Column, body: Column) -> Column:
    """Path titles, two line feeds and the body."""
    return F.when(F.size(titles) > 0, F.concat(F.array_join(titles, " > "), F.lit("\n\n"), body)).otherwise(body)


def body_text(content: Column) -> Column:
    """What follows the first blank line, or all."""
    at = F.locate("\n\n", content)
    return F.when(at > 0, F.substring(content, at + 2, F.length(content))).otherwise(content)


def without_titles(content: Column, titles: Column) -> Column:
    """Content without a leading full path, suffix of it or single title, if more than 20 characters remain (X11)."""
    n = F.size(titles)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(titles, k, F.greatest(n, F.lit(1))), " > "))
    heads = F.filter(F.concat(suffixes, titles), lambda t: (t != "") & F.startswith(content, t) & (F.length(content) - F.length(t) > 20))
    cut = F.substring(content, F.length(F.get(heads, F.lit(0))) + 1, F.length(content))
    return F.when((n > 0) & (F.size(heads) > 0), F.regexp_replace(cut, "^\\n{1,2}", "")).otherwise(content)


def without_repeated_titles(content: Column, titles: Column, least: int = 2) -> Column:
    """Content whose lines that are nothing but one of the titles or the joined path are left out, but for the first line, where more than ``least`` characters remain (X11): titles that a merge has left in mid text."""
    lines = F.split(content, "\n")
    path = F.array_join(titles, " > ")
    own = lambda x: F.array_contains(titles, F.trim(x)) | (F.trim(x) == path)
    kept = F.filter(lines, lambda x, i: (i == 0) | (F.trim(x) == "") | ~F.coalesce(own(x), F.lit(False)))
    out = F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")
    return F.when((F.size(titles) > 0) & (F.length(F.trim(out)) > least), out).otherwise(content)


def padded_markdown(rows: Column) -> Column:
    """Rows of cells as an aligned Markdown table, the first as its header: columns as wide as their widest cell, three at least, short rows filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda r, k: F.coalesce(F.trim(F.get(r, k)), F.lit(""))
    columns = F.sequence(F.lit(0), width - 1)
    wide = lambda k: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.length(cell(r, k)))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda k: F.rpad(cell(r, k), wide(k), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda k: F.repeat(F.lit("-"), wide(k) + 2)), "|"), F.lit("|"))
    return F.when((F.size(rows) == 0) | (width == 0), "").otherwise(F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, 1 << 30), line)), "\n"))


def overlap_length(prev: Column, cur: Column, most: int) -> Column:
    """Longest end of ``prev``, up to ``most``, with which ``cur`` begins; 0 if none."""
    limit = F.least(F.length(prev), F.length(cur), F.lit(most))
    sizes = F.when(limit > 0, F.sequence(limit, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(sizes, lambda k: F.right(prev, k) == F.left(cur, k)), F.lit(0)), F.lit(0))


def is_overlapping(prev: Column, cur: Column, window: int = 200, least: int = 50) -> Column:
    """The last and first min(200, ...) characters are the same, at least 50, and end in punctuation."""
    k = F.least(F.length(prev), F.length(cur), F.lit(window))
    tail = F.right(prev, k)
    return (k >= least) & (tail == F.left(cur, k)) & tail.rlike("[。！？；.!?;]$")


def without_overlap(prev: Column, cur: Column, most: int = 200) -> Column:
    return F.substring(cur, overlap_length(prev, cur, most) + 1, F.length(cur))


def is_included(prev: Column, cur: Column, most: int, least: int = 50) -> Column:
    """``cur`` begins with an end of ``prev`` of at least 50 characters."""
    near = F.right(prev, F.lit(2 * most))
    # such an end holds the first characters of ``cur``: only where it does are lengths tried
    return F.when(F.contains(near, F.left(cur, F.lit(least))) & (F.length(cur) >= least), overlap_length(near, cur, 2 * most) >= least).otherwise(False)


def overlap_text(text: Column, most: int, slack: int = 200, least: int = 50) -> Column:
    """What a following chunk repeats of ``text``: all of it if short; what follows the last blank line, or else the last punctuation with 50 characters behind it, of its last ``most`` + 200; else its last ``most``."""
    tail = F.right(text, F.least(F.length(text), F.lit(most + slack)))
    blank = F.length(tail) - F.length(F.substring_index(tail, "\n\n", -1))
    after_blank = F.substring_index(tail, "\n\n", -1)
    marks = "[" + OVERLAP_MARKS.replace(".", "\\.").replace("?", "\\?").replace("\n", "\\n") + "]"
    after_mark = F.regexp_extract(tail, f"(?s)^.*{marks}(.{{{least},}})$", 1)
    return F.when(F.length(text) <= most, text).when(blank > 0, after_blank).when(after_mark != "", after_mark).otherwise(F.right(text, F.lit(most)))


def overlap_text_first(text: Column, most: int, slack: int = 100) -> Column:
    """The older form: what follows the first punctuation of the last ``most`` + 100 characters."""
    tail = F.right(text, F.least(F.length(text), F.lit(most + slack)))
    marks = OVERLAP_MARKS.replace(".", "\\.").replace("?", "\\?").replace("\n", "\\n")
    hit = tail.rlike(f"[{marks}]")
    return F.when(F.length(text) <= most, text).when(hit, F.regexp_extract(tail, f"(?s)^[^{marks}]*[{marks}](.*)$", 1)).otherwise(F.right(text, F.lit(most)))


# replies ------------------------------------------------------------------------


def extract_option(c: Column) -> Column:
    """The option letter of a reply: a capital alone, any capital, a small letter alone, any small letter, else the reply (X19). Letters and digits of any script bound a word."""
    alone = lambda a: f"(?<![\\p{{L}}\\p{{N}}_])([{a}])(?![\\p{{L}}\\p{{N}}_])"
    tries = [alone("A-Z"), "([A-Z])", alone("a-z"), "([a-z])"]
    return F.coalesce(*[F.nullif(F.regexp_extract(c, t, 1), F.lit("")) for t in tries], c)


def yes_score(no: Column, yes: Column) -> Column:
    """Softmax of two logits, the share of yes."""
    return 1 / (1 + F.exp(no - yes))


def yes_score_logprobs(yes: Column, no: Column, missing: float = -10.0) -> Column:
    """The same from log probabilities, a missing one being -10."""
    y, n = F.exp(F.coalesce(yes, F.lit(missing))), F.exp(F.coalesce(no, F.lit(missing)))
    return y / (y + n)


def rerank_prompt(instruction: Column, query: Column, doc: Column, spaced: bool = False) -> Column:
    """Prompt of the reranker, with one or two line feeds between its parts."""
    gap = "\n\n" if spaced else "\n"
    return F.concat(F.lit("<Instruct>: "), instruction, F.lit(f"{gap}<Query>: "), query, F.lit(f"{gap}<Document>: "), doc)


def visible_metadata(metadata: Column) -> Column:
    """Metadata without the keys hidden from the model."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(*LLM_HIDDEN_KEYS))


def list_count(n: Column) -> Column:
    """Lists of an inverted-file index for ``n`` vectors."""
    k = F.when(n <= 10000, F.greatest(F.lit(1), F.floor(n / 50))).otherwise(F.floor(4 * F.sqrt(n)))
    return F.least(F.lit(65536), F.greatest(F.lit(1), k)).cast("int")
