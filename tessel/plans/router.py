"""Which tool answers a question: registry, rule router, batches, call log."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks a question for a tool; the first that matches wins, none means retrieval.
ROUTES = (
    ("calculator_tool", "计算|calculate|[0-9][0-9.]*\\s*[-+*/^×÷]\\s*[0-9(]|sqrt\\("),
    ("current_date_tool", "今天|现在几点|星期几|当前日期|today|current date"),
    ("exchange_rate_service", "汇率|兑换|exchange rate|convert"),
    ("credit_card_service", "信用卡.*账单|credit card"),
    ("utility_bill_service", "水费|电费|燃气|水电|utility"),
    ("user_assets_service", "资产|房产|assets"),
    ("payment_order_service", "支付订单|payment order"),
    ("nl2sql_tool", "交易|流水|商户|机构|账户|transaction|merchant|institution"),
)
RETRIEVAL = "rag"


def route(question: Column, content: Column | None = None) -> Column:
    """Name of the tool for each question; with choices in ``content`` a question goes to retrieval unless it computes."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = None
    for name, words in ROUTES:
        hit = q.rlike(words)
        if content is not None and name != "calculator_tool":
            hit = hit & (content.isNull() | (F.trim(content) == ""))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(RETRIEVAL)


def prompt_content(category: Column, content: Column) -> Column:
    """Choices count for choice questions only."""
    return F.when(category == "选择题", content)


@dataclass
class Call:
    tool: str
    arguments: dict[str, str]
    status_code: int
    duration: float
    timestamp: float
    type: str


#: The verbs of HTTP tools, and those that send their arguments as JSON.
VERBS, BODIED = ("GET", "POST", "PUT", "DELETE"), ("POST", "PUT")


@dataclass(frozen=True)
class Request:
    """What a connector sends: arguments in the query or as JSON, by the verb."""

    method: str
    url: str
    headers: dict[str, str]
    params: dict[str, Any] | None = None
    json: dict[str, Any] | None = None


def http_request(spec: dict, arguments: dict, headers: dict[str, str] | None = None) -> Request:
    """The request of a tool's call (S28): shared headers under the tool's own, JSON declared for bodies unless a header says otherwise. No URL or an unknown verb is a ValueError."""
    at = spec.get("http_config") or {}
    method, url = str(at.get("method") or "GET").upper(), at.get("url")
    if not url:
        raise ValueError(f"tool {spec.get('name')} has no URL")
    if method not in VERBS:
        raise ValueError(f"no HTTP method {method}")
    merged = {**(headers or {}), **(at.get("headers") or {})}
    if method in BODIED and "content-type" not in {k.lower() for k in merged}:
        merged["Content-Type"] = "application/json"
    return Request(method, url, merged, None if method in BODIED else arguments, arguments if method in BODIED else None)


@dataclass
class Registry:
    """Tools by name, local or over HTTP, and the log of their calls (L7). An HTTP tool is called through ``connector``, or as a Request through ``send``; without either it answers 503."""

    local: dict[str, Callable[..., Any]] = field(default_factory=dict)
    http: dict[str, dict] = field(default_factory=dict)
    log: list[Call] = field(default_factory=list)
    connector: Callable[[dict, dict], Any] | None = None
    send: Callable[[Request], Any] | None = None
    headers: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, f: Callable[..., Any]) -> None:
        self.local[name] = f

    def register_http(self, spec: dict) -> None:
        self.http[spec["name"]] = spec

    def call(self, name: str, arguments: dict) -> dict:
        at, kind = time.time(), "local" if name in self.local else "http"
        try:
            if name in self.local:
                status, result = 200, self.local[name](**arguments)
            elif name not in self.http:
                status, result = 404, f"no tool {name}"
            elif self.send is not None:
                status, result = 200, self.send(http_request(self.http[name], arguments, self.headers))
            elif self.connector is None:
                status, result = 503, "no connector"
            else:
                status, result = 200, self.connector(self.http[name], arguments)
        except Exception as x:  # noqa: BLE001 - a failing tool is an answer
            status, result = 500, str(x)
        self.log.append(Call(name, {k: str(v) for k, v in arguments.items()}, status, round(time.time() - at, 3), at, kind))
        return {"success": status == 200, "status_code": status, "result": result}

    def catalog(self) -> list[dict]:
        """Tools for a prompt: their HTTP settings left out, the kind added."""
        return [{"name": n, "type": "local"} for n in self.local] + [{k: v for k, v in s.items() if k != "http_config"} | {"type": "http"} for s in self.http.values()]


@dataclass(frozen=True)
class Reply:
    """A model's reply: text, or calls of tools as (name, arguments)."""

    text: str = ""
    calls: tuple[tuple[str, dict], ...] = ()


class Model(Protocol):
    """A language model (L6): messages {role, content} and the catalog of tools to a reply."""

    def __call__(self, messages: list[dict], tools: list[dict]) -> Reply: ...


def stream(model: Model, messages: list[dict]) -> Iterator[str]:
    """A model without streaming yields its whole text once."""
    yield model(messages, []).text


def rule_model(messages: list[dict], tools: list[dict]) -> Reply:
    """The offline stand-in: the first tool of ROUTES that the question matches and the catalog has is called with the question, its result is the text; without one the text is empty."""
    if messages[-1]["role"] == "tool":
        return Reply(str(messages[-1]["content"]))
    question, known = messages[-1]["content"], {t["name"] for t in tools}
    name = next((n for n, words in ROUTES if n in known and re.search(words, question.lower())), None)
    return Reply(calls=((name, {"query": question}),)) if name else Reply()


@dataclass(frozen=True)
class Outcome:
    """code 0 for an answer, 1 for none without a tool, which goes to retrieval."""

    code: str
    success: bool
    response: Any
    calls: list[dict]
    rounds: int


def converse(question: str, model: Model, registry: Registry, most_rounds: int = 5, direct: tuple[str, ...] = ("nl2sql_tool",), fallback: Callable[[str], Any] | None = None) -> Outcome:
    """Up to ``most_rounds`` rounds of a model and the tools it calls (L8). A call of a ``direct`` tool gets the question itself, whatever the model's arguments, and its result is the answer. After the last round the model is asked once more, without tools. A question that no tool was called for goes to ``fallback``; without one its code is 1. A failing model is no success."""
    messages: list[dict] = [{"role": "user", "content": question}]
    done: list[dict] = []
    try:
        for turn in range(1, most_rounds + 1):
            reply = model(messages, registry.catalog())
            if not reply.calls:
                if done or reply.text and fallback is None:
                    return Outcome("0" if done else "1", True, reply.text, done, turn)
                return Outcome("1", True, reply.text, done, turn) if fallback is None else Outcome("0", True, fallback(question), done, turn)
            messages.append({"role": "assistant", "content": reply.text, "calls": reply.calls})
            for name, arguments in reply.calls:
                short = name in direct
                got = registry.call(name, {"query": question} if short else arguments)
                done.append({"tool_name": name, "arguments": {"query": question} if short else arguments, "success": got["success"], "type": "local" if name in registry.local else "http"})
                if short:
                    return Outcome("0", got["success"], got["result"], done, turn)
                messages.append({"role": "tool", "content": got["result"]})
        return Outcome("0", True, model(messages, []).text, done, most_rounds)
    except Exception as x:  # noqa: BLE001 - a failing model is an outcome
        return Outcome("0" if done else "1", False, str(x), done, len(done))


def within(seconds: float, f: Callable[..., Any], empty: Any = "") -> Callable[..., Any]:
    """``f`` as a client with a time limit: its result, or ``empty`` if it fails or takes longer."""
    from concurrent.futures import ThreadPoolExecutor

    def call(*args: Any) -> Any:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(f, *args).result(timeout=seconds)
        except Exception:  # noqa: BLE001 - a failing service is an empty result
            return empty
        finally:
            pool.shutdown(wait=False)

    return call


def call_statistics(log: DataFrame) -> DataFrame:
    """total_calls, unique_tools, calls by tool, local and http calls, average duration to two places; zeros for an empty log (A5)."""
    per = log.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    by = per.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool", "n"))), lambda x: F.concat(x["tool"], F.lit("="), x["n"].cast("string"))), ";"), F.lit("")).alias("calls_by_tool"), F.count(F.lit(1)).alias("unique_tools"))
    all_ = log.agg(F.count(F.lit(1)).alias("total_calls"), F.count_if(F.col("type") == "local").alias("local_calls"), F.count_if(F.col("type") == "http").alias("http_calls"), F.coalesce(F.round(F.avg("duration"), 2), F.lit(0.0)).alias("average_duration"))
    return all_.withColumns({c: by.select(c).scalar() for c in ("calls_by_tool", "unique_tools")})


def batch_numbers(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds batch, numbering rows in order by ``size`` (T12); places come from range partitions, so no task sorts all rows."""
    from tessel.operators.ranking import ranks_in_groups

    return ranks_in_groups(df.withColumn("_all", F.lit(0)), ["_all"], order, "_at").withColumn("batch", F.floor(F.col("_at") / size)).drop("_all", "_at")


def answer_batch(questions: DataFrame, answers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(segments, paper, id, tool, answer) for all questions: split by tool, each answered as a set, failures as empty answers, keyed by id so that order can't be lost (L11, Q22). ``answers`` maps tools to (id, question, content) -> (id, answer)."""
    q = questions.withColumn("tool", route(F.col("question"), prompt_content(F.col("category"), F.col("content"))))
    out = None
    for name, f in answers.items():
        mine = f(q.where(F.col("tool") == name).select("id", "question", "content")).select("id", "answer")
        out = mine if out is None else out.unionByName(mine)
    base = q.select("segments", "paper", "id", "tool")
    return base.join(out, "id", "left").withColumn("answer", F.coalesce("answer", F.lit(""))) if out is not None else base.withColumn("answer", F.lit(""))


def last_results(messages: DataFrame, n: int = 3) -> DataFrame:
    """(chat, answer): the last ``n`` messages of each chat joined in order."""
    w = Window.partitionBy("chat").orderBy(F.col("seq").desc())
    last = messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return last.groupBy("chat").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n").alias("answer"))


