import pytest
from pyspark.sql import Row

from tessel.plans.router import Registry, Reply, answer_batch, converse, http_request, rule_model, stream, within
from tessel.plans.sql import CannotTranslate, NotAllowed, ask, clean_statement, generate, guard, reading_session, run_statement, shape_answer, to_spark


@pytest.mark.parametrize("sql", ["SELECT 1", "WITH a AS (SELECT 1 x) SELECT * FROM a", "SELECT a, count(*) FROM t GROUP BY a HAVING count(*) > 1 ORDER BY a LIMIT 3", "SELECT 1 UNION SELECT 2", "SELECT sum(a) OVER (PARTITION BY b), if(a > 1, date_add(c, 2), NULL), a RLIKE 'x' FROM t WHERE a IN (SELECT b FROM u) AND EXISTS (SELECT 1)", "SELECT * FROM range(3)"])
def test_guard_lets_reading_pass(spark, sql):
    guard(spark, sql)


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SET x = 1", "DELETE FROM t", "SHOW TABLES", "nonsense", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT 1 WHERE EXISTS (SELECT java_method('java.lang.System', 'exit', 0))", "WITH a AS (SELECT try_reflect('java.lang.System', 'getProperty', 'x') AS x) SELECT * FROM a", "SELECT (SELECT max(reflect('a', 'b')) FROM t)", "SELECT my_udf(1)", "SELECT spark_catalog.default.f(1)", "SELECT a FROM t ORDER BY reflect('a', 'b')", "SELECT * FROM t JOIN u ON t.a = reflect('a', 'b')", "SELECT sum(x) OVER (PARTITION BY reflect('a', 'b')) FROM t", "SELECT a FROM t WHERE a IN (SELECT input_file_name() FROM t)", "SELECT * FROM (SELECT transform(array(1), x -> reflect('a', 'b')))"])
def test_guard_stops_the_rest(spark, sql):
    with pytest.raises(NotAllowed):
        guard(spark, sql)


def test_cleaning_keeps_literals_and_with():
    assert clean_statement("SELECT 'a;  b' AS x;  rest") == "SELECT 'a;  b' AS x;"
    assert clean_statement("```sql\nWITH t AS (SELECT 1) SELECT * FROM t;\n```").startswith("WITH t AS")
    assert clean_statement("SELECT 'GROUP BY' FROM `t`") == "SELECT 'GROUP BY' \nFROM t".replace(" \n", "\n")


def test_dialect():
    assert to_spark("SELECT a FROM t LIMIT 5, 10") == "SELECT a FROM t LIMIT 10 OFFSET 5"
    assert "LIMIT 1, 2" in to_spark("SELECT 'LIMIT 1, 2'")
    assert to_spark("SELECT DATE_FORMAT(ts, '%Y-%m') FROM t") == "SELECT DATE_FORMAT(ts, 'yyyy-MM') FROM t"
    assert to_spark("SELECT JSON_UNQUOTE(JSON_EXTRACT(p, '$.k')), p->>'$.k', p -> '$.j' FROM t") == "SELECT get_json_object(p, '$.k'), get_json_object(p, '$.k'), get_json_object(p, '$.j') FROM t"
    assert to_spark("SELECT a FROM t WHERE a REGEXP '^x' AND b NOT REGEXP 'y->>z'") == "SELECT a FROM t WHERE a RLIKE '(?i)^x' AND b NOT RLIKE '(?i)y->>z'"
    assert "octet_length(x)" in to_spark("SELECT LENGTH(x), CHAR_LENGTH(x)")


def test_division_by_zero_is_null_only_there(spark):
    s = reading_session(spark)
    assert run_statement(s, "SELECT 1 / 0 AS x").first().x is None
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_shapes():
    assert shape_answer([]) == "无结果"
    assert shape_answer([Row(n=0)]) == "0"
    assert shape_answer([Row(a="T1", b=2)]) == "['T1', '2']"
    assert shape_answer([Row(a=1, b=2), Row(a=3, b=4)]) == "[['1', '2'], ['3', '4']]"


def test_question_to_answer(spark):
    s = reading_session(spark)
    t = s.createDataFrame([("T1", "I1", "REFUND", 5.0, "2024-01-02"), ("T2", "I1", "REFUND", 7.0, "2024-01-03"), ("T3", "I2", "REFUND", 9.0, "2024-01-04")], "transaction_id string, institution_id string, transaction_type string, transaction_amount double, transaction_time string")
    i = s.createDataFrame([("I1", "机构18"), ("I2", "机构2")], "institution_id string, institution_name string")
    a = ask(s, "机构18最近两笔退款的流水号和金额", {"transaction_flow": t, "institution_info": i})
    assert a.answer == "[['T2', '7.0'], ['T1', '5.0']]" and "LIMIT 2" in a.sql_query
    assert a.complete and not ask(s, "latest 2 refund", {"transaction_flow": t}, most_rows=1).complete
    with pytest.raises(CannotTranslate):
        generate("what is the meaning of life")


def test_registry_and_batch(spark):
    r = Registry()
    r.register("add", lambda a, b: a + b)
    r.register_http({"name": "fx", "http_config": {"url": "u"}, "parameters": {}})
    assert r.call("add", {"a": 1, "b": 2})["result"] == 3
    assert [r.call("fx", {})["status_code"], r.call("none", {})["status_code"], r.call("add", {})["status_code"]] == [503, 404, 500]
    assert "http_config" not in r.catalog()[1]
    q = spark.createDataFrame([("s", "p", 1, "问答题", "3*4 等于多少", None), ("s", "p", 2, "选择题", "商户的定义", "A. x"), ("s", "p", 3, "问答题", "商户有几家", "dropped")], "segments string, paper string, id int, category string, question string, content string")
    out = answer_batch(q, {"calculator_tool": lambda d: d.selectExpr("id", "'12' answer"), "rag": lambda d: d.selectExpr("id", "content answer")}).collect()
    assert {x.id: (x.tool, x.answer) for x in out} == {1: ("calculator_tool", "12"), 2: ("rag", "A. x"), 3: ("nl2sql_tool", "")}


def test_rounds_of_tools():
    r = Registry()
    r.register("calculator_tool", lambda query: query.split()[-1])
    r.register("nl2sql_tool", lambda query: f"rows of {query}")
    assert converse("calculate 1+1", rule_model, r).response == "1+1" and list(stream(rule_model, [{"role": "tool", "content": "x"}])) == ["x"]
    assert converse("hello", rule_model, r).code == "1" and converse("hello", rule_model, r, fallback=lambda q: q.upper()).response == "HELLO"
    # the model's arguments are overridden, its result ends the rounds
    got = converse("all merchants", lambda m, t: Reply(calls=(("nl2sql_tool", {"query": "other"}),)), r)
    assert (got.response, got.rounds, got.calls[0]["arguments"]) == ("rows of all merchants", 1, {"query": "all merchants"})
    loop = converse("q", lambda m, t: Reply(calls=(("calculator_tool", {"query": "a b"}),)) if t else Reply("end"), r)
    assert (loop.rounds, len(loop.calls), loop.response) == (5, 5, "end")
    assert not converse("q", lambda m, t: 1 / 0, r).success
    assert within(5, lambda x: x + 1)(1) == 2 and within(5, lambda x: x / 0, "none")(1) == "none"


def test_http_requests():
    spec = {"name": "t", "http_config": {"url": "http://x", "method": "post", "headers": {"B": "2"}}}
    q = http_request(spec, {"a": 1}, {"A": "1", "B": "1"})
    assert (q.method, q.json, q.params, q.headers) == ("POST", {"a": 1}, None, {"A": "1", "B": "2", "Content-Type": "application/json"})
    assert http_request({"http_config": {"url": "u"}}, {"a": 1}).params == {"a": 1}
    for bad in ({"name": "t"}, {"http_config": {"url": "u", "method": "PATCH"}}):
        with pytest.raises(ValueError):
            http_request(bad, {})
    r = Registry(send=lambda q: q.method, headers={"K": "v"})
    r.register_http(spec)
    assert r.call("t", {})["result"] == "POST"


def test_questions_at_the_terminal():
    from tessel.__main__ import questions

    assert list(questions([" a \n", "\n", "b", "Exit", "c"])) == ["a", "b"] and list(questions(["退出"])) == []
