"""Which errors are usual doesn't depend on what workers hold."""

from tessel.llm.scans import Cut, usual_errors, vocabulary


def test_usual_errors_with_any_cache(spark):
    said = ["the next box holds six extra taxes", "six extra boxes quit the quiet square", "the quick taxes next quarter equal extra boxes", "资金清算账户余额对账", "账户余额查询说明"] * 4
    corpus = spark.createDataFrame([(t,) for t in said], "text string")
    scans = spark.createDataFrame([(t.replace("x", "k").replace("账", "胀"),) for t in said] * 2, "text string")

    def usual(grams):
        cut = Cut(spark)
        v, rare = vocabulary(corpus, grams, cut)
        return usual_errors(scans, spark.sparkContext.broadcast(v), rare, cut)

    want = usual(1000)
    assert any(x[1:] == ("k", "x") for x in want) and any(x[1:] == ("胀", "账") for x in want)
    assert usual(0) == want and usual(5) == want
