from tessel.operators.retrieval import probe_count
from tessel.queries_docs import QUERIES


def test_recall_of_the_inverted_file(spark):
    sf = "/root/testdata/sf0.1"
    want, got = ({(r.query_id, r.node_id) for r in QUERIES[name](spark, sf).collect()} for name in ("rag_dense_topk", "rag_ivf_search"))
    assert len(want) == 400 and len(want & got) / len(want) >= 0.9


def test_probes_grow_with_the_lists():
    assert [probe_count(n) for n in (1, 10, 40, 4000)] == [10, 10, 25, 2500]
