"""The pipeline stage by stage, and the SQL counterparts of the queries, on the shared tables."""

import os

import pytest

import corpus_pipeline
from tests.compare import compare, connect
from tests.llm.test_operators import brute_components, brute_contamination, low
from tocsin.llm.common import table
from tocsin.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    rows = {i: t for i, t in rows.items() if not scores[i]}
    last = {low(t): i for i, t in sorted(rows.items())}
    rows = {i: rows[i] for i in last.values()}
    rows = {i: rows[i] for i, _, comp in brute_components(sorted(rows.items())) if i == comp}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    counts = {i: brute_contamination(t, items) for i, t in rows.items()}
    clean = {i for i, (n, hit, _) in counts.items() if not (hit and 20 * hit >= n)}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == clean
    assert len({r["sequence_id"] for r in out}) == -(-sum(r["length"] for r in out) // 4096)
