import os

import pytest

from quillstream.llm import queries as Q

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_runs(spark, name):
    df = Q.QUERIES[name](spark, D)
    assert df.collect() is not None
    assert all(k not in ("void",) for _, k in df.dtypes)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_columns(spark):
    want = {
        "p1_found": ["ref_id", "nlmid"], "p3_found": ["origin", "item_id"], "p4_found": ["vec_a", "vec_b"], "p5_found": ["paper_id", "line_no", "kind"],
        "p6_found": ["pmid", "cite_id"], "p7_found": ["kind", "name_a", "name_b"], "p10_found": ["doc_id"],
    }
    for name, columns in want.items():
        assert Q.QUERIES[name](spark, D).columns == columns
