"""Every query of the subpackage that has SQL gives what the SQL gives; the others run over the smallest tables."""

import os

import pytest

from oracle import compare, connection
from quern.llm import entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", entry.SQL)
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, entry, name, SF)


_SHARES = ["plan_id", "source", "target_share", "aimed_tokens", "tokens", "share", "share_of_aim", "most_repeats"]
COLUMNS = {
    "p2_found": ["page_id", "field"], "p2_restored": ["page_id", "field", "cipher", "text"], "p5_found": ["page_id", "line_no"], "p5_texts": ["page_id", "text", "n_lines"],
    "p8_containers": ["kind", "container_id", "doc_id", "piece_no", "tokens"], "p8_fill": ["kind", "containers", "tokens", "capacity_tokens", "fill"],
    "p9_selection": ["plan_id", "source", "doc_id", "tokens", "times"], "p9_shares": _SHARES, "p9_shares_held": _SHARES, "p9_tempered": _SHARES,
    "p10_found": ["doc_id"], "p10_levels": ["doc_id", "n_chars", "score", "level"],
}


@pytest.mark.parametrize("name", [n for n in entry.QUERIES if n not in entry.SQL])
def test_query_runs(spark, name):
    df = entry.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
