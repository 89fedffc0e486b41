import hashlib

import pytest

from larkspur.operators import graph

HASHES = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(3000)]


@pytest.mark.parametrize(
    "ids", [["a"], ["a", "a"], ["a", None], ["abcdef1", "abcdef2", "b"], [*HASHES], ["0" * 39 + "1", "0" * 39 + "2"], ["0" * 36 + "1", "0" * 35 + "11"]]
)
def test_prefix_length_counts_one_prefix_at_a_time(spark, ids, monkeypatch):
    count = len(ids)
    apart = [n for n in range(4, 41, 2) if None not in ids and len({i[:n] for i in ids}) == count]
    want = 4 if count <= 1 else min(40, apart[0] + 2) if apart else 40
    monkeypatch.setattr(graph.F, "count_distinct", None)  # all prefixes of every id at once
    assert graph.prefix_length(spark.createDataFrame([(i,) for i in ids], "id string")) == want
