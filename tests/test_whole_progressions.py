import os

import pytest

from larkspur.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_every_record_has_a_place(spark):
    every = {r.id for r in catalog.queries()["progression"](spark, DATA).collect()}
    placed = [(r.id, r.place) for r in catalog.queries()["progressions_latest_first"](spark, DATA).collect()]
    assert {i for i, _ in placed} == every and len(placed) == len(every)
    assert sum(p == 1 for _, p in placed) > 1
