"""Every registered query of the library beside its DuckDB text at the smallest size."""

import pytest

from check_oracle import compare
from panelwright.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert compare(frame, duck, ORACLES[name]) == ""
    else:
        assert frame.columns and frame.count() > 0
