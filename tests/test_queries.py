"""Every query of the library runs and, where it has SQL, gives what DuckDB gives."""

import numpy as np
import pytest

from tests.oracle import connect, same
from tonewright.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        assert same(got, duck.sql(registry.ORACLES[name]).df())
    else:  # its values are held against known answers in the other tests
        again = registry.QUERIES[name](spark, sf)
        assert len(got) and list(got.columns) == list(again.columns)
        assert all(got[c].notna().any() for c in got.columns)
        assert same(got, again.toPandas())  # whatever order rows come in
        keys = [c for c in ("song_id", "stem", "track", "k") if c in got.columns]
        assert got[keys].notna().all().all() and not got.duplicated(keys).any()
        assert set(got["song_id"]) == {r[0] for r in duck.sql("SELECT DISTINCT user_id % 10 FROM events").fetchall()}
        numbers = got.select_dtypes("number")
        assert np.isfinite(numbers.to_numpy(dtype=float)[numbers.notna().to_numpy()]).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
