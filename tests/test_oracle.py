"""Every registered query of the panel library against its SQL twin, on the smallest tables."""

import pytest
from conftest import SMALL, same
from ticklane.plans import registry

ORACLE = registry.oracle_sql()
ROWS_ONLY = sorted(set(registry.queries()) - set(ORACLE))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    same(duck, registry.queries()[name](spark, SMALL), ORACLE[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_runs(spark, name):
    """Models and sources, which SQL cannot say: rows, and what must hold of them."""
    frame = registry.queries()[name](spark, SMALL)
    rows = frame.collect()
    assert rows
    for r in rows:
        for k, v in r.asDict().items():
            if k in ("roc_auc", "average_precision", "precision", "recall", "f1", "hit_rate", "coverage") and v is not None:
                assert 0 <= v <= 1, (k, v)


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
