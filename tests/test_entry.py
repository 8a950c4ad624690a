import importlib
import re

import __spark_entry__ as entry
import pytest
from compare import SF, check

CORE = {k: v for m in entry._modules() if not m.__name__.startswith("siltstone.llm") for k, v in m.QUERIES.items()}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert set(CORE) <= set(q)
    present = any(m.__name__.startswith("siltstone.llm") for m in entry._modules())
    assert present == any(re.match(r"p\d_", k) for k in q)


def test_a_left_over_folder_is_no_package(monkeypatch):
    """A folder without modules, as a deleted package leaves behind, does not count as the package."""
    real = importlib.import_module

    def without(name):
        if name.startswith("siltstone.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", without)
    assert not any(re.match(r"p\d_", k) for k in entry.queries()) and len(entry.queries()) > 50


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_against_sql(spark, name):
    check(spark, name, CORE[name], entry.oracle_sql().get(name), SF)
