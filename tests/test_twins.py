"""Every query with a DuckDB twin gives the twin's rows over whole tables."""

import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from credence.plans import catalogue

SF_DIR = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    yield con
    con.close()


def cell(v):
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, (float, Decimal)) or (isinstance(v, int) and not isinstance(v, bool)):
        return f"{float(v):.6f}"
    return str(v)


def table(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    found = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.collect(), df.columns) == table(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_without_twin_is_repeatable(spark, name):
    """Drawn rows and fitted predictions are the same in each run."""
    one, two = catalogue.QUERIES[name](spark, SF_DIR), catalogue.QUERIES[name](spark, SF_DIR)
    assert one.schema == two.schema
    assert table(one.collect(), one.columns) == table(two.collect(), two.columns)


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    def gone(name, *args, **kwargs):
        if name in ("corpus_pipeline", "credence.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kwargs)

    import builtins

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", gone)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalogue.QUERIES) and "candidate_topk" in entry.oracle_sql()
    sys.modules.pop("__spark_entry__", None)
