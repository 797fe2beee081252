"""Every query of the engine's own operators against its check SQL at the smallest scale, and the quality gate."""

import math

import duckdb
import pytest

from vellum.plans import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_check_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    r = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(norm(dict(zip(names, row, strict=True))[c]) for c in cols) for row in r.fetchall()), key=str)
    assert cols == sorted(names)
    assert got == want


def test_name_quality_gate(spark):
    r = registry.name_quality(spark, "/root/testdata/sf0.01").first()
    assert r["recall"] >= 0.97 and r["prec"] >= 0.99


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
