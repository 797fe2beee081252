"""Orders of all cases against plain Python sorting."""

import datetime

import pytest

from vellum.plans import registry

DAYS = [datetime.date(2001, 1, 1) + datetime.timedelta(days=i * 7 % 11) for i in range(500)]
STATUS = ["F" if i % 4 else "O" for i in range(500)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cases")
    orders = [(i, i % 90, None if i == 77 else DAYS[i], STATUS[i], "1-URGENT") for i in range(500)]
    for t in registry.TABLES:
        made = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string") if t == "orders" else spark.range(1)
        made.write.parquet(f"{at}/{t}.parquet")
    return str(at)


def completed(i):
    return None if i == 77 else DAYS[i] + datetime.timedelta(days=i % 90 % 45)


@pytest.mark.parametrize(
    ("name", "column", "day", "has"),
    [
        ("srt01_cases_by_created", "received", lambda i: None if i == 77 else DAYS[i], lambda i: True),
        ("srt06_turnaround_order", "completed", completed, lambda i: STATUS[i] == "F"),
        ("srt08_newest_cases", "received", lambda i: None if i == 77 else DAYS[i], lambda i: i % 10 != 0),
    ],
)
def test_every_case_has_its_place(spark, sf, name, column, day, has):
    kept = sorted(filter(has, range(500)), key=lambda i: (-(day(i) or datetime.date.min).toordinal(), i))
    got = {r["place"]: (r["id"], r[column]) for r in registry.QUERIES[name](spark, sf).collect()}
    assert got == {n + 1: (i, day(i)) for n, i in enumerate(kept)}
