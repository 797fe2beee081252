"""Joins over whole tables against plain Python."""

import datetime

import pytest

from vellum.plans import registry

ORDERS = [(1, datetime.date(2001, 1, 5), "F"), (2, datetime.date(2001, 2, 5), "O"), (4, datetime.date(2001, 5, 9), "F"), (7, datetime.date(2001, 9, 1), "O")]
PARTS = {1: "Ann Green", 2: "dr widget", 3: "red ring", 50: "small box"}
STAFF = {1: "Dr Ann Brown", 2: "Peter Ring"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("joins")
    made = {
        "orders": ([(i, 0, d, s, "1-URGENT") for i, d, s in ORDERS], "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string"),
        "part": ([(i, n, "BIG") for i, n in PARTS.items()], "p_partkey long, p_name string, p_type string"),
        "supplier": (list(STAFF.items()), "s_suppkey long, s_name string"),
    }
    for t in registry.TABLES:
        (spark.createDataFrame(*made[t]) if t in made else spark.range(1)).write.parquet(f"{at}/{t}.parquet")
    return str(at)


def test_months_of_all_cases(spark, sf):
    got = {r["month"]: (r["received"], r["completed"]) for r in registry.QUERIES["jn12_months_received_completed"](spark, sf).collect()}
    assert got == {"2001-01": (True, True), "2001-02": (True, False), "2001-05": (True, True), "2001-09": (True, False)}


def test_staff_of_the_whole_list(spark, sf):
    got = {r["p_partkey"]: r["is_staff"] for r in registry.QUERIES["jn02_staff_tokens"](spark, sf).collect()}
    assert got == {1: True, 2: False, 3: True, 50: False}
