"""How often stored-result queries work out their input, on rows of their own."""

import datetime as dt

import pytest

from frostline.catalog import storage
from frostline.functions import clean

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string, l_shipdate timestamp"
ORDER = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"


@pytest.fixture()
def orders_of(spark, tmp_path):
    """A folder with one line item per (customer, nation, part name)."""
    def make(rows):
        day, n = dt.datetime(2000, 1, 1), range(len(rows))
        for name, schema, found in (
                ("lineitem", LINE, [(i, i, 1, "F", day) for i in n]), ("orders", ORDER, [(i, i, day, "1-URGENT") for i in n]),
                ("customer", "c_custkey long, c_nationkey int, c_acctbal double", [(i, rows[i][0], 0.0) for i in n]),
                ("part", "p_partkey long, p_name string", [(i, rows[i][1]) for i in n])):
            spark.createDataFrame(found, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def test_streets_are_parsed_once(spark, orders_of):
    folder = orders_of([(1, "red  bolt"), (2, "red bolt"), (23, "red bolt"), (3, None), (4, "blue, nut"), (5, " tiny gear ")])
    found = storage.c16_streets(spark, folder)
    assert [tuple(r) for r in found.collect()] == [("RED BOLT", 2), ("TINY GEAR", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert clean.ADDRESS_PATTERN in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and clean.ADDRESS_PATTERN in line]


@pytest.mark.parametrize("name", ["s11", "s11_rerun", "s10"])
def test_requests_are_joined_once_for_fit_score_and_records(spark, monkeypatch, name):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    day = dt.datetime(2000, 1, 1)
    rows = [("Ward 1", day, day + dt.timedelta(hours=1)), ("Ward 1", day, day + dt.timedelta(hours=4)), ("Ward 1", day, None), (None, None, day)]
    schema = "ward string, add_ts timestamp, due_ts timestamp, resolved_ts timestamp"
    frame = spark.createDataFrame([(w, a, day, r) for w, a, r in rows], schema).mapInArrow(counted, schema)
    monkeypatch.setattr(storage, "timed", lambda *_: clean.with_lateness(frame))
    found = getattr(storage, name)(spark, "").collect()
    assert seen.value == len(rows)
    if name == "s10":
        assert [(r["ward"], r["y_pred"], r["n"]) for r in found] == [("Ward 1", 2.5, 2)]
    else:
        assert sorted((r["stage"], r["n"], r["mae"]) for r in found) == [("evaluate", 2, 1.5), ("train", 2, 1.5)]
