"""Many of the catalog's queries against their SQL on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from meterloom import catalog
from meterloom.plans import health, logs, stores

DATA = "/root/testdata/sf0.001"
SAMPLE = (
    "event_adapter", "effectiveness_by_project", "rework_recurrence", "asof_model", "delta_counters", "restate_activity", "validate_records", "reconcile_scope",
    "reconcile_delta", "movers_project", "insights_going_stale", "insights_dormant_tools", "share_rays", "report_total", *logs.queries(), *health.queries(), *stores.queries(),
)


def plain(value):
    value = float(value) if isinstance(value, Decimal) else value
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", SAMPLE)
def test_query_gives_the_rows_of_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("events", "lineitem"):
        db.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = catalog.queries()[name](spark, DATA)
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda table: sorted((tuple(map(plain, r)) for r in table), key=repr)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_every_record_is_pushed(spark, tmp_path):
    """Also those of the member whose first push was refused, and those whose ids are below zero."""
    db = duckdb.connect()
    db.execute(f"copy (select * replace (event_id - 4 as event_id) from '{DATA}/events.parquet' where event_id < 40) to '{tmp_path}/events.parquet'")
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = catalog.queries()["push_whole"](spark, str(tmp_path))
    want = db.execute(catalog.oracle_sql()["push_whole"])
    columns = [c[0] for c in want.description]
    found = sorted(map(tuple, got.select(*columns).collect()))
    assert found == sorted(want.fetchall())
    assert sum(row[columns.index("n")] for row in found if not row[columns.index("member")].startswith("first-")) == 40
