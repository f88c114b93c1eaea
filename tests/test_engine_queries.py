"""Queries over the engine's projections against DuckDB on the smallest driver tables."""

import duckdb
import pytest

from ledgerline.plans.engine_queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(map(str, (tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows)))


@pytest.mark.parametrize("name", ["engine_sessions", "engine_encounters", "engine_actor_stats", "engine_resolver_states", "engine_session_summaries", "engine_link_conflicts"])
def test_projections_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(names) == columns and rows
    order = [names.index(c) for c in columns]
    assert plain(found.select(*columns).collect()) == plain([tuple(r[i] for i in order) for r in rows])
