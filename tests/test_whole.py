"""Registered queries that read whole tables and whole texts."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

SOURCES = "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 < 3 THEN 'gadm' || CAST(o_orderkey % 5 AS VARCHAR) END AS level, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'inactive' END AS status, o_orderdate AS since, o_orderkey AS seq FROM '{}/orders.parquet'"
WHOLE = {
    "latest_source_per_level": "SELECT id, level FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY since DESC, seq) AS n FROM ({})) WHERE n = 1 OR level IS NULL",
    "supersede_sources": "SELECT id, CASE WHEN level = 'gadm1' AND status = 'active' AND id <> '1' THEN 'inactive' ELSE status END AS status FROM ({})",
}


@pytest.mark.parametrize("name", list(WHOLE))
def test_sources_of_all_orders(spark, sf_dir, name):
    got = [tuple(r) for r in entry.queries()[name](spark, sf_dir).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(duckdb.sql(WHOLE[name].format(SOURCES.format(sf_dir))).fetchall(), key=key)


def test_repeats_are_told_by_whole_texts(spark, tmp_path):
    turns = [(1, 0, "user", "hello"), (1, 1, "user", "how are you"), (1, 2, "user", "how are you"), (1, 3, "assistant", "how are you"), (2, 0, "user", "hello"), (2, 1, "user", "hello ")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["consecutive_dedup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (1, 3), (2, 0), (2, 1)]
