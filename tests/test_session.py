"""Shuffles are dealt by the rows of the tables, so that a task holds a bounded part of them."""

import pytest

from netloom import session
from netloom.plans.fixtures import Tables

PARTS, SIZE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def settings(spark):
    kept = {n: spark.conf.get(n, None) for n in (PARTS, SIZE)}
    spark.conf.unset(PARTS)
    spark.conf.set(SIZE, "64m")
    yield spark.conf
    for n, v in kept.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_more_rows_have_more_tasks(spark, settings, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    t = Tables(spark, "/root/testdata/sf0.001")
    dealt = t.boxes.repartition("image_id")
    assert int(settings.get(PARTS)) == -(-t.read("lineitem").count() // 500)
    assert dealt._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions() == int(settings.get(PARTS))
    assert int(settings.get(SIZE)) == session.TASK_BYTES


def test_finer_settings_stay(spark, settings):
    settings.set(PARTS, "77")
    settings.set(SIZE, "1m")
    session.deal(spark, 5 * session.TASK_ROWS)
    assert (settings.get(PARTS), settings.get(SIZE)) == ("77", "1m")
