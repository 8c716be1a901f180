"""Checkpoint folder and persisted frames."""

import pytest

from retentio import session


def test_only_local_masters_fall_back_to_a_local_folder():
    assert session.local_fallback("local[4]") and session.local_fallback("local")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x", ""):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.local_fallback(master)


def test_persisted_frames_are_released(spark):
    df = session.keep(spark.range(10))
    df.count()
    assert df.storageLevel.useMemory
    session.release()
    assert not df.storageLevel.useMemory


def test_broadcast_only_what_was_counted_small(spark, monkeypatch):
    assert "broadcast" in session.small_side(spark.range(3))._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 2)
    assert "broadcast" not in session.small_side(spark.range(3))._jdf.queryExecution().logical().toString().lower()


def test_settings_of_a_query_are_put_back(spark):
    from retentio.session import configure, set_for_query
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    set_for_query(spark, key, "123")
    set_for_query(spark, key, "7")
    assert spark.conf.get(key) == "7"
    configure(spark)
    assert spark.conf.get(key) == before
