"""Incremental apply: batch results, idempotent re-runs, restart."""

import __spark_entry__ as entry
from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_apply_equals_batch_fold(spark):
    q = entry.queries()
    assert _rows(q["stream_apply"](spark, SF_SMALL)) == _rows(q["fold_positions"](spark, SF_SMALL))


def test_stateful_positions_equals_batch_fold(spark):
    q = entry.queries()
    assert _rows(q["stateful_positions"](spark, SF_SMALL)) == _rows(q["fold_positions"](spark, SF_SMALL))


def test_restart_from_checkpoint_equals_one_run(spark):
    q = entry.queries()
    assert _rows(q["resume"](spark, SF_SMALL)) == _rows(q["fold_positions"](spark, SF_SMALL))


def test_replayed_batch_is_a_no_op(spark):
    from pyspark.sql import functions as F

    from tallyray.plans import catalog as cat
    from tallyray.streaming.apply import POSITIONS_SCHEMA, VersionedState, make_batch_applier
    root, _ = cat._stream_source(spark, SF_SMALL, n_ranges=1)
    batch = spark.read.parquet(f"{root}/src/range=0000")
    apply = make_batch_applier(spark, root + "-state", cat._legs_of(spark, SF_SMALL))
    apply(batch, 0)
    st = VersionedState(spark, root + "-state", {"positions": POSITIONS_SCHEMA})
    first = _rows(st.read("positions"))
    apply(batch, 0)  # the same batch id again (a retried trigger)
    again = _rows(st.read("positions"))
    assert first == again and len(first) > 0
    assert batch.where(F.col("block_number") >= 0).count() > 0


def test_crash_before_pointer_keeps_previous_state(spark):
    """Data folders written but no pointer: readers still see the old state and
    the retried batch applies normally."""
    from tallyray.plans import catalog as cat
    from tallyray.streaming.apply import POSITIONS_SCHEMA, VersionedState, make_batch_applier
    root, _ = cat._stream_source(spark, SF_SMALL, n_ranges=2)
    st = VersionedState(spark, root + "-state", {"positions": POSITIONS_SCHEMA})
    apply = make_batch_applier(spark, root + "-state", cat._legs_of(spark, SF_SMALL))
    b0 = spark.read.parquet(f"{root}/src/range=0000")
    b1 = spark.read.parquet(f"{root}/src/range=0001")
    apply(b0, 0)
    after0 = _rows(st.read("positions"))
    # a half-finished batch 1: a data folder exists, the pointer was not moved
    st.read("positions").write.mode("overwrite").parquet(root + "-state/positions/v=1")
    assert st.current_version() == 0 and _rows(st.read("positions")) == after0
    apply(b1, 1)
    assert st.current_version() == 1


def test_unreadable_commit_is_an_error_and_none_is_no_state(spark, tmp_path):
    import pytest
    from tallyray.streaming.apply import VersionedState
    state = VersionedState(spark, str(tmp_path / "s"), {"t": "a long"})
    assert state.current_version() is None
    state.commit({"t": spark.range(3).selectExpr("id as a")}, 6)
    state.commit({"t": spark.range(4).selectExpr("id as a")}, 7)
    assert state.current_version() == 7
    (tmp_path / "s" / "_commits" / "n8" / "_temporary").mkdir(parents=True)  # a crash while a marker is written
    assert state.current_version() == 7
    (tmp_path / "s" / "_commits").chmod(0o755)
    part = next((tmp_path / "s" / "_commits" / "n7").glob("part-*"))
    part.with_name("part-broken.json.gz").write_bytes(b"no gzip")
    with pytest.raises(Exception):
        state.current_version()
