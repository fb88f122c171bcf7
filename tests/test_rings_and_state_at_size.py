"""Rows without a grid where they are few; state that is written once for many events."""

from unittest import mock

from pyspark.sql import Row

from foliograph.operators import relations as R
from foliograph.streaming.projects import ProjectState


def test_few_rows_meet_without_rings(spark):
    """A row in a corner went through all cells of the page."""
    rows = [(page, pos, "a", 900.0 * (pos % 2), 70.0 * pos, 900.0 * (pos % 2) + 2, 70.0 * pos + 2) for page in range(3) for pos in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, pos int, kind string, x1 double, y1 double, x2 double, y2 double")
    stored = []
    true = R.cut
    with mock.patch.object(R, "cut", lambda d: stored.append(1) or true(d)):
        got = R.nearest_in_rings(df, df, "kind")
    assert {(r.a_pos, r.b_pos, r.distance2, r.looked) for r in got.collect()} == {(p, p - 2 if p > 1 else p + 2, 140.0**2, 7) for p in range(8)} and got.count() == 24
    assert len(stored) == 1 and "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_value_is_written_once():
    """Each event wrote its own."""
    s = ProjectState(100)
    s.handle, s.images, s.known, s.approved, s.pointer, s.stage = (mock.MagicMock() for _ in range(6))
    s.pointer.exists.return_value = s.stage.exists.return_value = False
    s.images.get.return_value, s.approved.keys.return_value = iter([1, 2]), [(3,)]
    rows = [Row(kind=k, id=i, value=v, at=i) for i, (k, v) in enumerate([("approve", 3)] * 5 + [("stage", 2), ("stage", 4), ("discard", 4), ("stage", 5)])] + [Row(kind="image", id=i, value=0, at=9) for i in (20, 21, 20)]
    out = list(s.handleInputRows((7,), iter(rows), None))
    assert out == [Row(project=7, seq=1, images=2, approved="3", version=0, staged=5)]
    assert s.approved.updateValue.call_count == 1 and s.known.updateValue.call_count == 2 and not s.known.containsKey.called
    assert s.images.appendList.call_args.args[0] == [(20, "image_20"), (21, "image_21")] and s.stage.update.call_args_list == [mock.call((5, 108))]
    assert s.handle.registerTimer.call_args_list == [mock.call(108)] and not s.handle.deleteTimer.called
