"""Pages that lack what a join looks for, and rows of one place, against the SQL."""

import duckdb

from foliograph import plans


def test_rectangles_of_pages_without_images(spark, tmp_path):
    duck = duckdb.connect()
    kinds = "CASE WHEN event_id < 40 THEN 'purchase' WHEN event_id % 2 = 0 THEN 'purchase' ELSE 'view' END"
    duck.execute(f"COPY (SELECT event_id, event_id % 7 AS user_id, {kinds} AS event_type FROM (SELECT unnest(range(0, 120)) AS event_id UNION ALL SELECT 42)) TO '{tmp_path}/events.parquet'")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(duck.execute(plans.SQL["joi19_uncovered_region"]).fetchall())
    got = sorted(tuple(r) for r in plans.QUERIES["joi19_uncovered_region"](spark, str(tmp_path)).collect())
    assert got == want and sum(r[0] == 0 for r in got) == 40 and len(got) > len({r[:2] for r in got})


def test_a_large_hole_is_filled_alike_in_any_portions(monkeypatch):
    import numpy as np

    from foliograph.operators import inpaint

    image = np.random.default_rng(2).integers(0, 256, (60, 70, 3)).astype(np.uint8)
    mask = np.zeros((60, 70), bool)
    mask[5:50, 8:66] = True
    mask[20:24, 30:40] = False
    whole = inpaint.fast_marching(image, mask)
    monkeypatch.setattr(inpaint, "CHUNK", 7)
    assert (inpaint.fast_marching(image, mask) == whole).all() and (whole[~mask] == image[~mask]).all()


def test_rows_are_ranked_in_ranges(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT CASE WHEN i % 3 = 0 THEN 'O' ELSE 'F' END AS l_linestatus, CAST(i * 7919 % 30011 // 2 AS BIGINT) AS l_orderkey, CAST(i % 5 AS INT) AS l_linenumber, i AS l_partkey, i % 11 AS l_suppkey FROM (SELECT unnest(range(0, 90000)) AS i)) TO '{tmp_path}/lineitem.parquet'")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = plans.QUERIES["srt06_even_sample"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == sorted(duck.execute(plans.SQL["srt06_even_sample"]).fetchall())
    ranking = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line and "Window" in line]
    assert ranking and all("range#" in line for line in ranking)
