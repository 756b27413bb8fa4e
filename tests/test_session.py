"""Results kept by pair and image versions, map axes, subsets and rebuilt points, fields from a stream."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid.operators import points
from shiftgrid.plans import api
from shiftgrid.streaming import series
from tests.test_tracking import pixels, texture

SMALL = dict(chip_size=8, chip_size_max=8, search_radius=5, grid_spacing=8, preprocess="none", quantize="none", upsampling=8)


def pairs_of(spark, *names):
    return spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in (n.split() for n in names)], "pair_id string, ref_id string, sec_id string")


def test_only_pairs_of_changed_images_are_tracked_again(spark):
    v = texture(60, 60, 1)
    at = lambda name, dy, dx: pixels(spark, np.roll(v, (dy, dx), (0, 1)), name)
    s = api.Session((60, 60), **SMALL).add(at("a", 0, 0).unionByName(at("b", 1, 2)).unionByName(at("c", 2, 3)))
    all_ = pairs_of(spark, "a b", "b c", "a c")
    first = {(r.pair_id, r.gi, r.gj): (r.dx, r.dy) for r in s.field(all_).collect()}
    assert s.tracked_pairs == 3
    assert {(r.pair_id, r.gi, r.gj): (r.dx, r.dy) for r in s.field(all_).collect()} == first and s.tracked_pairs == 0
    assert s.field(pairs_of(spark, "b c")).select("pair_id").distinct().count() == 1 and s.tracked_pairs == 0
    s.add(at("c", -2, 1), replace=True)
    second = {(r.pair_id, r.gi, r.gj): (r.dx, r.dy) for r in s.field(all_).collect()}
    assert s.tracked_pairs == 2 and second.keys() == first.keys()
    assert all(second[k] == first[k] for k in first if k[0] == "a-b")
    ok = [d for k, d in second.items() if k[0] == "a-c" and d[0] is not None]
    assert len(ok) > 5 and all(abs(d[0] + 1) < 0.3 and abs(d[1] - 2) < 0.3 for d in ok)
    s.add(at("c", 9, 9))  # known, and not replaced
    s.field(all_)
    assert s.tracked_pairs == 0
    for k in range(9):  # many small additions: results end in one table again
        s.add(at("c", -2, k % 3), replace=True)
        s.field(all_)
        assert s.tracked_pairs == 2
    assert len(s._fields) <= 8 and s.field(all_).count() == len(first)


def axes_of(spark, **changes):
    rows = [dict(image_id=i, axis=a, origin=o, step=st, ascending=st > 0, regular=True, crs="EPSG:3413") | changes.get(f"{i}_{a}", {}) for i in ("a", "b") for a, o, st in (("X", 500.0, 30.0), ("Y", 900.0, -15.0))]
    return spark.createDataFrame([tuple(r.values()) for r in rows], "image_id string, axis string, origin double, step double, ascending boolean, regular boolean, crs string")


def test_velocities_on_map_axes(spark):
    v = texture(60, 60, 2)
    a, b = pixels(spark, v, "a"), pixels(spark, np.roll(v, (1, 2), (0, 1)), "b")
    run = lambda axes, **k: api.track_raster(a, b, axes, (60, 60), **(SMALL | k)).collect()
    north = run(axes_of(spark), dt=dt.timedelta(days=365.25 / 2))
    ok = [r for r in north if r.vx is not None]
    assert len(ok) > 5 and all(abs(r.vx - 2 * 30 * 2) < 8 and abs(r.vy + 1 * 15 * 2) < 4 for r in ok)  # it moved right and down
    assert all((r.map_x, r.map_y, r.crs) == (500 + (r.x - 1) * 30, 900 - (r.y - 1) * 15, "EPSG:3413") for r in north)
    south = run(axes_of(spark, a_Y=dict(step=15.0, ascending=True), b_Y=dict(step=15.0, ascending=True)), dt=0.5)
    assert {(r.gi, r.gj): r.vy for r in south if r.vy is not None} == {(r.gi, r.gj): -r.vy for r in ok}
    still = run(axes_of(spark), rotate=False)
    assert {(r.gi, r.gj): r.dx for r in still if r.dx is not None} == {(r.gi, r.gj): -r.vx / 60 for r in ok}
    for wrong, message in ((dict(b_X=dict(origin=501.0)), "not on one grid"), (dict(b_Y=dict(crs="EPSG:1")), "coordinate systems"), (dict(b_Y=dict(axis="Z")), "one axis"), (dict(a_X=dict(regular=False), b_X=dict(regular=False)), "regular")):
        with pytest.raises(Exception, match=message):
            run(axes_of(spark, **wrong), dt=0.5)
    assert run(axes_of(spark, a_X=dict(regular=False), b_X=dict(regular=False)))  # pixels need no size
    with pytest.raises(Exception, match="dt"):
        run(axes_of(spark), dt=-1)


def test_subsets_and_rebuilt_points(spark):
    pts = points.gridpoints(spark, (80, 80), 8, 8, search_radius=4)
    every = {(r.gi, r.gj): r for r in pts.collect()}
    got = {(r.gi, r.gj): r for r in points.subset(pts, [4, 2, 2], [3, 1]).collect()}
    assert {k: (r.x, r.y) for k, r in got.items()} == {(i, j): (every[a, b].x, every[a, b].y) for i, a in enumerate((4, 2, 2), 1) for j, b in enumerate((3, 1), 1)}
    assert sorted(r.pt_id for r in got.values()) == list(range(6))
    for bad in ([0], [], [1.5], [True]):
        with pytest.raises(ValueError, match="indices"):
            points.subset(pts, bad)
    with pytest.raises(Exception, match="beyond"):
        points.subset(pts, [99, 1]).collect()
    given = pts.select("pair_id", "pt_id", (F.col("pt_id") * 1.0).alias("dy_prior"))
    out = points.rebuild(pts, radius_y=7, x=F.col("x") + 2, dy_prior=given).collect()
    assert out[0].asDict().keys() == set(pts.columns) and all((r.radius_y, r.x, r.dy_prior) == (7, every[r.gi, r.gj].x + 2, float(r.pt_id)) for r in out)
    with pytest.raises(ValueError, match="colour"):
        points.rebuild(pts, colour=1)
    for bad, message in ((dict(chip_x=2.5), "whole"), (dict(x=F.lit(None)), "missing"), (dict(dy_prior=given.where("pt_id > 3")), "one to one"), (dict(dy_prior=given.union(given)), "one to one")):
        with pytest.raises(Exception, match=message):
            points.rebuild(pts, **bad).collect()


def test_a_stream_of_fields_survives_a_restart(spark, tmp_path):
    v = texture(60, 60, 3)
    names = ["a", "b", "c", "d"]
    s = api.Session((60, 60), **SMALL)
    for k, n in enumerate(names):
        s.add(pixels(spark, np.roll(v, (k, -k), (0, 1)), n))
    kind = "site string, image_id string, acq_ts timestamp"
    day = lambda k: dt.datetime(2024, 1, 1 + k)
    arrive = lambda *rows: spark.createDataFrame([("s", n, day(k)) for n, k in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls = []

    def field_of(pairs):
        calls.append(1)
        if len(calls) == 2:  # dies in the middle of the second batch, once
            raise RuntimeError("lost")
        return s.track(pairs.select("pair_id", "ref_id", "sec_id"))

    def run():
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        series.write_fields(series.stream_pairs_by_batch(stream, "10 days"), field_of, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    arrive(("a", 0), ("b", 1))
    run()
    arrive(("c", 2), ("d", 3))
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    got = series.read_fields(spark, str(tmp_path / "out"))
    want = s.track(pairs_of(spark, "a b", "b c", "c d"))
    row = lambda df: sorted((r.pair_id, r.gi, r.gj, str(r.dx), str(r.dy)) for r in df.collect())
    assert row(got) == row(want)


def test_idle_sites_begin_anew(spark, tmp_path):
    kind = "site string, image_id string, acq_ts timestamp"
    out = []

    def run(*rows):
        spark.createDataFrame([(x, n, dt.datetime(2024, 1, d)) for x, n, d in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = series.stream_pairs_by_batch(stream, "1 day", 3 * 86_400).writeStream.foreachBatch(lambda b, _: out.extend(r.pair_id for r in b.collect()))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run(("x", "a", 1), ("y", "k", 1))
    run(("y", "l", 20))  # the watermark passes x's state
    run(("x", "b", 21), ("y", "m", 21))
    run(("x", "c", 22))
    assert out == ["k-l", "l-m", "b-c"]
