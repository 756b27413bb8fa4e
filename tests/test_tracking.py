import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftgrid.functions.scalar import refinement_matrix
from shiftgrid.operators import correlate, firstguess, geo, kernels, multichip, outliers, peak, points
from shiftgrid.operators import preprocess as pre
from shiftgrid.params import Gardner, Preprocess, params
from shiftgrid.plans import api
from shiftgrid.sources import raw
from shiftgrid.streaming import series


def texture(ny, nx, seed=1):
    a = np.random.default_rng(seed).normal(size=(ny, nx))
    for _ in range(3):
        p = np.pad(a, 1, mode="edge")
        a = sum(p[i : i + ny, j : j + nx] for i in range(3) for j in range(3)) / 9
    return (a - a.min()) / (a.max() - a.min())


def pixels(spark, a, name, valid=None):
    ok = np.isfinite(a) if valid is None else valid
    rows = [(name, r + 1, c + 1, float(a[r, c]), bool(ok[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id string, r int, c int, v double, valid boolean")


def shifted(ny, nx, sx, sy, seed=1):
    """Reference, and secondary whose content moved by (sx, sy)."""
    big = texture(ny + 80, nx + 80, seed)
    return big[40 : 40 + ny, 40 : 40 + nx], big[40 - sy : 40 - sy + ny, 40 - sx : 40 - sx + nx]


@pytest.mark.parametrize("sx, sy", [(0, 0), (5, -3), (-7, 6)])
def test_known_shift_is_recovered(spark, sx, sy):
    ref, sec = shifted(120, 120, sx, sy)
    p = dict(chip_size=16, chip_size_max=16, search_radius=10, grid_spacing=8)
    for up, tol in ((1, 0), (64, 5 / 64)):
        more = dict(subpixel="none") if up == 1 else {}
        got = api.track_pair(pixels(spark, ref, "a"), pixels(spark, sec, "b"), ref.shape, **p, **more).where("dx is not null").collect()
        assert len(got) > 80
        assert all(abs(r.dx + sx) <= tol and abs(r.dy + sy) <= tol and r.chip_size == 16 for r in got)


def test_fields_agree_between_tiers(spark):
    ref, sec = shifted(60, 70, 2, -1)
    valid = (np.add.outer(np.arange(60) * 3, np.arange(70)) % 11) > 0
    p = params(chip_size=8, chip_size_max=8, search_radius=4, min_search_radius=4, grid_spacing=8, preprocess="none", quantize="none", upsampling=16)
    met = pre.valid_both(pre.image_pair(pixels(spark, ref, "a", valid), pixels(spark, sec, "b", valid)))
    im = multichip.Images(met.select("pair_id", "r", "c", "ref", "sec", "valid"), ref.shape)
    edge = spark.createDataFrame([(1000 + k, x, y) for k, (x, y) in enumerate([(1.0, 1.0), (69.0, 3.0), (-20.0, 5.0), (35.3, 58.9)])], "pt_id long, x double, y double")
    pts = api.build_grid(spark, ref.shape, p).unionByName(points.pointset(edge, 8, search_radius=4, dx_prior=1.0, dy_prior=-1.0))
    assert multichip.products(pts) == pts.count() * 64 * 64
    for measure in ("zncc", "ncc"):
        a, b = ({r.pt_id: r for r in multichip.track(im, pts, p, measure, None, tier).collect()} for tier in ("auto", "arrow"))
        assert a.keys() == b.keys()
        for k, x in a.items():
            y = b[k]
            assert x.searched == y.searched and (x.dx is None) == (y.dx is None), k
            if x.dx is not None:
                assert abs(x.correlation - y.correlation) < 1e-4
                assert abs(x.dx - y.dx) <= 3 / 16 and abs(x.dy - y.dy) <= 3 / 16


def test_tiles_do_not_show(spark):
    ref, sec = shifted(90, 90, -2, 3)
    p = params(chip_size=8, chip_size_max=8, search_radius=5, min_search_radius=5, grid_spacing=6, preprocess="none", quantize="none", upsampling=8)
    met = pre.valid_both(pre.image_pair(pixels(spark, ref, "a"), pixels(spark, sec, "b")))
    im = multichip.Images(met.select("pair_id", "r", "c", "ref", "sec", "valid"), ref.shape)
    pts = api.build_grid(spark, ref.shape, p)
    a, b = (sorted((r.pt_id, r.dx, r.dy) for r in multichip.track(im, pts, p, tile=t).collect()) for t in (16, 256))
    assert a == b


def test_complex_coherence(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(40, 40)) + 1j * rng.normal(size=(40, 40))
    chips, wins = z[10:18, 10:18][None], z[6:21, 6:21][None]
    s, ok = kernels.surfaces(chips, wins, "coherence")
    assert ok.all() and s[0].argmax() == 4 * 8 + 4 and abs(s[0, 4, 4] - 1) < 1e-6
    row = [("p", r + 1, c + 1, (float(z[r, c].real), float(z[r, c].imag)), True) for r in range(40) for c in range(40)]
    df = spark.createDataFrame(row, "pair_id string, r int, c int, z struct<re:double,im:double>, valid boolean")
    pts = points.pointset(spark.createDataFrame([(1, 15.0, 15.0)], "pt_id long, x double, y double"), 8, search_radius=4)
    got = {(r.sy, r.sx): r.score for r in correlate.surfaces(df, df, pts, "coherence").collect()}
    want, _ = kernels.surfaces(z[10:18, 10:18][None], z[6:21, 6:21][None], "coherence")
    assert max(abs(got[i, j] - want[0, i, j]) for i in range(8) for j in range(8)) < 1e-6
    with pytest.raises(ValueError):
        correlate.surfaces(df, df, pts, "zncc")
    with pytest.raises(ValueError):
        pre.preprocess(df.withColumn("image_id", F.lit("a")), Preprocess("highpass"), (40, 40))
    with pytest.raises(ValueError):
        pre.quantize(df, "uint8")


def test_ramp_is_found_and_removed(spark):
    k = np.exp(1j * (np.arange(20)[:, None] * 0.3 - np.arange(24)[None, :] * 0.2))
    rows = [("a", r + 1, c + 1, (float(k[r, c].real), float(k[r, c].imag)), True) for r in range(20) for c in range(24)]
    df = spark.createDataFrame(rows, "image_id string, r int, c int, z struct<re:double,im:double>, valid boolean")
    got = pre.ramp_phase(df).first()
    assert abs(got.phase_x + 0.2) < 1e-9 and abs(got.phase_y - 0.3) < 1e-9
    assert all(abs(r.z.re - 1) < 1e-9 and abs(r.z.im) < 1e-9 for r in pre.deramp(df).collect())


SURFACES = {
    "unique": (lambda a: a.__setitem__((2, 5), 1), (2, 5)), "tie_in_row": (lambda a: (a.__setitem__((3, 1), 1), a.__setitem__((3, 5), 1)), (3, 1)),
    "tie_in_column": (lambda a: (a.__setitem__((1, 3), 1), a.__setitem__((5, 3), 1)), (1, 3)), "plateau": (lambda a: a.__setitem__((slice(2, 5), slice(2, 5)), 1), (2, 2)),
    "all_equal": (lambda a: a.__setitem__(slice(None), 0.25), (0, 0)),
}


@pytest.mark.parametrize("name", SURFACES)
def test_peak_ties(spark, name):
    a = np.zeros((7, 7))
    make, want = SURFACES[name]
    make(a)
    rows = [("p", 1, i, j, float(a[i, j])) for i in range(7) for j in range(7)] + [("p", 1, 9, 9, None)]
    got = peak.peak(spark.createDataFrame(rows, "pair_id string, pt_id long, sy int, sx int, score double")).first()
    assert (got.sy, got.sx) == want
    dx, dy, _ = kernels.peaks(a[None].astype(np.float32), 1)
    assert (dy[0] + 3, dx[0] + 3) == want


def test_refinement_matrix():
    c = refinement_matrix(5, 64)
    assert c.shape == (320, 5) and np.allclose(c.sum(1), 1)
    assert np.allclose(c @ np.full((5, 5), 0.5) @ c.T, 0.5)


def test_quantize_edges(spark):
    mk = lambda vals, ok: spark.createDataFrame([("a", 1, k + 1, float(v), o) for k, (v, o) in enumerate(zip(vals, ok, strict=True))], "image_id string, r int, c int, v double, valid boolean")
    values = lambda df: [r.v for r in pre.quantize_uint8(df).orderBy("c").collect()]
    assert values(mk([5, 5, 5], [True, True, False])) == [128.0, 128.0, 0.0]
    assert values(mk([1, 2], [False, False])) == [0.0, 0.0]
    assert values(mk([7], [True])) == [128.0]
    assert values(mk([float("nan"), 0, 1], [True, True, True]))[0] == 0.0


def test_rejection_is_monotone_and_drops_planted(spark):
    rng = random.Random(3)
    bad = {(rng.randrange(1, 21), rng.randrange(1, 21)) for _ in range(25)}
    rows = [("p", i, j, 3 + 0.05 * i + (30 if (i, j) in bad else 0), -2 - 0.05 * j, 10, 10) for i in range(1, 21) for j in range(1, 21)]
    df = spark.createDataFrame(rows, "pair_id string, gi int, gj int, dx double, dy double, radius_x int, radius_y int")
    keep = {(r.gi, r.gj): r.keep for r in outliers.reject_outliers(df, Gardner(), 64, (20, 20)).collect()}
    assert not any(keep[k] for k in bad) and sum(keep.values()) > 0.8 * (400 - len(bad))
    fewer = {(r.gi, r.gj): r.keep for r in outliers.reject_outliers(df, Gardner(iterations=1), 64, (20, 20)).collect()}
    assert all(fewer[k] for k, v in keep.items() if v)


def test_coarser_chips_take_what_finer_ones_cannot(spark):
    ref, sec = shifted(170, 170, 3, 2)
    ref, sec = ref.copy(), sec.copy()
    ref[70:94], sec[70:94] = 0.5, 0.5  # no texture within a small chip
    p = params(chip_size=8, chip_size_max=32, search_radius=6, grid_spacing=8, preprocess="none", quantize="none", upsampling=8, coarse_stride=4)
    got = api.track_pair(pixels(spark, ref, "a"), pixels(spark, sec, "b"), ref.shape, p, checkpoint=True).collect()
    assert all((r.chip_size == 0) == (r.dx is None) for r in got)
    sizes = {r.chip_size for r in got}
    assert 8 in sizes and sizes & {16, 32}
    ok = [r for r in got if r.dx is not None]
    assert sum(abs(r.dx + 3) < 0.4 and abs(r.dy + 2) < 0.4 for r in ok) > 0.9 * len(ok)


def test_uncorrelated_images_give_little(spark):
    p = dict(chip_size=8, chip_size_max=16, search_radius=6, grid_spacing=8)
    got = api.track_pair(pixels(spark, texture(110, 110, 1), "a"), pixels(spark, texture(110, 110, 2), "b"), (110, 110), **p).collect()
    assert sum(r.dx is not None for r in got) < len(got) / 2


def test_rotation_search(spark):
    a = texture(80, 80, 5)
    a = a - a.mean()  # what a turn leaves empty is 0, which is neutral for filtered images
    turned = kernels.rotate(a[None], 6.0)[0]
    at = dict(x=np.array([40.0]), y=np.array([40.0]), radius_x=np.array([5.0]), radius_y=np.array([5.0]), dx_prior=np.zeros(1), dy_prior=np.zeros(1), chip_x=np.array([24.0]), chip_y=np.array([24.0]))
    ok = np.ones_like(a, bool)
    plain = kernels.track(a, turned, ok, at, 1, 1, 1)["correlation"][0]
    tried = kernels.track(a, turned, ok, at, 1, 1, 1, angles=(-6.0, -3.0, 0.0, 3.0, 6.0))["correlation"][0]
    assert tried > plain + 0.02 and np.array_equal(kernels.rotate(a[None], 0.0)[0], a)


def test_scene_rotation_and_guess(spark):
    rng = random.Random(6)
    rows, turn = [], np.radians(7)
    for k in range(120):
        c, r = rng.uniform(0, 400), rng.uniform(0, 400)
        sx, sy = c * np.cos(turn) + r * np.sin(turn) + 5, r * np.cos(turn) - c * np.sin(turn) - 9
        rows.append(("p", k, float(r), float(c), float(c - sx), float(r - sy)))
    df = spark.createDataFrame(rows, "pair_id string, m_id long, r double, c double, dx double, dy double")
    assert abs(firstguess.scene_rotation(df).first().degrees - 7) < 1e-9
    assert firstguess.scene_rotation(df.limit(1)).first().degrees is None
    rogue = df.withColumn("dx", F.when(F.col("m_id") == 5, 300.0).otherwise(F.col("dx")))
    kept = {r.m_id for r in firstguess.consistent_matches(rogue, tolerance=20.0).collect()}
    assert 5 not in kept and len(kept) > 100
    assert firstguess.first_guess(df.limit(6)).count() == 0
    with pytest.raises(ValueError, match="min_agree"):
        firstguess.consistent_matches(df, neighbours=3)


def test_north_up_and_south_up_agree(spark):
    rows = spark.createDataFrame([("p", 1, 1, 2.0, -1.0)], "pair_id string, gi int, gj int, dx double, dy double")
    up, down = (geo.velocity(rows, n).first() for n in (True, False))
    assert up.vx == down.vx == -2.0 and up.vy == -1.0 and down.vy == 1.0
    assert geo.interval_years(dt.timedelta(days=365.25)) == 1.0
    for bad in (0, -1):
        with pytest.raises(ValueError, match="dt"):
            geo.interval_years(bad)
    with pytest.raises(ValueError, match="dt"):
        geo.velocity(rows, True, None, None, 1.0)
    axes = [("a", "X", 0.0, 1.0, True, True, "E1"), ("b", "X", 0.0, 1.0, True, True, "E2"), ("c", "X", 5.0, 1.0, True, True, "E1")]
    df = spark.createDataFrame(axes, "image_id string, axis string, origin double, step double, ascending boolean, regular boolean, crs string")
    for other, what in (("b", "coordinate"), ("c", "axes")):
        with pytest.raises(ValueError, match=what):
            geo.check_aligned(df, "a", other)


def test_points_errors(spark):
    with pytest.raises(ValueError, match="no search centre fits"):
        points.gridpoints(spark, (40, 40), 8)
    assert points.gridpoints(spark, (512, 512), 32).count() == 196
    coords = spark.createDataFrame([(1, 5.0, 5.0, 2.5)], "pt_id long, x double, y double, radius_x double")
    with pytest.raises(Exception, match="radius_x"):
        points.pointset(coords).collect()
    one, other = pixels(spark, np.ones((3, 3)), "a"), pixels(spark, np.ones((3, 4)), "b")
    with pytest.raises(Exception, match="one shape"):
        pre.image_pair(one, other).collect()


def test_raw_files_and_command(spark, tmp_path):
    from shiftgrid import cli

    ref, sec = shifted(120, 120, 4, -2)
    for name, a in (("a", ref), ("b", sec)):
        (tmp_path / f"{name}.bin").write_bytes(a.astype("<f4").tobytes(order="F"))
    px = raw.read_raw(spark, str(tmp_path / "a.bin"), 120, 120)
    got = np.zeros((120, 120))
    for r in px.collect():
        got[r.r - 1, r.c - 1] = r.v
    assert np.array_equal(got, ref.astype("<f4"))
    assert cli.main([str(tmp_path / "a.bin"), str(tmp_path / "b.bin"), "120", "120", str(tmp_path / "out"), "8", "6"]) == 0
    n = api.grid_size((120, 120), params(chip_size=8, search_radius=6))
    planes = np.frombuffer((tmp_path / "out" / "p.bin").read_bytes(), "<f4").reshape(3, n[1], n[0])
    assert abs(np.nanmedian(planes[0]) + 4) < 0.05 and abs(np.nanmedian(planes[1]) - 2) < 0.05
    with pytest.raises(Exception, match="bytes"):
        raw.read_raw(spark, str(tmp_path / "a.bin"), 100, 100).count()


def test_session_prepares_each_image_once(spark):
    ref, sec = shifted(90, 90, 1, 1)
    p = params(chip_size=8, chip_size_max=8, search_radius=6, grid_spacing=8)
    s = api.Session((90, 90), p).add(pixels(spark, ref, "i0")).add(pixels(spark, sec, "i1"))
    s.add(pixels(spark, ref * 0, "i1"))  # known already
    assert {r[0] for r in s.image_ids().collect()} == {"i0", "i1"}
    pairs = spark.createDataFrame([("f", "i0", "i1"), ("b", "i1", "i0")], "pair_id string, ref_id string, sec_id string")
    got = s.track(pairs)
    assert s.track(pairs) is got
    rows = got.where("dx is not null").collect()
    by = {k: [r for r in rows if r.pair_id == k] for k in "fb"}
    assert all(abs(np.median([r.dx for r in by[k]]) - want) < 0.05 for k, want in (("f", -1), ("b", 1))) and len(by["f"]) > 50
    one = api.track_pair(pixels(spark, ref, "i0"), pixels(spark, sec, "i1"), (90, 90), p).where("dx is not null").collect()
    assert sorted((r.gi, r.gj, r.dx) for r in one) == sorted((r.gi, r.gj, r.dx) for r in by["f"])


def test_session_packs_once_and_replaces(spark, monkeypatch):
    """Images are packed when they are added and never again; a replaced one brings its values and its mask."""
    from shiftgrid.operators import correlate_arrow

    ref, sec = shifted(90, 90, 1, 1)
    p = params(chip_size=8, chip_size_max=16, search_radius=6, grid_spacing=8)
    s = api.Session((90, 90), p, tile=32).add(pixels(spark, ref, "i0")).add(pixels(spark, sec, "i1"))
    monkeypatch.setattr(correlate_arrow, "pack", None)
    monkeypatch.setattr(multichip, "tiles", None)
    pairs = spark.createDataFrame([("f", "i0", "i1"), ("b", "i1", "i0")], "pair_id string, ref_id string, sec_id string")
    got = s.track(pairs)
    assert abs(np.median([r.dx for r in got.where("dx is not null and pair_id = 'f'").collect()]) + 1) < 0.05
    far = points.pointset(spark.createDataFrame([(0, 45.0, 45.0)], "pt_id long, x double, y double"), 8, search_radius=4).drop("pair_id").withColumn("pair_id", F.lit("f"))
    assert s.track(pairs, far) is not got and s.track(pairs, far) is s.track(pairs, far)
    monkeypatch.undo()
    other = shifted(90, 90, 3, -2)[1]
    s.add(pixels(spark, other, "i1").withColumn("valid", F.col("c") > 45), replace=True)
    new = s.track(pairs)
    assert new is not got
    rows = [r for r in new.where("dx is not null and pair_id = 'f'").collect()]
    assert abs(np.median([r.dx for r in rows]) + 3) < 0.05 and min(r.x for r in rows) > 35
    with pytest.raises(ValueError, match="beyond its shape"):
        s.add(pixels(spark, shifted(100, 100, 1, 1)[0], "i9"))


def test_planes_are_prepared_as_pixels(spark):
    ref, sec = shifted(100, 100, 2, -1)
    ref = ref.copy()
    ref[20:30, 40:44] = np.nan
    p = params(chip_size=8, chip_size_max=16, search_radius=6, grid_spacing=8)
    rows = [(n, 100, 100, bytearray(np.ascontiguousarray(a, np.float32).tobytes())) for n, a in (("a", ref), ("b", sec))]
    planes = spark.createDataFrame(rows, "image_id string, ny int, nx int, data binary")
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, ref_id string, sec_id string")
    one = api.Session((100, 100), p, tile=64).add_planes(planes)
    px = pixels(spark, ref, "a").unionByName(pixels(spark, sec, "b"))
    px = px.withColumn("valid", ~F.isnan("v") & F.col("v").isNotNull())
    two = api.Session((100, 100), p, tile=64).add(px)
    key = lambda s: {(r.image_id, r.tr, r.tc): (np.frombuffer(r.data, np.float32), bytes(r.ok)) for r in s.packs.collect()}
    x, y = key(one), key(two)
    assert x.keys() == y.keys() and all(x[k][1] == y[k][1] and np.abs(x[k][0] - y[k][0]).max() <= 1 for k in x)
    field = [sorted((r.gi, r.gj, r.dx, r.dy) for r in s.track(pairs).where("dx is not null").collect()) for s in (one, two)]
    assert len(field[0]) > 50 and len(field[0]) == len(field[1])


ACQ = [("s1", "a", 1), ("s1", "b", 2), ("s2", "c", 1), ("s1", "d", 5), ("s2", "e", 9), ("s3", "f", 3)]


def test_series_batch_and_stream(spark, tmp_path):
    rows = [(s, i, dt.datetime(2024, 1, d)) for s, i, d in ACQ]
    schema = "site string, image_id string, acq_ts timestamp"
    want = sorted((r.pair_id, r.ref_id, r.sec_id, round(r.years * 365.25)) for r in series.pair_series(spark.createDataFrame(rows, schema)).collect())
    assert [w[0] for w in want] == ["a-b", "b-d", "c-e"]
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = series.stream_pairs_by_batch(stream, "10 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = sorted((r.pair_id, r.ref_id, r.sec_id, round(r.years * 365.25)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_series_with_state_processor(spark, tmp_path):
    rows = [(s, i, dt.datetime(2024, 1, d)) for s, i, d in ACQ]
    schema = "site string, image_id string, acq_ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = series.stream_pairs(stream, "10 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(r.pair_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["a-b", "b-d", "c-e"]


def test_small_surfaces_keep_the_integer_peak(spark):
    ref, sec = shifted(40, 40, 1, 0)
    side = lambda a: pixels(spark, a, "a").withColumn("pair_id", F.lit("p"))
    coords = spark.createDataFrame([(1, 20.0, 20.0, 2, 2), (2, 20.0, 20.0, 4, 4)], "pt_id long, x double, y double, radius_x int, radius_y int")
    pts = points.pointset(coords, 8)
    surf = correlate.surfaces(side(ref), side(sec), pts)
    got = {r.pt_id: (r.dx, r.dy) for r in peak.subpixel_peak(surf, pts, 8).collect()}
    assert got[1] == (-1.0, 0.0) and abs(got[2][0] + 1) <= 3 / 8 and abs(got[2][1]) <= 3 / 8
    assert {r.pt_id: (r.dx, r.dy) for r in peak.peak_offset(surf, pts).collect()} == {1: (-1.0, 0.0), 2: (-1.0, 0.0)}
