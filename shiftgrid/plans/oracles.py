"""DuckDB SQL of the registered queries, written independently of the plans they check."""

from __future__ import annotations

#: Pixels of the reference image, of the secondary (moved by 1, 2), and of the masked one.
PX = """px AS (SELECT CAST(e.vec_id AS INTEGER) + 1 AS r, CAST(k.i AS INTEGER) AS c, CAST(e.embedding[k.i] AS DOUBLE) AS v
  FROM embeddings e, (SELECT unnest(range(1, 65)) AS i) k),
dims AS (SELECT CAST(max(vec_id) AS INTEGER) + 1 AS n FROM embeddings)"""
SEC = "sec AS (SELECT r + 1 AS r, c + 2 AS c, v FROM px)"
WRAP = "sec AS (SELECT CAST(r % n + 1 AS INTEGER) AS r, CAST((c + 1) % 64 + 1 AS INTEGER) AS c, v FROM px, dims)"
MASKED = "mk AS (SELECT r, c, v, (r * 31 + c * 17) % 23 <> 0 AS ok, CASE WHEN (r * 31 + c * 17) % 23 <> 0 THEN v END AS h FROM px)"
#: The search grid: chip 8, radius 4, spacing 8, so margins of 9 pixels.
GRID = """ax AS (SELECT CAST(k.i AS INTEGER) AS gj, CAST(10 + 8 * (k.i - 1) AS INTEGER) AS x FROM (SELECT unnest(range(1, 9)) AS i) k WHERE 10 + 8 * (k.i - 1) <= 64 - 9),
ay AS (SELECT CAST(k.i AS INTEGER) AS gi, CAST(10 + 8 * (k.i - 1) AS INTEGER) AS y FROM (SELECT unnest(range(1, 5000)) AS i) k, dims WHERE 10 + 8 * (k.i - 1) <= n - 9),
ny AS (SELECT count(*) AS m FROM ay),
pt AS (SELECT CAST((gj - 1) * m + gi - 1 AS BIGINT) AS pt_id, gi, gj, x, y FROM ax, ay, ny)"""
UNEVEN = """un AS (SELECT pt_id, gi, gj, x, y, CAST(pt_id % 7 AS INTEGER) AS rx, CAST(pt_id % 5 + 1 AS INTEGER) AS ry,
  CAST(pt_id % 4 AS DOUBLE) * 0.75 - 1 AS dxp, CAST(pt_id % 3 AS DOUBLE) * 0.5 AS dyp FROM pt)"""
OFF8 = "o8 AS (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS k)"


def offsets(before_y: int, after_y: int, before_x: int, after_x: int) -> str:
    return (f"oy AS (SELECT CAST(unnest(range({-before_y}, {after_y + 1})) AS INTEGER) AS a), "
            f"ox AS (SELECT CAST(unnest(range({-before_x}, {after_x + 1})) AS INTEGER) AS b), off AS (SELECT a, b FROM oy, ox)")


def window(wx: int, wy: int) -> str:
    """Every pixel beside every non-missing pixel ``h`` of its window, sizes clamped to 64 columns."""
    wx = min(wx, 64)
    return f"{offsets(wy // 2, wy - 1 - wy // 2, wx // 2, wx - 1 - wx // 2)}, nb AS (SELECT m.r, m.c, m.h AS mine, q.h FROM mk m CROSS JOIN off JOIN mk q ON q.r = m.r + off.a AND q.c = m.c + off.b)"


def reduced(wx: int, wy: int, expr: str) -> str:
    return f"WITH {PX}, {MASKED}, {window(wx, wy)} SELECT r, c, round({expr}, 6) + 0.0 AS out FROM nb GROUP BY r, c"


CHIP = "chip AS (SELECT pt_id, i.k AS i, j.k AS j, coalesce(s.v, 0) AS v FROM pt CROSS JOIN o8 i CROSS JOIN o8 j LEFT JOIN sec s ON s.r = y - 4 + i.k AND s.c = x - 4 + j.k)"
SCORES = """cm AS (SELECT pt_id, avg(v) AS m FROM chip GROUP BY pt_id),
ct AS (SELECT chip.pt_id, i, j, v - m AS t FROM chip JOIN cm ON chip.pt_id = cm.pt_id),
cn AS (SELECT pt_id, sum(t * t) AS tt FROM ct GROUP BY pt_id),
mv AS (SELECT ct.pt_id, sy.k AS sy, sx.k AS sx, t, y - 8 + i + sy.k AS r, x - 8 + j + sx.k AS c FROM ct JOIN pt ON pt.pt_id = ct.pt_id CROSS JOIN o8 sy CROSS JOIN o8 sx),
sm AS (SELECT mv.pt_id, sy, sx, sum(t * coalesce(w.v, 0)) AS num, sum(coalesce(w.v, 0)) AS s1, sum(coalesce(w.v, 0) * coalesce(w.v, 0)) AS s2 FROM mv LEFT JOIN px w ON w.r = mv.r AND w.c = mv.c GROUP BY mv.pt_id, sy, sx),
zs AS (SELECT sm.pt_id, sy, sx, num / nullif(sqrt(tt) * sqrt({power}), 0) AS score FROM sm JOIN cn ON cn.pt_id = sm.pt_id WHERE tt > 1.1920929e-07 * 64)"""
ZNCC = SCORES.format(power="greatest(s2 - s1 * s1 / 64, 0)")
NCC = SCORES.format(power="s2")
#: Points, chips from ``sec`` and scores on every shift.
TRACKED = f"WITH {PX}, {SEC}, {GRID}, {OFF8}, {CHIP}, {ZNCC}"
PEAK = "pk AS (SELECT pt_id, sy, sx, score FROM (SELECT pt_id, sy, sx, score, row_number() OVER (PARTITION BY pt_id ORDER BY round(score, 9) DESC, sy, sx) AS k FROM zs WHERE score IS NOT NULL) q WHERE k = 1)"


def taps(n: str) -> str:
    """(k, i, w): the doubling of an axis of n samples (an expression over dims), reflected in the doubled axis."""
    even = "SELECT p, p + d.d AS q, d.w AS w FROM ps, (VALUES (-2, 0.125::DOUBLE), (0, 0.75::DOUBLE), (2, 0.125::DOUBLE)) d(d, w) WHERE p % 2 = 0"
    odd = "SELECT p, p + d.d AS q, 0.5::DOUBLE AS w FROM ps, (VALUES (-1), (1)) d(d) WHERE p % 2 = 1"
    return (f"(WITH ps AS (SELECT unnest(range(0, CAST(2 * {n} AS BIGINT))) AS p FROM dims), qs AS ({even} UNION ALL {odd}) "
            f"SELECT p AS k, (CASE WHEN abs(q) > 2 * {n} - 1 THEN 2 * (2 * {n} - 1) - abs(q) ELSE abs(q) END) // 2 AS i, w FROM qs, dims)")


#: Three doublings of a 5 x 5 patch, one after the other.
def cascade() -> str:
    out = []
    for n, (a, b) in zip((5, 10, 20), (("p0", "p1"), ("p1", "p2"), ("p2", "p3")), strict=True):
        out.append(f"t{n} AS (SELECT k, i, w FROM {taps(str(n))})")
        out.append(f"h{n} AS (SELECT pt_id, t{n}.k AS y, {a}.x, sum(w * v) AS v FROM {a} JOIN t{n} ON t{n}.i = {a}.y GROUP BY pt_id, t{n}.k, {a}.x)")
        out.append(f"{b} AS (SELECT pt_id, h{n}.y, t{n}.k AS x, sum(w * v) AS v FROM h{n} JOIN t{n} ON t{n}.i = h{n}.x GROUP BY pt_id, h{n}.y, t{n}.k)")
    return ", ".join(out)


PATCH = """ap AS (SELECT pt_id, sy, sx, greatest(least(sy - 2, 3), 0) AS i0, greatest(least(sx - 2, 3), 0) AS j0 FROM pk),
p0 AS (SELECT zs.pt_id, zs.sy - i0 AS y, zs.sx - j0 AS x, score AS v FROM zs JOIN ap ON ap.pt_id = zs.pt_id WHERE zs.sy - i0 BETWEEN 0 AND 4 AND zs.sx - j0 BETWEEN 0 AND 4)"""
FINE = "fp AS (SELECT pt_id, y, x, v FROM (SELECT pt_id, y, x, v, row_number() OVER (PARTITION BY pt_id ORDER BY round(v, 9) DESC, y, x) AS k FROM p3) q WHERE k = 1)"


def track_sql(digits: int) -> str:
    """The wrapped pair, refined to an eighth."""
    return f"""WITH {PX}, {WRAP}, {GRID}, {OFF8}, {CHIP}, {ZNCC}, {PEAK}, {PATCH}, {cascade()}, {FINE}
SELECT gi, gj, round(fp.x / 8.0 + j0 - 4, 6) + 0.0 AS dx, round(fp.y / 8.0 + i0 - 4, 6) + 0.0 AS dy, round(fp.v, {digits}) + 0.0 AS correlation, true AS searched
FROM pt JOIN fp ON fp.pt_id = pt.pt_id JOIN ap ON ap.pt_id = pt.pt_id"""


FIELD = """fd AS (SELECT r AS gi, c AS gj, CASE WHEN (r * 5 + c) % 17 <> 0 THEN 3 + 0.05::DOUBLE * r + v * 0.1::DOUBLE + CASE WHEN (r * 7 + c * 3) % 29 = 0 THEN 2.5 ELSE 0 END::DOUBLE END AS dx,
  CASE WHEN (r * 5 + c) % 17 <> 0 THEN -2 - 0.05::DOUBLE * c + v * 0.1::DOUBLE END AS dy, CASE WHEN (r + c * 11) % 31 = 0 THEN 0 ELSE 8 END AS radius FROM px)"""


def rejection() -> str:
    """Three rounds of agreement, two of distance from the median; each a self-join over 5 x 5 offsets."""
    out = [FIELD, offsets(2, 2, 2, 2), "g0 AS (SELECT gi, gj, CASE WHEN radius > 0 THEN dx / radius END AS x, CASE WHEN radius > 0 THEN dy / radius END AS y FROM fd)",
           "k0 AS (SELECT gi, gj, x, y FROM g0 WHERE x IS NOT NULL AND y IS NOT NULL)"]
    for n in range(3):
        out.append(f"""k{n + 1} AS (SELECT a.gi, a.gj, a.x, a.y FROM k{n} a CROSS JOIN off JOIN k{n} b ON b.gi = a.gi + off.a AND b.gj = a.gj + off.b GROUP BY a.gi, a.gj, a.x, a.y
  HAVING count(CASE WHEN abs(b.x - a.x) < 0.2 THEN 1 END) >= 8 AND count(CASE WHEN abs(b.y - a.y) < 0.2 THEN 1 END) >= 8)""")
    for n in (3, 4):
        out.append(f"n{n} AS (SELECT a.gi, a.gj, a.x, a.y, b.x AS bx, b.y AS by_ FROM k{n} a CROSS JOIN off JOIN k{n} b ON b.gi = a.gi + off.a AND b.gj = a.gj + off.b)")
        out.append(f"m{n} AS (SELECT gi, gj, median(bx) AS mx, median(by_) AS my FROM n{n} GROUP BY gi, gj)")
        out.append(f"d{n} AS (SELECT n{n}.gi, n{n}.gj, x, y, mx, my, median(abs(bx - mx)) AS dx, median(abs(by_ - my)) AS dy FROM n{n} JOIN m{n} ON m{n}.gi = n{n}.gi AND m{n}.gj = n{n}.gj GROUP BY n{n}.gi, n{n}.gj, x, y, mx, my)")
        out.append(f"k{n + 1} AS (SELECT gi, gj, x, y FROM d{n} WHERE abs(x - mx) <= greatest(4 * dx, 2.0 / (64 * 8)) + 1e-12 AND abs(y - my) <= greatest(4 * dy, 2.0 / (64 * 8)) + 1e-12)")
    return ", ".join(out)


def filling() -> str:
    out = [FIELD, offsets(1, 1, 1, 1), "f0 AS (SELECT gi, gj, dx, dy, false AS filled FROM fd)"]
    for n in range(3):
        out.append(f"n{n} AS (SELECT a.gi, a.gj, median(b.dx) AS mx, median(b.dy) AS my FROM f{n} a CROSS JOIN off JOIN f{n} b ON b.gi = a.gi + off.a AND b.gj = a.gj + off.b WHERE a.dx IS NULL AND b.dx IS NOT NULL GROUP BY a.gi, a.gj HAVING count(*) >= 6)")
        out.append(f"f{n + 1} AS (SELECT a.gi, a.gj, coalesce(a.dx, mx) AS dx, CASE WHEN mx IS NULL THEN a.dy ELSE my END AS dy, a.filled OR mx IS NOT NULL AS filled FROM f{n} a LEFT JOIN n{n} ON n{n}.gi = a.gi AND n{n}.gj = a.gj)")
    return ", ".join(out)


MATCHES = """m0 AS (SELECT vec_id AS m_id, vec_id // 20 * 5 + CAST(embedding[1] AS DOUBLE) AS r, vec_id % 20 * 5 + CAST(embedding[2] AS DOUBLE) AS c FROM embeddings),
mt AS (SELECT m_id, r, c, c - (c * cos(0.05235987755982988::DOUBLE) + r * sin(0.05235987755982988::DOUBLE)) + CASE WHEN m_id % 13 = 0 THEN 40 ELSE 0 END AS dx,
  r - (r * cos(0.05235987755982988::DOUBLE) - c * sin(0.05235987755982988::DOUBLE)) AS dy FROM m0)"""


def near(k: int) -> str:
    return (f"kn AS (SELECT i, j, d2, rank FROM (SELECT a.m_id AS i, b.m_id AS j, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2, CAST(row_number() OVER (PARTITION BY a.m_id ORDER BY "
            f"(a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.m_id) AS INTEGER) AS rank FROM mt a JOIN mt b ON a.m_id <> b.m_id) q WHERE rank <= {k})")


CONSISTENT = f"""{MATCHES}, {near(12)}, ok AS (SELECT kn.i AS m_id FROM kn JOIN mt a ON a.m_id = kn.i JOIN mt b ON b.m_id = kn.j
  GROUP BY kn.i HAVING count(CASE WHEN (a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy) <= 36 THEN 1 END) >= 5)"""
ERODED = "er AS (SELECT m.r, m.c, bool_and(q.ok) AS ok FROM mk m CROSS JOIN off JOIN mk q ON q.r = m.r + off.a AND q.c = m.c + off.b GROUP BY m.r, m.c)"


def filtered(width: int, value: str, more: str = "") -> str:
    """A filter's result ``value`` over columns of mk (m), nb statistics (s) and eroded validity (er)."""
    return f"""WITH {PX}, {MASKED}, {window(width, width)}, s AS (SELECT r, c, avg(h) AS mean FROM nb GROUP BY r, c), {ERODED}{more}
SELECT m.r, m.c, round(coalesce({value}, 0), 6) + 0.0 AS v, er.ok AND ({value}) IS NOT NULL AS valid FROM mk m JOIN s ON s.r = m.r AND s.c = m.c JOIN er ON er.r = m.r AND er.c = m.c"""


HIGH = "m.h - s.mean"
DEV = """, dv AS (SELECT m.r, m.c, (m.h - s.mean) * (m.h - s.mean) AS d FROM mk m JOIN s ON s.r = m.r AND s.c = m.c),
sd AS (SELECT m.r, m.c, greatest(sqrt(avg(q.d)), 0.01) AS sd FROM mk m CROSS JOIN off JOIN dv q ON q.r = m.r + off.a AND q.c = m.c + off.b GROUP BY m.r, m.c)"""


def derivative(kernels: list[tuple[list[int], list[int]]], value: str) -> str:
    """Sum of separable 3 x 3 correlations; missing where a tap is."""
    w = {}
    for kx, ky in kernels:
        for a in range(3):
            for b in range(3):
                w[a - 1, b - 1] = w.get((a - 1, b - 1), 0) + ky[a] * kx[b]
    rows = ",".join(f"({a},{b},{x})" for (a, b), x in w.items())
    return f"""WITH {PX}, {MASKED}, {offsets(1, 1, 1, 1)}, {ERODED}, kr AS (SELECT a, b, w FROM (VALUES {rows}) t(a, b, w)),
src AS (SELECT r, c, {value} AS v FROM mk), o AS (SELECT m.r, m.c, CASE WHEN count(q.v) = 9 THEN sum(kr.w * q.v) END AS v FROM mk m CROSS JOIN kr LEFT JOIN src q ON q.r = m.r + kr.a AND q.c = m.c + kr.b GROUP BY m.r, m.c)
SELECT o.r, o.c, round(coalesce(o.v, 0), 6) + 0.0 AS v, er.ok AND o.v IS NOT NULL AS valid FROM o JOIN er ON er.r = o.r AND er.c = o.c"""


CUBIC = ["-0.5 * t*t*t + t*t - 0.5 * t", "1.5 * t*t*t - 2.5 * t*t + 1.0", "-1.5 * t*t*t + 2.0 * t*t + 0.5 * t", "0.5 * t*t*t - 0.5 * t*t"]


def cubic_axis(name: str, src: str, dst: str) -> str:
    """Taps of an axis of ``src`` samples at ``dst`` places, both expressions over dims."""
    pos = f"((k - 0.5) * (({src})::DOUBLE / ({dst})) - 0.5)"
    parts = " UNION ALL ".join(f"SELECT k, CAST(greatest(least(f + {d}, m), 1) AS INTEGER) AS s, {CUBIC[d]} AS w FROM {name}0" for d in range(4))
    return f"{name}k AS (SELECT CAST(unnest(range(1, CAST({dst} + 1 AS BIGINT))) AS INTEGER) AS k, n FROM dims), {name}0 AS (SELECT k, {src} AS m, floor({pos}) AS f, {pos} - floor({pos}) AS t FROM {name}k), {name} AS ({parts})"


def area_axis(name: str, src: str, dst: str) -> str:
    by = f"(({src})::DOUBLE / ({dst}))"
    w = f"(least(k * {by}, s) - greatest((k - 1) * {by}, s - 1))"
    return f"""{name}k AS (SELECT CAST(unnest(range(1, CAST({dst} + 1 AS BIGINT))) AS INTEGER) AS k, n FROM dims), {name}s AS (SELECT CAST(unnest(range(1, CAST({src} + 1 AS BIGINT))) AS INTEGER) AS s FROM dims),
{name} AS (SELECT k, s, {w} AS w FROM {name}k, {name}s WHERE {w} > 0)"""


def resampled(y: str, x: str, least: str) -> str:
    return f"""WITH {PX}, {MASKED}, {y}, {x}, g AS (SELECT yy.k AS r, xx.k AS c, sum(yy.w * xx.w * h) AS a, sum(CASE WHEN h IS NOT NULL THEN yy.w * xx.w END) AS w
  FROM mk JOIN yy ON yy.s = mk.r JOIN xx ON xx.s = mk.c GROUP BY yy.k, xx.k) SELECT r, c, CASE WHEN w {least} THEN round(a / w, 6) + 0.0 END AS v FROM g"""


COMPLEX = """zc AS (SELECT a.r, a.c, a.v AS re, b.v AS im, a.ok AND b.ok AS ok FROM mk a JOIN mk b ON b.r = a.r AND b.c = a.c + 32 WHERE a.c <= 32)"""
RAMP = f"""WITH {PX}, {MASKED}, {COMPLEX},
xs AS (SELECT atan2(sum(a.re * b.im - a.im * b.re), sum(a.re * b.re + a.im * b.im)) AS px FROM zc a JOIN zc b ON b.r = a.r AND b.c = a.c + 1 WHERE a.ok AND b.ok),
ys AS (SELECT atan2(sum(a.re * b.im - a.im * b.re), sum(a.re * b.re + a.im * b.im)) AS py FROM zc a JOIN zc b ON b.r = a.r + 1 AND b.c = a.c WHERE a.ok AND b.ok)"""
PAIR = "SELECT m.r, m.c, round(m.v, 6) + 0.0 AS ref, round(s.v, 6) + 0.0 AS sec, m.ok AS ref_valid, true AS sec_valid FROM mk m JOIN sec s ON s.r = m.r AND s.c = m.c"
QUANT = """st AS (SELECT avg(q) AS mean, stddev_samp(q) AS sd FROM src)"""


def quantized(src: str) -> str:
    return f"""{src}, {QUANT} SELECT r, c, CASE WHEN q IS NULL THEN 0.0 ELSE round_even(least(greatest((q - (mean - 3 * sd)) * (255.0::DOUBLE / (6 * sd)), 0), 255), 0) + 0.0 END AS v, valid FROM src, st"""


ORACLES: dict[str, str] = {
    "scan_image": f"WITH {PX} SELECT 'ref' AS image_id, r, c, round(v, 6) + 0.0 AS v, true AS valid FROM px",
    "image_pair": f"WITH {PX}, {WRAP}, {MASKED} {PAIR}",
    "valid_both": f"WITH {PX}, {MASKED}, s AS (SELECT r % n + 1 AS r, (c + 1) % 64 + 1 AS c, ok FROM mk, dims) SELECT m.r, m.c, m.ok AND s.ok AS valid FROM mk m JOIN s ON s.r = m.r AND s.c = m.c",
    "valid_mask": f"WITH {PX} SELECT (r + c) % 7 <> 0 AS valid, count(*) AS n FROM px GROUP BY 1",
    "grid_coords": f"WITH {PX}, {GRID} SELECT gi, gj, 1000.0::DOUBLE + (x - 1) * 120.0::DOUBLE AS map_x, 9000.0::DOUBLE - (y - 1) * 120.0::DOUBLE AS map_y FROM pt",
    "pixel_size": "SELECT CAST(s_suppkey AS VARCHAR) AS image_id, 'X' AS axis, round(abs(s_acctbal::DOUBLE / 8), 6) + 0.0 AS pixel_size FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'Y', CASE WHEN s_suppkey % 3 <> 0 THEN round(abs(s_acctbal::DOUBLE / 4), 6) + 0.0 END FROM supplier",
    "gridpoints": f"WITH {PX}, {GRID} SELECT pt_id, gi, gj, x::DOUBLE AS x, y::DOUBLE AS y, 4 AS radius_x, 4 AS radius_y, 0.0::DOUBLE AS dx_prior, 0.0::DOUBLE AS dy_prior, 8 AS chip_x, 8 AS chip_y FROM pt",
    "pointset": "SELECT 'p' AS pair_id, l_orderkey * 8 + l_linenumber AS pt_id, (l_partkey % 64 + 1)::DOUBLE AS x, (l_suppkey % 64 + 1)::DOUBLE AS y, CAST(l_linenumber + 2 AS INTEGER) AS radius_x, 4 AS radius_y, 1.5::DOUBLE AS dx_prior, 0.0::DOUBLE AS dy_prior, 8 AS chip_x, 8 AS chip_y FROM lineitem",
    "scatter": f"WITH {PX}, {GRID} SELECT pt_id, CAST(NULL AS INTEGER) AS gi, CAST(NULL AS INTEGER) AS gj, x::DOUBLE AS x, y::DOUBLE AS y FROM pt",
    "decimate": f"WITH {PX}, {GRID} SELECT pt_id, gi // 3 AS gi, gj // 3 AS gj, x::DOUBLE AS x, y::DOUBLE AS y FROM pt WHERE gi % 3 = 0 AND gj % 3 = 0",
    "sanitize": f"WITH {PX}, {GRID}, {UNEVEN} SELECT pt_id, CASE WHEN rx <= 0 OR ry <= 0 THEN 0 ELSE greatest(rx, 3) END AS radius_x, CASE WHEN rx <= 0 OR ry <= 0 THEN 0 ELSE greatest(ry, 3) END AS radius_y FROM un",
    "chip_bounds": f"WITH {PX}, {GRID}, {UNEVEN}, q AS (SELECT pt_id, CAST(floor(x - dxp) AS INTEGER) AS cx, CAST(floor(y - dyp) AS INTEGER) AS cy FROM un) SELECT pt_id, cy - 4 AS chip_r0, cy + 3 AS chip_r1, cx - 4 AS chip_c0, cx + 3 AS chip_c1 FROM q",
    "search_bounds": f"WITH {PX}, {GRID}, {UNEVEN} SELECT pt_id, y - 4 - ry AS win_r0, y + 4 + ry - 2 AS win_r1, x - 4 - rx AS win_c0, x + 4 + rx - 2 AS win_c1 FROM un",
    "surface_size": f"WITH {PX}, {GRID}, {UNEVEN} SELECT pt_id, 2 * ry AS surf_rows, 2 * rx AS surf_cols FROM un",
    "inbounds": f"WITH {PX}, {GRID}, {UNEVEN} SELECT pt_id, y - 4 - ry >= 1 AND y + 2 + ry <= n AND x - 4 - 3 * rx >= 1 AND x + 2 + 3 * rx <= 64 AS inside FROM un, dims",
    "searchable_points": f"WITH {PX}, {GRID}, {UNEVEN} SELECT count(CASE WHEN rx > 0 AND ry > 0 THEN 1 END) AS n_searchable, count(*) AS n_points FROM un",
    "half_pixel_shift": f"WITH {PX}, {GRID} SELECT pt_id, x + 3.5::DOUBLE AS x, y + 5.5::DOUBLE AS y FROM pt",
    "pass_geometry": f"WITH {PX}, {GRID}, {UNEVEN} SELECT 8 AS chip_x, 8 AS chip_y, max(rx) AS radius_x, max(ry) AS radius_y, CAST(max(4 + rx + ceil(abs(dxp))) + 2 AS INTEGER) AS pad_x, CAST(max(4 + ry + ceil(abs(dyp))) + 2 AS INTEGER) AS pad_y, "
                     "bool_and(y - 4 - ry >= 1 AND y + 2 + ry <= n AND x - 4 - rx >= 1 AND x + 2 + rx <= 64) AS fits FROM un, dims WHERE rx > 0 AND ry > 0",
    "level_points": f"WITH {PX}, {GRID}, {UNEVEN} SELECT pt_id, CASE WHEN pt_id % 3 = 0 AND rx > 0 THEN greatest(rx, 2) ELSE 0 END AS radius_x, CASE WHEN pt_id % 3 = 0 AND rx > 0 THEN greatest(ry, 2) ELSE 0 END AS radius_y, 16 AS chip_x, 16 AS chip_y FROM un",
    "cut_chip": f"WITH {PX}, {MASKED}, {GRID}, {OFF8} SELECT pt_id, i.k AS i, j.k AS j, round(m.v, 6) + 0.0 AS v, m.ok AS valid FROM pt CROSS JOIN o8 i CROSS JOIN o8 j JOIN mk m ON m.r = y - 4 + i.k AND m.c = x - 4 + j.k",
    "cut_window": f"WITH {PX}, {GRID} SELECT pt_id, count(*) AS n, round(sum(v), 6) + 0.0 AS s, round(sum(v * ((r - y + 8) * 31 + c - x + 8)), 6) + 0.0 AS w FROM pt JOIN px ON r BETWEEN y - 8 AND y + 6 AND c BETWEEN x - 8 AND x + 6 GROUP BY pt_id",
    "chip_stats": f"WITH {PX}, {SEC}, {GRID}, {OFF8}, {CHIP}, m AS (SELECT pt_id, avg(v) AS mean FROM chip GROUP BY pt_id) SELECT chip.pt_id, count(*) AS n, round(max(mean), 6) + 0.0 AS mean, round(sqrt(sum((v - mean) * (v - mean))), 6) + 0.0 AS norm, "
                  "sum((v - mean) * (v - mean)) > 1.1920929e-07 * 64 AS ok, true AS any_valid FROM chip JOIN m ON m.pt_id = chip.pt_id GROUP BY chip.pt_id",
    "zncc": f"{TRACKED} SELECT pt_id, sy, sx, round(coalesce(score, 0), 6) + 0.0 AS score FROM zs",
    "ncc": f"WITH {PX}, {SEC}, {GRID}, {OFF8}, {CHIP}, {NCC} SELECT pt_id, sy, sx, round(coalesce(score, 0), 6) + 0.0 AS score FROM zs",
    "coherence": f"""WITH {PX}, {MASKED.replace("% 23 <> 0", "% 23 >= 0")}, {COMPLEX}, {GRID.replace("<= 64 - 9", "<= 32 - 9")}, {OFF8},
ch AS (SELECT pt_id, i.k AS i, j.k AS j, re, im FROM pt CROSS JOIN o8 i CROSS JOIN o8 j JOIN zc ON zc.r + 1 = y - 4 + i.k AND zc.c + 2 = x - 4 + j.k),
cm AS (SELECT pt_id, avg(re) AS mr, avg(im) AS mi FROM ch GROUP BY pt_id), ct AS (SELECT ch.pt_id, i, j, re - mr AS re, im - mi AS im FROM ch JOIN cm ON cm.pt_id = ch.pt_id),
cn AS (SELECT pt_id, sum(re * re + im * im) AS tt FROM ct GROUP BY pt_id),
mv AS (SELECT ct.pt_id, sy.k AS sy, sx.k AS sx, ct.re, ct.im, y - 8 + i + sy.k AS r, x - 8 + j + sx.k AS c FROM ct JOIN pt ON pt.pt_id = ct.pt_id CROSS JOIN o8 sy CROSS JOIN o8 sx),
sm AS (SELECT mv.pt_id, sy, sx, sum(mv.re * w.re + mv.im * w.im) AS nr, sum(mv.re * w.im - mv.im * w.re) AS ni, sum(w.re) AS wr, sum(w.im) AS wi, sum(w.re * w.re + w.im * w.im) AS s2 FROM mv JOIN zc w ON w.r = mv.r AND w.c = mv.c GROUP BY mv.pt_id, sy, sx)
SELECT sm.pt_id, sy, sx, round(sqrt(nr * nr + ni * ni) / (sqrt(tt) * sqrt(greatest(s2 - (wr * wr + wi * wi) / 64, 0))), 6) + 0.0 AS score FROM sm JOIN cn ON cn.pt_id = sm.pt_id""",
    "peak_index": f"{TRACKED}, {PEAK} SELECT pt_id, sy, sx, round(score, 6) + 0.0 AS correlation FROM pk",
    "peak_offset": f"{TRACKED}, {PEAK} SELECT pt_id, sx - 4 + 0.0::DOUBLE AS dx, sy - 4 + 0.0::DOUBLE AS dy, round(score, 6) + 0.0 AS correlation FROM pk",
    "subpixel_peak": f"{TRACKED}, {PEAK}, {PATCH}, {cascade()}, {FINE} SELECT fp.pt_id, round(fp.x / 8.0 + j0 - 4, 6) + 0.0 AS dx, round(fp.y / 8.0 + i0 - 4, 6) + 0.0 AS dy, round(fp.v, 6) + 0.0 AS correlation FROM fp JOIN ap ON ap.pt_id = fp.pt_id",
    "pyrup": f"WITH {PX}, ty AS (SELECT k, i, w FROM {taps('n')}), tx AS (SELECT k, i, w FROM {taps('64')}) SELECT CAST(ty.k + 1 AS INTEGER) AS r, CAST(tx.k + 1 AS INTEGER) AS c, round(sum(ty.w * tx.w * v), 6) + 0.0 AS v FROM px JOIN ty ON ty.i + 1 = px.r JOIN tx ON tx.i + 1 = px.c GROUP BY ty.k, tx.k",
    "rotate_chip": f"""WITH {PX}, {GRID}, {OFF8}, tn AS (SELECT i.k AS i, j.k AS j, 4.5 + cos(radians(10)) * (i.k - 3.5) + sin(radians(10)) * (j.k - 3.5) AS sy, 4.5 - sin(radians(10)) * (i.k - 3.5) + cos(radians(10)) * (j.k - 3.5) AS sx FROM o8 i CROSS JOIN o8 j),
tp AS (SELECT i, j, floor(sy) AS a, floor(sx) AS b, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM tn),
cl AS (SELECT pt_id, i, j, a, b, fy, fx, y - 5 + a AS r0, x - 5 + b AS c0, a >= 1 AND b >= 1 AND a + 1 <= 8 AND b + 1 <= 8 AS inside FROM pt CROSS JOIN tp)
SELECT pt_id, i, j, round(CASE WHEN inside THEN (1 - fy) * ((1 - fx) * p.v + fx * q.v) + fy * ((1 - fx) * s.v + fx * t.v) ELSE 0 END, 6) + 0.0 AS v
FROM cl JOIN px p ON p.r = r0 AND p.c = c0 JOIN px q ON q.r = r0 AND q.c = c0 + 1 JOIN px s ON s.r = r0 + 1 AND s.c = c0 JOIN px t ON t.r = r0 + 1 AND t.c = c0 + 1""",
    "knn": f"WITH {MATCHES}, {near(5)} SELECT i, j, round(d2, 6) + 0.0 AS d2, rank FROM kn",
    "knn_cells": f"WITH {MATCHES}, {near(5)} SELECT i, j, round(d2, 6) + 0.0 AS d2, rank FROM kn",
    "hamming_match": """WITH bt AS (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i), ds AS (SELECT vec_id, sum(CASE WHEN embedding[i] > 0 THEN (CASE WHEN i > 62 THEN 0 ELSE 1 END) ELSE 0 END) AS n FROM embeddings, bt GROUP BY vec_id),
sg AS (SELECT vec_id, i, CASE WHEN i <= 2 THEN (embedding[i] > 0) <> (embedding[i + 62] > 0) ELSE embedding[i] > 0 END AS b FROM embeddings, bt WHERE i <= 62),
w AS (SELECT vec_id, sum(CASE WHEN b THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)::BIGINT AS d FROM sg GROUP BY vec_id),
o AS (SELECT vec_id, xor(d, CASE WHEN vec_id % 3 = 0 THEN xor(xor(CAST(1 AS BIGINT) << CAST(vec_id % 61 AS INTEGER), CAST(1 AS BIGINT) << CAST(vec_id * 7 % 61 AS INTEGER)), CAST(1 AS BIGINT) << CAST(vec_id * 13 % 61 AS INTEGER)) ELSE CAST(1 AS BIGINT) << CAST(vec_id * 5 % 61 AS INTEGER) END) AS d FROM w),
p AS (SELECT a.vec_id AS m_id, b.vec_id AS j, bit_count(xor(a.d, b.d)) AS h FROM w a CROSS JOIN o b),
k AS (SELECT m_id, j, h, row_number() OVER (PARTITION BY m_id ORDER BY h, j) AS n, lead(h) OVER (PARTITION BY m_id ORDER BY h, j) AS h2 FROM p)
SELECT m_id, (m_id // 25)::DOUBLE AS r, (m_id % 25)::DOUBLE AS c, (m_id % 25 - j % 20)::DOUBLE AS dx, (m_id // 25 - j // 20)::DOUBLE AS dy FROM k WHERE n = 1 AND h < 0.9 * h2""",
    "consistent_matches": f"WITH {CONSISTENT} SELECT m_id FROM ok",
    "scene_rotation": f"""WITH {MATCHES}, s AS (SELECT c - dx AS sx, r - dy AS sy, c, r FROM mt), m AS (SELECT avg(sx) AS a, avg(sy) AS b, avg(c) AS p, avg(r) AS q FROM s)
SELECT round(degrees(atan2(sum((sx - a) * (r - q) - (sy - b) * (c - p)), sum((sx - a) * (c - p) + (sy - b) * (r - q)))), 6) + 0.0 AS degrees FROM s, m""",
    "first_guess": f"WITH {CONSISTENT} SELECT mt.m_id AS pt_id, round(c, 6) + 0.0 AS x, round(r, 6) + 0.0 AS y, round(dx, 6) + 0.0 AS dx_prior, round(dy, 6) + 0.0 AS dy_prior, 6 AS radius_x, 8 AS chip_x FROM mt JOIN ok ON ok.m_id = mt.m_id",
    "wanted": f"WITH {PX}, {GRID} SELECT pt_id FROM pt WHERE pt_id % 4 <> 1",
    "merge_levels": f"""WITH {PX}, {GRID}, k AS (SELECT gi, gj, x, pt_id, CASE WHEN pt_id % 2 = 0 THEN 8 WHEN pt_id % 3 = 0 THEN 16 WHEN pt_id % 5 = 0 THEN 32 ELSE 0 END AS chip_size FROM pt)
SELECT gi, gj, round(x / nullif(chip_size, 0)::DOUBLE, 6) + 0.0 AS dx, chip_size, chip_size > 0 AND pt_id % 2 = 0 AS interpolated FROM k""",
    "integral": f"WITH {PX}, a AS (SELECT r, c, sum(v) OVER (PARTITION BY r ORDER BY c) AS s FROM px) SELECT r, c, round(sum(s) OVER (PARTITION BY c ORDER BY r), 6) + 0.0 AS s FROM a",
    "integral_sq": f"WITH {PX}, a AS (SELECT r, c, sum(v * v) OVER (PARTITION BY r ORDER BY c) AS s FROM px) SELECT r, c, round(sum(s) OVER (PARTITION BY c ORDER BY r), 6) + 0.0 AS s FROM a",
    "boxsum": f"WITH {PX}, {offsets(0, 7, 0, 4)} SELECT m.r, m.c, round(sum(q.v), 6) + 0.0 AS s FROM px m CROSS JOIN off JOIN px q ON q.r = m.r + off.a AND q.c = m.c + off.b GROUP BY m.r, m.c HAVING count(*) = 40",
    "scale01": f"WITH {PX}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM px) SELECT r, c, round((v - lo) / (hi - lo), 6) + 0.0 AS v FROM px, m",
    "cell_max_radius": f"WITH {PX}, {GRID}, {UNEVEN} SELECT a.gi // 4 AS gi, a.gj // 4 AS gj, max(b.rx) AS radius_x FROM un a JOIN un b ON b.gi BETWEEN a.gi - 2 AND a.gi + 1 AND b.gj BETWEEN a.gj - 2 AND a.gj + 1 WHERE a.gi % 4 = 0 AND a.gj % 4 = 0 GROUP BY a.gi, a.gj",
    "coarse_fraction": f"WITH {PX}, {FIELD} SELECT round(count(CASE WHEN gi % 3 = 0 THEN 1 END) / count(*)::DOUBLE, 6) + 0.0 AS fraction FROM fd WHERE dx IS NOT NULL AND radius > 0",
    "nmeasured": f"WITH {PX}, {FIELD} SELECT count(dx) AS n FROM fd",
    "ramp_phase": f"{RAMP} SELECT round(px, 6) + 0.0 AS phase_x, round(py, 6) + 0.0 AS phase_y FROM xs, ys",
    "deramp": f"{RAMP}, a AS (SELECT r, c, re, im, -((r - 1) * py + (c - 1) * px) AS a FROM zc, xs, ys) SELECT r, c, round(re * cos(a) - im * sin(a), 6) + 0.0 AS re, round(re * sin(a) + im * cos(a), 6) + 0.0 AS im FROM a",
    "windowmax": reduced(5, 5, "max(h)"),
    "windowmin": reduced(4, 4, "min(h)"),
    "windowrange": reduced(7, 3, "max(h) - min(h)"),
    "windowmean": reduced(5, 5, "avg(h)"),
    "windowmean_clamped": reduced(100, 3, "avg(h)"),
    "windowmedian": reduced(3, 3, "median(h)"),
    "windowmad": f"WITH {PX}, {MASKED}, {window(3, 3)}, m AS (SELECT r, c, median(h) AS m FROM nb GROUP BY r, c) SELECT nb.r, nb.c, round(median(abs(h - m)), 6) + 0.0 AS out FROM nb JOIN m ON m.r = nb.r AND m.c = nb.c GROUP BY nb.r, nb.c",
    "windowmedmad": f"WITH {PX}, {MASKED}, {window(4, 4)}, m AS (SELECT r, c, median(h) AS m FROM nb GROUP BY r, c) SELECT nb.r, nb.c, round(max(m), 6) + 0.0 AS med, round(median(abs(h - m)), 6) + 0.0 AS mad FROM nb JOIN m ON m.r = nb.r AND m.c = nb.c GROUP BY nb.r, nb.c",
    "count_agreeing": f"WITH {PX}, {MASKED}, {window(5, 5)} SELECT r, c, count(CASE WHEN abs(h - mine) < 0.1::DOUBLE THEN 1 END) AS n FROM nb GROUP BY r, c",
    "highpass": filtered(5, HIGH),
    "wallis": filtered(5, f"({HIGH}) / sd.sd", DEV) + " JOIN sd ON sd.r = m.r AND sd.c = m.c",
    "erode_mask": f"WITH {PX}, {MASKED}, {offsets(1, 1, 1, 1)}, {ERODED} SELECT m.r, m.c, round(m.v, 6) + 0.0 AS v, er.ok AS valid FROM mk m JOIN er ON er.r = m.r AND er.c = m.c",
    "sobel": derivative([([-1, 0, 1], [1, 2, 1]), ([1, 2, 1], [-1, 0, 1])], "h"),
    "laplacian": derivative([([1, -2, 1], [1, 2, 1]), ([1, 2, 1], [1, -2, 1])], "CASE WHEN abs(h) > 0 THEN ln(abs(h)) END"),
    "decibel": f"WITH {PX}, {MASKED}, d AS (SELECT r, c, CASE WHEN abs(h) > 0 THEN 20 * log10(abs(h)) END AS d FROM mk) SELECT r, c, round(coalesce(d, 0), 6) + 0.0 AS v, d IS NOT NULL AS valid FROM d",
    "quantize_uint8": quantized(f"WITH {PX}, {MASKED}, src AS (SELECT r, c, h AS q, ok AS valid FROM mk)"),
    "quantize_none": f"WITH {PX}, {MASKED} SELECT r, c, round(v, 6) + 0.0 AS v, ok AS valid FROM mk",
    "prepare": quantized(f"WITH {PX}, {MASKED}, {window(5, 5)}, s AS (SELECT r, c, avg(h) AS mean FROM nb GROUP BY r, c), {ERODED}, src AS (SELECT m.r, m.c, CASE WHEN er.ok AND m.h IS NOT NULL THEN {HIGH} END AS q, er.ok AND m.h IS NOT NULL AS valid FROM mk m JOIN s ON s.r = m.r AND s.c = m.c JOIN er ON er.r = m.r AND er.c = m.c)"),
    "filter_identity": f"WITH {PX}, {MASKED} SELECT r, c, round(v, 6) + 0.0 AS v, ok AS valid FROM mk",
    "resample_nearest": f"WITH {PX}, {MASKED}, yy AS (SELECT unnest(range(1, CAST(n * 3 // 2 + 1 AS BIGINT))) AS k, n FROM dims), xx AS (SELECT unnest(range(1, 41)) AS k) SELECT CAST(yy.k AS INTEGER) AS r, CAST(xx.k AS INTEGER) AS c, round(h, 6) + 0.0 AS v FROM yy CROSS JOIN xx JOIN mk ON mk.r = least(greatest(floor((yy.k - 0.5) * (n::DOUBLE / (n * 3 // 2))) + 1, 1), n) AND mk.c = least(greatest(floor((xx.k - 0.5) * {64 / 40!r}::DOUBLE) + 1, 1), 64)",
    "resample_area": resampled(area_axis("yy", "n", "n * 5 // 12"), area_axis("xx", "64", "24"), "> 0"),
    "resample_bicubic": resampled(cubic_axis("yy", "n", "n * 3 // 2"), cubic_axis("xx", "64", "100"), ">= 0.5"),
    "dilate_within": f"WITH {PX}, t AS (SELECT r, c FROM px WHERE (r * 13 + c * 7) % 101 = 0) SELECT px.r, px.c, bool_or(t.r IS NOT NULL) AS m FROM px LEFT JOIN t ON (t.r - px.r) * (t.r - px.r) + (t.c - px.c) * (t.c - px.c) <= 9 GROUP BY px.r, px.c",
    "reject_outliers": f"WITH {PX}, {rejection()} SELECT fd.gi, fd.gj, k5.gi IS NOT NULL AS keep FROM fd LEFT JOIN k5 ON k5.gi = fd.gi AND k5.gj = fd.gj",
    "no_outlier_filter": f"WITH {PX}, {FIELD} SELECT gi, gj, dx IS NOT NULL AND dy IS NOT NULL AS keep FROM fd",
    "fill_holes": f"WITH {PX}, {filling()} SELECT gi, gj, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, filled FROM f3",
    "velocity": f"WITH {PX}, {FIELD} SELECT gi, gj, round(-dx * 240, 6) + 0.0 AS vx, round(dy * 240, 6) + 0.0 AS vy FROM fd",
    "reflect101": "WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey * 3 AS i FROM lineitem), m AS (SELECT *, ((i - 1) % 16 + 16) % 16 AS m FROM s) SELECT l_orderkey, l_linenumber, i, CAST(least(m, 16 - m) + 1 AS BIGINT) AS j FROM m",
    "dt_years": "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / (31557600.0::DOUBLE * 1000000), 9) + 0.0 AS years FROM events GROUP BY user_id",
    "cubic_weights": "WITH q AS (SELECT l_orderkey, l_linenumber, (l_partkey % 97) / 97.0::DOUBLE AS t FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({w}, 9) + 0.0 AS w{k}" for k, w in enumerate(CUBIC)) + " FROM q",
    "next_fft_size": """WITH s AS (SELECT DISTINCT p_partkey % 700 + 1 AS n FROM part), a AS (SELECT unnest(range(0, 11)) AS k), b AS (SELECT unnest(range(0, 7)) AS k), c AS (SELECT unnest(range(0, 5)) AS k), d AS (SELECT unnest(range(0, 4)) AS k),
m AS (SELECT CAST(pow(2, a.k) * pow(3, b.k) * pow(5, c.k) * pow(7, d.k) AS BIGINT) AS m, a.k AS twos FROM a, b, c, d), x AS (SELECT n, m, row_number() OVER (PARTITION BY n ORDER BY m * m * log2(m) * (1 - 0.35::DOUBLE * twos / log2(m)), m) AS k FROM s JOIN m ON m >= n AND m <= ceil(1.5 * n) WHERE n > 1),
z AS (SELECT n, m FROM x WHERE k = 1 UNION ALL SELECT 1, 1) SELECT p_partkey, CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS size FROM part JOIN z ON n = p_partkey % 700 + 1""",
    "pair_series": """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS site, lpad(CAST(event_id AS VARCHAR), 12, '0') AS sec_id, ts FROM events),
b AS (SELECT site, sec_id, ts, lag(sec_id) OVER (PARTITION BY site ORDER BY ts, sec_id) AS ref_id, lag(ts) OVER (PARTITION BY site ORDER BY ts, sec_id) AS t0 FROM a)
SELECT site, ref_id || '-' || sec_id AS pair_id, ref_id, sec_id, round((epoch_us(ts) - epoch_us(t0)) / (31557600.0::DOUBLE * 1000000), 9) + 0.0 AS years FROM b WHERE ref_id IS NOT NULL""",
    "track": track_sql(6),
    "track_arrow": track_sql(3),
}


def _scattered() -> str:
    """Points at part keys with priors (-2, -1): the chip is cut two columns and one row on, outside is zero."""
    chip = CHIP.replace("s.r = y - 4 + i.k AND s.c = x - 4 + j.k", "s.r = y + 1 - 4 + i.k AND s.c = x + 2 - 4 + j.k")
    pt = "pt AS (SELECT CAST(p_partkey AS BIGINT) AS pt_id, CAST(p_partkey % 44 + 10 AS INTEGER) AS x, CAST(p_partkey * 7 % (n - 20) + 10 AS INTEGER) AS y FROM part, dims)"
    return (f"WITH {PX}, {WRAP}, {pt}, {OFF8}, {chip}, {ZNCC}, {PEAK} SELECT pt_id, sx - 4 - 2 + 0.0::DOUBLE AS dx, sy - 4 - 1 + 0.0::DOUBLE AS dy, "
            "round(score, 6) + 0.0 AS correlation, true AS searched FROM pk")


def _turned(angle: float) -> str:
    """Chips of ``sec`` turned by an angle that is not zero, as in rotate_chip."""
    a = f"radians({angle}::DOUBLE)"
    return f"""tn AS (SELECT i.k AS i, j.k AS j, 4.5 + cos({a}) * (i.k - 3.5) + sin({a}) * (j.k - 3.5) AS sy, 4.5 - sin({a}) * (i.k - 3.5) + cos({a}) * (j.k - 3.5) AS sx FROM o8 i CROSS JOIN o8 j),
tp AS (SELECT i, j, floor(sy) AS a, floor(sx) AS b, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM tn),
cl AS (SELECT pt_id, i, j, fy, fx, y - 5 + a AS r0, x - 5 + b AS c0, a >= 1 AND b >= 1 AND a + 1 <= 8 AND b + 1 <= 8 AS inside FROM pt CROSS JOIN tp),
chip AS (SELECT pt_id, i, j, CASE WHEN inside THEN (1 - fy) * ((1 - fx) * p.v + fx * q.v) + fy * ((1 - fx) * s.v + fx * t.v) ELSE 0 END AS v
  FROM cl LEFT JOIN sec p ON p.r = r0 AND p.c = c0 LEFT JOIN sec q ON q.r = r0 AND q.c = c0 + 1 LEFT JOIN sec s ON s.r = r0 + 1 AND s.c = c0 LEFT JOIN sec t ON t.r = r0 + 1 AND t.c = c0 + 1)"""


def _rotations(what: str) -> str:
    """Chips turned by three angles: the best angle of each point, or its peak as a displacement."""
    parts = [f"SELECT * FROM (WITH {PX}, {SEC}, {GRID}, {OFF8}, {_turned(a) if a else CHIP}, {ZNCC} SELECT pt_id, {k} AS angle_idx, sy, sx, round(coalesce(score, 0), 9) AS p, coalesce(score, 0) AS s FROM zs) q{k}"
             for k, a in enumerate((-6.0, 0.0, 6.0))]
    return ("WITH every AS (" + " UNION ALL ".join(parts) + "), b AS (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY p DESC, angle_idx, sy, sx) AS k FROM every) " + what)


def _levels() -> str:
    """One level of chip 8 on the grid that is inset for chip 16, refined to an eighth and rejected; nothing is left for a second."""
    grid = GRID.replace("10 + 8 * (k.i - 1)", "14 + 8 * (k.i - 1)").replace("64 - 9", "64 - 13").replace("n - 9", "n - 13")
    found = "fd AS (SELECT gi, gj, fp.x / 8.0::DOUBLE + j0 - 4 AS dx, fp.y / 8.0::DOUBLE + i0 - 4 AS dy, 4 AS radius FROM pt JOIN fp ON fp.pt_id = pt.pt_id JOIN ap ON ap.pt_id = pt.pt_id)"
    rejected = rejection().replace(FIELD, found).replace("64 * 8", "8 * 4")
    return (f"WITH {PX}, {WRAP}, {grid}, {OFF8}, {CHIP}, {ZNCC}, {PEAK}, {PATCH}, {cascade()}, {FINE}, {rejected}, lv AS (SELECT pt.gi, pt.gj, round(x4, 6) + 0.0 AS dx, round(y4, 6) + 0.0 AS dy, "
            "CASE WHEN x4 IS NULL THEN 0 ELSE 8 END AS chip_size, false AS interpolated FROM pt LEFT JOIN (SELECT gi, gj, x * 4 AS x4, y * 4 AS y4 FROM k5) k ON k.gi = pt.gi AND k.gj = pt.gj)")


ORACLES |= {
    "track_scattered": _scattered(),
    "rotation_search": _rotations("SELECT pt_id, CAST(angle_idx AS INTEGER) AS angle_idx, round(s, 6) + 0.0 AS peak FROM b WHERE k = 1"),
    "rotation_track_rows": _rotations("SELECT pt_id, (sx - 4)::DOUBLE AS dx, (sy - 4)::DOUBLE AS dy, round(s, 3) + 0.0 AS correlation, true AS searched FROM b WHERE k = 1"),
    "rotation_track_arrow": _rotations("SELECT pt_id, (sx - 4)::DOUBLE AS dx, (sy - 4)::DOUBLE AS dy, round(s, 3) + 0.0 AS correlation, true AS searched FROM b WHERE k = 1"),
    "multichip_track": f"{_levels()} SELECT gi, gj, dx, dy, chip_size, interpolated FROM lv",
    "result_layers": f"""{_levels()} SELECT 'vx' AS layer, gi, gj, -dx + 0.0 AS value FROM lv UNION ALL SELECT 'vy', gi, gj, dy FROM lv UNION ALL SELECT 'chip_size', gi, gj, chip_size::DOUBLE FROM lv
UNION ALL SELECT 'interpolated', gi, gj, CASE WHEN interpolated THEN 1 ELSE 0 END::DOUBLE FROM lv""",
}


#: Corners: gradients, structure tensor over 5 x 5, the highest score within 3 pixels, 20 pixels clear of the image's edge.
CORNERS = f"""WITH {PX}, g AS (SELECT a.r, a.c, (coalesce(d.v, 0) - coalesce(u.v, 0)) / 2 AS gy, (coalesce(e.v, 0) - coalesce(w.v, 0)) / 2 AS gx FROM px a LEFT JOIN px d ON d.r = a.r + 1 AND d.c = a.c
  LEFT JOIN px u ON u.r = a.r - 1 AND u.c = a.c LEFT JOIN px e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN px w ON w.r = a.r AND w.c = a.c - 1),
o AS (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS k), t AS (SELECT g.r + y.k AS r, g.c + x.k AS c, sum(gx * gx) AS a, sum(gx * gy) AS b, sum(gy * gy) AS d FROM g, o y, o x WHERE abs(y.k) <= 2 AND abs(x.k) <= 2 GROUP BY 1, 2),
s AS (SELECT t.r, t.c, a * d - b * b - 0.04::DOUBLE * (a + d) * (a + d) AS s FROM t, dims WHERE t.r > 20 AND t.r <= n - 20 AND t.c > 20 AND t.c <= 44),
m AS (SELECT s.r + y.k AS r, s.c + x.k AS c, max(s.s) AS m FROM s, o y, o x WHERE y.k <> 0 OR x.k <> 0 GROUP BY 1, 2)
SELECT CAST((s.r - 1) * 64 + s.c AS BIGINT) AS k_id, s.r::DOUBLE AS r, s.c::DOUBLE AS c, round(s.s, 9) + 0.0 AS score FROM s LEFT JOIN m ON m.r = s.r AND m.c = s.c WHERE s.s > 0 AND (m.m IS NULL OR s.s > m.m)"""
ORACLES["detect_corners"] = CORNERS
#: Planes lie one after another; 32-bit values to four places.
ORACLES["raw_planes"] = f"""WITH {PX}, {FIELD}, q AS (SELECT gi AS r, gj AS c, dx AS v FROM fd UNION ALL SELECT gi, gj + 64, dy FROM fd UNION ALL SELECT gi, gj + 128, 0.5 FROM fd)
SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) + 0.0 AS v, v IS NOT NULL AS valid FROM q"""
FAR = f"WITH {PX}, t AS (SELECT r, c FROM px WHERE (r * 13 + c * 7) % 1009 = 0), d AS (SELECT px.r, px.c, CAST(min((t.r - px.r) * (t.r - px.r) + (t.c - px.c) * (t.c - px.c)) AS BIGINT) AS d2 FROM px CROSS JOIN t GROUP BY px.r, px.c)"
ORACLES["distance_transform"] = f"{FAR} SELECT r, c, d2 FROM d"
ORACLES["dilate_far"] = f"{FAR} SELECT r, c, d2 <= 156 AS m FROM d"
ORACLES["finish_blocks"] = ORACLES["reject_outliers"]
ORACLES["raster_velocity"] = f"""{_levels()} SELECT lv.gi, lv.gj, 1000.0::DOUBLE + (14 + 8 * (gj - 1) - 1) * 120.0::DOUBLE AS map_x, 9000.0::DOUBLE - (14 + 8 * (gi - 1) - 1) * 120.0::DOUBLE AS map_y,
round(-dx * 240, 6) + 0.0 AS vx, round(dy * 240, 6) + 0.0 AS vy, chip_size, 'EPSG:3413' AS crs FROM lv"""
#: Places of rows and columns in the lists are their new indices.
ORACLES["subset"] = f"""WITH {PX}, {GRID}, h AS (SELECT max(gi) AS n FROM pt), a AS (SELECT CAST(row_number() OVER () AS INTEGER) AS i, k FROM (SELECT unnest(list_concat(range(CAST(n AS BIGINT), 0, -2), [3, 3])) AS k FROM h)),
b AS (SELECT CAST(row_number() OVER () AS INTEGER) AS j, k FROM (SELECT unnest([5, 1, 2]) AS k)), t AS (SELECT max(i) AS m FROM a)
SELECT CAST((j - 1) * m + i - 1 AS BIGINT) AS pt_id, i AS gi, j AS gj, x::DOUBLE AS x, y::DOUBLE AS y FROM pt JOIN a ON a.k = gi JOIN b ON b.k = gj, t"""
ORACLES["rebuild"] = f"WITH {PX}, {GRID} SELECT pt_id, x::DOUBLE AS x, y + 1.0::DOUBLE AS y, 6 AS radius_x, 4 AS radius_y, (pt_id % 9) / 4.0::DOUBLE AS dx_prior FROM pt"
