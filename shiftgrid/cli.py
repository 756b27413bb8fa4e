"""Command line: ``python -m shiftgrid.cli REF SEC NY NX OUT [CHIP] [RADIUS]`` over raw images."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="shiftgrid", description="Displacements between two raw images (column-major 32-bit floats).")
    a.add_argument("reference")
    a.add_argument("secondary")
    a.add_argument("ny", type=int)
    a.add_argument("nx", type=int)
    a.add_argument("out")
    a.add_argument("chip", type=int, nargs="?", default=32)
    a.add_argument("radius", type=int, nargs="?", default=25)
    x = a.parse_args(argv)
    from pyspark.sql import SparkSession

    from shiftgrid.params import params
    from shiftgrid.plans.api import grid_size, track_pair
    from shiftgrid.sources.planes import scan_planes
    from shiftgrid.sources.raw import write_raw

    spark = SparkSession.builder.getOrCreate()
    p = params(chip_size=x.chip, search_radius=x.radius)
    shape = (x.ny, x.nx)
    got = track_pair(scan_planes(spark, x.reference, *shape, "reference"), scan_planes(spark, x.secondary, *shape, "secondary"), shape, p, checkpoint=True)
    for row in write_raw(got, grid_size(shape, p), x.out).collect():
        print(row.path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
