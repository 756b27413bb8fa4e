"""Two-stage outlier rejection over a displacement grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrid.operators.finish_arrow import finish
from shiftgrid.params import Gardner
from shiftgrid.registry import OutlierFilter


def reject_outliers(field: DataFrame, f: Gardner | OutlierFilter | None, upsampling: int, shape: tuple[int, int], keys=("pair_id",), r="gi", c="gj") -> DataFrame:
    """``field(keys, gi, gj, dx, dy, radius_x, radius_y, ...)`` with ``keep``.

    Displacements are over their radius (missing for radius 0). First, ``iterations`` times: at least a
    fixed fraction of the full window agrees within a tolerance on both axes. Then, one time fewer but at
    least once: both lie within ``mad_scale`` deviations of the window's median, or two sub-pixel steps.
    A rejected point is missing from then on, so rejection is monotone. All passes of a block of the grid
    are one task's, so a field is shuffled once.
    """
    measured = F.col("dx").isNotNull() & F.col("dy").isNotNull()
    if f is None:
        return field.withColumn("keep", measured)
    if isinstance(f, OutlierFilter):
        return f.columns(field, upsampling, shape).withColumn("keep", F.coalesce("keep", F.lit(False)) & measured)
    return finish(field, f, upsampling, shape, keys=keys, r=r, c=c)
