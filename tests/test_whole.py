"""Queries read their tables whole: rows of larger tables that a slice by id would leave out."""

import pytest

from shiftgrid.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, size, key, least", [("hamming_match", "sf0.1", "m_id", 500), ("track_scattered", "sf0.01", "pt_id", 200)])
def test_query_reads_larger_tables_whole(spark, name, size, key, least):
    """At sf0.001 no row of these lies beyond the ids that they used to keep."""
    assert QUERIES[name](spark, SF.replace("sf0.001", size)).where(f"{key} >= {least}").count() > 0
