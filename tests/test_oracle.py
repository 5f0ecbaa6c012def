"""Registered queries against their SQL on the smallest tables.

By default a cross-section runs; ``SPANACCORD_ALL=1`` runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
SOME = """p10_boundary_long p13_zscore v04_unmapped w04_next_skipping w06_merge_runs w13_concentration j05_join_id_list j09_assign_windows j15_shared_boundaries
j19_compare_runs a01_align_windows a03_align_classes g02_error_summary g03_with_totals g25_box_stats m03_class_metrics m10_mcnemar_exact r02_weighted_auc r05_weighted_median
b04_boot_metrics_two_way b07_boot_delta d01_cap_sample d05_balanced_draws l01_absorbed l04_target_encode t02_strip_tags t05_find_environments u05_seed_spread q04_tier_consistency s05_read_xml_units""".split()
NAMES = sorted(entry.queries()) if os.environ.get("SPANACCORD_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    msg, ok = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, msg


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


def test_entry(spark):
    assert entry.entry(spark).columns
