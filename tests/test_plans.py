"""Physical plans keep the properties that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from scanlake.operators import ordered, sweeps
from scanlake.plans import catalogue, tables

SF = "/root/testdata/sf0.001"
EAGER = ("sm", "src", "ag17", "gr6_outer", "layer_", "ag15", "ag18", "jn4", "autofocus", "index_marks", "ag19_frame_ticks", "ag6_flat_field_tiled")  # these run jobs while they are built
LAZY = sorted(n for n in catalogue.queries() if not n.startswith(EAGER) or n.startswith(("src2", "src7", "src9")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_products_and_no_global_windows(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for spec in re.findall(r"windowspecdefinition\((.*?)(?:specifiedwindowframe|$)", text):
        assert not re.match(r"[\w#]+ (ASC|DESC)", spec), f"window without partition: {spec}"
    assert "SinglePartition" not in text or name in ("jn4_apply_flat",)


def test_scans_read_only_what_is_needed(spark):
    text = plan(tables.sweep(spark, SF).groupBy("sweep_id").agg(F.max("metric")))
    assert "props" not in text
    text = plan(tables.captures(spark, SF).select("capture_id"))
    assert "EqualTo(event_type,purchase)" in text and "value" not in text.split("ReadSchema")[1]


def test_windows_carry_the_slice(spark):
    text = plan(sweeps.smoothed_delta(tables.sweep(spark, SF), 10))
    assert all(ordered.SLICE in part for part in re.findall(r"hashpartitioning\((.*?)\)", text) if "sweep_id" in part)


def test_nearest_k_limits_before_the_shuffle(spark):
    text = plan(sweeps.nearest_k(spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id AS sweep_id", "event_id AS i", "value AS z_mm"), F.lit(1.0), 3))
    assert text.count("WindowGroupLimit") == 2


#: Most scans and exchanges (broadcasts left out) of some plans; more is a step back.
LIMITS = {
    "sharpest_frame": (2, 4), "fl4_colour_mask": (1, 0), "ag6_flat_field": (1, 2), "ag8_best_focus": (2, 4), "gr7_tile_equalise": (2, 5), "jn3_predict_surface": (4, 4), "jn7_latest_position": (4, 8),
    "tk5_suppress_near": (1, 2), "tk1_nearest_k": (2, 4), "wn4_peak_crossing": (2, 6), "wn5_find_edge": (6, 12), "wn10_reference_track": (4, 7),
    "gr2_laplacian_tiled": (1, 2), "gr3_gaussian_blur_tiled": (1, 2), "gr4_opening_tiled": (1, 2), "gr7_tile_equalise_tiled": (1, 2), "wn1_temporal_average_tiled": (1, 2),
}


@pytest.mark.parametrize("name", sorted(LIMITS))
def test_scans_and_exchanges(spark, name):
    text = plan(catalogue.queries()[name](spark, SF)).split("== Initial Plan ==")[-1]
    found = len(re.findall(r"FileScan|Scan ExistingRDD", text)), len(re.findall(r"\bExchange ", text))
    assert all(n <= most for n, most in zip(found, LIMITS[name])), found


@pytest.mark.parametrize("name", ["ag15_grid_rotation", "jn5_near_pairs"])
def test_marks_of_small_frames_meet_in_the_list_of_the_frame(spark, name):
    text = plan(catalogue.queries()[name](spark, SF)).split("== Initial Plan ==")[-1]
    assert "FileScan" in text and "Join" not in text and len(re.findall(r"\bExchange ", text)) <= 2


@pytest.mark.parametrize("fresh", [False, True])
def test_one_sort_serves_the_windows_of_a_peak_search(spark, fresh):
    rows = spark.createDataFrame([], "sweep_id long, i long, z_mm double, metric double, n long")
    text = plan(sweeps.find_peak_crossing(rows, fresh=fresh)).split("== Initial Plan ==")[-1]
    assert text.count("Window [") >= 3 and text.count("Sort [") == 2  # the steps of the slices, and the slices of the sweeps


def test_clean_sweeps_bring_their_length(spark):
    text = plan(catalogue.queries()["wn4_peak_crossing_clean"](spark, SF)).split("== Initial Plan ==")[-1]
    assert len(re.findall(r"\b(?:SortMerge|BroadcastHash|ShuffledHash)Join ", text)) == 1 and len(re.findall(r"FileScan", text)) == 2
