"""Plans and results that decide whether a query holds on tables 60 times as large."""

import pytest

from pixelmill.plans import REGISTRY, fixtures

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["error_flow", "rank_modes", "hard_rows"])
def test_pixel_filters_stay_short_and_pixels_are_read_once(spark, name):
    # written out in full a filter on classes had 4,000 to 7,000 signs, and ran interpreted
    plan = optimized(REGISTRY[name].run(spark, SF))
    assert max(len(line) for line in plan.splitlines() if "Filter (" in line) < 1500
    assert plan.count("Relation [") == 1


def test_tasks_grow_with_the_number_of_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "PER_TASK", 10)
    spark.range(400).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    assert fixtures.pixels(spark, str(tmp_path)).rdd.getNumPartitions() == 40


@pytest.mark.parametrize(
    "name",
    "drop_small edge_profile blob_shape width_of_nearest_ridge recall_by_property classify_fp_modes "
    "boundary_band_errors ring_median mask_nearest halo_split gate_isolation".split(),
)
def test_pixels_are_not_shuffled_between_steps(spark, name):
    # steps that built on each other sent whole pixel rows through an exchange, and a semi-join
    # with a list of pixels was broadcast; what is exchanged has to be ids or sums
    plan = REGISTRY[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "MapInArrow" in line:
            below = [lines[j] for j in range(i + 1, len(lines)) if depth[j] > depth[i]]
            assert not any("MapInArrow" in b for b in below)
            assert not any("Exchange" in b and "REPARTITION_BY_NUM" not in b for b in below)
    assert not any("Join" in line and "y#" in line for line in lines)


def test_passes_are_merged_without_an_exchange_of_pixels(spark):
    # the join exchanged every pixel of both passes
    plan = REGISTRY["tta_merge"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "y#" in line for line in plan.splitlines())
    assert "Join" not in plan


def test_small_clouds_are_compared_without_an_exchange(spark):
    # the tree wrote points to checkpoints and exchanged them in each of its rounds
    plan = REGISTRY["nearest_point"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ExistingRDD" not in plan
    assert not any("Exchange" in line and "REPARTITION_BY_NUM" not in line for line in plan.splitlines())
