"""Fits that hold at scale: cells in place of rows, groups fitted together, few tasks a job."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hearlog.operators import clusters, evaluate, fatigue, origin, weekly
from hearlog.params import Params
from hearlog.session import sized

LIGHT = Params(forest_trees=5, boost_rounds=4, boost_depth=2, folds=3)


def labelled(spark, rows=6000, weight=False):
    """Labels that follow the first feature; the second is a flag that one row in 1,500 has."""
    ids = spark.range(rows).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"))
    made = ids.select(
        (F.col("x") > 0.7).cast("int").alias("label"), (F.col("id") % 10 >= 8).cast("int").alias("part"),
        (F.col("id") % 3).cast("int").alias("fold"),
        array_to_vector(F.array("x", (F.col("id") % 1500 == 7).cast("double"), (F.col("id") % 7).cast("double"))).alias("features"),
    )
    return made.withColumn("weight", F.lit(2.0) - F.col("label")) if weight else made


def test_bins_keep_few_values_apart_and_share_many_evenly(spark):
    flags, days = evaluate.bin_borders(labelled(spark), 3)[1:]
    assert flags == [0.0, 1.0] and days == [float(d) for d in range(7)]
    assert 30 <= len(evaluate.bin_borders(labelled(spark), 3)[0]) <= evaluate.BINS
    # A value that most rows have gets a bin of its own and leaves the others theirs.
    heavy = spark.range(4000).select(array_to_vector(F.array(
        F.when(F.col("id") % 4 > 0, 50.0).otherwise(F.col("id") / 40)
    )).alias("features"))
    borders = evaluate.bin_borders(heavy, 1)[0]
    assert 50.0 in borders and 48 < borders[borders.index(50.0) - 1] < 50
    assert borders[-1] == 99.9 and sum(b > 50 for b in borders) >= 3 and sum(b < 50 for b in borders) >= 3


def test_cells_and_blocks_hold_all_rows(spark):
    rows = labelled(spark, weight=True)
    found = evaluate.cells(rows, 3)
    sums = found.agg(*[F.sum(c) for c in ("part_0", "part_1", "fold_0", "fold_1", "fold_2")]).first()
    assert list(sums) == [4800, 1200, 2000, 2000, 2000]
    assert found.count() < 800
    for most in (1, 5):
        dealt = evaluate.blocks(found, F.col("part_0"), most)
        want = rows.filter("part = 0").agg(F.sum("weight")).first()[0]
        got = dealt.agg(F.sum("rows_weight").alias("w"), F.max("rows_weight").alias("most"), F.count("*").alias("n")).first()
        assert got["w"] == pytest.approx(want) and got["most"] <= 2 * most
        assert got["n"] == 4800 if most == 1 else got["n"] < 2000


@pytest.mark.parametrize("kind", ["boosting", "forest"])
def test_fits_go_over_blocks_and_score_every_row(spark, monkeypatch, kind):
    monkeypatch.setattr(evaluate, "BLOCKS", 300)
    estimator = fatigue.boosting(LIGHT) if kind == "boosting" else origin.forest(LIGHT)
    fitted = []
    blocks = evaluate.blocks

    def seen(*args):
        fitted.append(blocks(*args).count())
        return blocks(*args)

    monkeypatch.setattr(evaluate, "blocks", seen)
    model, matrix, scores = evaluate.train_and_score(estimator, labelled(spark, weight=kind == "forest"), LIGHT)
    assert matrix.agg(F.sum("plays")).first()[0] == 1200
    # Four fits over cells and 300 blocks, where the rows are 4,000 and more.
    assert len(fitted) == 4 and max(fitted) < 1200
    assert scores["accuracy"] > 0.9 and scores["cv_f1_mean"] > 0.9
    assert model.featureImportances[0] > 0.9


def test_groups_fitted_together_are_as_fitted_alone():
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(7, 20, 3)), 1)
    points[3] = 0
    fit = clusters.searched(4, 3, 4, 42)
    for alone, together in zip([fit(p[None])[0] for p in points], fit(points), strict=True):
        assert alone.keys() == together.keys()
        assert all((alone[name] == together[name]).all() for name in alone)
    centres = clusters.seeded(points, 3, range(5))
    own, moved = clusters.lloyd_together(points, centres)
    for at in range(len(points)):
        one, its = clusters.lloyd(points[at], centres[at])
        assert (one == own[at]).all() and (its == moved[at]).all()


def test_rows_of_unequal_size_are_fitted_in_slices(spark):
    most = clusters.TOGETHER
    made = spark.range(0, most + 200, 1, 1).select("id", F.transform(
        F.sequence(F.lit(1), F.col("id") % 3 + 2), lambda i: F.array(i.cast("double"), F.col("id").cast("double"))
    ).alias("points"))

    def sums(points):
        if len(points) > most:
            raise ValueError("all at once")
        return [{"sums": p.sum(axis=0), "groups": np.array([len(points)], np.int32)} for p in points]

    found = clusters.fitted(made, sums, {"sums": "double", "groups": "int"}).collect()
    assert len(found) == most + 200
    for row in found:
        size = row["id"] % 3 + 2
        assert row["sums"] == [size * (size + 1) / 2, size * row["id"]]


def test_a_fit_of_all_weeks_has_few_tasks(spark):
    many = spark.range(0, 460_000, 1, 60)
    assert sized(many, 460_000, weekly.WEEKS_PER_TASK).rdd.getNumPartitions() == 4
