"""The classifier sees every labelled cell with its own label, and all of its features keep the as-of rule."""

import inspect

from tidemark.operators import features, ml
from tidemark.plans import decision


def test_gbt_rows_are_the_labelled_cells(spark, tiny, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "train", lambda rows: seen.append(rows))
    monkeypatch.setattr(ml, "scores", lambda model, rows: rows)
    later = decision._gbt(spark, tiny)
    rows = seen[0].unionByName(later).persist()
    cells = lambda df: sorted((r["family_id"], r["prediction_moment"], r["label"]) for r in df.collect())
    assert cells(rows) == cells(decision._labels(spark, tiny))
    assert features.lookahead_violations(rows).first()["n_violations"] == 0


def test_gbt_trees():
    assert inspect.signature(ml.train).parameters["trees"].default == 200


def test_gbt_rows_are_gathered_in_few_partitions(spark, monkeypatch):
    columns = [f"cast(id as double) {c}" for c in ml.NUMERIC] + [f"id % 2 = 0 {c}" for c in ml.FLAGS] + [f"'x' {c}" for c in ml.CATEGORIES] + ["id % 3 = 0 label"]
    rows, seen = spark.range(0, 1000, 1, 16).selectExpr(*columns), []

    class Seen:
        def __init__(self, stages):
            self.stages = stages

        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count(), df.where("y = 1").count()))

    monkeypatch.setattr(ml, "Pipeline", Seen)
    ml.train(rows)
    monkeypatch.setattr(ml, "ROWS_A_TASK", 300, raising=False)
    ml.train(rows)
    assert seen == [(1, 1000, 334), (4, 1000, 334)]
