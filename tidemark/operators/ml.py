"""Time-split classifier: feature matrix, boosted trees, probabilities, importances."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ["price_momentum_60d", "sold_velocity_30d", "spread_at_cutoff", "rare_tier_premium", "search_slope_60d", "search_accel", "social_velocity_60d", "price_momentum_60d_peer_z", "sold_velocity_30d_peer_z", "search_slope_60d_peer_z", "social_velocity_60d_peer_z", "celebrity_event_count_90d", "celebrity_recency_days"]
FLAGS, CATEGORIES = ["collab_flag", "archive_flag"], ["brand", "category"]
#: Training rows that a task goes through: a few hundredths of a second's work a level of a tree.
ROWS_A_TASK = 50_000


def matrix(rows: DataFrame) -> DataFrame:
    """Numbers as doubles with a flag where missing, booleans as 0 and 1, and the balanced weight of each class."""
    out = rows.withColumns({c: F.col(c).cast("double") for c in NUMERIC + FLAGS} | {f"{c}_missing": F.col(c).isNull().cast("double") for c in NUMERIC} | {"y": F.col("label").cast("double")})
    share = out.agg(F.avg("y")).first()[0] or 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    return out.withColumn("weight", F.when(F.col("y") > 0, 0.5 / share).otherwise(0.5 / (1 - share)))


def train(rows: DataFrame, trees: int = 200, depth: int = 4, rate: float = 0.05, seed: int = 7) -> PipelineModel:
    filled = [f"{c}_f" for c in NUMERIC]
    stages = [
        Imputer(inputCols=NUMERIC, outputCols=filled, strategy="median"),
        StringIndexer(inputCols=CATEGORIES, outputCols=[f"{c}_i" for c in CATEGORIES], handleInvalid="keep"),
        VectorAssembler(inputCols=filled + [f"{c}_missing" for c in NUMERIC] + FLAGS + [f"{c}_i" for c in CATEGORIES], outputCol="x", handleInvalid="keep"),
        GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, maxBins=256),
    ]
    kept = gathered(matrix(rows))
    try:
        return Pipeline(stages=stages).fit(kept)
    finally:
        kept.unpersist()


def gathered(rows: DataFrame) -> DataFrame:
    """rows with what the model reads, kept, in as few partitions as hold ROWS_A_TASK each.

    Every level of every tree is a job of its own over all rows, about a thousand in all, so what counts is a
    task's fixed cost. All rows stay.
    """
    kept = rows.select(*NUMERIC, *FLAGS, *CATEGORIES, *(f"{c}_missing" for c in NUMERIC), "y", "weight")
    return kept.repartition(kept.count() // ROWS_A_TASK + 1).persist()


def scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(matrix(rows))
    return out.select("family_id", F.col("prediction_moment").alias("cutoff"), "label", "search_slope_60d", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, gain share) of the two dozen inputs, largest first."""
    names = model.stages[2].getInputCols()
    values = model.stages[3].featureImportances.toArray().tolist()
    return sorted(zip(names, values, strict=True), key=lambda x: (-x[1], x[0]))


def smell_test(ranked: list[tuple[str, float]], dominance: float = 0.8, static: tuple[str, ...] = ("brand_i", "category_i", "collab_flag", "archive_flag")) -> list[str]:
    """Warnings about a model that looks leaky: nothing learned, one dominant input, or a static one on top."""
    total = sum(v for _, v in ranked)
    if not total:
        return ["all importances are zero"]
    out = [f"{ranked[0][0]} holds {ranked[0][1] / total:.0%} of the importance"] if ranked[0][1] / total > dominance else []
    return out + ([f"static attribute {ranked[0][0]} on top"] if ranked[0][0] in static else [])
