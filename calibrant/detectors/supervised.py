"""Out-of-fold scores of a boosted-tree model (DET-04)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.detectors.features import FEATURES, with_features
from calibrant.operators.relational import keep_first
from calibrant.operators.sampling import grouped_folds


#: Texts of a task of the boosting: a small task's start takes longer than its work.
ROWS = 100_000


def out_of_fold(corpus: DataFrame, folds: int = 5, floor: int = 100, trees: int = 100, depth: int = 6, seed: int = 7, at_once: int = 5) -> DataFrame:
    """(row_id, score) of every corpus row; null where no model could be fitted.

    Per genre: one row per distinct text, whole repositories to one fold, a model
    per fold from the others, scores copied back to repeated texts. A genre needs
    ``floor`` distinct texts of each class. Up to ``at_once`` models are fitted side
    by side: a small stage of one leaves room for those of the others.
    """
    used = corpus.where((F.col("set") == "P") | ((F.col("set") == "N1") & F.col("matched").eqNullSafe(True)))
    used = used.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("y", (F.col("set") == "P").cast("int"))
    single = keep_first(used, ["genre", "key"], "row_id")
    data = with_features(single, ["genre", "key", "repo", "row_id", "y"])
    data = grouped_folds(data, "y", "repo", "row_id", folds, seed).checkpoint()  # else every tree's stages carry the whole plan
    sizes = {(r.genre, r.y): r.n for r in data.groupBy("genre", "y").agg(F.count("*").alias("n")).collect()}  # a row per genre and class
    # boosting runs some seven stages a tree: as few tasks as have about ROWS texts each
    parts = max(1, -(-sum(sizes.values()) // ROWS))
    data = (data.coalesce(parts) if parts < data.rdd.getNumPartitions() else data).persist()

    def fitted(job: tuple[str, int]) -> DataFrame | None:
        genre, k = job
        own = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(data.where(F.col("genre") == genre))
        learn, apply = own.where(F.col("fold") != k), own.where(F.col("fold") == k)
        if learn.select("y").distinct().count() < 2:
            return None
        model = GBTClassifier(labelCol="y", featuresCol="features", maxDepth=depth, maxIter=trees, seed=seed).fit(learn)
        return model.transform(apply).select("genre", "key", vector_to_array("probability")[1].alias("score"))

    large = [g for g in sorted({g for g, _ in sizes if g is not None}) if min(sizes.get((g, 0), 0), sizes.get((g, 1), 0)) >= floor]
    with ThreadPoolExecutor(at_once) as pool:
        models = pool.map(inheritable_thread_target(corpus.sparkSession)(fitted), [(g, k) for g in large for k in range(folds)])
        parts = [m for m in models if m is not None]
    rows = used.select("genre", "key", "row_id")
    if not parts:
        scored = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = rows.join(reduce(DataFrame.unionByName, parts), ["genre", "key"], "left")
    return corpus.select("row_id").join(scored.select("row_id", "score"), "row_id", "left")
