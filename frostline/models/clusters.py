"""k-means of the service-type feature table."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.operators.encoding import standardize

CLUSTER_FEATURES = ["log_n_requests", "median_rt", "p90_rt", "overdue_rate", "month_entropy",
                    "top_ward_share", "median_late_overdue"]


def cluster_types(features: DataFrame, k: int = 4, seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """Append ``cluster_kmeans``, a label 0..k-1 from standardised features (nulls count as 0)."""
    cols = columns or CLUSTER_FEATURES
    ready = features.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    scaled = standardize(ready, [f"_{c}" for c in cols], ready)
    x = VectorAssembler(inputCols=[f"_{c}" for c in cols], outputCol="_x").transform(scaled)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster_kmeans").fit(x)
    return model.transform(x).drop("_x", *[f"_{c}" for c in cols])
