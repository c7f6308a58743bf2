"""POI scoring and visit prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotide.functions.timefn import add_seconds, seconds_between, ts_literal
from geotide.operators.behaviour import DEFAULT_MEDIAN_DWELL_S, median_dwell
from geotide.operators.clustering import density_cluster
from geotide.operators.spatial import pattern_proximity

# Decay per second of age for daily / weekly predictions, and the
# clustering of the predicted sequence (degrees, min samples).
DAY_DECAY = 1.0 / (24 * 3600)
WEEK_DECAY = 1.0 / (7 * 24 * 3600)
SEQUENCE_EPS_DEG = 0.0015
SEQUENCE_MIN_SAMPLES = 1


def score_pois(pois: DataFrame, patterns: DataFrame, as_of, prediction_type: str = "daily") -> DataFrame:
    """B2: poi_score = rank * ln(1 + dwell) * exp(-age * decay) * pattern weight."""
    decay = DAY_DECAY if prediction_type == "daily" else WEEK_DECAY
    p = pattern_proximity(pois, patterns)
    age = seconds_between(ts_literal(as_of), F.col("created_at"))
    return p.withColumn("time_weight", F.log(F.col("time_spent") + F.lit(1.0))) \
        .withColumn("time_decay", F.exp(-age * F.lit(decay))) \
        .withColumn("poi_score", F.col("poi_rank") * F.col("time_weight") * F.col("time_decay")
                    * F.col("pattern_weight"))


def visit_clock(scored: DataFrame, as_of) -> DataFrame:
    """Order POIs by score (desc, nulls last; newest first on ties) and assign
    predicted times as_of + (rank - 1) * the client's median dwell (1800 s if unknown)."""
    w = Window.partitionBy("client_id").orderBy(F.col("poi_score").desc_nulls_last(),
                                                F.col("created_at").desc_nulls_last(), F.col("poi_id").asc())
    med = median_dwell(scored)
    s = scored.withColumn("seq", F.row_number().over(w)).join(med, "client_id")
    return s.withColumn("predicted_visit_time", add_seconds(
        ts_literal(as_of), (F.col("seq") - 1) * F.coalesce(F.col("median_dwell"), F.lit(DEFAULT_MEDIAN_DWELL_S))))


def predict_visits(pois: DataFrame, patterns: DataFrame, as_of, prediction_type: str = "daily",
                   eps_deg: float = SEQUENCE_EPS_DEG) -> DataFrame:
    """Scored visit sequence clustered with eps 0.0015 deg, min 1 sample (connected
    components); each cluster -> mean position and its earliest predicted time."""
    seq = visit_clock(score_pois(pois, patterns, as_of, prediction_type), as_of)
    seq = seq.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    lab = density_cluster(seq.select("client_id", "lat", "lon"), eps_deg, SEQUENCE_MIN_SAMPLES, metric="planar")
    j = seq.join(lab.select("client_id", "lat", "lon", "label"), ["client_id", "lat", "lon"])
    g = j.groupBy("client_id", "label").agg(F.avg("lat").alias("predicted_lat"), F.avg("lon").alias("predicted_lon"),
                                            F.min("predicted_visit_time").alias("predicted_visit_time"))
    return g.select("client_id", "predicted_lat", "predicted_lon", "predicted_visit_time",
                    F.lit(prediction_type).alias("prediction_type"), ts_literal(as_of).alias("created_at"))
