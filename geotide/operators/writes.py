"""Table mutations as set operations.

Parquet has no constraints and no MERGE, so each reference write becomes a
DataFrame that *is* the new table state (or the rows to append):
dedup-by-key + anti join for insert-ignore, full outer join + coalesce for
upserts, filters for retention.  Callers write the result with
``write.mode('append'|'overwrite')``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotide.functions.timefn import ts_literal
from geotide.operators.latest import top_k_per_key

EPOCH = "1970-01-01 00:00:00"

# Allowed enumerations (table CHECK constraints) and the retention TTL.
ASTAR_TARGET_TYPES = ("poi", "stop_point")
ASTAR_CONTEXTS = ("initial_prediction", "routed_to_poi", "routed_to_departure", "deviation_detected", "fallback_astar",
                  "fallback_stop_point", "rerouted_mapf")
MAPF_CONTEXTS = ("initial_prediction", "routed_to_poi", "routed_to_departure", "deviation_detected", "fallback_astar",
                 "rerouted_mapf", "mapf_predicted")
PREDICTION_TYPES = ("weekly", "daily")
SEGMENT_TYPES = ("direct", "multimodal", "fallback", "behavioral_path", "unknown")
RETENTION_DAYS = 28


def insert_ignore(target: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """K1: rows of ``new`` to append so that the first writer of each key wins.

    Within ``new`` the first row under ``order`` wins (all rows of a key are
    equivalent when no order is given); keys already in ``target`` are skipped.
    """
    key = list(key)
    if order:
        fresh = top_k_per_key(new, key, list(order), 1, None)
    else:
        fresh = new.dropDuplicates(key)
    return fresh.join(target.select(*key).distinct(), key, "left_anti")


def session_ids(df: DataFrame, client: str = "client_id", start: str = "start_time") -> DataFrame:
    """K4: session id as a pure function of (client, start_time); no lookup, no sequence."""
    return df.withColumn("session_id", F.xxhash64(F.col(client), F.col(start)))


def delete_by_keys(table: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K5: the table without the rows whose composite key is listed."""
    return table.join(keys_df.select(*keys).distinct(), list(keys), "left_anti")


def retention_ttl(table: DataFrame, as_of, days: int = RETENTION_DAYS, ts: str = "created_at"):
    """K6: (kept rows, number of expired rows as a one-row DataFrame)."""
    cutoff = ts_literal(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = table.where(F.col(ts) >= cutoff)
    expired = table.where(F.col(ts) < cutoff).agg(F.count(F.lit(1)).alias("expired"))
    return kept, expired


def upsert_hotspots(existing: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """K2: key (client, lat, lon): radius, density, updated_at replaced; created_at kept."""
    key = ["client_id", "lat", "lon"]
    now = ts_literal(as_of)
    n = new.select(*key, F.col("radius").alias("n_radius"), F.col("density").alias("n_density"),
                   F.col("type").alias("n_type"), F.col("source_type").alias("n_source_type"),
                   F.lit(True).alias("__new"))
    j = existing.join(n, key, "full_outer")
    is_new = F.coalesce(F.col("__new"), F.lit(False))
    return j.select(
        F.coalesce(F.col("hotspot_id"), F.xxhash64(*key)).alias("hotspot_id"), *key,
        F.when(is_new, F.col("n_radius")).otherwise(F.col("radius")).alias("radius"),
        F.when(is_new, F.col("n_density")).otherwise(F.col("density")).alias("density"),
        F.coalesce(F.col("type"), F.col("n_type")).alias("type"),
        F.col("time_spent"),
        F.coalesce(F.col("source_type"), F.col("n_source_type")).alias("source_type"),
        F.coalesce(F.col("created_at"), now).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"))


def upsert_chosen_route(existing: DataFrame, decisions: DataFrame, as_of, replace_destination: bool = True):
    """K3: key (client, stop, segment): path, is_chosen, origin and created_at replaced.

    ``replace_destination=False`` keeps the old destination (the reference's
    behaviour, D9); by default the destination follows the new path.
    """
    key = ["client_id", "stop_id", "segment_type"]
    now = ts_literal(as_of)
    cols = ["destination_lat", "destination_lon", "path", "is_chosen", "origin_lat", "origin_lon"]
    d = decisions.select(*key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("__new"))
    j = existing.join(d, [existing[k].eqNullSafe(d[k]) for k in key], "full_outer")
    is_new = F.coalesce(F.col("__new"), F.lit(False))
    keep_old_dest = not replace_destination

    def pick(c):
        if c.startswith("destination") and keep_old_dest:
            return F.coalesce(existing[c], F.col(f"n_{c}")).alias(c)
        return F.when(is_new, F.col(f"n_{c}")).otherwise(existing[c]).alias(c)

    out_cols = [F.coalesce(existing[k], d[k]).alias(k) for k in key] + [pick(c) for c in cols]
    extra = [existing[c] for c in existing.columns if c not in key + cols + ["created_at"]]
    return j.select(*out_cols, *extra,
                    F.when(is_new, now).otherwise(existing["created_at"]).alias("created_at"))


def poi_arrival_update(pois: DataFrame, arrivals: DataFrame) -> DataFrame:
    """K7: visit_count += arrivals and visit_start = greatest(old or epoch, latest arrival)
    for every POI row at the exact (client, lat, lon) of distinct arrivals."""
    key = ["client_id", "lat", "lon"]
    a = arrivals.select(*key, "visit_start").distinct().groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"), F.max("visit_start").alias("__last"))
    j = pois.join(a, key, "left")
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    hit = F.col("__n").isNotNull()
    return j.withColumn("visit_count", F.when(hit, F.coalesce(F.col("visit_count"), F.lit(0)) + F.col("__n"))
                        .otherwise(F.col("visit_count"))) \
        .withColumn("visit_start", F.when(hit, F.greatest(F.coalesce(F.col("visit_start"), epoch), F.col("__last")))
                    .otherwise(F.col("visit_start"))).drop("__n", "__last")


def validate_rows(df: DataFrame, not_null: Sequence[str] = (), enums: dict | None = None):
    """(good rows, rejected rows with a ``reject_reason``) by not-null and enum checks."""
    reason = F.lit(None).cast("string")
    for c, allowed in reversed(list((enums or {}).items())):
        reason = F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)), F.lit(f"bad_{c}")).otherwise(reason)
    for c in reversed(list(not_null)):
        reason = F.when(F.col(c).isNull(), F.lit(f"null_{c}")).otherwise(reason)
    tagged = df.withColumn("reject_reason", reason)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), \
        tagged.where(F.col("reject_reason").isNotNull())


def validate_pois(pois: DataFrame):
    """P11 for POI inserts: rows missing any required field are skipped."""
    return validate_rows(pois, not_null=["client_id", "lat", "lon", "time_spent", "poi_rank"])


def validate_astar(astar: DataFrame):
    return validate_rows(astar, not_null=["client_id", "path"], enums={"target_type": ASTAR_TARGET_TYPES})
