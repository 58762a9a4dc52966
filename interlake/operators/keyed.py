"""Updates of keyed rows, each as a new table, and the checks that rows pass before they are taken in.

Patches are small beside the target, so they go to it by a join that the optimizer may broadcast; keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlake.operators.changes import first_per_key

DIMENSIONS = ["people", "content", "behavior", "service", "temporal"]


def patch(target: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the columns that values has besides the keys set, also to null; values has one row a key. Others stay."""
    columns = [c for c in values.columns if c not in keys]
    new = values.select(*keys, F.struct(*columns).alias("_new"))
    out = target.join(new, keys, "left")
    return out.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def upsert_first(target: DataFrame, batch: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The target with the batch's rows in place of those of the same keys; of several in the batch the first in the order given."""
    one = batch.withColumn("_key", F.struct(*keys))
    one = first_per_key(one, "_key", *(order or keys)).drop("_key")
    return target.join(one.select(*keys), keys, "left_anti").unionByName(one)


def upsert_cluster_meta(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows by (dimension, cluster_id, user_id); a known row keeps the columns that the batch lacks. A null user is a user."""
    keys = ["dimension", "cluster_id"]
    a, b = target.alias("a"), batch.alias("b")
    same = (F.col("a.dimension") == F.col("b.dimension")) & (F.col("a.cluster_id") == F.col("b.cluster_id")) & F.col("a.user_id").eqNullSafe(F.col("b.user_id"))
    both = a.join(b, same, "full_outer")
    pick = lambda c: F.when(F.col("b.dimension").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in batch.columns else F.col(f"a.{c}")
    return both.select(*[(F.coalesce(f"a.{c}", f"b.{c}") if c in keys else pick(c)).alias(c) for c in target.columns])


def set_label(meta: DataFrame, labels: DataFrame) -> DataFrame:
    """auto_label by (dimension, cluster_id)."""
    return patch(meta, labels.select("dimension", "cluster_id", "auto_label"), ["dimension", "cluster_id"])


def mark_project(meta: DataFrame, found: DataFrame) -> DataFrame:
    """is_project and project_status of content clusters. found: (cluster_id, status)."""
    marks = found.select(F.lit("content").alias("dimension"), "cluster_id", F.lit(True).alias("is_project"), F.col("status").alias("project_status"))
    return patch(meta, marks, ["dimension", "cluster_id"])


def task_transition(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Tasks completed (with the time) or dismissed. changes: (task_id, status, at); other states are ignored."""
    new = changes.filter("status IN ('completed', 'dismissed')").select("task_id", "status", F.when(F.col("status") == "completed", F.col("at")).alias("completed_at"))
    done = tasks.join(new.select("task_id", F.col("status").alias("_status"), F.col("completed_at").alias("_at")), "task_id", "left")
    values = {"status": F.coalesce("_status", "status"), "completed_at": F.coalesce("_at", "completed_at")}
    return done.select(*[values.get(c, F.col(c)).alias(c) for c in tasks.columns])


def bulk_status_update(rows: DataFrame, ids: DataFrame, status: str, *, key: str = "cluster_id", column: str = "project_status") -> DataFrame:
    """The status of all rows whose key is among ids."""
    hit = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.withColumn(column, F.when(F.col("_hit"), F.lit(status)).otherwise(F.col(column))).select(*rows.columns)


def mark_sent(mail: DataFrame, own: list[str]) -> DataFrame:
    """is_sent also where the sender is an own address; it is never taken back."""
    if not own:
        return mail
    return mail.withColumn("is_sent", F.coalesce("is_sent", F.lit(False)) | F.coalesce(F.lower("from_email").isin(*[x.lower() for x in own]), F.lit(False)))


def child_rows(inserted: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Rows that belong to what was inserted only."""
    return children.join(inserted.select(key), key, "left_semi")


def replace_table(rows: DataFrame, path: str) -> None:
    """Truncate and insert: a rerun leaves the same table."""
    rows.write.mode("overwrite").parquet(path)


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `errors`, the names of the rules that don't hold (or can't be told, for a null)."""
    broken = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]
    return rows.withColumn("errors", F.array_compact(F.array(*broken)))


def task_rules() -> dict[str, Column]:
    """What a task must be: known type and status, urgency from 0 to 1, a description of 1 to 1000 characters."""
    c = F.col
    return {
        "status": c("status").isin("pending", "in_progress", "completed", "dismissed"),
        "urgency_score": c("urgency_score").isNull() | c("urgency_score").between(0, 1),
        "description": F.length("description").between(1, 1000),
    }


def cluster_rules() -> dict[str, Column]:
    """What a cluster's row must be: a known dimension, a size of 0 or more, a share from 0 to 100."""
    return {"dimension": F.col("dimension").isin(*DIMENSIONS), "size": F.col("size") >= 0, "pct_replied": F.col("pct_replied").isNull() | F.col("pct_replied").between(0, 100)}


def slug_rule(column: str = "slug") -> Column:
    """Lower-case letters, digits and single hyphens."""
    return F.col(column).rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")
