"""Figures about the tables themselves, and the summaries of clusters and projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlake.operators.clusters import project_status
from interlake.operators.keyed import patch


def pipeline_status(tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row with the rows of every table (0 for one that is absent), received messages and answers still wanted.

    tables: emails (with is_sent), ai_classification (with handleability), and any others by name, llm_classification among them.
    """
    def count(name: str, df: DataFrame | None) -> DataFrame:
        if df is None:
            return None
        sums = [F.count(F.lit(1)).alias(name)]
        if name == "emails":
            sums.append(F.count_if("is_sent").alias("sent_emails"))
        if name == "ai_classification":
            sums.append(F.count_if(F.col("handleability") == "needs_llm").alias("needs_llm"))
        return df.agg(*sums)

    rows = [count(n, df) for n, df in tables.items() if df is not None]
    out = reduce(lambda a, b: a.crossJoin(b), rows)
    absent = [n for n, df in tables.items() if df is None] + [n for n in ("sent_emails", "needs_llm", "llm_classification") if n not in out.columns and n not in tables]
    out = out.withColumns({n: F.lit(0).cast("long") for n in absent}) if absent else out
    return out.withColumns({"received_emails": F.col("emails") - F.col("sent_emails"), "llm_remaining": F.greatest(F.lit(0).cast("long"), F.col("needs_llm") - F.col("llm_classification"))})


def labeling_stats(meta: DataFrame) -> DataFrame:
    """Clusters in all, with and without a label, per dimension."""
    known = F.col("auto_label").isNotNull()
    return meta.groupBy("dimension").agg(F.count(F.lit(1)).alias("total"), F.count_if(known).alias("labeled"), F.count_if(~known).alias("unlabeled"))


def dimension_stats(meta: DataFrame) -> DataFrame:
    """dim_stats() with the counts of labelled clusters, projects and active projects; meta has auto_label, is_project and project_status."""
    project = F.coalesce("is_project", F.lit(False))
    return meta.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("total_clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_emails"), F.round(F.avg("size"), 6).alias("avg_cluster_size"), F.max("size").alias("largest_cluster_size"), F.min("size").alias("smallest_cluster_size"),
        F.count("auto_label").alias("labeled_clusters"), F.count_if(project).alias("project_clusters"), F.count_if(project & (F.col("project_status") == "active")).alias("active_projects"),
    )


def project_summary(meta: DataFrame, top: int = 10) -> DataFrame:
    """One row: content clusters, projects, active ones, and the `top` active ones by last activity as an array."""
    content = meta.filter("dimension = 'content'")
    stats = content.agg(F.count_if(F.coalesce("is_project", F.lit(False))).alias("total_projects"), F.count_if(F.coalesce(F.col("is_project") & (F.col("project_status") == "active"), F.lit(False))).alias("active_projects"), F.count(F.lit(1)).alias("total_content_clusters"))
    shown = content.filter("is_project AND project_status = 'active'").orderBy(F.desc_nulls_last("last_activity"), "cluster_id").limit(top)
    order = F.struct((-F.coalesce(F.unix_micros(F.col("last_activity").cast("timestamp")), F.lit(-(1 << 62)))).alias("o"), "cluster_id", F.col("auto_label").alias("label"), "size", F.col("pct_replied").alias("engagement"))
    listed = shown.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat_ws("|", x["cluster_id"].cast("string"), F.coalesce(x["label"], F.lit("-")), x["size"].cast("string"))).alias("top_active_projects"))
    return stats.crossJoin(listed)


def project_count(projects: DataFrame, active: bool | None = None) -> DataFrame:
    rows = projects if active is None else projects.filter(F.col("is_active") == active)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def refresh_project_status(meta: DataFrame, activity: DataFrame) -> DataFrame:
    """(cluster_id, before, after) of every project: active, stale or completed by the days since its last message; stale without any."""
    rows = meta.filter("dimension = 'content' AND is_project").select("cluster_id", F.col("project_status").alias("before"))
    return rows.join(activity.select("cluster_id", "days_since"), "cluster_id", "left").select("cluster_id", "before", project_status(F.col("days_since")).alias("after"))


def status_changes(refreshed: DataFrame) -> DataFrame:
    """One row: how many projects became active, stale, completed, and how many stayed."""
    moved = ~F.col("before").eqNullSafe(F.col("after"))
    to = lambda s: F.count_if(moved & (F.col("after") == s)).alias(f"to_{s}")
    return refreshed.agg(to("active"), to("stale"), to("completed"), F.count_if(~moved).alias("unchanged"))


def enrich_clusters(meta: DataFrame, activity: DataFrame) -> DataFrame:
    """participant_count and last_activity of content clusters from their messages; others stay."""
    found = activity.select(F.lit("content").alias("dimension"), "cluster_id", "participant_count", "last_activity")
    return patch(meta, found, ["dimension", "cluster_id"])


TEMPORAL = ["first_activity", "last_activity", "emails_7d", "emails_30d", "velocity", "trend", "temporal_strength"]


def temporal_enrich(meta: DataFrame, activity: DataFrame) -> DataFrame:
    """Adds the seven temporal columns of content clusters; null for others."""
    found = activity.select(F.lit("content").alias("dimension"), "cluster_id", *TEMPORAL)
    return meta.drop(*TEMPORAL).join(found, ["dimension", "cluster_id"], "left")


#: Lines of the status report and the figures that they show, in order (fixed values).
LINES = [
    ("Emails imported:        ", "emails"), ("  - Received:           ", "received_emails"), ("  - Sent:               ", "sent_emails"), ("Threads built:          ", "threads"), ("ML features computed:   ", "features"),
    ("Embeddings generated:   ", "embeddings"), ("Rule-based classified:  ", "ai_classification"), ("LLM classified:         ", "llm_classification"), ("Clusters created:       ", "clusters"), ("Priority computed:      ", "priority"), ("User profiles:          ", "users"),
]


def status_report(status: DataFrame) -> DataFrame:
    """(report) of pipeline_status(): one text, a line a figure with thousands marked, 0 for what isn't there; the last line only if answers are wanted."""
    number = lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0)) if c in status.columns else F.lit(0), 0)
    lines = [F.concat(F.lit(text), number(c)) for text, c in LINES]
    left = F.when(F.col("llm_remaining") > 0, F.concat(F.lit("Needs LLM (remaining):  "), number("llm_remaining")))
    return status.select(F.concat_ws("\n", *lines, left).alias("report"))
