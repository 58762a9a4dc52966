"""Names for clusters: by the terms that tell a cluster from the others, or by a model's reply to a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a term is: a run of three letters or more.
TERM = r"\p{L}{3,}"
#: Characters of a label, and of a reply that isn't JSON (fixed values).
LONGEST, CUT = 100, 50


def terms(text: Column) -> Column:
    """The terms of a text in lower case, as often as they stand in it."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_weights(texts: DataFrame, *, keys: tuple[str, ...] = ("dimension", "cluster_id")) -> DataFrame:
    """(keys, term, n, weight) of texts (keys, text): how much more often a cluster has a term than the clusters have it on average.

    weight = n / terms of the cluster * ln(1 + mean terms of a cluster / times the term stands anywhere). Terms are counted within
    tasks before they shuffle; a term or a cluster may be in any share of the texts. Rows of a null key are left out. A column `times`
    says how often a text counts (else once), and `terms` may stand for the text: its terms().
    """
    listed = list(keys)
    for k in listed:
        texts = texts.filter(F.col(k).isNotNull())
    found = F.col("terms") if "terms" in texts.columns else terms(F.col("text"))
    times = F.col("times") if "times" in texts.columns else F.lit(1).cast("long")
    counts = texts.select(*listed, times.alias("times"), F.explode(found).alias("term")).groupBy(*listed, "term").agg(F.sum("times").alias("n"))
    sizes = counts.groupBy(*listed).agg(F.sum("n").alias("_size"))
    mean = sizes.agg(F.avg("_size").alias("_mean"))
    everywhere = counts.groupBy("term").agg(F.sum("n").alias("_all"))
    both = counts.join(everywhere, "term").join(sizes, listed).crossJoin(F.broadcast(mean))
    return both.select(*listed, "term", "n", F.round(F.col("n") / F.col("_size") * F.log1p(F.col("_mean") / F.col("_all")), 9).alias("weight"))


def term_labels(meta: DataFrame, texts: DataFrame, *, most: int = 5, least: int = 2, redo: bool = False) -> DataFrame:
    """(dimension, cluster_id, auto_label) of clusters without a label, or of all with redo: their heaviest terms, ties by the term.

    Clusters with fewer than `least` terms get none. meta: (dimension, cluster_id, auto_label); texts: (dimension, cluster_id, text).
    """
    todo = meta.filter(F.lit(redo) | F.col("auto_label").isNull()).select("dimension", "cluster_id")
    order = Window.partitionBy("dimension", "cluster_id").orderBy(F.desc("weight"), "term")
    first = term_weights(texts).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    named = first.groupBy("dimension", "cluster_id").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("terms")).filter(F.size("terms") >= least)
    label = F.left(F.array_join(F.transform("terms", lambda t: t["term"]), " "), F.lit(LONGEST))
    return named.join(todo, ["dimension", "cluster_id"]).select("dimension", "cluster_id", label.alias("auto_label"))


def label_fields(meta: DataFrame, mail: DataFrame, features: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per cluster with the fields of a label prompt, from its representative message; clusters without one are left out.

    meta: (dimension, cluster_id, size, representative_email_id, pct_replied, avg_response_time_hours); mail has body_text; features: (id, relationship_strength);
    actions: (id, action, response_seconds).
    """
    shown = mail.select(F.col("id").alias("representative_email_id"), "from_email", "subject", "date_parsed", F.left("body_text", F.lit(500)).alias("preview"))
    known = actions.select(F.col("id").alias("representative_email_id"), "action", "response_seconds").join(features.select(F.col("id").alias("representative_email_id"), "relationship_strength"), "representative_email_id", "left")
    rows = meta.join(shown, "representative_email_id").join(known, "representative_email_id", "left")
    or_ = lambda c, v: F.coalesce(c, F.lit(v))
    return rows.select(
        "dimension", "cluster_id", or_("from_email", "unknown").alias("from_email"), or_("subject", "(no subject)").alias("subject"), or_(F.date_format("date_parsed", "yyyy-MM-dd HH:mm:ss"), "unknown").alias("date"),
        or_("preview", "").alias("body_preview"), or_("size", 0).alias("size"), or_("pct_replied", 0.0).alias("pct_replied"), F.round(or_("avg_response_time_hours", 0.0), 1).alias("avg_response_hours"),
        F.round(or_("relationship_strength", 0.0), 2).alias("relationship_strength"), or_("action", "unknown").alias("action"), F.round(or_("response_seconds", 0.0) / 3600, 1).alias("response_time_hours"),
    )


def parsed_label(reply: Column) -> Column:
    """struct(label, confidence, success) of a model's reply: a JSON object, bare or in a code fence; else the reply's first 50 characters, with 0.3."""
    bare = F.trim(reply)
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    text = F.when(fenced != "", fenced).otherwise(bare)
    said = F.from_json(text, "label string, confidence double, _corrupt_record string", {"mode": "PERMISSIVE"})
    good = said.isNotNull() & said["_corrupt_record"].isNull() & text.startswith("{")
    label = F.left(F.trim(F.coalesce(said["label"], F.lit(""))), F.lit(LONGEST))
    cut = F.nullif(F.trim(F.left(text, F.lit(CUT))), F.lit(""))
    read = F.struct(label.alias("label"), F.coalesce(said["confidence"], F.lit(0.5)).alias("confidence"), F.lit(True).alias("success"))
    other = F.struct(cut.alias("label"), F.lit(0.3).alias("confidence"), cut.isNotNull().alias("success"))
    return F.when(reply.isNotNull(), F.when(good, read).otherwise(other))
