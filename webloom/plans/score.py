"""Gate, sample floor, score, priority and rank of findings, and roll-ups per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import registry as R

#: Content pages below which breadth does not raise a severity; lower ends of the priority bands.
SAMPLE_FLOOR, P0_AT, P1_AT, P2_AT = 5, 0.52, 0.34, 0.12


def _pick(c: Column | str, values: dict, default=None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), c), F.lit(default))


def clamp_confidence(level: Column | str, confidence: Column | str) -> Column:
    """Confidence within the band of its evidence level, two decimals."""
    lo = _pick(level, {k: v[0] for k, v in R.LEVEL_BAND.items()})
    hi = _pick(level, {k: v[1] for k, v in R.LEVEL_BAND.items()})
    return F.round(F.least(F.greatest(F.col(confidence) if isinstance(confidence, str) else confidence, lo), hi), 2)


def affected_surface(share: Column | str, core: Column | str) -> Column:
    share, core = (F.col(x) if isinstance(x, str) else x for x in (share, core))
    s = F.lit(0.4) + F.lit(0.6) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    return F.round(F.when(core, F.greatest(s, F.lit(0.85))).otherwise(s), 3)


def score(severity: Column | str, confidence: Column | str, surface: Column | str, stage: Column | str) -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (confidence, surface)]
    return F.round(_pick(severity, R.SEVERITY_WEIGHT) * c[0] * c[1] * _pick(stage, R.STAGE_WEIGHT), 4)


def priority(value: Column | str, severity: Column | str, level: Column | str) -> Column:
    """Band of a score, with rails: verified critical findings are P0, medium ones P1 at best, low ones P2."""
    v, s, l = (F.col(x) if isinstance(x, str) else x for x in (value, severity, level))
    band = F.when(v >= P0_AT, "P0").when(v >= P1_AT, "P1").when(v >= P2_AT, "P2").otherwise("P3")
    return (
        F.when((s == "critical") & (l == "verified"), "P0")
        .when((s == "medium") & (band == "P0"), "P1")
        .when((s == "low") & band.isin("P0", "P1"), "P2")
        .otherwise(band)
    )


def severity_rank(c: Column | str) -> Column:
    return _pick(c, {"critical": 4, "high": 3, "medium": 2, "low": 1}, 0)


def check_findings(f: DataFrame) -> DataFrame:
    """f with the invariants of a finding enforced: known severity and level, at least one piece of evidence with an
    address and an observation; critical on indicative evidence becomes medium."""
    ok = (
        F.col("severity").isin(*R.SEVERITY_WEIGHT) & F.col("evidence_level").isin(*R.LEVEL_BAND) & (F.size("evidence") > 0)
        & F.exists("evidence", lambda e: e["url"].isNotNull() & e["observation"].isNotNull())
    )
    sev = F.when((F.col("severity") == "critical") & (F.col("evidence_level") == "indicative"), "medium").otherwise(F.col("severity"))
    return f.withColumn("severity", F.when(F.coalesce(ok, F.lit(False)), sev).otherwise(F.raise_error(F.concat(F.lit("not a finding: "), F.col("rule")))))


def prioritize(found: DataFrame, measures: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings gated, floored, scored and ranked: one row per finding with report_id F-001.. in order of priority,
    score and rule. measures gives n_cp and root_url per site."""
    f = found.where("evidence_level <> 'indicative'").join(F.broadcast(registry), "rule").join(measures.select("site_id", "n_cp", "root_url"), "site_id")
    few = (F.col("n_cp") < SAMPLE_FLOOR) & (F.col("evidence_level") != "verified") & F.col("severity").isin("critical", "high")
    note = F.struct(
        F.col("root_url").alias("url"), F.lit("severity was capped: too few pages to show breadth").alias("observation"),
        F.format_string("%d content pages, %d needed", "n_cp", F.lit(SAMPLE_FLOOR)).alias("measurement"),
    )
    f = f.withColumn("floored", few).withColumn("evidence", F.when(few, F.concat("evidence", F.array(note))).otherwise(F.col("evidence")))
    f = f.withColumn("severity", F.when(F.col("floored"), "medium").otherwise(F.col("severity")))
    f = f.withColumn("confidence", clamp_confidence("evidence_level", "confidence"))
    f = f.withColumn("affected_surface", affected_surface("affected_share", "core_page_affected"))
    f = f.withColumn("priority_score", score("severity", "confidence", "affected_surface", "stage"))
    f = f.withColumn("priority", priority("priority_score", "severity", "evidence_level"))
    w = Window.partitionBy("site_id").orderBy("priority", F.col("priority_score").desc(), "rule")  # 29 rules a site at most
    first = F.coalesce(F.try_element_at("affected_urls", F.lit(1)), F.col("root_url"))
    action = F.replace(F.replace(F.replace(F.col("action"), F.lit("{example}"), first), F.lit("{count}"), F.col("n_hits").cast("string")), F.lit("{field}"), F.lit("the data"))
    return f.withColumn("rank", F.row_number().over(w)).withColumn("report_id", F.format_string("F-%03d", "rank")).withColumn("action", action)


def summary(ranked: DataFrame) -> DataFrame:
    """(site_id, total, critical, high, medium, low)."""
    return ranked.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in R.SEVERITY_WEIGHT]
    )


def stage_rollup(ranked: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, stage, worst_severity, report_ids): every stage of every site, also without findings."""
    spark = ranked.sparkSession
    stages = spark.createDataFrame([(i, s) for i, s in enumerate(R.STAGES)], "stage_no int, stage string")
    g = ranked.groupBy("site_id", "stage").agg(
        F.max_by("severity", severity_rank("severity")).alias("worst_severity"), F.array_sort(F.collect_list("report_id")).alias("report_ids")
    )
    grid = sites.select("site_id").withColumn("stage", F.explode(F.array(*[F.lit(s) for s in R.STAGES])))  # seven rows a site
    none = F.expr("cast(array() as array<string>)")
    return grid.join(F.broadcast(stages), "stage").join(g, ["site_id", "stage"], "left").select(
        "site_id", "stage_no", "stage", "worst_severity", F.coalesce("report_ids", none).alias("report_ids")
    )


def audit_status(measures: DataFrame) -> DataFrame:
    """(site_id, status): inconclusive without a readable page, complete for a single page or an undisturbed sample of
    three pages or more, else partial."""
    partial = (F.col("n_readable") < 3) | (F.size("limitations") > 0) | (F.col("n_failures") > 0)
    return measures.select(
        "site_id",
        F.when(F.col("n_readable") == 0, "inconclusive").when(F.col("scope") == "page", "complete").when(partial, "partial").otherwise("complete").alias("status"),
    )
