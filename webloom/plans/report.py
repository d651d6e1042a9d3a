"""A run end to end: evidence, rules, score, opportunities, report, validation, sinks."""

from __future__ import annotations

import json
import textwrap
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..runtime import shared_table
from . import registry as R
from . import rules, score
from .evidence import Audit
from .opportunities import opportunities


@dataclass
class Result:
    findings: DataFrame
    withheld: DataFrame
    opportunities: DataFrame
    status: DataFrame
    measures: DataFrame
    audit: Audit


def run(a: Audit, codes=None) -> Result:
    """All rules (or the given ones) of all sites; sites that could not be read report nothing."""
    m = shared_table(rules.site_measures(a), "measures")
    found, held = rules.findings(a, codes)
    status = score.audit_status(m)
    read = status.where("status <> 'inconclusive'").select("site_id")
    ranked = shared_table(score.prioritize(score.check_findings(found).join(read, "site_id", "left_semi"), m, R.registry(a.spark)), "findings")
    ops = opportunities(a, ranked).join(read, "site_id", "left_semi")
    return Result(ranked, held, ops, status, m, a)


def run_skill(a: Audit, skill: str) -> DataFrame:
    """Findings of one skill (machine-readability, fact-integrity, arrival-experience, external-evidence), unscored."""
    prefix = next(k for k, v in R.SKILLS.items() if v == skill)
    return rules.findings(a, [r for r in rules.RULES if r.startswith(prefix)])[0]


def reports(r: Result) -> DataFrame:
    """(site_id, report): one JSON document per site."""
    ev = F.transform(F.slice("evidence", 1, 4), lambda e: F.concat_ws(": ", e["url"], e["observation"], e["measurement"]))
    more = F.size("evidence") - 4
    line = F.concat(F.array_join(ev, " | "), F.when(more > 0, F.format_string(" (+%d further)", more)).otherwise(F.lit("")))
    item = F.struct(
        F.col("rank"), F.col("report_id").alias("id"), F.col("rule").alias("defect_id"), "title", "skill", "stage", "failure_mode", "severity", "evidence_level",
        "confidence", "priority", "priority_score", "affected_surface", line.alias("evidence"), F.col("evidence").alias("evidence_items"), "affected_urls", "effort",
        F.struct(F.col("action").alias("summary"), F.col("priority").alias("priority")).alias("suggested_action"),
    )
    f = r.findings.groupBy("site_id").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    roll = score.stage_rollup(r.findings, r.measures).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("stage_no", "stage", "worst_severity", "report_ids"))).alias("evidence_path"))
    ops = r.opportunities.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("op_id", "kind", "priority", "stage", "observation", "observed_at"))).alias("opportunities"))
    w = r.withheld.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_withheld"))
    ext = rules.probe_summary(r.audit)
    sums = score.summary(r.findings)
    base = r.measures.join(r.status, "site_id")
    for d in (f, roll, ops, w, ext, sums):
        base = base.join(d, "site_id", "left")
    small = F.when(F.col("n_cp") < score.SAMPLE_FLOOR, F.array(F.format_string("%d content pages: breadth raised no severity", "n_cp"))).otherwise(F.expr("cast(array() as array<string>)"))
    head = (
        F.when(F.col("status") == "inconclusive", F.array(F.lit("no page could be read; nothing is said about this site")))
        .when(F.col("status") == "partial", F.array(F.lit("partial: few pages were read, or some failed")))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )
    zero = F.lit(0).cast("long")
    doc = F.struct(
        U.normalize_url("root_url").alias("site"), F.col("as_of").cast("string").alias("audited_at"),
        F.struct(F.col("scope").alias("type"), F.col("status"), F.col("n_pages").alias("pages_examined"), F.col("n_readable").alias("pages_readable")).alias("scope"),
        F.struct(F.coalesce("total", zero).alias("total_findings"), *[F.coalesce(s, zero).alias(s) for s in R.SEVERITY_WEIGHT]).alias("summary"),
        F.col("evidence_path"), F.struct(*[c for c in ext.columns if c != "site_id"]).alias("external_corroboration"),
        F.col("findings"),
        F.col("opportunities"), F.coalesce("n_withheld", zero).alias("withheld_signals"), F.concat(head, "limitations", small).alias("limitations"),
    )
    return base.select("site_id", F.to_json(doc).alias("report"))


def agent_brief(r: Result) -> DataFrame:
    """One row per page: what was measured, nothing inferred."""
    return r.audit.pages.select(
        "site_id", "page_ord", F.col("final_url").alias("url"), "status", "depth", "title", F.coalesce(F.try_element_at("h1s", F.lit(1)), F.lit("")).alias("h1"), "canonical",
        F.col("words_main").alias("main_words"), F.size(F.filter("links", lambda l: l["internal"])).alias("internal_links"),
        F.size(F.filter("links", lambda l: l["internal"] & (l["region"] == "main"))).alias("main_region_links"), F.col("directives").alias("robots_directives"),
    )


def violations(r: Result) -> DataFrame:
    """(site_id, error): what a report must not contain; empty for a valid run."""
    f = r.findings.join(r.status, "site_id")
    bad = lambda cond, text: f.where(cond).select("site_id", F.concat(F.col("report_id"), F.lit(": " + text)).alias("error"))
    twice = r.findings.groupBy("site_id", "report_id").count().where("count > 1").select("site_id", F.concat(F.lit("duplicate id "), "report_id").alias("error"))
    out = twice
    for cond, text in (
        (F.size("evidence") == 0, "no evidence"), (F.col("evidence_level") == "indicative", "indicative evidence"),
        ((F.col("severity") == "critical") & (F.col("evidence_level") != "verified"), "critical without verified evidence"),
        ((F.col("severity") == "low") & F.col("priority").isin("P0", "P1"), "low severity with high priority"),
        (~F.col("severity").isin(*R.SEVERITY_WEIGHT), "unknown severity"), (~F.col("priority").isin("P0", "P1", "P2", "P3"), "unknown priority"),
        (~F.col("stage").isin(*R.STAGES), "unknown stage"), ((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range"),
        (F.col("status") == "inconclusive", "finding on a site that was not read"),
    ):
        out = out.unionByName(bad(cond, text))
    return out


# Required members of a report and of its findings.
REQUIRED = ("site", "audited_at", "summary", "findings")
REQUIRED_FINDING = ("id", "title", "severity", "evidence", "suggested_action")


def validate_document(doc: dict, schema: dict | None = None, path: str = "$") -> list[str]:
    """Errors of one report: a subset of JSON Schema (type, enum, minimum, maximum, minItems, required, properties,
    additionalProperties as a schema, items) if a schema is given, and the consistency of its counts."""
    errors: list[str] = []
    if schema is not None:
        kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
        want = schema.get("type")
        names = [want] if isinstance(want, str) else want or []
        fits = any(isinstance(doc, kinds.get(n, object)) and not (n in ("integer", "number") and isinstance(doc, bool)) for n in names)
        if names and not fits:
            return [f"{path}: expected {'/'.join(names)}"]
        if "enum" in schema and doc not in schema["enum"]:
            errors.append(f"{path}: not one of {schema['enum']}")
        if isinstance(doc, (int, float)) and not isinstance(doc, bool):
            for limit, beyond in (("minimum", lambda v, m: v < m), ("maximum", lambda v, m: v > m)):
                if limit in schema and beyond(doc, schema[limit]):
                    errors.append(f"{path}: beyond {limit} {schema[limit]}")
        if isinstance(doc, dict):
            errors += [f"{path}: {k} is missing" for k in schema.get("required", ()) if k not in doc]
            for k, v in doc.items():
                sub = schema.get("properties", {}).get(k, schema.get("additionalProperties"))
                if isinstance(sub, dict):
                    errors += validate_document(v, sub, f"{path}.{k}")
        if isinstance(doc, list):
            if len(doc) < schema.get("minItems", 0):
                errors.append(f"{path}: fewer than {schema['minItems']} items")
            if isinstance(schema.get("items"), dict):
                for i, v in enumerate(doc):
                    errors += validate_document(v, schema["items"], f"{path}[{i}]")
        return errors
    errors += [f"{k} is missing" for k in REQUIRED if k not in doc]
    listed = doc.get("findings") or []
    for f in listed:
        errors += [f"{f.get('id')}: {k} is missing" for k in REQUIRED_FINDING if not f.get(k)]
        if f.get("suggested_action", {}).get("priority") != f.get("priority"):
            errors.append(f"{f.get('id')}: priorities differ")
    if doc.get("summary", {}).get("total_findings") != len(listed):
        errors.append("the summary does not count the findings")
    return errors


def render_text(report: str, width: int = 88) -> str:
    """One report as plain text for a reader."""
    d = json.loads(report)
    out = [f"Report for {d['site']}", "=" * width, f"status {d['scope']['status']}, {d['scope']['pages_examined']} pages, {d['summary']['total_findings']} findings", ""]
    for f in d.get("findings") or []:
        out.append(f"{f['id']}  [{f['priority']}] {f['severity'].upper()}  {f['title']}  ({f['defect_id']})")
        out += textwrap.wrap(f["evidence"], width, initial_indent="    ", subsequent_indent="    ")
        out += textwrap.wrap("Do: " + f["suggested_action"]["summary"], width, initial_indent="    ", subsequent_indent="    ") + [""]
    for o in d.get("opportunities") or []:
        out.append(f"{o['op_id']}  [{o['priority']}] {o['kind']}: {o['observation']}")
    out += ["", *[line for x in d.get("limitations") or [] for line in textwrap.wrap("- " + x, width)]]
    return "\n".join(out)


def write_reports(r: Result, path: str, fmt: str = "json") -> None:
    """Reports to a folder, one line each ('json') or one text document a line group ('text')."""
    docs = reports(r)
    if fmt == "json":
        docs.select("report").write.mode("overwrite").text(path)
    else:
        render = F.udf(render_text, "string")  # one row per site
        docs.select(render("report").alias("value")).write.mode("overwrite").text(path)
