"""Queries of the training-data operators, by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import load
from . import boilerplate, leakage, mixing, names, neardup, residue, sentences, stuffing

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_entity_pairs(load(spark, d, "page"))


@query("p1_entities")
def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(load(spark, d, "page"))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(load(spark, d, "page"), load(spark, d, "capture"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(load(spark, d, "page")).select("page_id")


@query("p3_shares")
def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(load(spark, d, "page")).select("page_id", F.round("stuffed_share", 6).alias("stuffed_share"))


_P4_SQL = r"""
WITH one AS (SELECT page_id, any_value(text_main) t FROM page GROUP BY page_id),
w AS (SELECT page_id, regexp_extract_all(lower(t), '[a-z0-9][a-z0-9''\-]*') ws FROM one WHERE t IS NOT NULL),
g AS (SELECT DISTINCT page_id, array_to_string(ws[i:i+5], ' ') s
      FROM (SELECT page_id, ws, unnest(range(1, len(ws) - 4)) i FROM w WHERE len(ws) >= 40)),
n AS (SELECT page_id, count(*) n FROM g GROUP BY page_id),
duo AS (SELECT a.page_id a, b.page_id b, count(*) c FROM g a JOIN g b ON a.s = b.s AND a.page_id < b.page_id GROUP BY 1, 2)
SELECT a AS page_id_a, b AS page_id_b FROM duo JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b
WHERE c >= 0.6 * (x.n + y.n - c)
"""


@query("p4_found", _P4_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand(*neardup.near_duplicates(load(spark, d, "page")))


_P4_REPS = _P4_SQL.split("g AS (SELECT DISTINCT page_id")[0] + r"""
m AS (SELECT page_id AS id, min(page_id) OVER (PARTITION BY ws) AS rep, ws FROM w WHERE len(ws) >= 40)
"""


@query(
    "p4_links",
    _P4_REPS + r""",
g AS (SELECT DISTINCT id, array_to_string(ws[i:i+5], ' ') s FROM (SELECT id, ws, unnest(range(1, len(ws) - 4)) i FROM m WHERE id = rep)),
n AS (SELECT id, count(*) n FROM g GROUP BY id),
duo AS (SELECT a.id a, b.id b, count(*) c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6)::DOUBLE AS jaccard FROM duo JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c)
""",
)
def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between different texts only, with their similarity."""
    links, _ = neardup.near_duplicates(load(spark, d, "page"))
    return links.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("p4_members", _P4_REPS + "SELECT id, rep FROM m")
def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Every compared page with the representative of its exact copies."""
    return neardup.near_duplicates(load(spark, d, "page"))[1]


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(load(spark, d, "page"), load(spark, d, "capture"))


@query("p5_body")
def p5_body(spark: SparkSession, d: str) -> DataFrame:
    page = load(spark, d, "page")
    return boilerplate.main_body(page, boilerplate.boilerplate_lines(page, load(spark, d, "capture")))


_P8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') w FROM documents WHERE text <> ''),
iw AS (SELECT item_id, regexp_extract_all(strip_accents(lower(item_text)), '[\p{L}\p{N}]+') w FROM eval_item),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) i FROM iw)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM dw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


@query("p8_found", _P8_SQL)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.matches(load(spark, d, "documents"), load(spark, d, "eval_item")).select("doc_id", "item_id").distinct()


# Matching grams by position: grams that follow each other on one diagonal are one match of 12 words more.
_P8_RUNS = _P8_SQL.split("ig AS")[0] + r"""
ig AS (SELECT item_id, i ipos, array_to_string(w[i:i+12], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) i FROM iw)),
dg AS (SELECT doc_id, i dpos, n, array_to_string(w[i:i+12], ' ') g FROM (SELECT doc_id, w, len(w) n, unnest(range(1, len(w) - 11)) i FROM dw)),
hit AS (SELECT doc_id, item_id, dpos, n, dpos - ipos diag FROM dg JOIN ig USING (g)),
run AS (SELECT doc_id, item_id, count(*) + 12 AS len FROM (SELECT *, dpos - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY dpos) isle FROM hit) GROUP BY doc_id, item_id, diag, isle)
"""


@query("p8_leaks_per_item", _P8_RUNS + "SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(len)::INT AS longest FROM run GROUP BY item_id")
def p8_leaks_per_item(spark: SparkSession, d: str) -> DataFrame:
    """Test items that leaked: into how many documents, and their longest match."""
    m = leakage.matches(load(spark, d, "documents"), load(spark, d, "eval_item"))
    return m.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("longest").alias("longest"))


@query("p8_coverage", _P8_RUNS + ", cov AS (SELECT doc_id, any_value(n) n, count(DISTINCT dpos + k) AS c FROM (SELECT DISTINCT doc_id, n, dpos FROM hit), range(13) t(k) GROUP BY doc_id) SELECT doc_id, c AS removed_words, round(c / n, 6)::DOUBLE AS coverage, c > 0.5 * n AS dropped FROM cov")
def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What is cut out of documents that hold a leak."""
    c = leakage.decontaminate(load(spark, d, "documents"), load(spark, d, "eval_item")).where("removed_words > 0")
    return c.select("doc_id", "removed_words", F.round("coverage", 6).alias("coverage"), "dropped")


@query("p8_clean")
def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.decontaminate(load(spark, d, "documents"), load(spark, d, "eval_item"))


@query("p9_report")
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_target"))[1]


@query("p9_selected")
def p9_selected(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_target"))[0]


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(load(spark, d, "documents")).select("doc_id", "sent_end").distinct()


@query("p10_units")
def p10_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(load(spark, d, "documents"))
