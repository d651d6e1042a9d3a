"""Queries over the core, by name: (spark, folder) -> DataFrame, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import nested, orphans
from .runtime import load, shared_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sql_norm(u: str) -> str:
    """DuckDB expression of the comparison form of an address whose query needs no re-encoding (all of the tables')."""
    p = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//([^/?#]*))?([^?#]*)(\?([^#]*))?"
    x = f"trim(coalesce({u}, ''))"
    scheme = rf"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"
    net = f"lower(regexp_extract({x}, '{p}', 2))"
    net = f"CASE WHEN {scheme} = 'http' THEN regexp_replace({net}, ':80$', '') ELSE regexp_replace({net}, ':443$', '') END"
    path = f"regexp_replace(regexp_replace(regexp_extract({x}, '{p}', 3), ';[^/]*$', ''), '/{{2,}}', '/', 'g')"
    path = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END"
    track = "(?i)^(utm_|gclid$|fbclid$|mc_cid$|mc_eid$|ref$|referrer$|igshid$|msclkid$|yclid$|_ga$|s_kwcid$)"
    q = f"regexp_extract({x}, '{p}', 5)"
    q = (
        f"array_to_string(list_transform(list_filter(string_split({q}, '&'), "
        f"lambda y: y <> '' AND NOT regexp_matches(split_part(y, '=', 1), '{track}')), "
        f"lambda y: CASE WHEN contains(y, '=') THEN y ELSE y || '=' END), '&')"
    )
    return (
        f"CASE WHEN {scheme} IN ('http', 'https') THEN {scheme} || '://' || {net} || {path} || "
        f"CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END ELSE '' END"
    )


_P6_SQL = f"""
WITH pg AS (
  SELECT page_id, min(site_id) site_id, min(url) url, min(final_url) final_url, min(ingested_at) opened, min(deleted_at) closed
  FROM page GROUP BY page_id),
par AS (
  SELECT DISTINCT page_id, site_id, {sql_norm("url")} u, opened, closed FROM pg
  UNION SELECT DISTINCT page_id, site_id, {sql_norm("final_url")} u, opened, closed FROM pg),
refs AS (
  SELECT 'link_edge' ref_table, edge_id ref_id, site_id, {sql_norm("dst")} u, seen_at t FROM link_edge
  UNION ALL SELECT 'sitemap_entry', entry_id, site_id, {sql_norm("loc")}, seen_at FROM sitemap_entry
  UNION ALL SELECT 'fetch_failure', failure_id, site_id, {sql_norm("url")}, failed_at FROM fetch_failure),
bad AS (
  SELECT DISTINCT ref_table, ref_id, t FROM refs r WHERE t IS NOT NULL AND ref_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM par p WHERE p.site_id = r.site_id AND p.u = r.u AND r.u <> '' AND p.opened <= r.t
      AND (p.closed IS NULL OR p.closed > r.t)))
"""


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(
        load(spark, d, "page"), load(spark, d, "link_edge"), load(spark, d, "sitemap_entry"), load(spark, d, "fetch_failure")
    )


@query("p6_found", _P6_SQL + "SELECT DISTINCT ref_table, ref_id, strftime(t, '%Y-%m') period FROM bad")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).select("ref_table", "ref_id", F.date_format("t", "yyyy-MM").alias("period")).distinct()


_P6_STATE = _P6_SQL + """,
keyed AS (SELECT b.ref_table, b.ref_id, b.t, count(p.page_id) FILTER (p.closed IS NULL OR p.closed > p.opened) known,
    count(p.page_id) FILTER (p.opened <= b.t AND (p.closed IS NULL OR p.closed > p.opened)) before
  FROM bad b JOIN refs r USING (ref_table, ref_id, t) LEFT JOIN par p ON p.site_id = r.site_id AND p.u = r.u AND r.u <> '' GROUP BY ALL)
SELECT ref_table, strftime(t, '%Y-%m') AS period, CASE WHEN known = 0 THEN 'missing' WHEN before > 0 THEN 'deleted' ELSE 'late' END AS state, count(*) AS n_refs
FROM keyed GROUP BY ALL
"""


@query("p6_report", _P6_STATE)
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_p6(spark, d))


_P7_SQL = r"""
WITH one AS (SELECT page_id, any_value(jsonld) jsonld, any_value(meta) meta FROM page GROUP BY page_id),
txt AS (
  SELECT page_id, 'jsonld' field_name, CAST(i - 1 AS VARCHAR) item_key, jsonld[i] AS tx
  FROM (SELECT page_id, jsonld, unnest(range(1, len(jsonld) + 1)) i FROM one)
  UNION ALL
  SELECT page_id, 'meta', e.key, e.value FROM (SELECT page_id, unnest(map_entries(meta)) e FROM one)),
ok AS (SELECT *, CASE WHEN json_valid(tx) THEN tx ELSE 'null' END AS j FROM txt WHERE regexp_matches(tx, '^\s*[\{\[]')),
nodes AS (SELECT page_id, field_name, item_key, n.fullkey fk FROM ok, json_tree(ok.j) n WHERE n.type = 'OBJECT'),
up AS (SELECT *, regexp_replace(fk, '\.("[^"]*"|[^."\[\]]+)(\[[0-9]+\])*$', '') AS par FROM nodes)
SELECT DISTINCT page_id, field_name, item_key, replace(fk, '"', '') AS node_path,
  CASE WHEN par = fk THEN '' ELSE replace(par, '"', '') END AS parent_path
FROM up
"""


@query("p7_found", _P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The places of every stored object: occurrences come by the identity of what occurs there."""
    bridge = shared_table(nested.flatten_json(load(spark, d, "page")), "bridge")
    stored = nested.objects(bridge).where("kind = 'object'").select("node_hash")
    return bridge.join(stored, "node_hash", "left_semi").select("page_id", "field_name", "item_key", "node_path", "parent_path").distinct()


# The tree of every text, containers with their minified text (the tables' equal objects list members in one order).
_P7_TREE = _P7_SQL.split("nodes AS")[0] + r"""
tree AS (SELECT page_id, field_name, item_key, n.id, n.parent, n.key, n.type, n.fullkey fk, n.value::VARCHAR v, n.atom FROM ok, json_tree(ok.j) n WHERE ok.j <> 'null'),
sib AS (SELECT *, row_number() OVER (PARTITION BY page_id, field_name, item_key, parent ORDER BY id) - 1 AS ordinal FROM tree),
box AS (SELECT *, lower(type) kind, replace(fk, '"', '') node_path, regexp_replace(fk, '\.("[^"]*"|[^."\[\]]+)(\[[0-9]+\])*$', '') par FROM sib WHERE type IN ('OBJECT', 'ARRAY'))
""".replace("\\\\", "\\")


@query(
    "p7_objects",
    _P7_TREE + """SELECT kind, CASE kind WHEN 'object' THEN len(json_keys(v::JSON)) ELSE json_array_length(v::JSON) END::INT AS n_members, count(*) AS n_occurrences, min(page_id) AS first_page, min(node_path) AS first_path
    FROM box GROUP BY kind, v""",
)
def p7_objects(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct object and array once: members, occurrences, where it is first met."""
    bridge = shared_table(nested.flatten_json(load(spark, d, "page")), "bridge")
    at = bridge.groupBy("node_hash").agg(F.min("page_id").alias("first_page"), F.min("node_path").alias("first_path"))
    shape = F.from_json("canon", F.lit("struct<object:array<array<string>>,array:array<array<string>>>"))
    n = F.when(F.col("kind") == "object", F.size(shape["object"])).otherwise(F.size(shape["array"]))
    return nested.objects(bridge).join(at, "node_hash").select("kind", n.alias("n_members"), "n_occurrences", "first_page", "first_path")


@query("p7_bridge", _P7_TREE + "SELECT page_id, field_name, item_key, node_path, CASE WHEN par = fk THEN '' ELSE replace(par, '\"', '') END AS parent_path, kind, ordinal::INT AS ordinal FROM box")
def p7_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of an object or array, with its place in its container."""
    return nested.flatten_json(load(spark, d, "page")).select("page_id", "field_name", "item_key", "node_path", "parent_path", "kind", "ordinal")


@query(
    "p7_attributes",
    _P7_TREE + """SELECT CASE b.kind WHEN 'object' THEN t.key END AS key, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
    t.atom->>'$' AS value, count(DISTINCT b.v) AS n_nodes FROM tree t JOIN box b ON b.page_id = t.page_id AND b.field_name = t.field_name AND b.item_key = t.item_key AND b.id = t.parent
    WHERE t.type NOT IN ('OBJECT', 'ARRAY') GROUP BY 1, 2, 3""",
)
def p7_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Scalar members and elements, with the number of stored objects and arrays that hold them."""
    flat = nested.attributes(nested.objects(nested.flatten_json(load(spark, d, "page"))))
    return flat.groupBy("key", "type", "value").agg(F.countDistinct("node_hash").alias("n_nodes"))
