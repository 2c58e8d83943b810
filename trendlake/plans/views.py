"""The driver's tables read as entities, snapshots, people and texts.

Each view is one SQL text that both engines understand; ``{array}`` and table names differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "metrics": """
SELECT id, recorded_on, CAST(SUM(q) OVER w AS BIGINT) AS stars, CAST(SUM(n) OVER w AS BIGINT) AS forks,
       CAST(SUM(ln) OVER w AS BIGINT) AS open_issues, CAST(SUM(n * 2) OVER w AS BIGINT) AS watchers,
       CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(SUM(n) OVER w AS BIGINT) END AS contributors_count
FROM (SELECT l_partkey AS id, CAST(l_shipdate AS DATE) AS recorded_on, SUM(l_quantity) AS q, COUNT(*) AS n, SUM(l_linenumber) AS ln
      FROM {lineitem} GROUP BY l_partkey, CAST(l_shipdate AS DATE)) g
WINDOW w AS (PARTITION BY id ORDER BY recorded_on ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "span": """
SELECT l_partkey AS id, CAST(MIN(l_shipdate) AS DATE) AS first_on, CAST(MAX(l_shipdate) AS DATE) AS last_on,
       CAST(SUM(l_quantity) AS BIGINT) AS stars, COUNT(*) AS forks, CAST(SUM(l_linenumber) AS BIGINT) AS open_issues
FROM {lineitem} GROUP BY l_partkey""",
    "today": "SELECT MAX(CAST(l_shipdate AS DATE)) + 1 AS now FROM {lineitem}",
    "entity": """
SELECT p_partkey AS id, p_partkey + 1000000 AS github_id, CONCAT('owner', CAST(p_partkey % 97 AS VARCHAR(9))) AS owner_login, p_name AS name,
       CONCAT('owner', CAST(p_partkey % 97 AS VARCHAR(9)), '/', REPLACE(p_name, ' ', '-'), '-', CAST(p_partkey AS VARCHAR(19))) AS full_name,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS description, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE 'https://example.org' END AS homepage,
       p_brand AS language, p_size % 6 AS topics_count,
       CASE p_size % 9 WHEN 0 THEN NULL WHEN 1 THEN 'MIT' WHEN 2 THEN '  ' WHEN 3 THEN 'NOASSERTION' WHEN 4 THEN 'MPL-2.0' WHEN 5 THEN 'AGPL-3.0'
            WHEN 6 THEN 'CC-BY-NC-4.0' WHEN 7 THEN 'X-NC-1.0' ELSE 'Custom' END AS license_spdx_id,
       COALESCE(s.stars, 0) AS stars, COALESCE(s.forks, 0) AS forks, CASE WHEN p_size % 4 = 1 THEN COALESCE(s.open_issues, 0) ELSE COALESCE(s.stars, 0) / 50 * 0 + p_size END AS open_issues,
       s.first_on AS created_on, CASE WHEN p_size % 12 = 0 THEN NULL ELSE s.last_on - p_size * 3 END AS pushed_on,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE s.last_on - p_size * 10 END AS released_on,
       CASE WHEN p_size % 8 = 0 THEN NULL ELSE p_size % 7 END AS releases_last_year,
       CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 9 END AS contributors_count,
       CASE WHEN p_size % 5 = 1 THEN NULL ELSE CAST(p_size AS DOUBLE) / 50 END AS top_contributor_share,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(FLOOR(p_retailprice) AS INT) * 4 - 3500 END AS readme_length,
       p_size % 10 = 0 AS is_archived, p_size % 11 = 0 AS is_fork, CASE WHEN p_size % 13 = 0 THEN 'rejected' ELSE 'active' END AS status,
       CASE WHEN n.n_nationkey % 6 = 0 THEN NULL ELSE n.n_name END AS owner_country, s.first_on AS first_seen_on,
       CASE WHEN p_size % 4 = 2 THEN NULL ELSE s.last_on - p_size END AS synced_on, CASE WHEN p_size % 3 = 2 THEN NULL ELSE s.last_on - 20 END AS classified_on
FROM {part} p LEFT JOIN span s ON s.id = p.p_partkey LEFT JOIN {nation} n ON n.n_nationkey = p.p_partkey % 25""",
    "person": """
SELECT s_suppkey AS id, s_name AS login, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS country,
       CAST(FLOOR(ABS(s_acctbal)) AS BIGINT) AS followers, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE DATE '2001-01-01' END AS synced_on
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    "link": "SELECT l_partkey AS entity_id, l_suppkey AS person_id, CAST(SUM(l_quantity) AS BIGINT) AS contributions FROM {lineitem} GROUP BY l_partkey, l_suppkey",
    "category": """
SELECT p_type AS slug, CONCAT('group-', SUBSTRING(p_type, 1, 1)) AS group_slug, ROW_NUMBER() OVER (ORDER BY p_type) AS sort_order FROM (SELECT DISTINCT p_type FROM {part}) t
UNION ALL SELECT 'unused', 'group-unused', 9999""",
    "assignment": """
SELECT p_partkey AS entity_id, p_type AS slug, TRUE AS is_primary, CAST(p_size AS DOUBLE) / 50 AS confidence, CASE WHEN p_size % 9 = 0 THEN 'manual' ELSE 'rule' END AS source FROM {part}
UNION ALL SELECT p_partkey, 'unused', FALSE, CAST(p_size AS DOUBLE) / 100, 'rule' FROM {part} WHERE p_size % 3 = 0""",
}
NEEDS = {"entity": ["span"]}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame over the Parquet tables in ``sf_dir``."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    parts = [f"{n} AS ({VIEWS[n].format(**tables)})" for n in NEEDS.get(name, [])]
    head = "WITH " + ", ".join(parts) if parts else ""
    return spark.sql(f"{head} {VIEWS[name].format(**tables)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(*names: str) -> str:
    """``WITH`` clause of the named views for DuckDB."""
    tables = {t: t for t in TABLES}
    wanted = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**tables)})" for n in wanted) + " "
