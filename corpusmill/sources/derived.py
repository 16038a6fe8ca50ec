"""Documentation corpora derived from the driver's tables: flat, threads, site, html.

Each has ``path`` and ``content``. ``threads`` and ``site`` have headings and links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per row of ``documents``: source/doc_id.md."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


def _ordered(items: Column, mark: str) -> Column:
    """The strings of (order, string) structs, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["s"]), mark)


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per conversation, each turn under a heading of its role."""
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").alias("o"), turn.alias("s")).alias("x"))
    path = F.concat(F.lit("thread/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return rows.groupBy("conv_id").agg(_ordered(F.col("x"), "\n\n").alias("content")).select(path.alias("path"), "content")


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linked site: an index, regions, nations that have suppliers, suppliers."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    text = lambda c: F.col(c).cast("string")
    item = lambda name, *url: F.concat(F.lit("- ["), name, F.lit("]("), *url, F.lit(")"))

    def listed(df: DataFrame, key: list[str], order: str, line: Column, head: Column) -> DataFrame:
        rows = df.groupBy(*key).agg(_ordered(F.struct(F.col(order).alias("o"), line.alias("s")), "\n").alias("items"))
        return rows.select(*key, F.concat(head, F.col("items")).alias("content"))

    index = region.agg(_ordered(F.struct(F.col("r_regionkey").alias("o"), item(F.col("r_name"), F.lit("region/"), text("r_regionkey"), F.lit(".md")).alias("s")), "\n").alias("items"))
    index = index.select(F.lit("index.md").alias("path"), F.concat(F.lit("# Home\n\n"), "items").alias("content"))
    of_region = region.join(nation, F.col("r_regionkey") == F.col("n_regionkey"))
    regions = listed(of_region, ["r_regionkey", "r_name"], "n_nationkey", item(F.col("n_name"), F.lit("../nation/"), text("n_nationkey"), F.lit(".md")), F.concat(F.lit("# "), "r_name", F.lit("\n\n")))
    regions = regions.select(F.concat(F.lit("region/"), text("r_regionkey"), F.lit(".md")).alias("path"), "content")
    of_nation = nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey"))
    head = F.concat(F.lit("# "), "n_name", F.lit("\n\nRegion [up](../region/"), text("n_regionkey"), F.lit(".md)\n\n## Suppliers\n\n"))
    nations = listed(of_nation, ["n_nationkey", "n_name", "n_regionkey"], "s_suppkey", item(F.col("s_name"), F.lit("../supplier/"), text("s_suppkey")), head)
    nations = nations.select(F.concat(F.lit("nation/"), text("n_nationkey"), F.lit(".md")).alias("path"), "content")
    when = lambda n, block: F.when(F.col("s_suppkey") % n == 0, block)
    blocks = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), "s_name"), F.concat(F.lit("Nation ["), "n_name", F.lit("](../nation/"), text("n_nationkey"), F.lit(".md#suppliers)")),
        when(10, F.concat(F.lit("[gone](../nope/"), text("s_suppkey"), F.lit(".md)"))),
        when(7, F.concat(F.lit("### Code\n\n```sql\nselect "), text("s_suppkey"), F.lit("\n```"))), when(31, F.concat(F.lit("```js\nlet x = "), text("s_suppkey"))),
    )
    suppliers = of_nation.select(F.concat(F.lit("supplier/"), text("s_suppkey"), F.lit(".md")).alias("path"), blocks.alias("content"))
    return index.unionByName(regions).unionByName(nations).unionByName(suppliers)


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML file per page: pages/page_id.html."""
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.col("html").alias("content"))


#: The same corpora in DuckDB SQL, as common table expressions (path, content).
FLAT_SQL = "flat AS (SELECT source || '/' || doc_id || '.md' AS path, text AS content FROM documents)"
THREADS_SQL = r"""threads AS (
  SELECT 'thread/' || conv_id || '.md' AS path, string_agg('## ' || role || ' ' || turn || E'\n\n' || text, E'\n\n' ORDER BY turn, '## ' || role || ' ' || turn || E'\n\n' || text) AS content
  FROM conversations GROUP BY conv_id)"""
SITE_SQL = r"""site AS (
  SELECT 'index.md' AS path, E'# Home\n\n' || string_agg('- [' || r_name || '](region/' || r_regionkey || '.md)', E'\n' ORDER BY r_regionkey) AS content FROM region
  UNION ALL
  SELECT 'region/' || r_regionkey || '.md', '# ' || r_name || E'\n\n' || string_agg('- [' || n_name || '](../nation/' || n_nationkey || '.md)', E'\n' ORDER BY n_nationkey)
  FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name
  UNION ALL
  SELECT 'nation/' || n_nationkey || '.md', '# ' || n_name || E'\n\nRegion [up](../region/' || n_regionkey || E'.md)\n\n## Suppliers\n\n'
    || string_agg('- [' || s_name || '](../supplier/' || s_suppkey || ')', E'\n' ORDER BY s_suppkey)
  FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name, n_regionkey
  UNION ALL
  SELECT 'supplier/' || s_suppkey || '.md', concat_ws(E'\n\n', '# ' || s_name, 'Nation [' || n_name || '](../nation/' || n_nationkey || '.md#suppliers)',
    CASE WHEN s_suppkey % 10 = 0 THEN '[gone](../nope/' || s_suppkey || '.md)' END,
    CASE WHEN s_suppkey % 7 = 0 THEN E'### Code\n\n```sql\nselect ' || s_suppkey || E'\n```' END,
    CASE WHEN s_suppkey % 31 = 0 THEN E'```js\nlet x = ' || s_suppkey END)
  FROM nation JOIN supplier ON n_nationkey = s_nationkey)"""
WEB_SQL = "web AS (SELECT 'pages/' || page_id || '.html' AS path, html AS content FROM pages)"
