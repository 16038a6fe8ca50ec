"""Queries for the functions, sources, sinks and servers that the main list leaves out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import errors, perf
from corpusmill.functions import paths, text
from corpusmill.operators import bundles, chunks, documents, graph, links, manifest, metadata, navigation, quality, retrieval, security, symbols, tags
from corpusmill.plans import build, server, sinks
from corpusmill.plans import queries as main
from corpusmill.plans.queries import LINKS_SQL, RANKS_SQL, query, site_edges
from corpusmill.session import scratch
from corpusmill.sources import artefacts, config, derived, files
from corpusmill.streaming import incremental, watch


def join(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- functions of paths and texts


@query(
    r"""WITH p AS (SELECT p_partkey, 'a_b/' || replace(p_name, ' ', '-') || '_v' || p_partkey || '.tar.md' AS path, p_name FROM part),
t AS (SELECT *, replace(replace(regexp_replace(split_part(path, '/', -1), '\.[^.]+$', ''), '-', ' '), '_', ' ') AS title FROM p)
SELECT path, title, array_to_string([upper(w[1:1]) || w[2:] for w in string_split(title, ' ')], ' ') AS raised, '.md' AS extension,
  '&lt;' || p_name || '&gt; &amp; &quot;x&quot; &apos;y&apos;' AS escaped, '' AS none FROM t"""
)
def path_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2, X8, X11."""
    rows = derived.table(spark, sf_dir, "part").select("p_name", join("a_b/", F.replace("p_name", F.lit(" "), F.lit("-")), "_v", F.col("p_partkey"), ".tar.md").alias("path"))
    title = paths.title(F.col("path"))
    escaped = text.xml_escaped(join("<", F.col("p_name"), "> & \"x\" 'y'"))
    return rows.select("path", title.alias("title"), paths.title_case(title).alias("raised"), paths.extension(paths.basename(F.col("path"))).alias("extension"), escaped.alias("escaped"), paths.extension(F.lit("none")).alias("none"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id ELSE doc_id::VARCHAR END AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'n' || doc_id WHEN doc_id % 5 = 0 THEN 'd' || doc_id ELSE '' END AS notes FROM documents"""
)
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3."""
    i = F.col("doc_id")
    meta = F.create_map(F.lit("title"), F.when(i % 3 == 0, join("T", i)), F.lit("notes"), F.when(i % 2 == 0, join("n", i)), F.lit("description"), F.when(i % 5 == 0, join("d", i)))
    rows = derived.table(spark, sf_dir, "documents").select("doc_id", meta.alias("m"))
    return rows.select("doc_id", paths.document_title(F.col("m"), join("x/", i, ".md")).alias("title"), paths.document_notes(F.col("m")).alias("notes"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://x.org/docs/a/' || p_partkey || '.md' WHEN 1 THEN 'https://x.org/up/' || p_partkey WHEN 2 THEN 'https://x.org/docs/' || p_partkey || '.md'
  ELSE 'https://x.org/docs/a b/' || p_partkey END AS url FROM part"""
)
def absolute_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4."""
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, join("a/", k, ".md")).when(k % 4 == 1, join("../up/", k)).when(k % 4 == 2, join("./", k, ".md")).otherwise(join("a b/", k))
    return derived.table(spark, sf_dir, "part").select("p_partkey", paths.absolute_url(path, "https://x.org/docs/").alias("url"))


LINK_CASES = ("https://a.org/", "http://a", "mailto:x@y", "//cdn/", "#top", "../a.md", "ftp://h/", "b:")


@query(
    f"""WITH u AS (SELECT p_partkey, ({list(LINK_CASES)})[p_partkey % 8 + 1] || p_partkey AS url FROM part)
SELECT p_partkey, regexp_matches(url, '^(https?://|mailto:|//)') AS external, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]') AS absolute,
  CASE WHEN starts_with(url, 'http') THEN url END AS safe FROM u"""
)
def link_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, F8, X19."""
    rows = derived.table(spark, sf_dir, "part")
    url = join(F.element_at(F.array(*map(F.lit, LINK_CASES)), (F.col("p_partkey") % 8 + 1).cast("int")), F.col("p_partkey"))
    named = F.regexp_replace(url, "://", "://user:secret@")
    return rows.select("p_partkey", links.external(url).alias("external"), links.absolute(url).alias("absolute"), paths.sanitized_url(named).alias("safe"))


@query(
    r"""SELECT p_partkey, p_name || ' ' || p_brand || ' x' AS logged, p_partkey || '_' || p_brand || '_ _a_' AS name, left(replace(text, E'\n', ' '), 1000) = '' AS nothing
FROM part JOIN documents ON doc_id = p_partkey"""
)
def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19."""
    rows = derived.table(spark, sf_dir, "part").join(derived.table(spark, sf_dir, "documents"), F.col("doc_id") == F.col("p_partkey"))
    logged = paths.sanitized_for_log(join(F.col("p_name"), "\n", F.col("p_brand"), "\tx"))
    return rows.select("p_partkey", logged.alias("logged"), paths.sanitized_filename(join("..", F.col("p_partkey"), "/", F.col("p_brand"), "? <a>..")).alias("name"), (paths.sanitized_for_log(F.col("text")) == "").alias("nothing"))


@query(
    r"""WITH n AS (SELECT o_orderkey, (o_totalprice * 100)::BIGINT * 2 + 1 AS n, o_orderkey * 37 AS ms FROM orders)
SELECT o.o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END AS size,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN 's' ELSE (ms // 60000) || 'm' END AS took,
  'o/' || o.o_orderkey || '.md' || CASE WHEN o.o_orderkey % 2 = 0 THEN ' § A > ' || o_orderpriority ELSE '' END || ' L' || o_custkey || '-' || (o_custkey + 9) AS cited
FROM n JOIN orders o USING (o_orderkey)"""
)
def labels_of_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15, X16."""
    k = F.col("o_orderkey")
    n = F.round(F.col("o_totalprice") * 100).cast("bigint") * 2 + 1
    took = text.duration_label(k * 37)
    took = F.when(k * 37 < 1000, took).when(k * 37 < 60000, F.substring(took, -1, 1)).otherwise(F.regexp_extract(took, r"^(\d+m)", 1))
    cited = text.citation(join("o/", k, ".md"), F.when(k % 2 == 0, join("A > ", F.col("o_orderpriority"))).otherwise(F.lit("")), F.col("o_custkey"), F.col("o_custkey") + 9)
    return derived.table(spark, sf_dir, "orders").select("o_orderkey", text.bytes_label(n).alias("size"), took.alias("took"), cited.alias("cited"))


@query(
    r"""WITH h AS (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, [unicode(c)::BIGINT for c in string_split(p_name || ' ' || p_brand, '')]), lambda a, c: (a * 31 + c) % 4294967296) AS u FROM part),
s AS (SELECT p_partkey, u >= 2147483648 AS less, abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) AS v FROM h)
SELECT p_partkey, CASE WHEN v = 0 THEN '0' ELSE CASE WHEN less THEN '-' ELSE '' END || ltrim(array_to_string(['0123456789abcdefghijklmnopqrstuvwxyz'[(v // (36 ** (6 - i))::BIGINT) % 36 + 1] for i in range(0, 7)], ''), '0') END AS hash FROM s"""
)
def rolling_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X34."""
    return derived.table(spark, sf_dir, "part").select("p_partkey", text.rolling_hash(join(F.col("p_name"), " ", F.col("p_brand"))).alias("hash"))


@query(
    rf"""WITH {derived.SITE_SQL} SELECT path, round(coalesce(length(array_to_string(regexp_extract_all(content, '(?s)```.*?```'), '')), 0) / length(content)::DOUBLE, 6) AS share,
  contains(content, '```sql') AS inside FROM site"""
)
def code_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20, F10."""
    at = F.greatest(F.instr("content", "select") - 1, F.lit(0))
    return derived.site(spark, sf_dir).select("path", F.round(text.code_share(F.col("content")), 6).alias("share"), text.in_code_block(F.col("content"), at).alias("inside"))


# --- filters, audits, orders


@query(
    rf"""WITH {derived.SITE_SQL}, p AS (SELECT path FROM site UNION ALL SELECT 'build/' || path FROM site UNION ALL SELECT 'routes/' || replace(path, '.md', '.txt') FROM site)
SELECT path, NOT starts_with(path, 'routes') AS document, regexp_matches(path, 'build|out') AS excluded, starts_with(path, 'build/') AS whole, regexp_matches(path, '^nation/[^/]*$|^supplier/[^/]\.md$') AND NOT regexp_matches(path, '(^|/)1[^/]*$') AS wanted FROM p"""
)
def path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, F1, F2, V1, V2."""
    site, p = derived.site(spark, sf_dir).select("path"), F.col("path")
    rows = site.union(site.select(join("build/", p))).union(site.select(join("routes/", F.replace(p, F.lit(".md"), F.lit(".txt")))))
    wanted = files.matches_globs(p, ["nation/*", "supplier/?.md"], ["**/1*"])
    return rows.select("path", files.is_document(p).alias("document"), files.excluded(p).alias("excluded"), files.excluded(p, whole_segments=True).alias("whole"), wanted.alias("wanted"))


@query(
    """WITH p AS (SELECT p_partkey, ['docs/', 'docs/../', 'docs/secrets/', 'docs/a?b/', 'other/'][p_partkey % 5 + 1] || p_partkey || '.md' AS path FROM part)
SELECT path, unnest(list_filter([CASE WHEN contains(path, '?') THEN 'suspicious_character' END, CASE WHEN contains(path, '/../') THEN 'parent_step' END,
  CASE WHEN contains(path, '/../') OR contains(path, 'secrets') THEN 'blocked_segment' END, CASE WHEN NOT starts_with(path, 'docs/') THEN 'outside_prefixes' END], lambda x: x IS NOT NULL)) AS type FROM p"""
)
def path_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9."""
    heads = F.array(*map(F.lit, ("docs/", "docs/../", "docs/secrets/", "docs/a?b/", "other/")))
    rows = derived.table(spark, sf_dir, "part").select(join(F.element_at(heads, (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_partkey"), ".md").alias("path"))
    return security.path_issues(rows, ("docs/",))


@query(
    """WITH f AS (SELECT 'd' || p_size || '/' || p_partkey || ['.md', '.exe', '.bin', ''][p_partkey % 4 + 1] AS path, p_retailprice::BIGINT AS size FROM part)
SELECT path, unnest(list_filter([CASE WHEN size > 1500 THEN 'file_too_large' END, CASE WHEN path LIKE '%.exe' THEN 'forbidden_extension' WHEN path NOT LIKE '%.md' THEN 'unknown_extension' END], lambda x: x IS NOT NULL)) AS type FROM f
UNION ALL SELECT 'd' || p_size, 'crowded:' || count(*) FROM part GROUP BY p_size HAVING count(*) > 40"""
)
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10."""
    ends = F.element_at(F.array(*map(F.lit, (".md", ".exe", ".bin", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = derived.table(spark, sf_dir, "part").select(join("d", F.col("p_size"), "/", F.col("p_partkey"), ends).alias("path"), F.round("p_retailprice").cast("bigint").alias("size"))
    crowded = security.crowded_directories(rows, 40).select(F.col("directory").alias("path"), join("crowded:", F.col("files")).alias("type"))
    return security.file_issues(rows, 1500).union(crowded)


@query(
    f"""WITH {derived.FLAT_SQL}, s AS (SELECT path, strlen(content)::BIGINT AS size FROM flat), t AS (SELECT count(*) AS files, sum(size)::BIGINT AS total_size, max(size) AS largest, round(avg(size), 3) AS average FROM s)
SELECT path, size, CASE WHEN size > 5000 THEN 'too_large' WHEN size > 1000 THEN 'large' ELSE 'ok' END AS verdict, t.* FROM s, t"""
)
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    rows = derived.flat(spark, sf_dir).select("path", F.octet_length("content").cast("bigint").alias("size"))
    return files.size_report(rows, 1000, 5000).crossJoin(F.broadcast(files.size_statistics(rows).withColumn("average", F.round("average", 3))))


@query(
    """SELECT 's/' || s_suppkey || '.md' AS source, 'reference' AS style, 0::INT AS pos, s_name AS text, 'last/' || s_suppkey AS url FROM supplier
UNION ALL SELECT 's/' || s_suppkey || '.md', 'reference', 1, 'Other', 'https://x.org/' || s_nationkey FROM supplier"""
)
def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last definition of a name wins, a use without one drops out."""
    k = F.col("s_suppkey")
    content = join("[", F.col("s_name"), "][ref] and [Other][] and [none][gone]\n\n[ref]: first.md\n[other]: https://x.org/", F.col("s_nationkey"), "\n[REF]: last/", k, "\n")
    return links.reference(derived.table(spark, sf_dir, "supplier").select(join("s/", k, ".md").alias("path"), content.alias("content")))


@query(
    rf"""WITH {derived.SITE_SQL}, p AS (SELECT path FROM site UNION ALL SELECT 'docs/readme.md' UNION ALL SELECT 'tutorial/a.md'),
c AS (SELECT path, CASE WHEN regexp_matches(path, '(^|/)(index|readme)\.md$') THEN 0 WHEN regexp_matches(path, '{"|".join(documents.IMPORTANT)}') THEN 1 ELSE 2 END AS class,
  CASE WHEN regexp_matches(path, '(^|/)index\.md$') THEN 1 WHEN regexp_matches(path, '(^|/)readme\.md$') THEN 2 ELSE 0 END AS class_rank FROM p)
SELECT path, class, class_rank, row_number() OVER (ORDER BY class, class_rank, path)::INT AS place FROM c"""
)
def legacy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3."""
    from pyspark.sql import Window

    more = spark.createDataFrame([("docs/readme.md", ""), ("tutorial/a.md", "")], "path string, content string")
    found = documents.legacy_ordered(derived.site(spark, sf_dir).union(more))
    return found.withColumn("place", F.row_number().over(Window.orderBy("class", "class_rank", F.collate("path", "UNICODE"))))


@query(
    rf"""WITH {derived.SITE_SQL} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS parent, split_part(path, '/', -1) AS name, path, strlen(content)::INT AS size, 'file' AS type, '.md' AS extension,
  true AS is_markdown, row_number() OVER (PARTITION BY CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END ORDER BY split_part(path, '/', -1))::INT AS place FROM site"""
)
def directory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, O7, P14."""
    from pyspark.sql import Window

    found = navigation.entries(derived.site(spark, sf_dir).select("path", F.octet_length("content").alias("size")))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.collate("name", "UNICODE"))))


@query(
    rf"""WITH RECURSIVE {RANKS_SQL} SELECT s.path, (CASE WHEN s.path = 'index.md' THEN 40.0 + 5 ELSE 0 END + CASE WHEN regexp_matches(lower(s.path), '{"|".join(documents.IMPORTANT_IN_BUNDLES)}') THEN 50.0 ELSE 0 END
  - CASE WHEN length(content) > 10000 THEN 10 ELSE 0 END + importance * 2.0 + CASE WHEN length(s.path) % 2 = 0 THEN 7.5 ELSE 0 END)::DOUBLE AS score FROM site s JOIN importance i ON i.path = s.path"""
)
def bundle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own weights, importance and usage."""
    docs, edges = site_edges(spark, sf_dir)
    usage = docs.where(F.length("path") % 2 == 0).select("path", F.lit(7.5).alias("usage"))
    found = bundles.scores(docs, graph.importance(graph.ranks(docs, edges)), usage, {"index": 40.0, "importance": 2.0})
    return found.select("path", "score")


@query(
    rf"""WITH {derived.SITE_SQL} SELECT path, unnest(list_filter([CASE WHEN path LIKE 'nation/%' THEN 'place' END, CASE WHEN path LIKE '%/1.md' THEN 'first' END, CASE WHEN contains(lower(content), 'suppliers') OR contains(lower(content), 'gone') THEN 'firm' END], lambda x: x IS NOT NULL)) AS tag FROM site"""
)
def custom_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: own rules; tags that the text itself shows are left out here."""
    found = tags.tags(derived.site(spark, sf_dir), {"^nation/": "place"}, {r"^1\.md$": "first"}, {"firm": ["Suppliers", "gone"]})
    return tags.long_form(found).where(F.col("tag").isin("place", "first", "firm"))


@query(f"WITH RECURSIVE {RANKS_SQL.replace('0.15 /', '0.5 /').replace('0.85 *', '0.5 *').replace('r.i < 20', 'r.i < 7').replace('i = 20', 'i = 7')} SELECT path, round(score, 9) AS score FROM ranks")
def rank_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: another damping, and fewer rounds."""
    return graph.ranks(*site_edges(spark, sf_dir), damping=0.5, rounds=7).select("path", F.round("score", 9).alias("score"))


# --- retrieval and loaders


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = derived.site(spark, sf_dir)
    tagged = docs.select("path", F.when(F.col("path").contains("1"), F.array(F.lit("one"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return docs, retrieval.doc_index(docs, tagged)


INDEX_SQL = rf"""{derived.SITE_SQL}, i AS (SELECT path, CASE WHEN path = 'index.md' THEN 'Index' ELSE regexp_extract(path, '([0-9]+)\.md$', 1) END AS title,
  CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS section, CASE WHEN contains(path, '1') THEN ['one'] ELSE []::VARCHAR[] END AS tags, content FROM site)"""


@query(f"WITH {INDEX_SQL} SELECT 'section' AS asked, path, title FROM i WHERE section = 'nation' UNION ALL SELECT 'tags', path, title FROM i WHERE len(tags) > 0 UNION ALL SELECT 'both', path, title FROM i WHERE section = 'region' AND len(tags) > 0 UNION ALL SELECT 'path', path, md5(content) FROM i WHERE path = 'index.md'")
def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G3, G4, F15."""
    docs, index = _indexed(spark, sf_dir)
    asked = lambda name, df: df.select(F.lit(name).alias("asked"), "path", "title")
    one = retrieval.get_document(docs, "index.md").select(F.lit("path").alias("asked"), "path", F.md5("content").alias("title"))
    return asked("section", retrieval.list_documents(index, "nation")).union(asked("tags", retrieval.list_documents(index, tags=["one", "two"]))).union(asked("both", retrieval.list_documents(index, "region", ["one"]))).union(one)


@query(f"WITH {INDEX_SQL} SELECT md5(content) AS content, path AS source, title, section, tags FROM i WHERE regexp_matches(path, '^(nation|supplier)/[^/]*$') AND NOT regexp_matches(path, '^supplier/2')")
def loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, J21, F13."""
    docs, index = _indexed(spark, sf_dir)
    found = retrieval.loader_documents(docs, index.select("path", "tags"), ["nation/*", "supplier/*"], ["supplier/2*"])
    return found.select(F.md5("page_content").alias("content"), "metadata.source", "metadata.title", "metadata.section", "metadata.tags")


CHUNK_SQL = main._chunk_sql(1000, 1500)


@query(f"SELECT source_path AS source, chunk_index, content_md5, token_count, token_count BETWEEN 20 AND 200 AS kept FROM ({CHUNK_SQL})")
def loaded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loader chunks, and which of them a filter by tokens keeps."""
    found = chunks.chunks(derived.threads(spark, sf_dir))
    kept = retrieval.filter_chunks(found, 20, 200).select("chunk_id", F.lit(True).alias("kept"))
    shown = retrieval.loader_chunks(found).select("metadata.chunk_id", "metadata.source", "metadata.token_count", F.md5("page_content").alias("content_md5"))
    return shown.join(found.select("chunk_id", "chunk_index"), "chunk_id").join(kept, "chunk_id", "left").select("source", "chunk_index", "content_md5", "token_count", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(
    f"""SELECT source_path, chunk_index, content_md5, CASE WHEN source_path LIKE '%0.md' THEN NULL ELSE substr(sha256(source_path), 1, 12) END AS source_id,
  chunk_index > min(chunk_index) OVER (PARTITION BY source_path) AS has_previous, chunk_index < max(chunk_index) OVER (PARTITION BY source_path) AS has_next FROM ({CHUNK_SQL})"""
)
def chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some documents are gone."""
    docs = derived.threads(spark, sf_dir)
    found = chunks.chunks(docs)
    made = retrieval.nodes(found, docs.where(~F.col("path").endswith("0.md")))
    own = found.select(F.col("chunk_id").alias("node_id"), "source_path", "chunk_index")
    return made.join(own, "node_id").select(
        "source_path", "chunk_index", F.md5("text").alias("content_md5"), "source_id", F.col("previous_id").isNotNull().alias("has_previous"), F.col("next_id").isNotNull().alias("has_next")
    )


@query(
    f"""WITH {derived.FLAT_SQL} SELECT path, CASE WHEN length(path) % 2 = 0 THEN 'id-' || path ELSE substr(sha256(path), 1, 12) END AS parent_doc_id,
  CASE WHEN length(path) % 2 = 0 AND path LIKE '%1.md' THEN 'about ' || path ELSE left(content, 200) END AS summary FROM flat"""
)
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, J14."""
    docs = derived.flat(spark, sf_dir)
    listed = docs.where(F.length("path") % 2 == 0).select("path", join("id-", F.col("path")).alias("id"), F.when(F.col("path").endswith("1.md"), join("about ", F.col("path"))).alias("description"))
    return retrieval.summaries(docs, listed)


# --- files: written to the shared folder, and read again


def written(spark: SparkSession, rows: DataFrame, folder: str) -> str:
    sinks.write_files(rows, folder)
    return folder


_built: dict[tuple[str, str], str] = {}


def site_folder(spark: SparkSession, sf_dir: str) -> str:
    """The site and some source files as a directory, once a session and input."""
    key = (spark.sparkContext.applicationId, "site " + sf_dir)
    if key not in _built:
        code = main._code(spark, sf_dir).select(F.col("file").alias("path"), "content")
        odd = spark.createDataFrame([("build/no.md", "no"), ("nation/pic.png", "x"), ("src/vendor/no.py", "no")], "path string, content string")
        _built[key] = written(spark, derived.site(spark, sf_dir).unionByName(code).unionByName(odd), scratch(spark, "site"))
    return _built[key]


def built(spark: SparkSession, sf_dir: str) -> str:
    """The output of a build of the site with every option, once a session and input."""
    key = (spark.sparkContext.applicationId, "built " + sf_dir)
    if key not in _built:
        out = scratch(spark, "built")
        given = {"input": site_folder(spark, sf_dir), "output": out, "base_url": "https://docs.example.org", "optional": ["nation/1*.md"], "bundle_sizes": [2000, 4000], "continue_on_error": True, "exclude_tokens": ["src/"]}
        flags = ("sitemap", "index", "toc", "ast", "chunks", "manifest", "graph", "graph_sections", "tags", "bundles", "validate", "validate_ai", "incremental", "mcp", "single_files")
        build.build(spark, config.merge(given, dict.fromkeys(flags, True)))
        _built[key] = out
    return _built[key]


@query(
    rf"""WITH {derived.SITE_SQL} SELECT 'scan' AS kind, path, strlen(content)::BIGINT AS size, sha256(content) AS hash FROM site WHERE path NOT LIKE 'region/%'
UNION ALL SELECT 'documents', path, strlen(content), sha256(content) FROM site UNION ALL SELECT 'root', path, strlen(content), sha256(content) FROM site WHERE path = 'index.md'"""
)
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the directory as documents."""
    folder = site_folder(spark, sf_dir)
    shown = lambda kind, df, size: df.select(F.lit(kind).alias("kind"), "path", F.col(size).cast("bigint").alias("size"), F.sha2("content", 256).alias("hash"))
    found = files.listed(spark, folder)
    scan = files.scan(spark, folder, ["**/*.md"], tokens=["build/"], keep=lambda p: ~p.startswith("region/"), found=found)
    every = artefacts.from_directory(spark, folder).where("path not like 'build/%'")
    return shown("scan", scan, "size").union(shown("documents", every, "raw_size")).union(shown("root", files.root_index(files.scan(spark, folder, found=found)), "size"))


@query(
    rf"""WITH {derived.SITE_SQL}, {main.CODE_SQL} SELECT path, strlen(content)::BIGINT AS size FROM site UNION ALL SELECT file, strlen(content) FROM code
UNION ALL SELECT * FROM (VALUES ('build/no.md', 2), ('nation/pic.png', 1), ('src/vendor/no.py', 2))"""
)
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, S6."""
    return files.listing(spark, site_folder(spark, sf_dir)).select("path", "size")


@query(f"WITH {main.CODE_SQL} SELECT file, extension, md5(content) AS hash FROM code")
def scanned_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8."""
    return files.code_files(spark, site_folder(spark, sf_dir)).select("file", "extension", F.md5("content").alias("hash"))


TITLE_SQL = r"CASE WHEN path = 'index.md' THEN 'Home' ELSE path END"


@query(
    rf"""WITH {derived.SITE_SQL}, l AS (SELECT path, CASE WHEN path LIKE 'nation/1%' THEN 'Optional' WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'Root' END AS s FROM site)
SELECT 'llms.txt' AS file, regexp_extract(line, '\((.*)\)$', 1) AS url, count(*) AS n FROM (SELECT '(https://docs.example.org/' || path || ')' AS line FROM l) GROUP BY ALL
UNION ALL SELECT 'llms-ctx.txt', 'https://docs.example.org/' || path, 1 FROM l WHERE s <> 'Optional'
UNION ALL SELECT 'sections', s, 1 FROM l GROUP BY s"""
)
def written_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: links and sections of the index files."""
    out = built(spark, sf_dir)
    lines = lambda name: spark.read.text(f"{out}/{name}")
    link = F.regexp_extract("value", r"^- \[.*?\]\((.*?)\)", 1)
    of = lambda name: lines(name).where(F.col("value").startswith("- [")).groupBy(F.lit(name).alias("file"), link.alias("url")).agg(F.count("*").alias("n"))
    heads = lines("llms.txt").where(F.col("value").startswith("## ")).select(F.lit("sections").alias("file"), F.substring("value", 4, 999).alias("url"), F.lit(1).cast("bigint").alias("n"))
    return of("llms.txt").union(of("llms-ctx.txt")).union(heads)


@query(
    rf"""WITH {derived.SITE_SQL}, l AS (SELECT unnest(string_split('## ' || path || E'\n\n' || content || E'\n\n---\n', E'\n')) AS value FROM site) SELECT value, count(*) AS n FROM l GROUP BY value"""
)
def written_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the lines of the full text."""
    return spark.read.text(f"{built(spark, sf_dir)}/llms-full.txt").groupBy("value").agg(F.count("*").alias("n"))


@query(
    rf"""WITH {derived.SITE_SQL}, c AS (SELECT path, CASE WHEN path = 'index.md' THEN 'Root' WHEN regexp_matches(path, '{"|".join(documents.IMPORTANT)}') THEN 'Documentation' ELSE 'Optional' END AS k FROM site) SELECT '- ' || k || ': ' || path AS value FROM c"""
)
def written_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4."""
    out = scratch(spark, "legacy")
    sinks.write_legacy(derived.site(spark, sf_dir), out)
    return spark.read.text(f"{out}/llms-legacy.txt")


@query(f"WITH {main.TAGS_SQL} SELECT t.path, unnest(tags) AS tag, 'document' AS side FROM t JOIN site USING (path) UNION ALL SELECT t.path, unnest(tags), 'tag' FROM t JOIN site USING (path)")
def written_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both files of tags."""
    out = built(spark, sf_dir)
    one = spark.read.json(f"{out}/tags/by-document").select("path", F.explode("tags").alias("tag"), F.lit("document").alias("side"))
    return one.union(spark.read.json(f"{out}/tags/by-tag").select(F.explode("paths").alias("path"), "tag", F.lit("tag").alias("side")))


@query(
    f"""WITH RECURSIVE {RANKS_SQL}{main.DEGREES_SQL} SELECT 'node' AS kind, path AS source, importance::VARCHAR AS target FROM importance
UNION ALL SELECT 'edge', source, target FROM e WHERE target IS NOT NULL UNION ALL SELECT 'section', path, count(*)::VARCHAR FROM (SELECT path, unnest(regexp_extract_all(content, '(?m)^#{{1,6}}\\s+.+$')) FROM site) GROUP BY path"""
)
def written_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, S12."""
    out = built(spark, sf_dir)
    read = lambda name: spark.read.json(f"{out}/graph/{name}")
    nodes = read("nodes").select(F.lit("node").alias("kind"), F.col("path").alias("source"), F.col("importance").cast("string").alias("target"))
    sections = read("section-nodes").groupBy("doc_path").agg(F.count("*").cast("string").alias("n")).select(F.lit("section"), "doc_path", "n")
    return nodes.union(read("edges").select(F.lit("edge"), "source", "target")).union(sections)


MANIFEST_SQL = f"""{main.TAGS_SQL}, {LINKS_SQL[LINKS_SQL.index(", l AS (") + 2 :]}, {main.SIMHASH_SQL.replace("FROM flat", "FROM site")}, g AS (SELECT * FROM e WHERE target IS NOT NULL)
SELECT site.path, substr(sha256(site.path || content), 1, 12) AS id, sha256(content) AS sha256, strlen(content)::BIGINT AS size, {main.WORDS}::BIGINT AS word_count, len(string_split(content, E'\\n'))::BIGINT AS line_count,
  coalesce(lpad(lower(to_hex(f)), 16, '0'), '0000000000000000') AS simhash, (SELECT count(*) FROM g WHERE source = site.path) AS outgoing, (SELECT count(*) FROM g WHERE target = site.path) AS incoming, t.tags
FROM site LEFT JOIN f USING (path) JOIN t ON t.path = site.path"""


@query(f"WITH {MANIFEST_SQL}")
def written_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with the documents that the directory still has."""
    found = artefacts.from_manifest(spark, f"{built(spark, sf_dir)}/manifest", site_folder(spark, sf_dir))
    return found.select("path", "id", "sha256", "size", "word_count", "line_count", "simhash", F.size("outgoing").cast("bigint").alias("outgoing"), F.size("incoming").cast("bigint").alias("incoming"), "tags")


@query(f"SELECT source_path, chunk_index::BIGINT AS chunk_index, content_md5, token_count::BIGINT AS token_count, count(*) OVER (PARTITION BY source_path) AS listed FROM ({CHUNK_SQL})")
def written_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk lines read back, bad lines skipped, and how many the manifest lists."""
    docs, out = derived.threads(spark, sf_dir), scratch(spark, "chunks")
    found = chunks.chunks(docs)
    sinks.write_jsonl(found, out)
    spark.createDataFrame([("no chunk {",)], "value string").write.mode("append").text(out)
    listed = manifest.documents(docs, None, None, found).select(F.col("path").alias("source_path"), F.size("chunk_ids").cast("bigint").alias("listed"))
    back = artefacts.chunks(spark, out).join(listed, "source_path")
    return back.select("source_path", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("content").alias("content_md5"), F.col("token_count").cast("bigint").alias("token_count"), "listed")


SITEMAP_SQL = main.SQL["sitemap"]


@query(f"SELECT 'sitemap' AS kind, url AS a, priority AS b FROM ({SITEMAP_SQL}) UNION ALL SELECT 'toc', line, '' FROM ({main.SQL['toc']})")
def written_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10, K12."""
    out = built(spark, sf_dir)
    xml = spark.read.text(f"{out}/sitemap.xml")
    each = xml.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<url>.*?</url>"), F.lit(0))).alias("u"))
    urls = each.select(F.lit("sitemap").alias("kind"), F.regexp_extract("u", r"<loc>(.*?)</loc>", 1).alias("a"), F.regexp_extract("u", r"<priority>(.*?)</priority>", 1).alias("b"))
    return urls.union(spark.read.text(f"{out}/toc-full.md").select(F.lit("toc"), "value", F.lit("")))


@query(f"SELECT file, count(*) AS symbols FROM ({main.SQL['code_symbols']}) GROUP BY file")
def written_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of all symbols."""
    return spark.read.text(f"{built(spark, sf_dir)}/symbols.txt").groupBy(F.regexp_extract("value", "^(.*?):", 1).alias("file")).agg(F.count("*").alias("symbols"))


@query("SELECT * FROM (VALUES (2000::BIGINT, true, true), (4000, true, true)) AS t(size, filled, fits)")
def written_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: a text for each size, within its budget of tokens."""
    out = built(spark, sf_dir)
    text_of = spark.read.text([f"{out}/llms-ctx-2k.txt", f"{out}/llms-ctx-4k.txt"], wholetext=True)
    size = F.when(F.col("_metadata.file_name").contains("2k"), 2000).otherwise(4000).cast("bigint")
    tokens = F.ceil(F.length("value") / 4)
    return text_of.select(size.alias("size"), (tokens > 0).alias("filled"), (tokens <= size).alias("fits"))


@query(
    f"SELECT path, depth::BIGINT AS depth, files, markdown_files FROM (WITH {main.ROLLUP_SQL}) WHERE path <> '' UNION ALL SELECT 'entries', NULL, count(*), count(*) FROM (WITH {derived.SITE_SQL} SELECT path FROM site WHERE contains(path, '/'))"
)
def written_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory indexes, read back; other files than the site's are left out here."""
    out = built(spark, sf_dir)
    site = F.col("path").rlike("^(nation|region|supplier)(/|$)") & ~F.col("path").endswith(".png")
    found = artefacts.directory_indexes(spark, f"{out}/index/directories").where(site)
    entries = artefacts.directory_indexes(spark, f"{out}/index/entries").where(site).agg(F.count("*").alias("n"))
    pictures = F.when(F.col("path") == "nation", 1).otherwise(0)
    return found.select("path", "depth", (F.col("files") - pictures).alias("files"), "markdown_files").union(entries.select(F.lit("entries"), F.lit(None).cast("bigint"), "n", "n"))


@query(f"SELECT errors, valid FROM ({main.SQL['report_summary']})")
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the build."""
    return artefacts.document(spark, f"{built(spark, sf_dir)}/report.json").select("errors", "valid")


# --- state, options, server, watch


@query(
    f"""WITH {derived.FLAT_SQL} SELECT path, sha256(content) AS hash, strlen(content)::BIGINT AS size, count(*) OVER () AS file_count, sum(strlen(content)) OVER ()::BIGINT AS total_size,
  path = (SELECT min(path) FROM flat) AS entry, 2::BIGINT AS versions, 0::BIGINT AS cleared FROM flat"""
)
def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state committed twice and loaded, its versions, and one cleared."""
    folder = incremental.state_path(scratch(spark, "state"), sf_dir)
    now = incremental.snapshot(derived.flat(spark, sf_dir))
    incremental.commit_state(now.limit(0), folder)
    incremental.commit_state(now, folder)
    state = incremental.load_state(spark, folder)
    first = state.agg(F.min("path")).first()[0]
    own = incremental.entry(state, first).select("path", F.lit(True).alias("entry"))
    for _ in range(2):
        incremental.append_versions(state, folder + "-versions")
    versions = spark.read.parquet(folder + "-versions")
    assert incremental.history(versions, first).count() == 2
    many = incremental.last_versions(versions).groupBy("path").agg(F.count("*").alias("versions"))
    incremental.commit_state(now, folder + "-gone")
    incremental.clear_state(spark, folder + "-gone")
    cleared = incremental.load_state(spark, folder + "-gone").count()
    rows = state.join(own, "path", "left").join(many, "path").crossJoin(F.broadcast(incremental.statistics(state)))
    return rows.select("path", "hash", "size", "file_count", "total_size", F.coalesce("entry", F.lit(False)).alias("entry"), "versions", F.lit(cleared).cast("bigint").alias("cleared"))


@query(
    """SELECT * FROM (VALUES ('bundle_sizes', '[500, 2000]'), ('chunk_profile', '"default"'), ('exclude', '["a", "b"]'), ('base_url', '"https://x.org/"'), ('chunks', 'true'), ('camel', '"baseUrl"'), ('kinds', '[1, 2.5, true, null, "x"]'), ('sample', 'true')) AS t(name, value)"""
)
def merged_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a file and of flags."""
    flat = config._flat_yaml("# made\nbaseUrl: https://x.org\nexclude:\n  - a\nbundleSizes: [2000, 500, -1]\nchunkProfile: unheard\nmixed: [1, 2.5, true, null, 'x']\n")
    kinds = flat.pop("mixed")
    found = config.merge({config.snake(k): v for k, v in flat.items()}, {"exclude": ["b", "a"], "chunks": True, "silent": None})
    rows = {k: getattr(found, k) for k in ("bundle_sizes", "chunk_profile", "exclude", "base_url", "chunks")} | {"camel": config.camel("base-url"), "kinds": kinds, "sample": json.loads(config.sample())["chunks"]}
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "name string, value string")


@query("SELECT * FROM (VALUES ('configuration', 2, true), ('input', 3, true), ('processing', 4, false), ('output', 5, true), ('validation', 6, false), ('summary', 5, true)) AS t(kind, code, fatal)")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11, A16, F20, V8, V9, K21, F19."""
    raised = (ValueError("option x"), FileNotFoundError("gone"), ValueError("odd"), PermissionError("permission denied"), ValueError("not valid"))
    log, rows = errors.ErrorLog(continue_on_error=True), []
    metrics = perf.Metrics()
    for known in perf.run_batch(metrics.wrap("errors", errors.categorize), raised):
        one = errors.ErrorLog(continue_on_error=True)
        one.handle(known)
        log.handle(known)
        rows.append((known.kind, known.exit_code, one.fatal()))
    assert metrics.report()["metrics"]["errors"] >= 0 and not metrics.over_memory(1e9)
    return spark.createDataFrame([*rows, ("summary", log.summary()["errors"], log.fatal())], "kind string, code int, fatal boolean")


@query(
    rf"""WITH {INDEX_SQL} SELECT 'list' AS asked, path AS answer FROM i WHERE section = 'region' UNION ALL SELECT 'get', md5(content) FROM i WHERE path = 'index.md'
UNION ALL SELECT 'resource', 'docs://section/' || section || ' ' || count(*) || ' documents' FROM i GROUP BY section
UNION ALL SELECT 'tool', unnest(['get_document', 'get_section', 'list_documents', 'search_docs']) UNION ALL SELECT 'error', '-32601' UNION ALL SELECT 'prompt', unnest(['answer', 'compare', 'summarize_section'])
UNION ALL SELECT 'file', unnest(['mcp.client.json', 'mcp.config.json', 'mcp.server.json'])"""
)
def server_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session of messages."""
    import hashlib

    docs, index = _indexed(spark, sf_dir)
    host = server.Server(index, docs)
    call = lambda name, **a: json.loads(host.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]["content"][0]["text"])
    ask = lambda method: host.handle({"id": 1, "method": method})
    rows = [("list", r["path"]) for r in call("get_section", section="region")]
    rows += [("get", hashlib.md5(r["content"].encode()).hexdigest()) for r in call("get_document", path="index.md")]
    rows += [("resource", f"{r['uri']} {r['description']}") for r in ask("resources/list")["result"]["resources"]]
    rows += [("tool", t["name"]) for t in ask("tools/list")["result"]["tools"]] + [("error", str(ask("no/such")["error"]["code"]))]
    rows += [("prompt", p["name"]) for p in ask("prompts/list")["result"]["prompts"]]
    rows += [("file", x) for x in server.write_configs(scratch(spark, "mcp"), "docs", "python")]
    return spark.createDataFrame(rows, "asked string, answer string")


@query(
    f"""WITH {derived.SITE_SQL}, p AS (SELECT path FROM site WHERE path LIKE 'region/%') SELECT 1 AS build, path, 'added' AS change FROM p UNION ALL SELECT 2, 'region/0.md', 'changed'
UNION ALL SELECT 2, 'region/9.md', 'added' UNION ALL SELECT 3, 'region/1.md', 'deleted' UNION ALL SELECT 4, path, 'added' FROM (SELECT path FROM p WHERE path <> 'region/1.md' UNION ALL SELECT 'region/9.md') UNION ALL SELECT 0, event, 'event' FROM (VALUES ('changes_detected'), ('rebuild_started'), ('rebuild_completed'), ('force_rebuild_requested'), ('watch_stopped')) t(event)"""
)
def watched_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks at a directory between edits, additions and deletions; what each build got, and the kinds of events."""
    folder = scratch(spark, "watched") + "/docs"
    written(spark, derived.site(spark, sf_dir).where("path like 'region/%'"), folder)
    rows: list[tuple] = []
    said: list[str] = []
    w = watch.Watcher(spark, folder, folder + "-state", lambda s, changed, b: rows.extend((w.counts["rebuilds"] + 1, r.path, r.change) for r in changed.collect()), emit=said.append)

    def settle() -> None:
        w.look(0)
        w.look(1)

    settle()
    written(spark, spark.createDataFrame([("region/0.md", "edited"), ("region/9.md", "new"), ("region/x.png", "")], "path string, content string"), folder)
    settle()
    fs, root = sinks._file_system(folder)
    fs.delete_file(f"{root}/region/1.md")
    settle()
    w.force()
    w.stop()
    rows += [(0, e, "event") for e in {json.loads(x)["event"] for x in said}]
    return spark.createDataFrame(rows, "build int, path string, change string")


@query(
    f"""WITH RECURSIVE {RANKS_SQL} SELECT 'nodes' AS kind, path AS a, importance::VARCHAR AS b FROM importance UNION ALL SELECT 'edges', source, target FROM e WHERE target IS NOT NULL
UNION ALL SELECT 'manifest', path, sha256(content) FROM site UNION ALL SELECT 'directory', split_part(path, '/', 1), split_part(path, '/', 2) FROM site WHERE contains(path, '/')
UNION ALL SELECT 'chunks', path, '' FROM site UNION ALL SELECT 'sections', path, count(*)::VARCHAR FROM (SELECT path, unnest(regexp_extract_all(content, '(?m)^#{{1,6}}\\s+.+$')) FROM site) GROUP BY path
UNION ALL SELECT 'bundles', size::VARCHAR, '' FROM (VALUES (2000), (4000)) AS t(size) UNION ALL SELECT 'master', 'directories', '' UNION ALL SELECT 'tags', path, '' FROM site UNION ALL SELECT 'symbols', file, '' FROM ({main.SQL['code_symbols']}) GROUP BY file"""
)
def single_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build's tables as single files."""
    out = built(spark, sf_dir)
    kind = lambda name, df, a, b: df.select(F.lit(name).alias("kind"), F.col(a).cast("string").alias("a"), (F.col(b).cast("string") if b else F.lit("")).alias("b"))
    rows = lambda file, name: artefacts.rows(spark, f"{out}/{file}", name)
    own = F.col("path").rlike(r"^(nation|region|supplier)/[^/]*\.md$")
    nation, region, supplier = (rows(f"{d}/index.json", "files").select("path", "parent", "name") for d in ("nation", "region", "supplier"))
    entries = nation.union(region).union(supplier).where(own)
    master = artefacts.document(spark, f"{out}/master-index.json")
    parts = [
        kind("nodes", rows("graph.json", "nodes"), "path", "importance"), kind("edges", rows("graph.json", "edges"), "source", "target"), kind("manifest", rows("manifest.json", "documents"), "path", "sha256"),
        kind("directory", entries, "parent", "name"), kind("chunks", artefacts.chunks(spark, f"{out}/chunks.jsonl").select("source_path").distinct(), "source_path", None),
        kind("sections", rows("graph-sections.json", "nodes").groupBy("doc_path").agg(F.count("*").alias("n")), "doc_path", "n"), kind("bundles", rows("bundles.meta.json", "bundles"), "size", None),
        kind("tags", rows("tags.json", "documents"), "path", None), kind("symbols", rows("ast-index.json", "symbols").select("file").distinct(), "file", None),
        master.where(F.size("directories") > 0).select(F.lit("master"), F.lit("directories"), F.lit("")),
    ]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.union(more)
    return whole
