"""Queries over the driver's tables, one for each group of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import paths, text
from corpusmill.operators import bundles, chunks, documents, graph, links, manifest, metadata, navigation, patterns, quality, retrieval, security, symbols, tags
from corpusmill.sources import derived
from corpusmill.streaming import incremental, watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WORDS = r"len(regexp_extract_all(content, '[^\s\x0B]+'))"
SPLIT = r"len(string_split_regex(content, '\s+'))"
INLINE = links.INLINE

#: site -> inline links with their candidates' resolution (graph flavour).
LINKS_SQL = (
    derived.SITE_SQL
    + rf""", l AS (
  SELECT path AS source, unnest(regexp_extract_all(content, '{INLINE}', 1)) AS text, unnest(regexp_extract_all(content, '{INLINE}', 2)) AS url,
    unnest(range(0, len(regexp_extract_all(content, '{INLINE}'))))::INT AS pos FROM site
), p AS (
  SELECT *, regexp_replace(regexp_replace(source, '(^|/)[^/]*$', '') || '/' || split_part(url, '#', 1), '(^|/)[^/.]+/\.\./', '\1') AS r0 FROM l
), q AS (
  SELECT *, ltrim(r0, '/') AS r FROM p
), e AS (
  SELECT source, pos, text, coalesce(a.path, b.path, c.path) AS target, nullif(split_part(url, '#', 2), '') AS anchor
  FROM q LEFT JOIN site a ON a.path = r LEFT JOIN site b ON b.path = r || '.md' LEFT JOIN site c ON c.path = r || '/index.md'
)"""
)
#: ... and the ranks of the site's documents.
RANKS_SQL = (
    LINKS_SQL
    + """, g AS (SELECT source, target FROM e WHERE target IS NOT NULL), n AS (SELECT path, count(*) OVER ()::DOUBLE AS n FROM site),
w AS (SELECT source, target, count(*)::DOUBLE / (SELECT count(*) FROM g h WHERE h.source = g.source) AS share FROM g GROUP BY source, target),
rounds AS (
  SELECT 0 AS i, path, 1 / n AS score, n FROM n
  UNION ALL
  SELECT * FROM (
    SELECT r.i + 1 AS i, d.path, 0.15 / any_value(d.n) + 0.85 * coalesce(sum(s.score * w.share), 0) AS score, any_value(d.n) AS n
    FROM (SELECT DISTINCT i FROM rounds) r CROSS JOIN n d LEFT JOIN w ON w.target = d.path LEFT JOIN rounds s ON s.path = w.source
    WHERE r.i < 20 GROUP BY r.i, d.path
  )
), ranks AS (SELECT path, score FROM rounds WHERE i = 20),
importance AS (
  SELECT path, floor((score - min(score) OVER ()) / CASE WHEN max(score) OVER () > min(score) OVER () THEN max(score) OVER () - min(score) OVER () ELSE 1 END * 100 + 0.5)::INT AS importance FROM ranks
)"""
)
DEGREES_SQL = ", degree AS (SELECT path, (SELECT count(*) FROM e WHERE target = path) AS in_links, (SELECT count(*) FROM e WHERE source = path AND target IS NOT NULL) AS out_links FROM site)"
HEADINGS_SQL = r""", lines AS (
  SELECT path, unnest(string_split(content, E'\n')) AS l, generate_subscripts(string_split(content, E'\n'), 1)::INT AS line FROM {corpus}
), hs AS (
  SELECT path, line, (row_number() OVER (PARTITION BY path ORDER BY line) - 1)::INT AS pos, len(regexp_extract(l, '^(#{{1,6}})\s', 1))::INT AS level, trim(regexp_extract(l, '^#{{1,6}}\s+(.+)$', 1)) AS title
  FROM lines WHERE regexp_matches(l, '^#{{1,6}}\s+.+$')
), h AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^A-Za-z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g')) AS anchor FROM hs
)"""


def site_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = derived.site(spark, sf_dir)
    return docs, links.edges(docs)


# --- documents


@query(f"WITH {derived.FLAT_SQL} SELECT path, substr(sha256(path || content), 1, 12) AS id, substr(sha256(path), 1, 12) AS reader_id FROM flat")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.flat(spark, sf_dir)
    return docs.select("path", text.document_id(F.col("path"), F.col("content")).alias("id"), text.reader_id(F.col("path")).alias("reader_id"))


@query(f"WITH {derived.FLAT_SQL} SELECT split_part(path, '/', 1) AS section, count(*) AS documents, sum({WORDS})::BIGINT AS words, sum(strlen(content))::BIGINT AS bytes FROM flat GROUP BY 1")
def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.section_rollup(derived.flat(spark, sf_dir))


@query(
    rf"""WITH {derived.THREADS_SQL} SELECT path, substr(sha256(path || content), 1, 12) AS id, strlen(content)::INT AS size, {WORDS}::INT AS word_count, len(string_split(content, E'\n'))::INT AS line_count,
  ceil(length(content) / 4)::INT AS token_estimate, regexp_matches(content, '`[^`]+`') AS has_code, regexp_matches(content, '(?m)^[-*+]\s|^[0-9]+\.\s') AS has_list FROM threads"""
)
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.statistics(derived.threads(spark, sf_dir))


ORDER_SQL = r"""
  SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'Root' END AS section,
    CASE WHEN regexp_matches(lower(path), '(^|/)index\.(md|mdx|html)$') THEN 1 WHEN regexp_matches(lower(path), '(^|/)readme\.(md|mdx|html)$') THEN 2
      WHEN regexp_matches(lower(path), '(^|/)home\.(md|mdx|html)$') THEN 3
      WHEN regexp_matches(lower(path), 'doc|get-started|getting-started|intro|quick-start|quickstart|start|tutorial') THEN 100 ELSE 200 END AS priority,
    regexp_matches(path, '^nation/1[^/]*\.md$') AS is_optional FROM site"""


@query(
    f"""WITH {derived.SITE_SQL}, o AS ({ORDER_SQL})
SELECT path, section, priority, is_optional, row_number() OVER (ORDER BY is_optional, CASE WHEN is_optional THEN NULL ELSE section <> 'Root' END, CASE WHEN is_optional THEN NULL ELSE section END, priority, path)::INT AS place FROM o"""
)
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = documents.ordered(derived.site(spark, sf_dir), ["nation/1*.md"])
    place = F.row_number().over(Window.orderBy(*documents.order_keys()))
    return docs.select("path", "section", "priority", "is_optional", place.alias("place"))


@query(
    r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title\b[^>]*>([^<]+)</title>', 1)), '') AS title, len(regexp_extract_all(html, '(?i)<meta\s+name=[\x22\x27]([^\x22\x27]+)[\x22\x27]\s+content=[\x22\x27]([^\x22\x27]+)[\x22\x27]'))::INT AS meta FROM pages"""
)
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.table(spark, sf_dir, "pages")
    return pages.select("page_id", metadata.html_title(F.col("html")).alias("title"), F.size(metadata.html_meta(F.col("html"))).alias("meta"))


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.documents(derived.web(spark, sf_dir)).select("path", "original_path", "section", "title", "content")


FRONT_SQL = r"""front AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN E'---\ntitle: "Doc ' || doc_id || E'"\ntags: ' || source || ', ' || lang || E'\n---\n' || text ELSE text END AS content FROM documents)"""


@query(
    f"WITH {FRONT_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Doc ' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN source || ', ' || lang END AS tags, md5(text) AS body FROM documents"
)
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter added to every fifth document, and read again."""
    docs = derived.table(spark, sf_dir, "documents")
    head = F.concat(F.lit('---\ntitle: "Doc '), F.col("doc_id").cast("string"), F.lit('"\ntags: '), "source", F.lit(", "), "lang", F.lit("\n---\n"))
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(head, "text")).otherwise(F.col("text"))
    rows = docs.select("doc_id", content.alias("content"))
    meta = metadata.front_matter(F.col("content"))
    return rows.select("doc_id", meta["title"].alias("title"), meta["tags"].alias("tags"), F.md5(metadata.without_front_matter(F.col("content"))).alias("body"))


# --- links and the graph


@query(f"WITH {LINKS_SQL} SELECT source, target, anchor, text, CASE WHEN anchor IS NULL THEN 'internal' ELSE 'internal-anchor' END AS type, 'inline' AS style, pos FROM e WHERE target IS NOT NULL")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_edges(spark, sf_dir)[1]


@query(
    r"""SELECT 'pages/' || page_id || '.html' AS source, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
  unnest(range(0, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>'))))::INT AS pos FROM pages"""
)
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of HTML pages, after their conversion to inline form by pattern."""
    inline = F.regexp_replace("content", r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    rows = derived.web(spark, sf_dir).select("path", inline.alias("content"))
    rule = r"\[([^\]]*)\]\((/[^)\s]*)\)"
    pair = F.arrays_zip(F.regexp_extract_all("content", F.lit(rule), F.lit(1)).alias("text"), F.regexp_extract_all("content", F.lit(rule), F.lit(2)).alias("url"))
    return rows.select(F.col("path").alias("source"), F.posexplode(pair).alias("pos", "x")).select("source", "x.url", "x.text", "pos")


@query(
    f"""WITH {LINKS_SQL} SELECT source AS document, pos, url AS target, r AS resolved FROM q
WHERE NOT regexp_matches(url, '^(https?://|mailto:|#)') AND r NOT IN (SELECT path FROM site) AND r || '.md' NOT IN (SELECT path FROM site) AND r || '/index.md' NOT IN (SELECT path FROM site)"""
)
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.broken(derived.site(spark, sf_dir))


@query(
    "WITH "
    + derived.SITE_SQL
    + HEADINGS_SQL.format(corpus="site")
    + """ SELECT a.path, a.pos, a.line, a.level, a.title, a.anchor,
  (SELECT b.anchor FROM h b WHERE b.path = a.path AND b.pos < a.pos AND b.level < a.level ORDER BY b.pos DESC LIMIT 1) AS parent_anchor FROM h a"""
)
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.headings(derived.site(spark, sf_dir))


@query("WITH " + derived.THREADS_SQL + HEADINGS_SQL.format(corpus="threads") + " SELECT path || '#' || anchor AS id, path AS doc_path, title, level, anchor FROM h")
def section_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.section_nodes(derived.threads(spark, sf_dir))


@query(
    "WITH "
    + LINKS_SQL
    + HEADINGS_SQL.format(corpus="site")
    + """ SELECT source, target || '#' || anchor AS target, 'section-reference' AS type FROM e WHERE target IS NOT NULL AND anchor IS NOT NULL
  UNION ALL
  SELECT path || '#' || parent, path || '#' || anchor, 'parent-child' FROM (
    SELECT a.path, a.anchor, (SELECT b.anchor FROM h b WHERE b.path = a.path AND b.pos < a.pos AND b.level < a.level ORDER BY b.pos DESC LIMIT 1) AS parent FROM h a
  ) WHERE parent IS NOT NULL"""
)
def section_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.section_edges(*site_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {RANKS_SQL} SELECT path, importance FROM importance")
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.importance(graph.ranks(*site_edges(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {RANKS_SQL}{DEGREES_SQL} SELECT s.path, replace(replace(regexp_replace(split_part(s.path, '/', -1), '\\.[^.]+$', ''), '-', ' '), '_', ' ') AS title,
  CASE WHEN contains(s.path, '/') THEN split_part(s.path, '/', 1) ELSE 'root' END AS section, in_links, out_links, importance, {SPLIT}::INT AS word_count
FROM site s JOIN degree d ON s.path = d.path JOIN importance i ON i.path = s.path"""
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(*site_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {RANKS_SQL} SELECT path, importance FROM importance ORDER BY importance DESC, path LIMIT 10")
def most_important(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which documents matter most."""
    return graph.most_important(graph.importance(graph.ranks(*site_edges(spark, sf_dir))))


@query(f"WITH {LINKS_SQL}{DEGREES_SQL} SELECT path, out_links FROM degree WHERE out_links >= 5 ORDER BY out_links DESC, path LIMIT 10")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(graph.degrees(*site_edges(spark, sf_dir)))


@query(f"WITH {LINKS_SQL}{DEGREES_SQL} SELECT path, in_links FROM degree WHERE in_links >= 3 ORDER BY in_links DESC, path LIMIT 10")
def authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.authorities(graph.degrees(*site_edges(spark, sf_dir)))


@query(
    f"""WITH {LINKS_SQL}{DEGREES_SQL} SELECT count(*) AS total_nodes, sum(out_links)::BIGINT AS total_edges, round(sum(out_links) / count(*), 6) AS average_links_per_doc, count(*) FILTER (out_links >= 5) AS hubs,
  count(*) FILTER (in_links >= 3) AS authorities, count(*) FILTER (in_links = 0 AND out_links = 0) AS isolated_count FROM degree"""
)
def graph_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.analysis(graph.degrees(*site_edges(spark, sf_dir)))


# --- tags


def _tag_sql() -> str:
    from corpusmill.operators import rules

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    found = [f"CASE WHEN regexp_matches(lower(path), {quote(r)}) THEN {quote(t)} END" for r, t in rules.PATHS.items()]
    found += [f"CASE WHEN regexp_matches(split_part(lower(path), '/', -1), {quote(r)}) THEN {quote(t)} END" for r, t in rules.FILES.items()]
    found += [f"CASE WHEN {' OR '.join(f'contains(s, {quote(w)})' for w in ws)} THEN {quote(t)} END" for t, ws in rules.KEYWORDS.items()]
    fence = "len(regexp_extract_all(content, '(?s)```.*?```')) > 0"
    found += [
        f"CASE WHEN {fence} THEN 'has-code' END", r"CASE WHEN regexp_matches(content, '\|.*\|.*\|') AND regexp_matches(content, '\|[-:]+\|') THEN 'has-tables' END",
        r"CASE WHEN regexp_matches(content, '!\[.*?\]\(.*?\)') THEN 'has-images' END", r"CASE WHEN regexp_matches(content, '\[.*?\]\(.*?\)') THEN 'has-links' END",
        "CASE WHEN len(array_to_string(regexp_extract_all(content, '(?s)```.*?```'), '')) > 0.5 * length(content) THEN 'code-heavy' END",
        r"CASE WHEN regexp_matches(content, '(?im)^#+\s*(?:FAQ|Question:|Q:)|\*{2}Q:\*{2}|<strong>Q:</strong>') THEN 'qa-format' END",
        r"CASE WHEN len(regexp_extract_all(content, '(?m)^[0-9]+\.\s+')) >= 3 THEN 'step-by-step' END",
        f"CASE WHEN {SPLIT} < 200 THEN 'length:short' WHEN {SPLIT} > 2000 THEN 'length:long' ELSE 'length:medium' END",
    ]
    languages = f"CASE WHEN {fence} THEN list_transform(regexp_extract_all(content, '```(\\w+)', 1), lambda x: 'lang:' || lower(x)) ELSE [] END"
    return f"""c AS (SELECT * FROM flat UNION ALL SELECT * FROM site), s AS (SELECT *, lower('  ' || content) AS s FROM c),
t AS (SELECT path, list_sort(list_distinct(list_filter(list_concat([{', '.join(found)}], {languages}), lambda x: x IS NOT NULL))) AS tags FROM s)"""


TAGS_SQL = f"{derived.FLAT_SQL}, {derived.SITE_SQL}, {_tag_sql()}"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tags(derived.flat(spark, sf_dir).unionByName(derived.site(spark, sf_dir)))


@query(f"WITH {TAGS_SQL} SELECT path, unnest(tags) AS tag FROM t")
def tags_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.long_form(_tagged(spark, sf_dir))


@query(f"WITH {TAGS_SQL} SELECT tag, list(path ORDER BY path) AS paths FROM (SELECT path, unnest(tags) AS tag FROM t) GROUP BY tag")
def tags_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.inverted(_tagged(spark, sf_dir))


@query(f"WITH {TAGS_SQL} SELECT tag, count(*) AS documents FROM (SELECT path, unnest(tags) AS tag FROM t) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.counts(_tagged(spark, sf_dir))


@query(
    f"""WITH {FRONT_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN list_sort(list_distinct([regexp_replace(lower(source), '[^a-z0-9:-]', '', 'g'), lower(lang)])) ELSE []::VARCHAR[] END AS tags FROM documents"""
)
def metadata_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents")
    given = F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit(", "), "lang"))
    return docs.select("doc_id", F.array_sort(F.array_distinct(tags.from_metadata(F.create_map(F.lit("tags"), given)))).alias("tags"))


# --- manifest


SIMHASH_SQL = r"""w AS (
  SELECT path, w, count(*) AS n FROM (SELECT path, unnest(string_split_regex(regexp_replace(lower(content), '[^A-Za-z0-9_\s]', ' ', 'g'), '\s+')) AS w FROM flat) WHERE length(w) > 2 GROUP BY path, w
), b AS (
  SELECT path, n, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS h FROM w
), v AS (
  SELECT path, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN n ELSE -n END) AS v FROM b, (SELECT unnest(range(0, 64))::UBIGINT AS i) GROUP BY path, i
), f AS (
  SELECT path, bit_or(CASE WHEN v > 0 THEN (1::UBIGINT << i) ELSE 0::UBIGINT END) AS f FROM v GROUP BY path
)"""


@query(f"WITH {derived.FLAT_SQL}, {SIMHASH_SQL} SELECT flat.path, coalesce(lpad(lower(to_hex(f)), 16, '0'), '0000000000000000') AS simhash FROM flat LEFT JOIN f USING (path)")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.simhash(derived.flat(spark, sf_dir))


@query(
    f"""WITH {LINKS_SQL}, g AS (SELECT * FROM e WHERE target IS NOT NULL)
SELECT path, coalesce((SELECT list({{'path': target, 'text': text}} ORDER BY target, text) FROM g WHERE source = path), []) AS outgoing,
  coalesce((SELECT list({{'path': source, 'text': text}} ORDER BY source, text) FROM g WHERE target = path), []) AS incoming FROM site"""
)
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.relationships(*site_edges(spark, sf_dir))


@query(
    f"""WITH {derived.FLAT_SQL} SELECT count(*) AS total_documents, sum(strlen(content))::BIGINT AS total_size, sum({WORDS})::BIGINT AS total_words, floor(sum({WORDS}) / count(*) + 0.5)::BIGINT AS average_words,
  count(*) FILTER (regexp_matches(content, '`[^`]+`')) AS with_code FROM flat"""
)
def manifest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.statistics(derived.flat(spark, sf_dir))


@query(
    f"""WITH {TAGS_SQL}, {LINKS_SQL[LINKS_SQL.index(", l AS (") + 2 :]}, {SIMHASH_SQL.replace("FROM flat", "FROM site")}, g AS (SELECT * FROM e WHERE target IS NOT NULL)
SELECT site.path, substr(sha256(site.path || content), 1, 12) AS id, replace(replace(regexp_replace(split_part(site.path, '/', -1), '\\.[^.]+$', ''), '-', ' '), '_', ' ') AS title,
  CASE WHEN contains(site.path, '/') THEN split_part(site.path, '/', 1) ELSE 'Root' END AS section, sha256(content) AS sha256, strlen(content)::INT AS size, {WORDS}::INT AS word_count,
  len(string_split(content, E'\\n'))::INT AS line_count, regexp_matches(content, '`[^`]+`') AS has_code, coalesce(lpad(lower(to_hex(f)), 16, '0'), '0000000000000000') AS simhash,
  coalesce((SELECT list({{'path': target, 'text': text}} ORDER BY target, text) FROM g WHERE source = site.path), []) AS outgoing,
  coalesce((SELECT list({{'path': source, 'text': text}} ORDER BY source, text) FROM g WHERE target = site.path), []) AS incoming, t.tags
FROM site LEFT JOIN f USING (path) JOIN t ON t.path = site.path"""
)
def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, edges = site_edges(spark, sf_dir)
    return manifest.documents(docs, edges, tags.tags(docs))


# --- chunks


def _chunk_sql(target: int, most: int) -> str:
    """Threads: paragraphs are parts between blank lines (no fences there), folded per section."""
    return rf"""WITH RECURSIVE {derived.THREADS_SQL}, lines AS (
  SELECT path, content, unnest(string_split(content, E'\n')) AS l, generate_subscripts(string_split(content, E'\n'), 1) AS line FROM threads
), marked AS (
  SELECT *, regexp_matches(l, '^#{{1,6}}\s+.+$') AS is_head, trim(l, E' \t\r\f\v') = '' AS blank FROM lines
), sec AS (
  SELECT *, sum(is_head::INT) OVER (PARTITION BY path ORDER BY line) AS sec FROM marked
), body AS (
  SELECT *, lag(blank OR is_head, 1, true) OVER (PARTITION BY path ORDER BY line) AS after FROM sec
), para AS (
  SELECT *, sum((after AND NOT blank)::INT) OVER (PARTITION BY path, sec ORDER BY line) AS p FROM body WHERE NOT is_head
), parts AS (
  SELECT path, sec, p, string_agg(l, E'\n' ORDER BY line) AS part FROM para WHERE NOT blank GROUP BY path, sec, p
), numbered AS (
  SELECT path, sec, part, ceil(length(part) / 4)::INT AS tok, row_number() OVER (PARTITION BY path, sec ORDER BY p) AS k FROM parts
), fold AS (
  SELECT path, sec, k, part, 1 AS chunk, CASE WHEN tok >= {target} THEN 0 ELSE tok END AS used, tok >= {target} AS closed FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.path, n.sec, n.k, n.part, CASE WHEN f.closed OR f.used + n.tok > {most} THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN (CASE WHEN f.closed OR f.used + n.tok > {most} THEN n.tok ELSE f.used + n.tok END) >= {target} THEN 0 ELSE CASE WHEN f.closed OR f.used + n.tok > {most} THEN n.tok ELSE f.used + n.tok END END,
    (CASE WHEN f.closed OR f.used + n.tok > {most} THEN n.tok ELSE f.used + n.tok END) >= {target}
  FROM fold f JOIN numbered n ON n.path = f.path AND n.sec = f.sec AND n.k = f.k + 1
), joined AS (
  SELECT path, sec, chunk, trim(string_agg(part, E'\n\n' ORDER BY k), E' \t\n\r\f\v') AS content FROM fold GROUP BY path, sec, chunk
)
SELECT path AS source_path, (row_number() OVER (PARTITION BY path ORDER BY sec = 0, sec, chunk) - 1)::INT AS chunk_index, md5(content) AS content_md5, ceil(length(content) / 4)::INT AS token_count FROM joined"""


def _chunk_rows(spark: SparkSession, sf_dir: str, profile: chunks.Profile | str) -> DataFrame:
    return chunks.chunks(derived.threads(spark, sf_dir), profile).select("source_path", "chunk_index", F.md5("content").alias("content_md5"), "token_count")


@query(_chunk_sql(1000, 1500))
def chunks_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, "default")


@query(_chunk_sql(500, 800))
def chunks_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, "faq")


@query(_chunk_sql(400, 600))
def chunks_granular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, "granular")


@query(_chunk_sql(3000, 5000))
def chunks_large_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, "large-context")


@query(_chunk_sql(1200, 2000))
def chunks_code_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, "code-heavy")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat documents with every line as a paragraph, so that many chunks arise."""
    return derived.flat(spark, sf_dir).select("path", F.replace("content", F.lit("\n"), F.lit("\n\n")).alias("content"))


@query(
    _chunk_sql(60, 100).replace(derived.THREADS_SQL, r"threads AS (SELECT source || '/' || doc_id || '.md' AS path, replace(text, E'\n', E'\n\n') AS content FROM documents)")
)
def chunks_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(_folded(spark, sf_dir), chunks.Profile(60, 100)).select("source_path", "chunk_index", F.md5("content").alias("content_md5"), "token_count")


@query(
    f"""SELECT count(*) AS total_chunks, count(DISTINCT source_path) AS documents, sum(token_count)::BIGINT AS total_tokens, round(avg(token_count), 4) AS average_tokens, min(token_count) AS min_tokens,
  max(token_count) AS max_tokens, 0::BIGINT AS with_code FROM ({_chunk_sql(1000, 1500)})"""
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.statistics(chunks.chunks(derived.threads(spark, sf_dir)))


@query(
    f"""SELECT source_path AS source, chunk_index, CASE WHEN token_count < 50 THEN 'chunk_too_small' ELSE 'chunk_too_large' END AS type, 'warning' AS severity FROM ({_chunk_sql(1000, 1500)})
WHERE token_count < 50 OR token_count > 3000"""
)
def chunk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.chunks(derived.threads(spark, sf_dir))
    return quality.chunk_issues(found).join(found.select("chunk_id", "chunk_index"), "chunk_id").select("source", "chunk_index", "type", "severity")


# --- bundles


def _bundle_sql(size: int, header: int) -> str:
    room = size - header - bundles.FOOTER_TOKENS
    fits, refers = f"b.cum + n.et <= {room}", f"b.cum + 100 <= {room} AND b.cum + n.rt <= {room}"
    return rf"""WITH RECURSIVE {derived.SITE_SQL}, s AS (
  SELECT path, content, replace(replace(regexp_replace(split_part(path, '/', -1), '\.[^.]+$', ''), '-', ' '), '_', ' ') AS title,
    CASE WHEN regexp_matches(lower(path), '(^|/)index\.(md|mdx|html)$') THEN 100.0 ELSE 0 END + CASE WHEN contains(path, '/') THEN 0 ELSE 5.0 END
    + CASE WHEN regexp_matches(lower(path), '{"|".join(documents.IMPORTANT_IN_BUNDLES)}') THEN 50.0 ELSE 0 END - CASE WHEN length(content) > 10000 THEN 10.0 ELSE 0 END AS score FROM site
), n AS (
  SELECT path, row_number() OVER (ORDER BY score DESC, path) AS rank, ceil(length('## ' || title || E'\n*Source: ' || path || E'*\n\n' || content || E'\n\n---\n\n') / 4)::INT AS et,
    ceil(length('- [' || title || '](' || path || E')\n') / 4)::INT AS rt FROM s
), b AS (
  SELECT 0::BIGINT AS rank, ''::VARCHAR AS path, NULL::VARCHAR AS kind, 0 AS tokens, {header} AS cum
  UNION ALL
  SELECT n.rank, n.path, CASE WHEN {fits} THEN 'full' WHEN {refers} THEN 'ref' END, CASE WHEN {fits} THEN n.et WHEN {refers} THEN n.rt ELSE 0 END,
    b.cum + CASE WHEN {fits} THEN n.et WHEN {refers} THEN n.rt ELSE 0 END
  FROM b JOIN n ON n.rank = b.rank + 1
)
SELECT {size}::INT AS size, rank::INT AS rank, path, kind, tokens::INT AS tokens, cum::INT AS cum_tokens FROM b WHERE kind IS NOT NULL"""


def _bundle(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return bundles.bundles(bundles.scores(derived.site(spark, sf_dir)), [size], header_tokens=12)


@query(_bundle_sql(2000, 12))
def bundle_2k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(spark, sf_dir, 2000)


@query(_bundle_sql(8000, 12))
def bundle_8k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundle(spark, sf_dir, 8000)


@query(
    "SELECT size, count(*) FILTER (kind = 'full') AS document_count, max(cum_tokens) AS actual_tokens, list_sort(list_distinct(list(CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'Root' END) FILTER (kind = 'full'))) AS sections, "
    f"(SELECT 1 + count(*) FROM region) + (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)) + (SELECT count(*) FROM supplier) AS total_documents FROM ({_bundle_sql(2000, 12)} UNION ALL SELECT * FROM ({_bundle_sql(4000, 12)})) GROUP BY size"
)
def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.site(spark, sf_dir)
    found = bundles.bundles(bundles.scores(docs), [2000, 4000], header_tokens=12)
    return bundles.summary(found, docs.agg(F.count("*").alias("total")))


# --- quality and security


def _hits_sql(rules: dict[str, str], corpus: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(f"SELECT path, content, '{k}' AS kind, unnest(regexp_extract_all(content, {quote(r)})) AS m FROM {corpus}" for k, r in rules.items())
    return f"SELECT path, kind, m FROM ({each}) WHERE NOT regexp_matches(m, {quote(text.EXAMPLE.replace(chr(92) + 'A', '^').replace(chr(92) + 'z', '$'))})"


SECRET_SQL = r"""leaky AS (SELECT source || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 97 = 0 THEN text || ' AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) WHEN doc_id % 89 = 0 THEN text || ' password = "' || md5(doc_id::VARCHAR) || '"' ELSE text END AS content FROM documents)"""


def _leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat documents; some have a made-up key or password added."""
    docs = derived.table(spark, sf_dir, "documents")
    mark = F.md5(F.col("doc_id").cast("string"))
    key = F.concat("text", F.lit(" AKIA"), F.upper(F.substring(mark, 1, 16)))
    word = F.concat("text", F.lit(' password = "'), mark, F.lit('"'))
    content = F.when(F.col("doc_id") % 97 == 0, key).when(F.col("doc_id") % 89 == 0, word).otherwise(F.col("text"))
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


@query(
    f"""WITH {SECRET_SQL} SELECT path AS document, kind, count(*) AS hits, min(CASE WHEN length(m) <= 8 THEN repeat('*', length(m)) ELSE left(m, 4) || repeat('*', length(m) - 8) || right(m, 4) END) AS snippet
FROM ({_hits_sql(quality.SECRETS, 'leaky')}) GROUP BY ALL"""
)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.secrets(_leaky(spark, sf_dir))
    return found.groupBy("document", F.col("detail")["kind"].alias("kind")).agg(F.count("*").alias("hits"), F.min(F.col("detail")["snippet"]).alias("snippet"))


@query(f"WITH {derived.FLAT_SQL} SELECT path AS document, kind, count(*) AS hits FROM ({_hits_sql(quality.PII, 'flat')}) GROUP BY ALL")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pii(derived.flat(spark, sf_dir)).groupBy("document", F.col("detail")["kind"].alias("kind")).agg(F.count("*").alias("hits"))


@query(
    rf"""WITH {derived.SITE_SQL}, lines AS (
  SELECT path, unnest(string_split(content, E'\n')) AS l, generate_subscripts(string_split(content, E'\n'), 1)::INT AS line FROM site
), f AS (
  SELECT *, regexp_matches(l, '^\s*```') AS f, sum(regexp_matches(l, '^\s*```')::INT) OVER (PARTITION BY path ORDER BY line) AS n FROM lines
)
SELECT 'unclosed_code_fence' AS type, 'error' AS severity, path AS document, max(line) FILTER (f) AS line, regexp_extract(max_by(l, line) FILTER (f), '^\s*```+(\w*)', 1) AS language FROM f GROUP BY path HAVING max(n) % 2 = 1
UNION ALL
SELECT 'unclosed_inline_code', 'warning', path, line, NULL FROM f WHERE n % 2 = 0 AND NOT contains(l, '```') AND len(regexp_extract_all(l, '`')) % 2 = 1"""
)
def fence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fences(derived.site(spark, sf_dir)).select("type", "severity", "document", "line", F.col("detail")["language"].alias("language"))


@query(
    f"WITH {derived.FLAT_SQL}, d AS (SELECT path, min(path) OVER (PARTITION BY content) AS first FROM flat) SELECT first, path AS document FROM d WHERE path <> first"
)
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_content(derived.flat(spark, sf_dir))


@query("SELECT lower(trim(split_part(p_name, ' ', 1))) AS title, list(p_partkey::VARCHAR ORDER BY p_partkey::VARCHAR) AS documents FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("title"))
    return quality.duplicate_titles(rows)


@query(
    rf"""WITH {derived.THREADS_SQL} SELECT trim(regexp_replace(lower(h), '^#+\s+', '')) AS heading, count(*) AS count FROM (SELECT unnest(regexp_extract_all(content, '(?m)^#{{1,6}}\s+.+$')) AS h FROM threads) GROUP BY 1 HAVING count(*) >= 5"""
)
def repeated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_headings(derived.threads(spark, sf_dir))


@query(
    f"""WITH {LINKS_SQL}, broken AS (SELECT count(*) AS n FROM q WHERE r NOT IN (SELECT path FROM site) AND r || '.md' NOT IN (SELECT path FROM site) AND r || '/index.md' NOT IN (SELECT path FROM site)),
lines AS (SELECT path, unnest(string_split(content, E'\\n')) AS l FROM site), fences AS (SELECT count(*) AS n FROM (SELECT path FROM lines GROUP BY path HAVING count(*) FILTER (starts_with(l, '```')) % 2 = 1)),
again AS (SELECT count(*) AS n FROM (SELECT lower(l) FROM lines WHERE regexp_matches(l, '^#{{1,6}}\\s+.+$') GROUP BY 1 HAVING count(*) >= 5))
SELECT fences.n AS errors, broken.n AS warnings, again.n AS infos, fences.n = 0 AS valid FROM fences, broken, again"""
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.issues(derived.site(spark, sf_dir)))


@query(
    f"""WITH {LINKS_SQL}, lines AS (SELECT path, unnest(string_split(content, E'\\n')) AS l FROM site), small AS (SELECT token_count AS t FROM ({_chunk_sql(1000, 1500)})),
n AS (
  SELECT 'high' AS priority, 'code_quality' AS category, 'unclosed_code_fence' AS issue, 1 AS least, (SELECT count(*) FROM (SELECT path FROM lines GROUP BY path HAVING count(*) FILTER (starts_with(l, '```')) % 2 = 1)) AS count
  UNION ALL SELECT 'medium', 'content_quality', 'broken_internal_link', 1, (SELECT count(*) FROM q WHERE r NOT IN (SELECT path FROM site) AND r || '.md' NOT IN (SELECT path FROM site) AND r || '/index.md' NOT IN (SELECT path FROM site))
  UNION ALL SELECT 'medium', 'chunk_quality', 'chunk_too_small', 6, (SELECT count(*) FROM small WHERE t < 50) UNION ALL SELECT 'medium', 'chunk_quality', 'chunk_too_large', 1, (SELECT count(*) FROM small WHERE t > 3000)
) SELECT priority, category, issue, count FROM n WHERE count >= least"""
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the site's issues and the threads' chunks."""
    return quality.recommendations(quality.issues(derived.site(spark, sf_dir), chunks.chunks(derived.threads(spark, sf_dir))))


@query(
    f"""WITH u AS (SELECT page_id, url, lower(url) AS l FROM pages)
SELECT page_id, url, regexp_matches(l, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') OR {" OR ".join(f"contains(l, '{s}')" for s in security.SUSPICIOUS)} AS suspicious FROM u"""
)
def url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "pages").select("page_id", "url", security.suspicious_url(F.col("url")).alias("suspicious"))


@query(
    rf"""WITH {derived.WEB_SQL}, u AS (
  SELECT path, count(*) FILTER ({" OR ".join(f"contains(lower(u), '{s}')" for s in security.SUSPICIOUS)} OR regexp_matches(u, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS n
  FROM (SELECT path, unnest(regexp_extract_all(content, '(?i)https?://[^\s<>"]+')) AS u FROM web) GROUP BY path
)
SELECT web.path, CASE WHEN regexp_matches(content, '(?is)<script[^>]*>.*?</script>|javascript:|vbscript:|data:text/html|on(?:load|error|click)\s*=') OR n > 0 THEN 'unsafe' ELSE 'safe' END AS verdict
FROM web LEFT JOIN u ON u.path = web.path"""
)
def security_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.audit(derived.web(spark, sf_dir)).select("path", "verdict")


@query(
    rf"""WITH {derived.WEB_SQL} SELECT count(*) AS total, count(*) FILTER (NOT s) AS safe, count(*) FILTER (s) AS unsafe, 0::BIGINT AS errors, floor(count(*) FILTER (NOT s) * 100 / count(*) + 0.5)::INT AS score
FROM (SELECT regexp_matches(content, '(?is)<script[^>]*>.*?</script>') AS s FROM web)"""
)
def security_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.audit_summary(security.audit(derived.web(spark, sf_dir)))


# --- navigation


@query(
    rf"""WITH {derived.SITE_SQL}, p AS (SELECT '/' || regexp_replace(path, '\.(md|mdx|html)$', '') AS u, lower(path) AS l FROM site)
SELECT 'https://docs.example.org' || CASE WHEN u LIKE '%/index' THEN substr(u, 1, instr(u, '/index')) || substr(u, instr(u, '/index') + 6) ELSE u END AS url,
  CASE WHEN regexp_matches(l, 'index|home') THEN 'weekly' WHEN regexp_matches(l, 'doc|tutorial|api|reference') THEN 'monthly' ELSE 'yearly' END AS changefreq,
  CASE WHEN regexp_matches(l, 'index|home') THEN '1.0' WHEN regexp_matches(l, 'doc|tutorial|getting-started') THEN '0.8' WHEN regexp_matches(l, 'api|reference') THEN '0.7' ELSE '0.5' END AS priority FROM p"""
)
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.sitemap(derived.site(spark, sf_dir), "https://docs.example.org/")


ROLLUP_SQL = rf"""{derived.SITE_SQL}, f AS (SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS dir, strlen(content) AS size FROM site)
SELECT dir AS path, CASE WHEN dir = '' THEN 0 ELSE 1 END AS depth, count(*) AS files, CASE WHEN dir = '' THEN (SELECT count(DISTINCT dir) FROM f WHERE dir <> '') ELSE 0 END AS subdirectories,
  count(*) AS markdown_files, sum(size)::BIGINT AS bytes FROM f GROUP BY dir"""


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.directory_rollup(derived.site(spark, sf_dir).select("path", F.octet_length("content").alias("size")))


@query(f"WITH {ROLLUP_SQL}")
def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir)


@query(
    f"SELECT count(*) AS directories, sum(files)::BIGINT AS files, sum(subdirectories)::BIGINT AS subdirectories, sum(markdown_files)::BIGINT AS markdown_files, sum(bytes)::BIGINT AS bytes FROM (WITH {ROLLUP_SQL})"
)
def master_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.master_totals(_rollup(spark, sf_dir))


@query(
    rf"""WITH {derived.SITE_SQL} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS parent, path, contains(path, '/')::INT AS depth,
  CASE WHEN contains(path, '/') THEN '  ' ELSE '' END || '- [' || regexp_replace(split_part(path, '/', -1), '\.(md|mdx|html)$', '') || '](' || path || ') (' || len(string_split(content, E'\n')) || ' lines)' AS line FROM site"""
)
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.toc(derived.site(spark, sf_dir))


# --- symbols


CODE_SQL = r"""code AS (
  SELECT 'src/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS file, CASE p_partkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' ELSE 'go' END AS extension, p_partkey AS k,
    CASE p_partkey % 3 WHEN 0 THEN E'import os\n\nSIZE = ' || p_size || E'\n\nclass P' || p_partkey || E':\n    def _f(self):\n        pass' WHEN 1 THEN E'export const f' || p_partkey || E' = (a) => a\ninterface I' || p_partkey || E' {}'
      ELSE E'import "fmt"\nfunc (p P) F' || p_partkey || E'() {}\ntype T' || p_partkey || ' struct {' END AS content FROM part)"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small source files in three languages, one per part."""
    k, s = F.col("p_partkey"), lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    pick = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    extension = pick(F.lit("py"), F.lit("ts"), F.lit("go"))
    content = pick(
        s("import os\n\nSIZE = ", F.col("p_size"), "\n\nclass P", k, ":\n    def _f(self):\n        pass"), s("export const f", k, " = (a) => a\ninterface I", k, " {}"),
        s('import "fmt"\nfunc (p P) F', k, "() {}\ntype T", k, " struct {"),
    )
    return derived.table(spark, sf_dir, "part").select(s("src/", k, ".", extension).alias("file"), extension.alias("extension"), content.alias("content"))


@query(
    rf"""WITH {CODE_SQL}
SELECT file, extension, s.line::INT AS line, s.kind AS kind, s.name AS name FROM (
  SELECT file, extension, unnest(CASE extension
    WHEN 'py' THEN [{{'line': 1, 'kind': 'import', 'name': 'import os'}}, {{'line': 3, 'kind': 'constant', 'name': 'SIZE'}}, {{'line': 5, 'kind': 'class', 'name': 'P' || k}}, {{'line': 6, 'kind': 'function', 'name': '_f'}}]
    WHEN 'ts' THEN [{{'line': 1, 'kind': 'export', 'name': 'f' || k}}, {{'line': 1, 'kind': 'function', 'name': 'f' || k}}, {{'line': 2, 'kind': 'interface', 'name': 'I' || k}}]
    ELSE [{{'line': 1, 'kind': 'import', 'name': 'import "fmt"'}}, {{'line': 2, 'kind': 'function', 'name': 'F' || k}}, {{'line': 3, 'kind': 'type', 'name': 'T' || k}}] END) AS s FROM code)"""
)
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbols(_code(spark, sf_dir)).select("file", "extension", "line", "kind", "name")


@query(
    f"""WITH {CODE_SQL}, t AS (SELECT extension, count(*) AS files, sum(len(string_split(content, E'\\n')))::BIGINT AS lines, sum(CASE extension WHEN 'py' THEN 4 ELSE 3 END)::BIGINT AS symbols FROM code GROUP BY ROLLUP (extension)) SELECT * FROM t"""
)
def code_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    return symbols.totals(code, symbols.symbols(code))


# --- pattern configuration


PATTERNS = patterns.PatternSet({
    "**/*.md": {"chunkProfile": "default", "tags": ["doc"]}, "nation/**": {"chunkProfile": "granular", "tags": ["place"], "priority": 1}, "nation/1*.md": {"priority": 5, "optional": True},
    "supplier/*.md": {"chunkProfile": "faq", "tags": ["place", "firm"]},
})


@query(
    rf"""WITH {derived.SITE_SQL} SELECT path, CASE WHEN path LIKE 'supplier/%' THEN 'faq' WHEN path LIKE 'nation/%' THEN 'granular' ELSE 'default' END AS chunk_profile,
  CASE WHEN path LIKE 'nation/1%' THEN 5 WHEN path LIKE 'nation/%' THEN 1 END AS priority, CASE WHEN path LIKE 'nation/1%' THEN true END AS optional,
  CASE WHEN path LIKE 'supplier/%' THEN ['doc', 'place', 'firm'] WHEN path LIKE 'nation/%' THEN ['doc', 'place'] ELSE ['doc'] END AS tags FROM site"""
)
def pattern_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = PATTERNS.apply(derived.site(spark, sf_dir))
    return out.select("path", F.col("cfg_chunkProfile").alias("chunk_profile"), F.col("cfg_priority").alias("priority"), F.col("cfg_optional").alias("optional"), F.col("cfg_tags").alias("tags"))


# --- retrieval


@query(
    rf"""WITH {derived.SITE_SQL}, i AS (SELECT path, 'Supplier ' || regexp_extract(path, '([0-9]+)\.md$', 1) AS t, path LIKE 'supplier/%' AS s FROM site)
SELECT path, regexp_extract(path, '([0-9]+)\.md$', 1) AS title, 'supplier' AS section, 5 + CASE WHEN contains(lower(regexp_extract(path, '([0-9]+)\.md$', 1)), 'supplier') THEN 10 ELSE 0 END AS score
FROM i WHERE s ORDER BY score DESC, path LIMIT 5"""
)
def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_docs(retrieval.doc_index(derived.site(spark, sf_dir)), "supplier")


RETRIEVE_SQL = r"""
SELECT path, (len(string_split(lower(content), 'the')) - 1 + len(string_split(lower(content), 'tion')) - 1)::DOUBLE AS score FROM flat WHERE score > 0 ORDER BY score DESC, path LIMIT 4"""


@query(f"WITH {derived.FLAT_SQL} {RETRIEVE_SQL}")
def retrieve_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.relevant_documents(derived.flat(spark, sf_dir), "the tion")


@query(
    rf"""WITH RECURSIVE {RANKS_SQL}, c AS (SELECT site.path, importance, len(string_split(lower(content), 'nation')) - 1 AS n FROM site JOIN importance ON importance.path = site.path)
SELECT path, (n * (1 + importance))::DOUBLE AS score FROM c WHERE n * (1 + importance) > 0 ORDER BY score DESC, path LIMIT 4"""
)
def retrieve_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, edges = site_edges(spark, sf_dir)
    return retrieval.relevant_documents(docs, "nation", importance=graph.importance(graph.ranks(docs, edges)))


@query(
    f"""SELECT source_path, chunk_index, token_count, (len(string_split(lower(content), 'the')) - 1)::DOUBLE AS score FROM ({_chunk_sql(1000, 1500).replace("md5(content) AS content_md5", "content")}) WHERE score > 0 ORDER BY score DESC, source_path, chunk_index LIMIT 20"""
)
def index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.chunks(derived.threads(spark, sf_dir))
    score = retrieval.occurrences(F.col("content"), "the").cast("double").alias("score")
    return found.select("source_path", "chunk_index", "token_count", score).where("score > 0").orderBy(F.desc("score"), "source_path", "chunk_index").limit(20)


@query(
    f"WITH {derived.FLAT_SQL} SELECT split_part(path, '/', 1) AS prefix, 1 AS depth, count(*) AS documents, list(path ORDER BY path) AS paths FROM flat GROUP BY 1"
)
def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hierarchy(derived.flat(spark, sf_dir))


# --- changes


NEXT_SQL = r"""
SELECT path, CASE WHEN b.path IS NULL THEN 'deleted' WHEN a.path IS NULL THEN 'added' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS change FROM (
  SELECT source || '/' || doc_id || '.md' AS path, sha256(text) AS h FROM documents WHERE doc_id IS NULL OR doc_id % 13 <> 0 OR doc_id % 11 = 0) a
FULL JOIN (SELECT source || '/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END) AS h FROM documents WHERE doc_id IS NULL OR doc_id % 11 <> 0) b USING (path)"""


@query(NEXT_SQL)
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of the corpus against a later one: some documents edited, dropped and new; each is in one of them at least."""
    docs = derived.table(spark, sf_dir, "documents").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    before = docs.where("doc_id is null or doc_id % 13 <> 0 or doc_id % 11 = 0").select("path", F.col("text").alias("content"))
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    after = docs.where("doc_id is null or doc_id % 11 <> 0").select("path", edited.alias("content"))
    return incremental.changes(incremental.snapshot(before), incremental.snapshot(after)).select("path", "change")


@query(
    r"""WITH d AS (SELECT user_id, ts, event_type, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM d)
SELECT user_id::VARCHAR AS watch_root, count(*) AS events, count(DISTINCT event_type) AS paths, min(ts) AS first_at FROM s GROUP BY user_id, n"""
)
def debounced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("watch_root"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.lit("changed").alias("event"))
    found = watch.debounced(events, "6 hours")
    return found.select("watch_root", "events", F.size("last").cast("bigint").alias("paths"), F.col("first_at").cast("timestamp_ntz").alias("first_at"))


@query(
    r"""WITH v AS (SELECT user_id::VARCHAR AS path, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT path, count(*) AS versions FROM v WHERE r <= 50 GROUP BY path"""
)
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_id").alias("version"))
    return incremental.last_versions(rows, ["ts", "version"]).groupBy("path").agg(F.count("*").alias("versions"))
