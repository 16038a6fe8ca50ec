"""The operators of this subpackage as queries ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import covertree, extraction, kmeanstree, langid, mixing, ngram_join, packing, substring, tokencount, warc
from corpusmill.session import drop_cut, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 20, against all rows; as those of ``op8``."""
    return covertree.top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as three captures in an archive; the index of the deduplicated archive."""
    folder = scratch(spark, "warc")
    records = warc.captures(table(spark, sf_dir, "pages"))
    drop_cut(warc.write(records, f"{folder}/crawl", dictionary=warc.train(records)))
    return warc.deduplicate(spark, f"{folder}/crawl", f"{folder}/deduplicated").drop("file", "offset", "length")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


def op8_approximate_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeanstree.neighbors(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_top_k,
        op2_language_id,
        op3_ngram_jaccard_join,
        op4_token_counts,
        op5_best_fit_packing,
        op6_warc_revisits,
        op7_html_extraction,
        op8_approximate_neighbors,
        op9_substring_dedup,
        op10_mixing,
    )
    return {f.__name__: f for f in found}


SQL_REPEATED_SPANS = """
WITH words AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id, text ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY doc_id, text) AS n, text
  FROM (
    SELECT doc_id, text, unnest(ws) AS word, generate_subscripts(ws, 1) AS idx
    FROM (SELECT DISTINCT doc_id, text, string_split_regex(text, '[ \\t\\n\\v\\f\\r]+') AS ws FROM documents WHERE text IS NOT NULL)
  ) WHERE word <> ''
), windows AS (
  SELECT doc_id, text, pos, n, md5(array_to_string(list(word) OVER (PARTITION BY doc_id, text ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING), ' ')) AS h
  FROM words
), ranked AS (
  SELECT doc_id, text, pos, count(*) OVER (PARTITION BY h) AS times, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) = 1 AS original
  FROM windows WHERE pos + 50 <= n
), starts AS (
  SELECT doc_id, text, pos, original,
    CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id, text, original ORDER BY pos) + 50 THEN 1 ELSE 0 END AS new
  FROM ranked WHERE times > 1
), runs AS (
  SELECT doc_id, text, pos, original, sum(new) OVER (PARTITION BY doc_id, text, original ORDER BY pos) AS run FROM starts
)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, original FROM runs GROUP BY doc_id, text, original, run
"""


SQL_CLASSES = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END)) AS gs FROM d
), k AS (
  SELECT doc_id, gs, CASE WHEN len(gs) > 0 THEN md5(array_to_string(gs, '|')) END AS node FROM s
), n AS (
  SELECT node, any_value(gs) AS gs, count(*) AS same, min(doc_id) AS rep FROM k WHERE node IS NOT NULL GROUP BY node
), e AS (
  SELECT node, len(gs) AS size, unnest(gs) AS g FROM n
), p AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.4
), reach AS (
  SELECT node AS a, node AS b FROM n UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a
), c AS (
  SELECT r.a AS node, min(n.rep) AS class_id FROM reach r JOIN n ON r.b = n.node GROUP BY r.a
), l AS (
  SELECT p.a AS node, sum(n.same) AS links FROM p JOIN n ON p.b = n.node GROUP BY p.a
)
SELECT k.doc_id, coalesce(c.class_id, k.doc_id) AS class_id, (coalesce(n.same - 1, 0) + coalesce(l.links, 0))::BIGINT AS links
FROM k LEFT JOIN n USING (node) LEFT JOIN c USING (node) LEFT JOIN l USING (node)
"""

SQL_TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), d AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, min(list_distance(a.e, b.e)) AS d
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id, b.vec_id
), r AS (
  SELECT query_id, neighbor_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id)::INT AS rank FROM d
)
SELECT query_id, neighbor_id, rank, round(d, 5) AS distance FROM r WHERE rank <= 10
"""

SQL_REVISITS = """
WITH p AS (
  SELECT DISTINCT page_id, url, html, 'sha1:' || sha1(html) AS digest FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), v AS (
  SELECT *, unnest(range(0, 3)) AS visit FROM p
), m AS (
  SELECT *, md5(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), url, digest, visit)) AS u FROM v
), r AS (
  SELECT url, html, digest, CASE WHEN visit = 1 THEN 'revisit' ELSE 'response' END AS old_type, '2024-01-0' || (visit + 1) || 'T00:00:00Z' AS date,
    '<urn:uuid:' || concat_ws('-', u[1:8], u[9:12], u[13:16], u[17:20], u[21:32]) || '>' AS record_id FROM m
), o AS (
  SELECT *, row_number() OVER (PARTITION BY digest ORDER BY date, record_id) = 1 AS original FROM r WHERE old_type = 'response'
)
SELECT r.record_id, r.old_type, CASE WHEN r.record_id = o.record_id THEN 'response' ELSE 'revisit' END AS warc_type, r.url AS target_uri, r.date, r.digest,
  CASE WHEN r.record_id <> o.record_id THEN o.record_id END AS refers_to,
  CASE WHEN r.record_id <> o.record_id THEN o.url END AS refers_to_uri,
  CASE WHEN r.record_id <> o.record_id THEN o.date END AS refers_to_date,
  CASE WHEN r.record_id = o.record_id THEN strlen(r.html) ELSE 0 END AS payload_bytes, true AS resolved
FROM r JOIN o ON r.digest = o.digest AND o.original
"""

#: Byte-level BPE: pre-tokens by a pattern without look-ahead (the last white space before a word is parted
#: by a private character first), then the pair of the lowest rank is merged until none is left.
TOKENS = r"""
vocab AS MATERIALIZED (
  SELECT hex(from_base64(split_part(line, ' ', 1))) AS tok, split_part(line, ' ', 2)::INT AS rank
  FROM read_csv('VOCABULARY_PATH', columns = {'line': 'VARCHAR'}, delim = '\t', header = false, quote = '', escape = '', auto_detect = false)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text FROM documents
), cut AS (
  SELECT r, regexp_replace(text, '([\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}])([\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}][^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}])', '\1' || chr(57344) || '\2', 'g') AS t FROM d WHERE text <> ''
), pt AS (
  SELECT r, unnest(regexp_extract_all(t, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}\p{L}\p{N}\x{E000}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+')) AS tok FROM cut
), own AS (
  SELECT r, hex(encode(tok)) AS tok, count(*) AS times FROM pt GROUP BY r, tok
), step AS (
  SELECT tok, CASE WHEN tok IN (SELECT tok FROM vocab) THEN [tok] ELSE [tok[2 * i + 1:2 * i + 2] for i in range(len(tok) // 2)] END AS pieces FROM (SELECT DISTINCT tok FROM own)
  UNION ALL
  SELECT s.tok, list_concat(list_append(any_value(pieces)[1:arg_min(i, (rank, i)) - 1], any_value(pieces)[arg_min(i, (rank, i))] || any_value(pieces)[arg_min(i, (rank, i)) + 1]), any_value(pieces)[arg_min(i, (rank, i)) + 2:])
  FROM (SELECT tok, pieces, unnest(range(1, len(pieces))) AS i FROM step WHERE len(pieces) > 1) s JOIN vocab v ON v.tok = s.pieces[i] || s.pieces[i + 1]
  GROUP BY s.tok
), n AS (
  SELECT tok, min(len(pieces)) AS n FROM step GROUP BY tok
), tokens AS (
  SELECT d.r, d.doc_id, d.source, d.text, coalesce(sum(o.times * n.n), 0)::BIGINT AS n_tokens FROM d LEFT JOIN own o ON o.r = d.r LEFT JOIN n ON n.tok = o.tok GROUP BY ALL
)
""".replace("VOCABULARY_PATH", tokencount.VOCABULARY)

SQL_LANGUAGE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, ltrim(regexp_replace(lower(text), '[^a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), ' ') AS t FROM documents
), letters AS (
  SELECT r, unnest(string_split(t, '')) AS x, generate_subscripts(string_split(t, ''), 1) AS i FROM d WHERE t <> ''
), after AS (
  SELECT r, x, lead(x) OVER w AS y, lead(x, 2) OVER w AS z FROM letters WINDOW w AS (PARTITION BY r ORDER BY i)
), cut AS (
  SELECT r, x || y AS g FROM after WHERE y IS NOT NULL UNION ALL SELECT r, x || y || z FROM after WHERE z IS NOT NULL
), times AS (
  SELECT r, g, count(*) AS n FROM cut GROUP BY ALL
), places AS (
  SELECT g, i, g[i] AS ch FROM (SELECT g, unnest(range(1, length(g) + 1)) AS i FROM (SELECT DISTINCT g FROM times))
), chars AS (
  SELECT ch, (SELECT sum(('0x' || x[2 * k + 1:2 * k + 2])::BIGINT << (8 * k)) FROM range(len(x) // 2) AS b(k))::BIGINT AS code
  FROM (SELECT DISTINCT ch, hex(encode(ch)) AS x FROM places)
), codes AS (
  SELECT g, list(code ORDER BY i) AS c FROM places JOIN chars USING (ch) GROUP BY g
), s1 AS (SELECT g, c, (xor((2166136261 * len(c)) & 4294967295, c[1]) * 16777619) & 4294967295 AS h FROM codes
), s2 AS (SELECT g, c, (xor(xor(h, h >> 15), c[2]) * 16777619) & 4294967295 AS h FROM s1
), s3 AS (SELECT g, CASE WHEN len(c) = 2 THEN h ELSE (xor(xor(h, h >> 15), c[3]) * 16777619) & 4294967295 END AS h FROM s2
), s4 AS (SELECT g, ((xor(h, h >> 15)::HUGEINT * 2221713035) % 4294967296)::BIGINT AS f FROM s3
), grams AS (
  SELECT r, xor(f, f >> 16) % 65536 AS b, sum(n)::BIGINT AS n FROM times JOIN s4 USING (g) GROUP BY ALL
), train AS (
  SELECT r, lang FROM d WHERE lang IS NOT NULL AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))[1:12], doc_id) <= 2000
), seen AS (
  SELECT lang, b, sum(n)::BIGINT AS n FROM train JOIN grams USING (r) GROUP BY ALL
), total AS (
  SELECT lang, sum(n)::BIGINT AS n FROM seen GROUP BY lang
), class AS (
  SELECT lang, row_number() OVER (ORDER BY lang) AS c, CAST(ln(0.1) - ln(n + 0.1 * 65536) AS FLOAT)::DOUBLE AS none, n FROM total
), gain AS (
  SELECT lang, b, CAST(ln(s.n + 0.1) - ln(k.n + 0.1 * 65536) AS FLOAT)::DOUBLE - k.none AS v FROM seen s JOIN class k USING (lang)
), size AS (
  SELECT r, sum(n)::BIGINT AS n FROM grams GROUP BY r
), gained AS (
  SELECT g.r, v.lang, sum(g.n * v.v) AS v FROM grams g JOIN gain v USING (b) GROUP BY ALL
), score AS (
  SELECT z.r, k.lang, k.c, z.n * k.none + coalesce(s.v, 0) AS v FROM size z CROSS JOIN class k LEFT JOIN gained s ON s.r = z.r AND s.lang = k.lang
  UNION ALL SELECT r, 'und', 1000000, n * CAST(-ln(65536) AS FLOAT)::DOUBLE FROM size
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) AS place, v - lead(v) OVER (PARTITION BY r ORDER BY v DESC, c) AS ahead FROM score
)
SELECT d.doc_id, best.lang AS predicted, round(best.ahead / size.n, 4) AS margin, coalesce(best.lang <> 'und', false) AS accepted
FROM d LEFT JOIN best ON best.r = d.r AND best.place = 1 LEFT JOIN size ON size.r = d.r
"""

SQL_TOKEN_COUNTS = f"""
WITH RECURSIVE {TOKENS}
SELECT doc_id, n_tokens FROM (SELECT DISTINCT doc_id, text, n_tokens FROM tokens)
"""

SQL_PACKING = f"""
WITH RECURSIVE {TOKENS}, items AS (
  SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, n, r, start) AS k, doc_id, start, least(2048, n - start) AS size FROM (
    SELECT ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:12])::BIGINT % (SELECT greatest(1, ceil(sum(n_tokens) / 8388608)::BIGINT) FROM tokens) AS shard,
      doc_id, n_tokens AS n, r, unnest(range(0, n_tokens, 2048)) AS start FROM tokens WHERE n_tokens > 0
  )
), pack AS (
  SELECT DISTINCT shard, 0::BIGINT AS k, []::STRUCT(f BIGINT, s BIGINT, b BIGINT)[] AS open, 0::BIGINT AS bins, 0::BIGINT AS bin, 0::BIGINT AS at FROM items
  UNION ALL
  SELECT shard, k, CASE WHEN free > size THEN list_append([x for x in open if x.b <> gone], {{'f': free - size, 's': -k, 'b': bin}}) ELSE [x for x in open if x.b <> gone] END,
    bins, bin, 2048 - free
  FROM (
    SELECT shard, k, size, open, CASE WHEN fit IS NULL THEN bins + 1 ELSE bins END AS bins, coalesce(fit.b, bins) AS bin, coalesce(fit.f, 2048) AS free,
      coalesce(fit.b, CASE WHEN len(open) = 64 THEN list_sort(open)[1].b ELSE -1 END) AS gone
    FROM (SELECT i.shard, i.k, i.size, p.open, p.bins, list_sort([x for x in p.open if x.f >= i.size])[1] AS fit FROM pack p JOIN items i ON i.shard = p.shard AND i.k = p.k + 1)
  )
)
SELECT i.shard::INT AS shard, p.bin, p.at AS "offset", i.doc_id, i.start, i.size AS n_tokens FROM pack p JOIN items i ON i.shard = p.shard AND i.k = p.k
"""

SQL_POSITIONS = f"""
WITH RECURSIVE {TOKENS}, dh AS (
  SELECT doc_id, source, n_tokens, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM tokens
), c AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS c0
  FROM dh WHERE n_tokens > 0
), s AS (
  SELECT source, sum(n_tokens)::DOUBLE AS supply, sum(sum(n_tokens)) OVER ()::DOUBLE AS total FROM c GROUP BY source
), w AS (
  SELECT source, supply, total, supply / total AS a, sqrt(supply / total) / sum(sqrt(supply / total)) OVER () AS b FROM s
), e AS (
  SELECT c.*, w.supply, w.total, w.a, w.b, unnest(range(0, ceil(total * (a + b) / 2 / supply)::BIGINT + 1)) AS epoch
  FROM c JOIN w ON c.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, source, epoch::INT AS epoch, n_tokens::BIGINT AS n_tokens,
  round(2 * ((c0 + epoch * supply) / total) / (a + sqrt(a * a + 2 * (b - a) * ((c0 + epoch * supply) / total))), 9) AS position
FROM e WHERE c0 + epoch * supply < total * (a + b) / 2
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": SQL_TOP_K, "op2_language_id": SQL_LANGUAGE, "op3_ngram_jaccard_join": SQL_CLASSES, "op4_token_counts": SQL_TOKEN_COUNTS, "op5_best_fit_packing": SQL_PACKING, "op10_mixing": SQL_POSITIONS, "op6_warc_revisits": SQL_REVISITS, "op9_substring_dedup": SQL_REPEATED_SPANS}
