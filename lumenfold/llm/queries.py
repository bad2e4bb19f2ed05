"""The queries opN_<name>: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REACH = """links2 AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links),
reach AS (SELECT x, y FROM links2 UNION SELECT r.x, l.y FROM reach r JOIN links2 l ON l.x = r.y)"""

OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, ws[p] || ' ' || ws[p + 1] AS s FROM w, LATERAL (SELECT unnest(range(1, len(w.ws))) AS p) UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""

OP4_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS k FROM w, LATERAL (SELECT unnest(range(1, greatest(1, len(w.ws) - 48))) AS p)
), first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p + j AS i FROM win JOIN first USING (k), range(0, 50) t(j) WHERE doc_id > m),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS t FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9),
{_REACH}
SELECT d.vec_id, (SELECT count(*) FROM links2 l WHERE l.x = d.vec_id) AS n_links, least(d.vec_id, coalesce(min(r.y), d.vec_id)) AS component_id, d.vec_id = least(d.vec_id, coalesce(min(r.y), d.vec_id)) AS kept
FROM embeddings d LEFT JOIN reach r ON r.x = d.vec_id GROUP BY d.vec_id
"""


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents`` on 2-word shingles at similarity 0.8."""
    from lumenfold.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of 4096 tokens."""
    import public_tokenizers

    from lumenfold.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op3_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token ids in sorted-string-table shards, read back."""
    import public_tokenizers

    from lumenfold.llm.sstable import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257, end_id=0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of ``documents`` without 50-word windows of earlier ones."""
    from lumenfold.llm.substring import digest

    return digest(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    from lumenfold.llm.language import held_out, identify, learn

    docs = _table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), learn(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every row of ``embeddings`` for each 50th."""
    from lumenfold.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among ``embeddings`` at cosine 0.9."""
    from lumenfold.llm.embedding import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


#: The rules of op6: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

OP6_SQL = """
WITH parsed AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages
), parts AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parsed
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fit AS (
  SELECT rid, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) f USING (rid)
"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow and block rules over the urls of ``pages``."""
    from lumenfold.llm.urlfilter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every row of ``documents``."""
    from lumenfold.llm.mixing import mix_sources

    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``."""
    from lumenfold.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


def oracle_sql() -> dict:
    return {"op1_minhash_near_dedup": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op10_embedding_near_dedup": OP10_SQL, "op5_top_k": OP5_SQL, "op6_url_filter": OP6_SQL}
