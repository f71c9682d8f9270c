"""The registered queries of the training-data operators, and SQL where it can express them."""

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import (
    bit_search, curves, fingerprints, jaccard, language, licenses, line_dedup, mixing, packing, personal_data, secret_scan,
    va_clusters, warc,
)
from memlake.sources.scratch import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, which is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark, sf_dir):
    """License notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_jaccard(spark, sf_dir):
    """Near-duplicate classes of all documents and how many links each has."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark, sf_dir):
    """Personal data in every document: fixed patterns and what the tagger adds."""
    docs = _table(spark, sf_dir, "documents")
    return personal_data.scan(docs, personal_data.fit(personal_data.training_texts(docs)))


def op4_language(spark, sf_dir):
    """The language of every document, learned from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(language.sample(docs))
    asked = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text", language.held_out().alias("held_out"))
    return language.identify(asked, model).drop("text").select("doc_id", "held_out", "lang_pred", "score")


def op8_fingerprints(spark, sf_dir):
    """Chunk fingerprints of every document and of its edited text."""
    return fingerprints.with_edits(_table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_line_dedup(spark, sf_dir):
    """The class of every line of all documents, its links, and whether it stays."""
    return line_dedup.classes(_table(spark, sf_dir, "documents"))


def op7_secrets(spark, sf_dir):
    """Secrets in every document: fixed patterns and badly tokenised random strings."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op9_mixing(spark, sf_dir):
    """All documents mixed to weights 1, 2, 3 over the sources; words taken of each."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot", "blocks")


def op10_curves(spark, sf_dir):
    """The 20 nearest of every twentieth vector among all others, by inner product."""
    return curves.nearest(_table(spark, sf_dir, "embeddings"))


def op11_centroids(spark, sf_dir):
    """All vectors in 16 clusters after three rounds, with distances and final centroids."""
    return va_clusters.with_totals(_table(spark, sf_dir, "embeddings"))


def op12_lexical(spark, sf_dir):
    """The 20 documents that score best for each benchmark item."""
    return bit_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_warc(spark, sf_dir):
    """All pages written as WARC archives and read back."""
    return warc.archived(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def queries() -> dict:
    return {
        "op1_licenses": op1_licenses,
        "op2_jaccard": op2_jaccard,
        "op3_personal_data": op3_personal_data,
        "op4_language": op4_language,
        "op5_packing": op5_packing,
        "op6_line_dedup": op6_line_dedup,
        "op7_secrets": op7_secrets,
        "op8_fingerprints": op8_fingerprints,
        "op9_mixing": op9_mixing,
        "op10_curves": op10_curves,
        "op11_centroids": op11_centroids,
        "op12_lexical": op12_lexical,
        "op13_warc": op13_warc,
    }


OP9 = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(cast(doc_id AS varchar), '') || ':mix') AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no
      FROM d GROUP BY source),
w AS (SELECT *, ((no - 1) % 3 + 1)::DOUBLE AS weight, 3 * source_size AS top FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, no
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / sum(weight) OVER (ORDER BY top / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM w),
t AS (SELECT *, least(top::DOUBLE, max(lev) OVER () * weight) AS target FROM l),
p AS MATERIALIZED (SELECT d.*, t.no, t.source_size, t.target, round(t.target)::BIGINT AS goal, row_number() OVER () AS id,
             (sum(size) OVER (PARTITION BY t.no ORDER BY place, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT no, round(target)::BIGINT AS goal, target / sum(target) OVER () AS share FROM t),
h AS MATERIALIZED (SELECT *, sum(share) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM g),
c AS MATERIALIZED (SELECT no, goal, coalesce(lag(hi) OVER (ORDER BY no), 0) AS lo, hi FROM h),
k AS (SELECT ceil(sum(goal) / 512)::BIGINT AS slots FROM c),
drawn AS MATERIALIZED (SELECT slot, no, goal, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS block_no
  FROM (SELECT unnest(range((SELECT slots FROM k))) AS slot) JOIN c
    ON (slot * 0.6180339887498949::DOUBLE) % 1 >= lo AND (slot * 0.6180339887498949::DOUBLE) % 1 < hi),
slots AS MATERIALIZED (SELECT slot, no, block_no FROM drawn WHERE block_no * 512 < goal
  UNION ALL SELECT (SELECT slots FROM k) + block_no, no, block_no FROM (
    SELECT c.no, unnest(range((SELECT count(*) FROM drawn r WHERE r.no = c.no), ceil(c.goal / 512)::BIGINT)) AS block_no FROM c)),
turns AS (SELECT id, no, size, goal, start + turn * source_size AS lies FROM p, (VALUES (0), (1), (2)) x(turn) WHERE size > 0),
cuts AS (SELECT id, no, lies, least(lies + size, goal) AS ends,
    unnest(range(lies // 512, (least(lies + size, goal) - 1) // 512 + 1)) AS block_no FROM turns WHERE lies < goal),
taken AS (SELECT id, sum(least(ends, (block_no + 1) * 512) - greatest(lies, block_no * 512))::BIGINT AS taken,
    min(slot)::BIGINT AS first_slot, max(slot)::BIGINT AS last_slot, count(*) AS blocks
  FROM cuts JOIN slots USING (no, block_no) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, last_slot, coalesce(blocks, 0) AS blocks
FROM p LEFT JOIN taken USING (id)
"""

_APART = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _round(n: int) -> str:
    """Assignment of all vectors to the centroids c<n>, and the centroids after it."""
    return f"""
a{n} AS MATERIALIZED (SELECT k.id, k.v, c.no, {_APART} AS distance FROM kept k CROSS JOIN c{n} c
  QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY distance, c.no) = 1),
m{n} AS (SELECT no, d, sum(x) AS s, count(*) AS n
  FROM (SELECT no, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{n}) GROUP BY no, d),
c{n + 1} AS MATERIALIZED (SELECT c.no, coalesce(f.v, c.v) AS v FROM c{n} c LEFT JOIN (
  SELECT no, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY d) AS v FROM m{n} GROUP BY no) f USING (no))"""


OP11 = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, v FROM (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), v) - 1 AS no, v
  FROM kept WHERE vec_id IS NOT NULL QUALIFY no < 16),
{",".join(_round(n) for n in range(3))},
last AS (SELECT k.vec_id, c.no, c.v, {_APART} AS distance FROM kept k CROSS JOIN c3 c
  QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY distance, c.no) = 1)
SELECT vec_id, no::INT AS cluster, distance, sum(distance) OVER (PARTITION BY no)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM last
"""


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP12 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS t FROM documents),
w AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
i AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
q AS MATERIALIZED (SELECT item_id, term, times, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM i JOIN (SELECT term, count(*) AS df FROM w GROUP BY term) USING (term), s),
m AS (SELECT id, doc_id, 75 + (25 * len(t)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE doc_id IS NOT NULL),
x AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN m USING (id) GROUP BY item_id, id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20
"""


OP13 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN kept END AS refers_to
FROM (SELECT *, payload_bytes >= 1000 AND kept IS NOT NULL AND page_id IS DISTINCT FROM kept AS again FROM k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9, "op11_centroids": OP11, "op12_lexical": OP12, "op13_warc": OP13}
