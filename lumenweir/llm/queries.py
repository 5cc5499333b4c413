"""The registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import decontamination, hyperminhash, language, language_model, line_dedup, packing, prefix_hash, quality, sharding, simhash, spelling, toxicity, whitening


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    held = F.coalesce(c.crc32_mod("doc_id", 4) == 2, F.lit(False))
    model = quality.fit(docs.where(~held), c.labels(spark, sf_dir))
    scored = quality.score(c.pick(docs, "doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(c.documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(c.documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    held = F.coalesce(c.crc32_mod("doc_id", 3) == 1, F.lit(False))
    model = language.fit(docs.where(~held))
    return language.predict(c.pick(docs, "doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_model.scores(c.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean", 6).alias("mean"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edit_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    held = F.coalesce(c.crc32_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs.where(~held), c.labels(spark, sf_dir))
    scored = toxicity.score(c.pick(docs, "doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.pick(c.documents(spark, sf_dir), "doc_id", "text")
    return decontamination.digest(decontamination.scan(docs, c.benchmark(spark, sf_dir)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(c.pick(c.documents(spark, sf_dir), "doc_id", "text"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(c.documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it exceeds a long (some three million vectors of 64 entries); the operator's own is a decimal."""
    found = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(c.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: v for k, v in globals().items() if k.startswith("op")} | {"pipeline": corpus_pipeline.run}


#: Words as in decontamination.words; RE2 reads the class as the contract gives it.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 byte by byte, over a table made from its polynomial.
_OP7 = """
WITH t AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, t),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS place FROM d),
s AS (SELECT *, least(((2 * upto - size) * 8 // (2 * total)), 7)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s
"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


_OP5 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT c AS x, count(*) AS n FROM t GROUP BY c),
p AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
q AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
total AS (SELECT count(*) AS n FROM t),
s AS (SELECT doc_id, CASE WHEN q.n >= 2 THEN ln(q.n / ab.n) WHEN bc.n >= 2 THEN ln(bc.n / ub.n) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END ELSE least(i - 1, 2) * ln(0.4) + ln(uc.n / total.n) END AS s
      FROM t CROSS JOIN total JOIN u uc ON uc.x = t.c LEFT JOIN u ub ON ub.x = t.b LEFT JOIN p bc ON bc.b = t.b AND bc.c = t.c LEFT JOIN p ab ON ab.b = t.a AND ab.c = t.b LEFT JOIN q ON q.a = t.a AND q.b = t.b AND q.c = t.c)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(sum(s), 0), 4) AS score, round(sum(s) / len(w), 6) AS mean
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, w
"""


#: Candidates share one of their rarest shingles, as many as a measure of 0.85 leaves room for.
_OP11 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
k AS (SELECT r, n, dense_rank() OVER (ORDER BY sg) AS c FROM (SELECT r, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS sg FROM s GROUP BY r)),
one AS (SELECT c, min(r) AS r, min(n) AS n FROM k GROUP BY c),
rare AS (SELECT s.r, s.g, one.c, one.n, row_number() OVER (PARTITION BY s.r ORDER BY f.f, s.g) AS place FROM s JOIN one USING (r) JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) f USING (g)),
pre AS (SELECT * FROM rare WHERE place <= n - ceil(0.85 * n) + 1),
may AS (SELECT DISTINCT p.c AS a, q.c AS b, p.r AS ra, q.r AS rb, p.n AS na, q.n AS nb FROM pre p JOIN pre q USING (g) WHERE p.c < q.c AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)),
l AS (SELECT a, b FROM may JOIN s p ON p.r = ra JOIN s q ON q.r = rb AND q.g = p.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 85 * (na + nb - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT c AS a, c AS b FROM one UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
m AS (SELECT reach.a AS c, min(doc_id) AS component_id FROM reach JOIN k ON k.c = reach.b JOIN d USING (r) GROUP BY reach.a)
SELECT doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, CASE WHEN k.n IS NULL THEN doc_id ELSE component_id END AS component_id, coalesce(CASE WHEN k.n IS NULL THEN true ELSE doc_id = component_id END, doc_id IS NULL AND component_id IS NULL) AS kept
FROM d LEFT JOIN k USING (r) LEFT JOIN m USING (c)
"""

_OP13 = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
a AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
b AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, count(*) AS c FROM a GROUP BY ALL),
h AS (SELECT run, c, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(named)), '..'), lambda x: ('0x' || x)::BIGINT), lambda s, x: xor(s >> 8, tb[(xor(s, x) & 255) + 1])), 4294967295) AS h FROM b, t),
w AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) GROUP BY word HAVING sum(c) >= 5 AND length(word) >= 6),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS x, substr(word, i + 1) AS y FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT p.word, q.word AS other, q.n FROM k p JOIN k q ON p.i = q.i AND p.x = q.x AND p.y = q.y AND p.word <> q.word
      UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.x || k.y UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.x || k.y),
f AS (SELECT word, w.n, coalesce(m, 0)::BIGINT AS n_near, CASE WHEN on_n >= 5 * w.n THEN other END AS form, CASE WHEN on_n >= 5 * w.n THEN on_n END AS form_n
      FROM w LEFT JOIN (SELECT word, count(*) AS m, first(other ORDER BY n DESC, other) AS other, max(n) AS on_n FROM p GROUP BY word) USING (word)),
c AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) WHERE c.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_lm_scoring": _OP5, "op7_sharding": _OP7, "op9_benchmark_decontamination": _OP9, "op11_minhash_near_dedup": _OP11, "op13_spelling_variants": _OP13}
