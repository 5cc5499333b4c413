"""Queries over documents, pages and conversations: gate, quality, text functions, chunking, terms, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import documents as d
from .registry import Registry, table
from .storage import stored

r = Registry()
#: Others that are given out in a run, the same for each term.
RUN = 512
_STRIP = f"trim({{0}}, '{t.SPACES}')"
_TRIM = _STRIP.format("coalesce(text, '')")
_METRICS = r"""SELECT *, length(text) AS content_length, regexp_matches(text, '\|.*\|.*\|') AS has_tables, regexp_matches(text, '```|<code>') AS has_code,
  regexp_matches(text, '(?m)^#{1,6}\s') OR regexp_matches(text, '<h[1-6]>') AS has_headers, regexp_matches(text, '!\[.*\]\(.*\)|<img') AS has_images, regexp_matches(text, '\[.*\]\(.*\)|<a\s+href') AS has_links FROM documents"""
_TIER = "CASE WHEN content_length >= 2000 OR (content_length >= 1000 AND (has_tables OR has_code)) THEN 'GOLD' WHEN content_length >= 500 OR (content_length >= 200 AND (has_tables OR has_code OR has_headers)) THEN 'SILVER' WHEN content_length >= 50 THEN 'BRONZE' ELSE 'NOISE' END"
_SQUEEZE = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_TOKENS = "list_filter(string_split(lower(" + _SQUEEZE + "), ' '), lambda x: x <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@r.query(f"WITH m AS ({_METRICS}), q AS (SELECT *, {_TIER} AS tier FROM m) SELECT source, tier, count(*) AS n, round(avg(content_length), 4) AS avg_length FROM q GROUP BY source, tier")
def quality_tiers(spark, sf_dir):
    graded = d.quality_metrics(_docs(spark, sf_dir)).withColumn("tier", d.quality_tier())
    return graded.groupBy("source", "tier").agg(F.count("*").alias("n"), F.round(F.avg("content_length"), 4).alias("avg_length"))


@r.query(f"""WITH m AS ({_METRICS}), q AS (SELECT *, {_TIER} AS tier FROM m)
SELECT doc_id, tier, has_tables, has_code, has_headers, has_images, has_links, least(100.0, round(least(60.0, ln(1 + content_length) / ln(5001) * 60)
 + 8 * (has_tables::INT + has_code::INT + has_headers::INT + has_images::INT + has_links::INT) + CASE tier WHEN 'GOLD' THEN 15 WHEN 'SILVER' THEN 10 WHEN 'BRONZE' THEN 5 ELSE 0 END, 1)) AS quality_score FROM q""")
def quality_scores(spark, sf_dir):
    m = d.quality_metrics(_docs(spark, sf_dir)).withColumn("tier", d.quality_tier())
    return m.select("doc_id", "tier", "has_tables", "has_code", "has_headers", "has_images", "has_links", d.quality_score(F.col("tier")).alias("quality_score"))


_GATE = rf"""
WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1),
b AS (SELECT doc_id, text, {_TRIM} AS body, CASE WHEN f.first <> doc_id THEN f.first END AS duplicate_of FROM documents LEFT JOIN f ON f.h = sha256(text)),
c AS (SELECT *, length(body) AS n, len(regexp_extract_all(body, '[0-9A-Za-z_À-ÖØ-öø-ÿ가-힣]+')) AS words, len(regexp_extract_all(body[1:2000], '[가-힣]')) AS ko, len(regexp_extract_all(body[1:2000], '[A-Za-z]')) AS en FROM b),
v AS (SELECT doc_id, duplicate_of, CASE WHEN n = 0 THEN 'fail' WHEN n < 50 THEN 'warn' ELSE 'pass' END AS ig03,
 CASE WHEN regexp_matches(coalesce(text, ''), '(?i)\bdeprecated\b|\bobsolete\b|폐기|중단|사용\s*금지') THEN 'fail' ELSE 'pass' END AS ig04,
 CASE WHEN duplicate_of IS NOT NULL THEN 'fail' ELSE 'pass' END AS ig05, CASE WHEN strlen(text) > 104857600 THEN 'fail' ELSE 'pass' END AS ig07,
 CASE WHEN n < 25 THEN 'fail' WHEN n < 500 OR words < 10 THEN 'warn' ELSE 'pass' END AS ig10, CASE WHEN n < 20 THEN 'skip' WHEN ko > en OR en > 0 THEN 'pass' ELSE 'warn' END AS ig11,
 CASE WHEN n < 50 THEN 'fail' ELSE 'pass' END AS ig12 FROM c),
k AS (SELECT *, (ig03 = 'fail')::INT + (ig04 = 'fail')::INT + (ig10 = 'fail')::INT + (ig11 = 'fail')::INT AS core FROM v)
SELECT doc_id, duplicate_of, ig03, ig04, ig05, ig07, ig10, ig11, ig12, CASE WHEN ig07 = 'fail' THEN 'quarantine' WHEN ig05 = 'fail' OR ig12 = 'fail' OR core >= 2 THEN 'reject' WHEN core = 1 THEN 'hold' ELSE 'proceed' END AS action FROM k
"""


@r.query(_GATE)
def ingestion_gate(spark, sf_dir):
    checked = d.gate_checks(_docs(spark, sf_dir)).withColumn("sha", F.sha2("text", 256)).drop("text")  # only verdicts and hashes are shuffled
    return d.gate_action(d.first_seen(checked, "sha")).select("doc_id", "duplicate_of", "ig03", "ig04", "ig05", "ig07", "ig10", "ig11", "ig12", "action")


@r.query(f"WITH g AS ({_GATE}) SELECT action, count(*) AS n, sum((ig05 = 'fail')::INT)::BIGINT AS duplicates, round(sum((action = 'proceed')::INT) / count(*), 4) AS pass_rate FROM g GROUP BY action")
def gate_summary(spark, sf_dir):
    return ingestion_gate(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.count_if(F.col("ig05") == "fail").alias("duplicates"), F.round(F.count_if(F.col("action") == "proceed") / F.count("*"), 4).alias("pass_rate"))


@r.query(f"SELECT doc_id, sha256(lower({_STRIP.format('text')}))[1:32] AS content_hash, sha256({_STRIP.format('text')})[1:16] AS chunk_fingerprint, ('0x' || sha256(lower(trim(source)) || '||' || lower(trim(lang)))[1:8])::BIGINT % 100 AS bucket FROM documents")
def text_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.content_hash(F.col("text")).alias("content_hash"), t.chunk_fingerprint(F.col("text")).alias("chunk_fingerprint"), t.percent_bucket(F.col("source"), F.col("lang")).alias("bucket"))


@r.query(f"WITH h AS (SELECT sha256(lower({_STRIP.format('text')}))[1:32] AS content_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1) SELECT content_hash, first_doc, n FROM h WHERE n > 1")
def exact_duplicates(spark, sf_dir):
    groups = _docs(spark, sf_dir).groupBy(t.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return groups.where("n > 1")


@r.query(r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '\b\d{6}[- ]?\d{7}\b', '[SSN]', 'g') AS x FROM documents), b AS (SELECT doc_id, text, regexp_replace(x, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b', '[CARD]', 'g') AS x FROM a),
c AS (SELECT doc_id, text, regexp_replace(x, '\b01[016789][- ]?\d{3,4}[- ]?\d{4}\b', '[PHONE]', 'g') AS x FROM b), e AS (SELECT doc_id, text, regexp_replace(x, '\b[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+(\.[0-9A-Za-z_-]+)+\b', '[EMAIL]', 'g') AS x FROM c)
SELECT doc_id, sha256(x) AS masked_sha256, len(regexp_extract_all(x, '\[(SSN|CARD|PHONE|EMAIL)\]')) AS masked FROM e""")
def pii_masked(spark, sf_dir):
    masked = _docs(spark, sf_dir).select("doc_id", t.mask_pii(F.col("text")).alias("x"))
    return masked.select("doc_id", F.sha2("x", 256).alias("masked_sha256"), F.regexp_count("x", F.lit(r"\[(SSN|CARD|PHONE|EMAIL)\]")).alias("masked"))


@r.query(rf"""SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens, len(list_distinct({_TOKENS.format('text')})) AS n_distinct, length({_SQUEEZE.format('text')}) AS clean_length,
 round(len(regexp_extract_all(text, '[^0-9A-Za-z가-힣À-ÿ\s.,!?()\-]')) / length(text), 6) AS noise,
 CASE WHEN len(regexp_extract_all(text, '[A-Za-z가-힣]')) = 0 THEN 'unknown' WHEN len(regexp_extract_all(text, '[가-힣]')) / len(regexp_extract_all(text, '[A-Za-z가-힣]')) >= 0.7 THEN 'ko' WHEN len(regexp_extract_all(text, '[가-힣]')) / len(regexp_extract_all(text, '[A-Za-z가-힣]')) <= 0.3 THEN 'en' ELSE 'mixed' END AS script FROM documents""")
def text_traits(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(t.tokens(c)).alias("n_tokens"), F.size(F.array_distinct(t.tokens(c))).alias("n_distinct"), F.length(t.squeezed(c)).alias("clean_length"), F.round(t.noise_score(c), 6).alias("noise"), t.script_language(c).alias("script"))


@r.query(rf"""WITH w AS (SELECT item_id, list_filter(string_split({_SQUEEZE.format('text')}, ' '), lambda x: x <> '') AS w FROM benchmark) SELECT item_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE 0.4 * len(list_distinct(w)) / len(w) + 0.3 * least(len(w) / 10.0, 1.0) + 0.3 * len(list_filter(w, lambda x: length(x) >= 3)) / len(w) END, 6) AS specificity FROM w""")
def query_specificity(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(t.specificity(F.col("text")), 6).alias("specificity"))


_NO_SIGNS = _SQUEEZE.format(r"""regexp_replace(text, '[+&|!(){}\[\]^"~*?:\\/-]', ' ', 'g')""")


@r.query(f"WITH w AS (SELECT item_id, list_filter(string_split({_NO_SIGNS}, ' '), lambda x: x <> '' AND upper(x) NOT IN ('AND', 'OR', 'NOT')) AS w FROM benchmark) SELECT item_id, array_to_string(w[1:10], ' OR ') AS query FROM w")
def lucene_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", t.lucene_or(F.col("text")).alias("query"))


@r.query(r"""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, lower(trim(a.p_name)) AS x, lower(trim(b.p_name)) AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 20 = 0),
g AS (SELECT *, CASE WHEN length(x) >= 3 THEN list_distinct(list_transform(range(1, length(x) - 1), lambda i: x[i:i + 2])) ELSE [x] END AS gx, CASE WHEN length(y) >= 3 THEN list_distinct(list_transform(range(1, length(y) - 1), lambda i: y[i:i + 2])) ELSE [y] END AS gy FROM p)
SELECT a, b, levenshtein(x, y) AS distance, round(0.7 * len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))) + 0.3 * (1 - levenshtein(x, y) / greatest(length(x), length(y))), 6) AS score FROM g""")
def lexical_scores(spark, sf_dir):
    """Each stated term against all of its brand. Terms of one name are one row until the pairs are given out; these then repeat
    the same run of others for term after term, which takes little room where they are written."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").where("p_brand is not null and p_partkey is not null")
    asked = part.where("p_partkey % 20 = 0").groupBy("p_brand", "p_name").agg(F.collect_list("p_partkey").alias("of_a"))
    other = part.groupBy("p_brand", F.col("p_name").alias("name_b")).agg(F.sort_array(F.collect_list("p_partkey")).alias("of_b"))
    names = asked.select("p_brand", "p_name").join(other.select("p_brand", "name_b"), "p_brand")
    distance = F.levenshtein(F.lower(F.trim("p_name")), F.lower(F.trim("name_b"))).alias("distance")
    scores = stored(names.select("p_brand", "p_name", "name_b", distance, F.round(t.lexical_score(F.col("p_name"), F.col("name_b")), 6).alias("score")))  # copies of a name are scored once
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked, other = asked.toDF("brand_a", "name_a", "of_a"), other.toDF("brand_b", "other_name", "of_b")
    pairs = scores.join(asked, (F.col("p_brand") == F.col("brand_a")) & F.col("p_name").eqNullSafe(F.col("name_a"))).repartition(n, "p_brand", "name_b")  # few rows become many
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("of_b") - 1) / RUN).cast("int")), lambda i: F.slice("of_b", i * RUN + 1, RUN))
    met = pairs.join(other.withColumn("of_b", F.explode(runs)), (F.col("p_brand") == F.col("brand_b")) & F.col("name_b").eqNullSafe(F.col("other_name")))
    each = met.select(F.explode("of_a").alias("a"), "of_b", "distance", "score")
    return each.select("a", F.explode("of_b").alias("b"), "distance", "score").where("a <> b")


@r.query(r"""SELECT p_partkey, regexp_replace(lower(regexp_replace(regexp_replace(trim(p_name), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g')), '^-+|-+$', '', 'g') AS normalized, regexp_replace(lower(p_name), '[-\s_]', '', 'g') AS comparable,
 upper(array_to_string(list_transform(list_filter(regexp_split_to_array(trim(p_name), '[\s\-_]+'), lambda w: w <> ''), lambda w: w[1]), '')) AS initials, regexp_matches(p_type, '^[A-Z][A-Z0-9&]{1,9}$') AS abbreviation FROM (SELECT p_partkey, p_type, nfc_normalize(replace(p_name, 'e', 'e' || chr(769)) || CASE WHEN p_partkey % 3 = 0 THEN '_' || chr(4352) || chr(4449) ELSE '' END) AS p_name FROM part)""")
def term_forms(spark, sf_dir):
    """Of names with decomposed letters and syllables, composed first."""
    x = F.concat(F.replace("p_name", F.lit("e"), F.lit("e\u0301")), F.when(F.col("p_partkey") % 3 == 0, "_\u1100\u1161").otherwise(""))
    n = F.col("name")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", t.nfc(x).alias("name")).select("p_partkey", t.normalized_term(n).alias("normalized"), t.comparable_term(n).alias("comparable"), t.initials(n).alias("initials"), t.is_abbreviation(F.col("p_type")).alias("abbreviation"))


@r.query(rf"""WITH w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w WHERE length(term) >= 2 GROUP BY term HAVING count(*) >= 3""")
def term_frequency(spark, sf_dir):
    words = _docs(spark, sf_dir).select("doc_id", F.explode(t.tokens(F.col("text"))).alias("term")).where(F.length("term") >= 2)
    each = words.groupBy("term", "doc_id").count()  # no distinct of a frequent word's documents in one place
    return each.groupBy("term").agg(F.sum("count").alias("n"), F.count("*").alias("docs")).where("n >= 3")


_RUNS = r"[0-9A-Za-zÀ-ÿ]+(?:-[0-9A-Za-zÀ-ÿ]+)*"
_KINDS = {"camel": "^[A-Z][a-z]+[A-Z][A-Za-z]+$", "acronym": "^[A-Z]{2,8}$", "hyphen": "^[A-Za-z]+-[A-Za-z]+$"}
_KIND_SQL = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{k}'" for k, p in _KINDS.items())


@r.query(f"WITH l AS (SELECT unnest(regexp_extract_all(text, '{_RUNS}')) AS x FROM documents), k AS (SELECT CASE {_KIND_SQL} END AS kind, lower(x) AS term FROM l) SELECT kind, term, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind, term HAVING count(*) >= 3")
def pattern_terms(spark, sf_dir):
    runs = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(_RUNS), F.lit(0))).alias("x"))
    kind = F.coalesce(*(F.when(F.col("x").rlike(p), k) for k, p in _KINDS.items()))
    return runs.select(kind.alias("kind"), F.lower("x").alias("term")).where("kind is not null").groupBy("kind", "term").agg(F.count("*").alias("n")).where("n >= 3")


@r.query(r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\n') AS l FROM documents), e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM s)
SELECT doc_id, i - 1 AS line, length(l[i]) AS n, sha256(l[i])[1:16] AS fingerprint FROM e WHERE trim(l[i]) <> ''""")
def document_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).where(F.trim("x") != "")
    return lines.select("doc_id", "line", F.length("x").alias("n"), F.substring(F.sha2("x", 256), 1, 16).alias("fingerprint"))


@r.query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a\s[^>]*href="')) AS n_links, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS n_headings, len(regexp_extract_all(html, '<table')) AS n_tables, len(regexp_extract_all(html, '<(pre|code)')) AS n_code, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def page_structure(spark, sf_dir):
    count = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), count(r'<a\s[^>]*href="').alias("n_links"), count(r"<h[1-6][^>]*>").alias("n_headings"), count("<table").alias("n_tables"), count("<(pre|code)").alias("n_code"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))


@r.query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, CASE WHEN regexp_matches(href, '^mailto:') THEN 'mail' WHEN regexp_matches(href, '^https?://') THEN 'external' WHEN regexp_matches(lower(href), '\.(pdf|docx?|xlsx?|pptx?|zip)$') THEN 'attachment' ELSE 'internal' END AS kind, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    kind = F.when(F.col("href").rlike("^mailto:"), "mail").when(F.col("href").rlike("^https?://"), "external").when(F.lower("href").rlike(r"\.(pdf|docx?|xlsx?|pptx?|zip)$"), "attachment").otherwise("internal")
    return links.withColumn("kind", kind).groupBy("page_id", "href", "kind").agg(F.count("*").alias("n"))


@r.query("WITH v AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/:?#]+)', 1) ORDER BY page_id DESC) AS k FROM pages) SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, page_id, url FROM v WHERE k = 1")
def latest_page_of_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), "page_id", "url")
    return d.latest_version(pages, "host", "page_id")


@r.query("""WITH l AS (SELECT page_id || ':1:' || sha256(html) AS l FROM pages), b AS (SELECT sha256(l)[1:3] AS bucket, sha256(string_agg(l, chr(10) ORDER BY l)) AS digest, count(*) AS n FROM l GROUP BY 1)
SELECT sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS fingerprint, sum(n)::BIGINT AS n FROM b""")
def corpus_fingerprint(spark, sf_dir):
    """One hash of all pages whatever their order: the sorted lines of each of 4,096 ranges of their hashes are hashed, then the digests."""
    lines = table(spark, sf_dir, "pages").select(F.concat_ws(":", "page_id", F.lit("1"), F.sha2("html", 256)).alias("l"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256)
    ranges = lines.groupBy(F.substring(F.sha2("l", 256), 1, 3).alias("bucket")).agg(F.concat_ws(":", "bucket", digest).alias("d"), F.count("*").alias("n"))
    return ranges.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("fingerprint"), F.sum("n").alias("n"))


@r.query(r"""SELECT q.conv_id, q.turn, sha256(q.text)[1:16] AS question, sha256(a.text)[1:16] AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'""")
def question_answer_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.substring(F.sha2("text", 256), 1, 16).alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.substring(F.sha2("text", 256), 1, 16).alias("answer"))
    return asked.join(said, ["conv_id", "turn"])
