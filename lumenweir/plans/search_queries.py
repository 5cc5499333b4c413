"""Queries over search requests and answers. Requests are conversations' turns, benchmark items, or phrases that orders' dates give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import search as q
from .registry import Registry, table
from .text_queries import _SQUEEZE

r = Registry()
_list = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_WORDS = "list_filter(string_split(" + _SQUEEZE + ", ' '), lambda x: x <> '')"


@r.query(rf"SELECT conv_id, turn, sha256(regexp_replace({_SQUEEZE.format('text')}, '\s+([,.:;!?])', '\1', 'g'))[1:16] AS normalized, length(regexp_replace({_SQUEEZE.format('text')}, '\s+([,.:;!?])', '\1', 'g')) AS n FROM conversations")
def normalized_queries(spark, sf_dir):
    x = q.normalized_query(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.sha2(x, 256), 1, 16).alias("normalized"), F.length(x).alias("n"))


_ID_TEXT = "o_clerk || ' ' || 'ORD-' || o_orderkey || ' E-' || (1000 + o_orderkey % 9000) || ' VL' || (100 + o_custkey % 900) || ' ' || (1 + o_custkey % 900) || ',' || (100 + o_orderkey % 900) || ' part-' || o_custkey || '.json OrderLineCache'"
_ID_LIST = "list_concat(list_concat(list_concat(list_concat(list_concat(regexp_extract_all(x, '{0}'), regexp_extract_all(x, '{1}')), regexp_extract_all(x, '{2}')), regexp_extract_all(x, '{3}')), regexp_extract_all(x, '{4}')), regexp_extract_all(x, '{5}'))".format(*q.IDENTIFIERS)


def _id_text():
    n = lambda base, c, m: (F.lit(base) + F.col(c) % m).cast("string")
    return F.concat(
        "o_clerk", F.lit(" ORD-"), "o_orderkey", F.lit(" E-"), n(1000, "o_orderkey", 9000), F.lit(" VL"), n(100, "o_custkey", 900), F.lit(" "), n(1, "o_custkey", 900), F.lit(","), n(100, "o_orderkey", 900),
        F.lit(" part-"), "o_custkey", F.lit(".json OrderLineCache"),
    )


@r.query(f"SELECT o_orderkey, array_to_string({_ID_LIST}, '|') AS identifiers FROM (SELECT o_orderkey, {_ID_TEXT} AS x FROM (SELECT o_orderkey, o_custkey, 'Clerk' AS o_clerk FROM orders))")
def query_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_clerk", F.lit("Clerk")).select("o_orderkey", F.array_join(q.identifiers(_id_text()), "|").alias("identifiers"))


_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need to of in for on with at by from up about into over after and or but not this that these those it its what which who whom when where why how "
    "은 는 이 가 을 를 의 에 에서 로 으로 와 과 도 만 뿐 부터 까지 하다 되다 있다 없다 것 수 등 대해 대해서 대한 관한 관해 관해서 해서 하고 합니다 입니다 습니다 에요 이에요 같은 어떤 어떻게 무엇 알고 싶어 알고싶어 알려 알려줘 알려주세요 궁금"
).split()  # the statements' own list


@r.query(rf"""SELECT conv_id, turn, len(t) AS n, sha256(array_to_string(t, ' '))[1:16] AS tokens FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[A-Za-z0-9]+|[가-힣]+'), lambda x: NOT list_contains({_list(_STOP)}, lower(x))) AS t FROM (SELECT conv_id, turn, replace(replace(replace(text, ' der ', ' 대해 '), ' de ', ' 알려줘 '), ' la ', ' 환불 ') AS text FROM conversations))""")
def expansion_tokens(spark, sf_dir):
    x = F.col("text")
    for word, phrase in (("der", "대해"), ("de", "알려줘"), ("la", "환불")):
        x = F.replace(x, F.lit(f" {word} "), F.lit(f" {phrase} "))
    t = q.query_tokens(x)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).alias("n"), F.substring(F.sha2(F.array_join(t, " "), 256), 1, 16).alias("tokens"))


_GLOSSARY = "SELECT lower(string_split(p_name, ' ')[1]) AS term, list(DISTINCT lower(string_split(p_name, ' ')[2]) ORDER BY lower(string_split(p_name, ' ')[2]))[1:4] AS syn FROM part GROUP BY 1"


@r.query(rf"""WITH g AS ({_GLOSSARY}), t AS (SELECT p_partkey, unnest(range(1, len(w) + 1)) AS i, w FROM (SELECT p_partkey, regexp_extract_all(p_name, '[A-Za-z0-9]+|[가-힣]+') AS w FROM part)),
e AS (SELECT p_partkey, i, w[i] AS tok, list_distinct(list_concat([w[i]], coalesce(syn, []))) AS all_terms, syn FROM t LEFT JOIN g ON g.term = lower(w[i]) WHERE NOT list_contains({_list(_STOP)}, lower(w[i]))),
f AS (SELECT *, list_concat([tok], list_filter(coalesce(syn, []), lambda x: x <> tok)) AS terms FROM e)
SELECT p_partkey, string_agg(CASE WHEN len(terms) > 1 THEN '(' || array_to_string(terms, ' OR ') || ')' ELSE terms[1] END, ' AND ' ORDER BY i) AS expanded FROM f GROUP BY p_partkey""")
def expanded_queries(spark, sf_dir):
    """Terms and their synonyms OR-ed, terms AND-ed. The glossary is aggregated before it is joined; a query's tokens are few."""
    part = table(spark, sf_dir, "part")
    first, second = (F.lower(F.element_at(F.split("p_name", " "), i)) for i in (1, 2))
    glossary = part.groupBy(first.alias("term")).agg(F.slice(F.array_sort(F.collect_set(second)), 1, 4).alias("syn"))
    tokens = part.select("p_partkey", F.posexplode(q.query_tokens(F.col("p_name"))).alias("i", "tok"))
    joined = tokens.join(glossary, F.lower("tok") == F.col("term"), "left")
    terms = F.concat(F.array("tok"), F.filter(F.coalesce("syn", F.array().cast("array<string>")), lambda x: x != F.col("tok")))
    group = F.when(F.size(terms) > 1, F.concat(F.lit("("), F.array_join(terms, " OR "), F.lit(")"))).otherwise(F.col("tok"))
    parts = joined.select("p_partkey", F.struct("i", group.alias("g")).alias("x")).groupBy("p_partkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return parts.select("p_partkey", F.array_join(F.transform("x", lambda x: x["g"]), " AND ").alias("expanded"))


_WEEK_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN month(d) || '월 ' || (1 + day(d) // 7) || '주차 업무' WHEN 1 THEN year(d) || '년 ' || (1 + day(d)) || '주차' WHEN 2 THEN year(d) || '-' || month(d) || '-' || day(d) || ' 회의' WHEN 3 THEN month(d) || '월 ' || day(d) || '일' ELSE year(d) || '년 ' || month(d) || '월 ' || day(d) || '일' END"


def _week_text():
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    k = F.col("o_orderkey") % 5
    return (
        F.when(k == 0, F.concat(m, F.lit("월 "), (1 + F.floor(d / 7)), F.lit("주차 업무"))).when(k == 1, F.concat(y, F.lit("년 "), d + 1, F.lit("주차"))).when(k == 2, F.concat(y, F.lit("-"), m, F.lit("-"), d, F.lit(" 회의")))
        .when(k == 3, F.concat(m, F.lit("월 "), d, F.lit("일"))).otherwise(F.concat(y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일")))
    )


@r.query(f"""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, {_WEEK_TEXT} AS x FROM (SELECT o_orderkey, o_orderdate, o_orderdate::DATE AS d FROM orders))
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'E' WHEN 3 THEN 'D1' ELSE 'D3' END AS kind,
 CASE o_orderkey % 5 WHEN 0 THEN month(d) || '월 ' || (1 + day(d) // 7) || '주차|' || lpad(month(d)::VARCHAR, 2, '0') || '월 ' || lpad((1 + day(d) // 7)::VARCHAR, 2, '0') || '주차|' || lpad(month(d)::VARCHAR, 2, '0') || '월 0' || (1 + day(d) // 7) || '주차|' || month(d) || '월 0' || (1 + day(d) // 7) || '주차'
 WHEN 1 THEN year(d) || '_' || lpad((1 + day(d))::VARCHAR, 2, '0') WHEN 3 THEN lpad(month(d)::VARCHAR, 2, '0') || '월' ELSE strftime(d, '%Y-%m-%d') END AS filters FROM t""")
def week_patterns(spark, sf_dir):
    f = q.week_filters(_week_text())
    return table(spark, sf_dir, "orders").select("o_orderkey", f["kind"].alias("kind"), F.array_join(f["filters"], "|").alias("filters"))


@r.query("""WITH t AS (SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d, month(o_orderdate + INTERVAL 3 DAY) AS m1, day(o_orderdate + INTERVAL 3 DAY) AS d1, month(o_orderdate + INTERVAL (3 + o_orderkey % 9) DAY) AS m2, day(o_orderdate + INTERVAL (3 + o_orderkey % 9) DAY) AS d2 FROM orders),
u AS (SELECT *, 1 + (m + o_orderkey % 2 - 1) % 12 AS qm, 1 + (d + o_orderkey) % 28 AS qd FROM t)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 2 = 0 WHEN m1 = m2 THEN qm = m1 AND qd BETWEEN d1 AND d2 WHEN qm = m1 THEN qd >= d1 WHEN qm = m2 THEN qd <= d2 ELSE false END AS inside FROM u""")
def date_in_names(spark, sf_dir):
    o = F.to_date("o_orderdate")
    first, last = F.date_add(o, 3), F.date_add(o, (3 + F.col("o_orderkey") % 9).cast("int"))
    span = F.concat(F.lit("보고 ("), F.date_format(first, "MM/dd"), F.lit(" ~ "), F.date_format(last, "MM/dd"), F.lit(")"))
    name = F.when(F.col("o_orderkey") % 7 == 0, F.when(F.col("o_orderkey") % 2 == 0, "3월 1주차 보고").otherwise("보고")).otherwise(span)
    month, day = 1 + (F.month(o) + F.col("o_orderkey") % 2 - 1) % 12, 1 + (F.dayofmonth(o) + F.col("o_orderkey")) % 28
    return table(spark, sf_dir, "orders").select("o_orderkey", q.date_in_name(name, month, day).alias("inside"))


@r.query(f"""WITH x AS (SELECT conv_id, turn, text, {_SQUEEZE.format('lower(text)')} AS n, CASE WHEN turn % 3 = 0 THEN '' ELSE CASE WHEN role < 'm' THEN role || ',main' ELSE 'main,' || role END END AS kb FROM conversations)
SELECT conv_id, turn, 'knowledge:' || CASE WHEN kb <> '' THEN sha256(kb)[1:8] || ':' ELSE '' END || sha256(n || CASE WHEN kb <> '' THEN '::' || kb ELSE '' END || '::top_k=5')[1:16] AS cache_key, sha256(trim(lower(text), ' \t\n') || CASE WHEN kb <> '' THEN '::' || kb ELSE '' END)[1:24] AS request FROM x""")
def request_keys(spark, sf_dir):
    kbs = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("main"), "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", q.cache_key(F.col("text"), kbs, top_k=5).alias("cache_key"), q.request_hash(F.col("text"), kbs).alias("request"))


@r.query(f"""WITH h AS (SELECT page_id, sha1(from_hex('{q.NAMESPACE}') || encode(url)) AS h FROM pages)
SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT & 3) + 1, 1) || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", q.name_uuid(F.col("url")).alias("point_id"))


@r.query(f"SELECT p_partkey, CASE WHEN n >= 2 THEN 0.75 WHEN n = 1 THEN 0.55 ELSE 0.35 END::DOUBLE AS inject FROM (SELECT p_partkey, len(list_filter({_WORDS.format('lower(p_name)')}, lambda w: length(w) >= 2 AND contains(lower(p_type || ' ' || p_name[1:12]), w))) AS n FROM part)")
def inject_scores(spark, sf_dir):
    name = F.concat_ws(" ", "p_type", F.substring("p_name", 1, 12))
    return table(spark, sf_dir, "part").select("p_partkey", q.inject_score(F.col("p_name"), name).alias("inject"))


_NOTE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '/etc/[^\s]*', '/etc/<MASKED>', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '<EMAIL>', 'g'), '\b(\d{1,3}\.){3}\d{1,3}\b', '<IP>', 'g'), '\b[a-f0-9]{32,64}\b', '<HEX>', 'g')"


@r.query(rf"SELECT doc_id, sha256(y)[1:16] AS masked_sha256, len(regexp_extract_all(y, '<(EMAIL|IP|HEX|MASKED)>')) AS masked FROM (SELECT doc_id, {_NOTE} AS y FROM (SELECT doc_id, text || ' /etc/passwd 10.0.' || doc_id % 256 || '.1 ' || md5(doc_id::VARCHAR) AS x FROM documents))")
def notification_masked(spark, sf_dir):
    x = F.concat("text", F.lit(" /etc/passwd 10.0."), F.col("doc_id") % 256, F.lit(".1 "), F.md5(F.col("doc_id").cast("string")))
    y = q.mask_notification(x)
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(y, 256), 1, 16).alias("masked_sha256"), F.regexp_count(y, F.lit("<(EMAIL|IP|HEX|MASKED)>")).alias("masked"))


@r.query(r"WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 100 / 100.0)::DECIMAL(4, 2)::VARCHAR WHEN 1 THEN 'score: 1' WHEN 2 THEN '1' ELSE '' END AS x FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 2) THEN x::DOUBLE ELSE 0.5 END AS score FROM t")
def parsed_scores(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, (F.col("o_orderkey") % 100 / 100).cast("decimal(4,2)").cast("string")).when(k == 1, "score: 1").when(k == 2, "\n1\nbecause").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", q.strict_score(x).alias("score"))


_ANSWER = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\[(\d+|문서\s*\d+)\]', '', 'g'), '#{1,4}\s*', '', 'g'), '\*{1,2}([^*]+)\*{1,2}', '\1', 'g'), '---+', '', 'g'), '제공된 문서[들]?[에서을를]*\s*(따르면|종합하[면여]|바탕으로|분석한 결과)', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '  +', ' ', 'g'), chr(9) || chr(10) || ' ')"


@r.query(rf"SELECT conv_id, turn, sha256({_ANSWER})[1:16] AS cleaned, length({_ANSWER}) AS n FROM (SELECT conv_id, turn, '## 제공된 문서에 따르면 **' || text || '** [1]' || chr(10) || '----' || chr(10) || chr(10) || chr(10) || '[문서 2]  end' AS x FROM conversations WHERE role = 'assistant')")
def cleaned_answers(spark, sf_dir):
    x = F.concat(F.lit("## 제공된 문서에 따르면 **"), "text", F.lit("** [1]\n----\n\n\n[문서 2]  end"))
    y = q.clean_answer(x)
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.substring(F.sha2(y, 256), 1, 16).alias("cleaned"), F.length(y).alias("n"))


_TOK = r"list_distinct(list_filter(" + _WORDS.format(r"regexp_replace({0}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g')") + ", lambda x: length(x) >= 2))"
_NEXT = "SELECT a.conv_id, a.turn, a.text AS q, b.text AS v, c.text AS a FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1"


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    later = lambda k, name: t.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("text").alias(name))
    return t.select("conv_id", "turn", F.col("text").alias("q")).join(later(2, "v"), ["conv_id", "turn"]).join(later(1, "a"), ["conv_id", "turn"])


@r.query(rf"""WITH t AS ({_NEXT}), s AS (SELECT *, CASE WHEN length(v) < length(q) THEN v ELSE q END AS x, CASE WHEN length(v) < length(q) THEN q ELSE v END AS y FROM t),
o AS (SELECT *, CASE WHEN x = '' OR y = '' THEN 0 ELSE len(list_filter(string_split(x, ''), lambda c: contains(y, c))) / length(y) END AS overlap FROM s)
SELECT conv_id, turn, round(overlap, 6) AS overlap, length(v) BETWEEN 8 AND 200 AND v <> q AND overlap <= 0.9 AS valid FROM o""")
def question_variations(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", F.round(q.character_overlap(F.col("v"), F.col("q")), 6).alias("overlap"), q.valid_variation(F.col("v"), F.col("q")).alias("valid"))


@r.query(rf"""WITH t AS ({_NEXT}), k AS (SELECT conv_id, turn, {_TOK.format('q')} AS tq, {_TOK.format('v')} AS tv, {_TOK.format('a')} AS ta FROM t),
n AS (SELECT conv_id, turn, list_filter(tv, lambda x: NOT list_contains(tq, x)) AS new, list_filter(ta, lambda x: NOT list_contains(tq, x)) AS told FROM k)
SELECT conv_id, turn, CASE WHEN len(new) = 0 THEN false ELSE len(list_filter(new, lambda x: len(list_filter(told, lambda y: x = y OR (length(y) >= 3 AND contains(x, y)))) > 0)) / len(new) >= 0.3 END AS leak FROM n""")
def answer_leaks(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", q.answer_leak(F.col("v"), F.col("q"), F.col("a")).alias("leak"))


@r.query(f"SELECT doc_id, CASE WHEN p = '' THEN '{q.NO_PREVIEW}' WHEN length(p) <= 180 THEN p ELSE rtrim(p[1:179]) || '…' END AS snippet FROM (SELECT doc_id, {_SQUEEZE.format('text')} AS p FROM documents)")
def grounded_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", q.grounded_snippet(F.col("text")).alias("snippet"))


@r.query("""WITH s AS (SELECT conv_id, turn, 'Seen in [2], [1] and [' || (turn % 4) || '].' AS x FROM conversations WHERE role = 'assistant'), c AS (SELECT conv_id, turn, unnest(list_sort(list_distinct(list_transform(regexp_extract_all(x, '\\[(\\d+)\\]', 1), lambda v: v::INT)))) AS ref FROM s)
SELECT c.conv_id, c.turn, ref, '[' || ref || '] ' || CASE WHEN u.turn % 2 = 0 THEN '[' || u.role || '](kb://' || u.conv_id || '/' || u.turn || ')' ELSE u.role END || ' (score=' || printf('%.2f', (length(u.text) % 100) / 100.0) || ')' AS line
FROM c JOIN conversations u ON u.conv_id = c.conv_id AND u.turn = c.ref - 1""".replace("\\\\", "\\"))
def citations(spark, sf_dir):
    """The sources that an answer names, looked up by their place among its conversation's turns."""
    t = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("Seen in [2], [1] and ["), F.col("turn") % 4, F.lit("]."))
    refs = t.where("role = 'assistant'").select("conv_id", "turn", F.explode(q.citation_refs(text)).alias("ref"))
    uri = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("kb://"), "conv_id", F.lit("/"), "turn"))
    sources = t.select("conv_id", (F.col("turn") + 1).alias("ref"), F.col("role").alias("name"), uri.alias("uri"), (F.length("text") % 100 / 100).alias("score"))
    return refs.join(sources, ["conv_id", "ref"]).select("conv_id", "turn", "ref", q.citation_line(F.col("ref"), F.col("name"), F.col("uri"), F.col("score")).alias("line"))
