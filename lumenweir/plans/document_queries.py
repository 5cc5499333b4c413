"""Queries over documents' structure and metadata: cleaning, chunking, prefixes, trees, categories, owners, terms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import structure as s
from .registry import Registry, table
from .storage import spread
from .text_queries import _SQUEEZE, _STRIP

r = Registry()


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


_CLEAN = rf"regexp_replace(regexp_replace(text, '[\t\x0B\f\r \x{{A0}}\x{{3000}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_RFIND = "length(x) - strpos(reverse(x), '{0}') - {1} + 1"


def _cut(end):
    at = f"(length(x) - strpos(reverse(x), '{end[::-1]}') - {len(end)} + 1)"
    return f"WHEN contains(x, '{end}') AND {at} > 0 AND {at} > length(x) - 100 THEN x[1:{at} + {len(end)}]"


@r.query(rf"""WITH a AS (SELECT doc_id, text, string_split({_STRIP.format(_CLEAN)}, chr(10)) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, text, l, list_transform(l, lambda y: lower({_STRIP.format('y')})) AS k FROM a),
c AS (SELECT doc_id, text, rtrim(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: k[i] = '' OR list_position(k, k[i]) = i), lambda i: l[i]), chr(10)), '{t.SPACES}') AS x FROM b),
d AS (SELECT doc_id, CASE WHEN length({_STRIP.format('text')}) < 10 THEN text WHEN length(x) <= 15 OR regexp_matches(x[-15:], '[.!?。다요음]\s*$') THEN x {' '.join(map(_cut, s.ENDS))} ELSE x END AS x FROM c)
SELECT doc_id, length(x) AS n_chars, sha256(x)[1:16] AS cleaned FROM d WHERE length(x) >= 10""")
def cleaned_passages(spark, sf_dir):
    return s.clean_passages(_docs(spark, sf_dir)).select("doc_id", F.length("text").alias("n_chars"), F.substring(F.sha2("text", 256), 1, 16).alias("cleaned"))


@r.query()
def paragraph_chunks(spark, sf_dir):
    return s.each_text(_docs(spark, sf_dir), lambda x: [(c,) for c in s.paragraph_chunks(x)], "text string")


@r.query()
def heading_chunks(spark, sf_dir):
    """Of pages' Markdown-like text: each line of over 60 characters is body, shorter ones are headings."""
    marked = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"(?m)^(.{1,60})$", "# $1").alias("text"))
    return s.each_text(marked, s.heading_chunks, "heading_path string, text string")


@r.query()
def legal_chunks(spark, sf_dir):
    marked = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"(?m)^(\p{Lu}\w* \w+)", "##### $1\n").alias("text"))
    return s.each_text(marked, s.legal_chunks, "heading_path string, text string")


@r.query(r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) AS x, 'body' AS kind FROM pages), c AS (SELECT page_id, unnest(regexp_extract_all(html, '<td>([^<]*)</td>', 1)) AS x, 'table' AS kind FROM pages), d AS (SELECT page_id, unnest(regexp_extract_all(html, '<pre><code>([^<]*)</code></pre>', 1)) AS x, 'code' AS kind FROM pages)
SELECT page_id, kind, count(*) AS n, sum(length(x))::BIGINT AS n_chars FROM (SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d) WHERE trim(x) <> '' GROUP BY page_id, kind""")
def typed_chunks(spark, sf_dir):
    """Body, table and code parts of pages as chunks of their kind."""
    pages = table(spark, sf_dir, "pages")
    part = lambda kind, p: pages.select("page_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("html", F.lit(p), F.lit(1))).alias("x"))
    all_ = part("body", "<p>([^<]*)</p>").unionByName(part("table", "<td>([^<]*)</td>")).unionByName(part("code", "<pre><code>([^<]*)</code></pre>"))
    return all_.where(F.trim("x") != "").groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("n_chars"))


_TITLE = "CASE doc_id % 4 WHEN 0 THEN '1234567890123_' || source || '.PDF' WHEN 1 THEN repeat(source, 20) || '.docx' WHEN 2 THEN '' ELSE source || '_2024-03 보고' END"


def _title():
    k = F.col("doc_id") % 4
    return F.when(k == 0, F.concat(F.lit("1234567890123_"), "source", F.lit(".PDF"))).when(k == 1, F.concat(F.repeat("source", 20), F.lit(".docx"))).when(k == 2, "").otherwise(F.concat("source", F.lit("_2024-03 보고")))


_SHORT = rf"(CASE WHEN length({{0}}) > 60 THEN {{0}}[1:60] || '…' ELSE {{0}} END)".format(rf"regexp_replace(regexp_replace({_TITLE}, '^\d{{10,}}_', ''), '(?i)\.(pptx?|pdf|docx?|xlsx?|csv)$', '')")


@r.query(f"SELECT doc_id, {_SHORT} AS short FROM documents")
def short_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", s.short_title(_title()).alias("short"))


@r.query(rf"""WITH l AS (SELECT doc_id, lang, source, {_SHORT} AS title, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, lang, source, title, len(l) AS total, unnest(range(1, len(l) + 1)) AS i, l FROM l),
h AS (SELECT doc_id, i - 1 AS chunk, array_to_string(list_filter([CASE WHEN title <> '' THEN title END, lang, '§' || i || '/' || total], lambda x: x IS NOT NULL), ' | ') AS head, lang, i, source FROM e),
p AS (SELECT doc_id, chunk, '[Context] ' || head || chr(10) || CASE WHEN i % 2 = 0 THEN '[섹션: ' || source || ' > ' || lang || ']' || chr(10) ELSE '' END || CASE WHEN i % 3 = 0 THEN '[유형: table]' || chr(10) ELSE '' END || chr(10) AS p FROM h)
SELECT doc_id, chunk, CASE WHEN length(p) > 150 THEN p[1:147] || '…' || chr(10) || chr(10) ELSE p END AS prefix FROM p""")
def chunk_prefixes(spark, sf_dir):
    """What each line of a document, taken as its chunks, is embedded with."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.split("text", "\n").alias("l")).select("doc_id", "lang", "source", F.size("l").alias("total"), F.posexplode("l").alias("chunk", "x"))
    path = F.when(F.col("chunk") % 2 == 1, F.concat_ws(" > ", "source", "lang"))
    kind = F.when(F.col("chunk") % 3 == 2, "table").otherwise("body")
    return lines.select("doc_id", "chunk", s.context_prefix(_title(), F.col("lang"), path, kind, F.col("chunk"), F.col("total"), F.lit("")).alias("prefix"))


@r.query("""WITH x AS (SELECT o_orderkey, o_orderdate::DATE + 3000 AS d, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN strftime(d, ' %Y %Y년 ') || month(d) || '월 ' || strftime(d, '%Y_%m') WHEN k = 1 THEN strftime(d, ' %Y %Y년 ') || month(d) || '월 ' || strftime(d, '%Y_%m') || ' ' || month(d) || '월 2주차' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ' 김철수' ELSE '' END AS tokens FROM x""")
def date_author_tokens(spark, sf_dir):
    d, k = F.date_add(F.to_date("o_orderdate"), 3000), F.col("o_orderkey") % 3
    title = F.when(k == 0, F.concat(F.lit("report_"), F.date_format(d, "yyyy-MM"))).when(k == 1, F.concat(F.year(d), F.lit("년 "), F.month(d), F.lit("월 2주차"))).otherwise("plain")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.date_author_tokens(title, F.when(F.col("o_orderkey") % 2 == 0, "김철수")).alias("tokens"))


_TREE_CHUNKS = """SELECT c_nationkey AS doc_id, c_custkey AS chunk_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS chunk_index, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment || ' > ' || (CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END) END AS p FROM customer"""
_TREE = f"""WITH c AS ({_TREE_CHUNKS}), n AS (SELECT doc_id, count(*) FILTER (p = '') AS n FROM c GROUP BY doc_id), z AS (SELECT *, CASE WHEN n <= 5 THEN greatest(n, 1) WHEN n <= 20 THEN 5 WHEN n <= 100 THEN 10 ELSE 20 END AS size FROM c JOIN n USING (doc_id)),
l AS (SELECT doc_id, chunk_index, 1 AS level, CASE WHEN p = '' THEN 'p.' || (chunk_index // size * size + 1) || '-' || ((chunk_index // size + 1) * size) ELSE split_part(p, ' > ', 1) END AS full_path, CASE WHEN p = '' THEN md5('__page_group_' || (chunk_index // size) || '__')[1:12] ELSE md5(split_part(p, ' > ', 1))[1:12] END AS h, NOT contains(p, ' > ') AS leaf, NULL AS parent FROM z
 UNION ALL SELECT doc_id, chunk_index, 2, p, md5(p)[1:12], true, md5(split_part(p, ' > ', 1))[1:12] FROM z WHERE contains(p, ' > ')),
s AS (SELECT doc_id, 'kb:' || doc_id || ':section:' || h AS node_id, level, any_value(full_path) AS full_path, any_value(parent) AS parent, min((chunk_index, level)) AS pos FROM l GROUP BY doc_id, h, level),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM s),
g AS (SELECT doc_id, chunk_index, 'kb:' || doc_id || ':section:' || h AS section, 'kb:' || doc_id || ':page:' || chunk_index AS page FROM l WHERE leaf)
"""


def _tree(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("c_custkey") % 3
    path = F.when(k == 0, "").when(k == 1, F.col("c_mktsegment")).otherwise(F.concat_ws(" > ", "c_mktsegment", F.when(F.col("c_acctbal") > 5000, "high").otherwise("low")))
    index = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    chunks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("chunk_id"), path.alias("heading_path"), index.alias("chunk_index"))
    return s.document_tree(chunks, "kb")


@r.query(_TREE + "SELECT doc_id, node_id, level, CASE WHEN level = 2 THEN split_part(full_path, ' > ', 2) ELSE full_path END AS title, full_path, place FROM o")
def tree_sections(spark, sf_dir):
    return _tree(spark, sf_dir)[0]


@r.query(_TREE + """SELECT DISTINCT doc_id, doc_id::VARCHAR AS source, 'kb:' || doc_id AS target, 'HAS_TREE_ROOT' AS type FROM c
UNION ALL SELECT doc_id, CASE WHEN level = 1 THEN 'kb:' || doc_id ELSE 'kb:' || doc_id || ':section:' || parent END, node_id, 'HAS_TREE_SECTION' FROM o UNION ALL SELECT doc_id, section, page, 'HAS_TREE_PAGE' FROM g
UNION ALL SELECT doc_id, page, nxt, 'TREE_NEXT_SIBLING' FROM (SELECT *, lead(page) OVER (PARTITION BY doc_id, section ORDER BY chunk_index) AS nxt FROM g) WHERE nxt IS NOT NULL
UNION ALL SELECT doc_id, node_id, nxt, 'TREE_NEXT_SIBLING' FROM (SELECT *, lead(node_id) OVER (PARTITION BY doc_id, parent ORDER BY place) AS nxt FROM o) WHERE nxt IS NOT NULL""")
def tree_edges(spark, sf_dir):
    return _tree(spark, sf_dir)[1]


_PATH = "r_name || ' > ' || n_name || ' >  ' || c_mktsegment"


@r.query(f"""WITH p AS (SELECT c_custkey, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), l AS (SELECT c_custkey, 1 AS level, r_name AS title, r_name AS full_path FROM p UNION ALL SELECT c_custkey, 2, n_name, r_name || ' > ' || n_name FROM p UNION ALL SELECT c_custkey, 3, c_mktsegment, r_name || ' > ' || n_name || ' > ' || c_mktsegment FROM p)
SELECT c_custkey, level, title, full_path, md5(full_path)[1:12] AS path_hash FROM l""")
def heading_levels(spark, sf_dir):
    c, n, g = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return s.path_levels(rows.select("c_custkey", F.concat("r_name", F.lit(" > "), "n_name", F.lit(" >  "), "c_mktsegment").alias("heading_path"))).drop("heading_path")


# Categories and their keywords, kinds of documents, and owners that are none.
CATEGORIES = {
    "IT인프라·운영": ("서버", "배포", "장애", "모니터링", "인프라", "쿠버네티스", "네트워크", "방화벽", "SSL", "DNS"), "시스템·애플리케이션": ("시스템", "메뉴", "화면", "API", "앱", "UI", "백엔드", "DB", "데이터베이스"),
    "업무프로세스·규정": ("프로세스", "절차", "규정", "감사", "인사", "회계", "재무", "결재", "계약"), "사업·전략": ("매출", "전략", "KPI", "마케팅", "영업", "실적", "성과"),
    "유통·물류": ("발주", "배송", "재고", "물류", "점포", "상품", "유통"), "용어·지식정의": ("용어", "정의", "약어", "표준", "사전"),
}
DOCUMENT_TYPES = (
    ("guide", ("가이드", "guide", "매뉴얼", "manual")), ("policy", ("정책", "policy", "규정")), ("procedure", ("절차", "procedure", "프로세스")), ("faq", ("faq", "자주", "질문")), ("meeting_notes", ("회의", "meeting", "미팅")),
    ("changelog", ("변경", "changelog", "릴리스")),
)
NO_OWNERS = ("^Unknown$", "^User$", "^admin$", "APP$", "팀$")


def l1_category(title, content, categories: dict[str, tuple[str, ...]] = CATEGORIES):
    """Of categories, which an organisation names with its own words: the first one with the best score: 3 for a keyword in the title, 1 for one in the content's first 2000 characters."""
    title, head = F.lower(title), F.lower(F.substring(content, 1, 2000))
    score = lambda words: sum((F.contains(title, F.lit(w.lower())).cast("int") * 3 + F.contains(head, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    ranked = F.array(*(F.struct(score(w).alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, w) in enumerate(categories.items())))
    best = F.array_max(ranked)
    return F.when(best["score"] > 0, best["name"]).otherwise("기타")


#: CATEGORIES and words that the given texts have.
_OWN_WORDS = {"업무프로세스·규정": ("the",), "사업·전략": ("und",), "유통·물류": ("les",)}
_TOPICS = {name: words + _OWN_WORDS.get(name, ()) for name, words in CATEGORIES.items()}


def _category_sql():
    hits = lambda w: f"3 * contains(ti, lower('{w}'))::INT + contains(co, lower('{w}'))::INT"
    each = ", ".join("{'s': " + " + ".join(map(hits, words)) + f", 'i': {-i}, 'n': '{name}'}}" for i, (name, words) in enumerate(_TOPICS.items()))
    return f"list_max([{each}])"


@r.query(f"WITH d AS (SELECT doc_id, lower('API ' || source || CASE WHEN doc_id % 5 = 0 THEN ' 매출 실적' ELSE '' END) AS ti, lower(text[1:2000]) AS co FROM documents), b AS (SELECT doc_id, {_category_sql()} AS b FROM d) SELECT doc_id, CASE WHEN b.s > 0 THEN b.n ELSE '기타' END AS category FROM b")
def l1_categories(spark, sf_dir):
    title = F.concat(F.lit("API "), "source", F.when(F.col("doc_id") % 5 == 0, " 매출 실적").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", l1_category(title, F.col("text"), _TOPICS).alias("category"))


def document_type(title):
    """The first kind of which the title has a word."""
    kind = F.lit("reference")
    for k, words in reversed(DOCUMENT_TYPES):
        kind = F.when(F.lower(title).rlike("|".join(words)), k).otherwise(kind)
    return kind


def clean_owner(c, none: tuple[str, ...] = NO_OWNERS):
    """A Korean name of two to four syllables or a plain ASCII one, without a department and an M at the end; else null."""
    name = F.trim(F.element_at(F.split(F.trim(c), "/"), 1))
    name = F.when(name.rlike(".M$"), F.regexp_replace(name, "M$", "")).otherwise(name)
    bad = F.trim(c).rlike(r"^Unknown User \([^)]+\)")
    for p in none:
        bad = bad | name.rlike(f"(?i){p}")
    return F.when(~bad & name.rlike("^([가-힣]{2,4}|[A-Za-z]{2,20})$"), name)


@r.query(r"""WITH l AS (SELECT doc_id, '[home](/wiki/' || doc_id || ') [x](https://e.com) ' || text || ' [Spec](https://wiki.example.com/' || source || ')' AS x FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(x, '\[([^\]]+)\]\(([^)]+)\)')) AS m FROM l), g AS (SELECT doc_id, regexp_extract(m, '\[([^\]]+)\]\(([^)]+)\)', 1) AS label, regexp_extract(m, '\[([^\]]+)\]\(([^)]+)\)', 2) AS url FROM m)
SELECT doc_id, label, url FROM g WHERE starts_with(url, '/') OR contains(url, 'confluence') OR contains(url, 'wiki')""")
def cross_references(spark, sf_dir):
    x = F.concat(F.lit("[home](/wiki/"), "doc_id", F.lit(") [x](https://e.com) "), "text", F.lit(" [Spec](https://wiki.example.com/"), "source", F.lit(")"))
    p = r"\[([^\]]+)\]\(([^)]+)\)"
    pairs = F.arrays_zip(F.regexp_extract_all(x, F.lit(p), F.lit(1)).alias("label"), F.regexp_extract_all(x, F.lit(p), F.lit(2)).alias("url"))
    links = table(spark, sf_dir, "documents").select("doc_id", F.explode(pairs).alias("m")).select("doc_id", F.col("m.label").alias("label"), F.col("m.url").alias("url"))
    return links.where(F.col("url").startswith("/") | F.contains("url", F.lit("confluence")) | F.contains("url", F.lit("wiki")))


@r.query(r"SELECT o_orderkey, regexp_replace(x, '(\d{1,3}(?:,\d{3})+)\d([^\d]|$)', '\1\2', 'g') AS fixed FROM (SELECT o_orderkey, 'total ' || (1 + o_custkey % 99) || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '8' ELSE '' END || ' won, 12345 and 1,2345' AS x FROM orders)")
def ocr_numbers(spark, sf_dir):
    x = F.concat(F.lit("total "), 1 + F.col("o_custkey") % 99, F.lit(","), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.when(F.col("o_orderkey") % 2 == 0, "8").otherwise(""), F.lit(" won, 12345 and 1,2345"))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.ocr_numbers(x).alias("fixed"))


@r.query("""WITH c AS (SELECT c_custkey, [44032 + c_custkey * 31 % 11172, 97, 44032 + c_custkey * 577 % 11172] AS p FROM customer) SELECT c_custkey, array_to_string(list_transform(list_filter(p, lambda x: x >= 44032), lambda x: ('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ')[(x - 44032) // 588 + 1]), '') AS initials FROM c""")
def initial_consonants(spark, sf_dir):
    k = F.col("c_custkey")
    char = lambda n: F.decode(F.unhex(F.hex(n)), "UTF-16BE")
    return table(spark, sf_dir, "customer").select("c_custkey", s.initial_consonants(F.concat(char(44032 + k * 31 % 11172), F.lit("a"), char(44032 + k * 577 % 11172))).alias("initials"))


@r.query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[OCR] ㅋㅋ ' || text WHEN 1 THEN text || repeat('=', doc_id % 9) || ' 륙은' ELSE text END AS x FROM documents), c AS (SELECT doc_id, x, string_split(x, '') AS c FROM d),
n AS (SELECT doc_id, x, 2 * len(regexp_extract_all(x, '[ㄱ-ㅣᆨ-ᇿ]')) + 3 * len(list_filter(range(4, len(c) + 1), lambda i: c[i] <> chr(10) AND c[i] = c[i - 1] AND c[i] = c[i - 2] AND c[i] = c[i - 3] AND (i = 4 OR c[i - 4] <> c[i]))) + 5 * len(regexp_extract_all(x, '[륙곰슨묻릉룬륨름륵몽룸뭬늘믄뉘녈][어은을룸름릉늙류늘는근]')) AS n FROM c),
s AS (SELECT doc_id, x, CASE WHEN x = '' THEN 0 ELSE least(1.0, 10 * n / length(x)) END AS s FROM n) SELECT doc_id, round(s, 9) AS noise, s >= CASE WHEN contains(x, '[OCR]') THEN 0.05 ELSE 0.1 END AS correct FROM s""")
def ocr_noise(spark, sf_dir):
    k = F.col("doc_id") % 3
    x = F.when(k == 0, F.concat(F.lit("[OCR] ㅋㅋ "), "text")).when(k == 1, F.concat("text", F.repeat(F.lit("="), (F.col("doc_id") % 9).cast("int")), F.lit(" 륙은"))).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return rows.select("doc_id", F.round(s.ocr_noise(F.col("x")), 9).alias("noise"), s.needs_correction(F.col("x")).alias("correct"))


@r.query()
def ocr_sections(spark, sf_dir):
    """Documents whose text is read twice by OCR, on a page and as an image: one reading is left."""
    x = F.concat(F.lit("[OCR]\n[Page 1 OCR]"), "text", F.lit("\n[Image 1 OCR] "), "text", F.lit("\n[Slide 2 OCR] other "), "doc_id")
    once = s.each_text(table(spark, sf_dir, "documents").select("doc_id", x.alias("text")), lambda v: [(s.unrepeated_ocr(v),)], "text string")
    return once.select("doc_id", F.length("text").alias("n_chars"), s.ocr_spacing(F.col("text")).alias("text"))


@r.query(f"SELECT doc_id, CASE WHEN length(text) <= 200 THEN {_STRIP.format('text')} WHEN strpos(x, '.') > 0 AND length(x) - strpos(reverse(x), '.') > 50 THEN x[1:length(x) - strpos(reverse(x), '.') + 1] WHEN strpos(x, chr(10)) > 0 AND length(x) - strpos(reverse(x), chr(10)) > 50 THEN x[1:length(x) - strpos(reverse(x), chr(10)) + 1] ELSE x END AS summary FROM (SELECT doc_id, text, {_STRIP.format('text[1:200]')} AS x FROM documents)")
def lead_summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.lead_summary(F.col("text")).alias("summary"))


@r.query(rf"SELECT page_id, length(x) AS n, sha256(x)[1:16] AS cleaned FROM (SELECT page_id, {_STRIP.format('y')} AS x FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[\t\r \x{{A0}}\x{{2009}}\x{{3000}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS y FROM pages))")
def embedding_texts(spark, sf_dir):
    x = t.clean_for_embedding(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(x).alias("n"), F.substring(F.sha2(x, 256), 1, 16).alias("cleaned"))


@r.query("SELECT doc_id, CASE WHEN length(text) > 8000 THEN sha256(text[1:8000] || '...[truncated]')[1:16] ELSE sha256(text)[1:16] END AS content FROM documents")
def truncated_contents(spark, sf_dir):
    c = F.col("text")
    cut = F.when(F.length(c) > 8000, F.concat(F.substring(c, 1, 8000), F.lit("...[truncated]"))).otherwise(c)
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(cut, 256), 1, 16).alias("content"))


_W3 = "list_filter(string_split(lower(" + _SQUEEZE.format("text") + "), ' '), lambda x: x <> '')"


@r.query(f"SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END::INT AS shingles FROM (SELECT doc_id, {_W3} AS w FROM documents)")
def shingle_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size(t.shingles(F.col("w"))).alias("shingles"))


@r.query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_totalprice AS score FROM orders), h AS (SELECT * FROM o WHERE o_orderkey % 20 = 0),
p AS (SELECT h.o_custkey, h.o_orderkey AS hit, h.score, x.o_orderkey AS sibling, row_number() OVER (PARTITION BY x.o_orderkey ORDER BY h.score DESC, h.o_orderkey) AS first, x.i FROM h JOIN o x ON x.o_custkey = h.o_custkey AND abs(x.i - h.i) BETWEEN 1 AND 2 WHERE x.o_orderkey % 20 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY i) AS n FROM p WHERE first = 1), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, hit, i) AS used FROM k WHERE n <= 4)
SELECT o_custkey, hit, sibling, round(score * 0.85, 4) AS score FROM b WHERE used <= 16""")
def expanded_siblings(spark, sf_dir):
    """Siblings within two places of each hit, no hit themselves, each at its best hit, up to four a hit and 8,000 characters
    (of 500 a chunk) a customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"))
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    hits = o.where("o_orderkey % 20 = 0").select("o_custkey", F.col("o_orderkey").alias("hit"), "score", F.col("i").alias("hit_i"))
    near = hits.join(o.where("o_orderkey % 20 <> 0").select("o_custkey", F.col("o_orderkey").alias("sibling"), "i"), "o_custkey").where("abs(i - hit_i) between 1 and 2")
    one = near.withColumn("_k", F.row_number().over(Window.partitionBy("sibling").orderBy(F.desc("score"), "hit"))).where("_k = 1")
    few = one.withColumn("_n", F.row_number().over(Window.partitionBy("hit").orderBy("i"))).where("_n <= 4")
    used = few.withColumn("_u", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "hit", "i")) * 500).where("_u <= 8000")
    return used.select("o_custkey", "hit", "sibling", F.round(F.col("score") * 0.85, 4).alias("score"))


# Terms


# Patterns of terms that are said to be the same.
SYNONYM_PATTERNS = (
    (r"(\S+)\s*[\(（]이하\s+([^)）]+)[\)）]", "abbreviation_intro"), (r"(\S+)\s*[\(（]([^)）]+)[\)）]", "parenthetical"), (r"(\S+)\s*[,，]\s*(?:일명|또는|혹은|즉|일컫는|이른바)\s+(\S+)", "aka"),
    (r"(\S+)[이가]?\s*(?:라고도\s*불리는|로도\s*알려진|이라고도\s*하는)\s+(\S+)", "also_known_as"),
)


#: Where a pattern that begins with a run of other characters than spaces can match first: at the run's begin, or where the match
#: before it ended. From any later place it matches only what it matches from there, so that those needn't be tried.
_AT_RUN = r"(?U)(?:(?<!\S)|\G)"
#: What a text must hold for a pattern to match.
_NEEDED = {"abbreviation_intro": r"[\(（]이하", "parenthetical": r"[\(（]", "aka": r"[,，]", "also_known_as": "불리는|알려진|하는"}


def synonym_pairs(rows, key: str, text: str, known: tuple[str, ...]):
    """(key, kind, term, synonym): pairs that the patterns give in texts, valid ones, a known term first, each pair once by pattern
    and place. Each pattern is searched once in a text, and only in those that hold its mark."""
    whole = lambda p, kind: F.when(F.col(text).rlike(_NEEDED[kind]), F.regexp_extract_all(text, F.lit(_AT_RUN + p), F.lit(0)))
    part = lambda m, p, g: F.regexp_extract(m, f"(?U)^{p}", g)
    pairs = lambda p, kind: F.transform(F.coalesce(whole(p, kind), F.array().cast("array<string>")), lambda m: F.struct(part(m, p, 1).alias("a"), part(m, p, 2).alias("b")))
    tagged = lambda i, p, kind: F.transform(pairs(p, kind), lambda m, at: F.struct(F.lit(i).alias("seq"), at.alias("at"), F.lit(kind).alias("kind"), F.trim(m["a"]).alias("a"), F.trim(m["b"]).alias("b")))
    found = rows.select(key, F.explode(F.concat(*(tagged(i, p, kind) for i, (p, kind) in enumerate(SYNONYM_PATTERNS)))).alias("m")).select(key, "m.*")
    alnum = lambda c: F.regexp_count(c, F.lit(r"[\p{L}\p{N}]")) / F.length(c)
    bad = lambda c: c.rlike(r"^[#*@\\/$`~^|{}<>]") | c.rlike(r"^[.+%,-]*\d+[.+%,-]*$") | ((F.length(c) > 3) & (alnum(c) < 0.6))
    ok = F.length("a").between(2, 30) & F.length("b").between(2, 30) & ~bad(F.col("a")) & ~bad(F.col("b")) & (F.lower("a") != F.lower("b"))
    swap = F.lower("b").isin(*known) & ~F.lower("a").isin(*known)
    named = found.where(ok).select(key, "seq", "at", "kind", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("term"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("synonym"))
    best = named.groupBy(key, F.lower("term").alias("_t"), F.lower("synonym").alias("_s")).agg(F.min_by(F.struct("kind", "term", "synonym"), F.struct("seq", "at")).alias("r"))
    return best.select(key, "r.*")


@r.query(rf"SELECT doc_id, CASE WHEN i > 0 THEN '...' || {_SQUEEZE.format('text[greatest(i - 50, 1):least(i + 52, length(text))]')} || '...' END AS context FROM (SELECT doc_id, text, strpos(lower(text), 'the') AS i FROM documents)")
def term_contexts(spark, sf_dir):
    """Fifty characters on either side of a term's first place."""
    i = F.instr(F.lower("text"), "the")
    start = F.greatest(i - 50, F.lit(1))
    cut = F.substring("text", start, F.least(i + 52, F.length("text")) - start + 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(i > 0, F.concat(F.lit("..."), t.squeezed(cut), F.lit("..."))).alias("context"))


@r.query(r"SELECT p_partkey, lower(regexp_replace(trim(regexp_replace(regexp_replace(p_brand || '/' || p_name || '-' || p_type || '_x', '[^0-9A-Za-z가-힣\s_-]', ' ', 'g'), '[_-]', ' ', 'g')), '\s+', ' ', 'g')) AS term FROM part")
def search_terms(spark, sf_dir):
    x = F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), "p_type", F.lit("_x"))
    return table(spark, sf_dir, "part").select("p_partkey", t.search_term(x).alias("term"))


@r.query("""WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part), c AS (SELECT p_partkey, replace(p_name, ' ', '') AS x FROM part), s AS (SELECT p_partkey, x, i, x[1:i] AS a, x[i + 1:] AS b FROM (SELECT p_partkey, x, unnest(range(2, length(x) - 1)) AS i FROM c)),
m AS (SELECT s.*, (a IN (SELECT w FROM w))::INT + (b IN (SELECT w FROM w))::INT AS n FROM s) SELECT p_partkey, a AS head, b AS tail FROM m WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, i) = 1""")
def compound_splits(spark, sf_dir):
    """The first split of a compound whose parts are the most known words. Splits are joined to the words, twice."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    x = F.replace("p_name", F.lit(" "), F.lit(""))
    splits = p.select("p_partkey", x.alias("x"), F.explode(F.sequence(F.lit(2), F.length(x) - 2)).alias("i"))
    splits = splits.select("p_partkey", "i", F.substring("x", F.lit(1), F.col("i")).alias("a"), F.substring("x", F.col("i") + 1, F.length("x")).alias("b"))
    known = splits.join(words.select(F.col("w").alias("a"), F.lit(1).alias("ka")), "a", "left").join(words.select(F.col("w").alias("b"), F.lit(1).alias("kb")), "b", "left")
    n = F.coalesce("ka", F.lit(0)) + F.coalesce("kb", F.lit(0))
    best = known.where(n > 0).groupBy("p_partkey").agg(F.min_by(F.struct("a", "b"), F.struct((-n).alias("n"), "i")).alias("s"))
    return best.select("p_partkey", F.col("s.a").alias("head"), F.col("s.b").alias("tail"))
