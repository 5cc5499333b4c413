"""Queries over Korean words, titles, names and laws, made of the words of documents and conversations.

The given texts have no Korean. HANGUL spells the letters of their words as syllables, and some frequent words stand for
Korean phrases, so that which rule applies to a text depends on its own words. The statements hold their own constants.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking
from ..functions import search as q
from ..functions import text as t
from ..operators import matching, structure
from . import legal_queries as law
from .document_queries import clean_owner, document_type, synonym_pairs
from .graph_queries import _SPARSE, _sparse
from .registry import Registry, table
from .storage import spread, stored

r = Registry()

LETTERS, SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "이김수님에서는명을박가장의지로점최과정도은현월대리민"


def hangul(c):
    """ASCII letters, lower-cased, as syllables."""
    return F.translate(F.lower(c), LETTERS, SYLLABLES)


def _hangul(c: str) -> str:
    return f"translate(lower({c}), '{LETTERS}', '{SYLLABLES}')"


def worded(c, words: dict[str, str]):
    """With some words, between spaces, replaced one after the other."""
    for word, phrase in words.items():
        c = F.replace(c, F.lit(f" {word} "), F.lit(f" {phrase} "))
    return c


def _worded(c: str, words: dict[str, str]) -> str:
    for word, phrase in words.items():
        c = f"replace({c}, ' {word} ', ' {phrase} ')"
    return c


def _texts(spark, sf_dir, name="documents"):
    return spread(table(spark, sf_dir, name))


# Words


_STOPS = {"the": "있는", "of": "그러나", "and": "대하여", "de": "이것을", "der": "모든"}


@r.query(f"""WITH w AS (SELECT unnest(regexp_extract_all({_worded("text", _STOPS)}, '[가-힣]+|[a-zA-Z]+')) AS x FROM documents), k AS (SELECT {_hangul('x')} AS word, count(*) AS n FROM w GROUP BY 1)
SELECT word, n, length(word) BETWEEN 2 AND 4 AND NOT list_contains(['이행에', '대하여', '위하여', '관하여', '통하여', '인하여', '따르면', '따라서', '있는', '없는', '이러한', '같은', '다른', '그러나', '그리고', '그러면', '그래서', '하지만', '또는', '그것을', '이것을', '저것을', '어떤', '모든', '각각'], word) AND NOT (length(word) <= 3 AND regexp_matches(word, '[에의을를이가은는로과와도만께랑]$')) AS person FROM k""")
def person_candidates(spark, sf_dir):
    """Which of the words of all documents may be a person's name, and how often each occurs."""
    words = F.regexp_extract_all(worded(F.col("text"), _STOPS), F.lit("[가-힣]+|[a-zA-Z]+"), F.lit(0))
    found = _texts(spark, sf_dir).select(F.explode(words).alias("x")).groupBy(hangul(F.col("x")).alias("word")).agg(F.count("*").alias("n"))
    return found.withColumn("person", q.likely_person(F.col("word")))


_PARTICLE = "^(.{3,}?)(에서|으로|까지|부터|처럼|같이|에게|한테|보다|[가를에의는은도와과이로만서])$"


@r.query(f"""WITH w AS (SELECT DISTINCT {_hangul('x')} AS word FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS x FROM documents))
SELECT word, regexp_replace(regexp_replace(regexp_replace(word, '{_PARTICLE}', '\\1'), '{_PARTICLE}', '\\1'), '{_PARTICLE}', '\\1') AS stem FROM w""")
def stripped_particles(spark, sf_dir):
    """Particles go from the end of each distinct word of the documents, while three characters besides one stay."""
    words = _texts(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("x")).select(hangul(F.col("x")).alias("word")).distinct()
    return words.select("word", t.strip_particles(F.col("word")).alias("stem"))


@r.query(r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(translate(text, 'aeiou', '가나다라마'), E' \t\n\x0B\f\r'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, flatten(list_transform(w, lambda x: CASE WHEN len(regexp_extract_all(x, '[a-zA-Z0-9]+|[가-힣]+')) > 0 THEN regexp_extract_all(x, '[a-zA-Z0-9]+|[가-힣]+') WHEN length(x) >= 2 THEN [x] ELSE [] END)) AS p FROM w)
SELECT conv_id, turn, len(p) AS n, sha256(array_to_string(p, '|'))[1:16] AS parts FROM p""")
def compound_parts(spark, sf_dir):
    """The ASCII and Hangul runs of each word of a turn, whose vowels are spelled as syllables."""
    p = q.compound_parts(F.translate("text", "aeiou", "가나다라마"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(p).alias("n"), F.substring(F.sha2(F.array_join(p, "|"), 256), 1, 16).alias("parts"))


# Requests and answers


_ASKED = {"the": "매장 번호", "of": "2024년", "and": "어제", "to": "강남점 재고", "in": "김철수 과장", "is": "지난 주", "a": "3월 2일", "de": "GN001", "der": "편의점", "la": "점포 코드"}


@r.query(rf"""WITH x AS (SELECT conv_id, turn, {_worded("text", _ASKED)} AS x FROM conversations WHERE role = 'user'),
k AS (SELECT conv_id, turn, regexp_matches(x, '매장\s*번호')::INT + regexp_matches(x, '점포\s*코드')::INT + regexp_matches(x, '[A-Z]{{2,}}\d{{3,}}')::INT + regexp_matches(x, '\d{{4}}년')::INT + regexp_matches(x, '\d{{1,2}}월\s*\d{{1,2}}일')::INT + regexp_matches(x, '오늘|어제|내일|그제|모레')::INT + regexp_matches(x, '이번\s*주|지난\s*주|다음\s*주')::INT + regexp_matches(x, '[가-힣]{{2,4}}\s*(님|씨|과장|대리|매니저|팀장|점장)')::INT
 + len(list_filter(regexp_extract_all(x, '([가-힣]{{2,}}점)([^가-힣0-9A-Za-z_]|$)', 1), lambda s: NOT list_contains(['편의점', '시점', '관점', '장점', '약점', '특점', '요점', '중점', '거점', '지점'], s))) AS n FROM x)
SELECT conv_id, turn, CASE WHEN n >= 3 THEN 0.1 WHEN n = 2 THEN 0.3 WHEN n = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS generality FROM k""")
def question_generality(spark, sf_dir):
    """How general users' questions are: fewer stores, dates and persons, more general."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", q.generality(worded(F.col("text"), _ASKED)).alias("generality"))


_FRAMES = (("제공된 문서에는 ", " 포함되어 있지 않습니다"), ("제공된 문서들을 보면 직접적인 ", " 정보는 찾을 수 없습니다"), ("직접적인 ", " 정보를 찾을 수 없습니다"), ("현재 제공된 정보로는 ", " 어렵습니다"), ("", " 관련 부서에 문의하세요"), ("", " 담당자에게 문의 바랍니다"), ("", " 담당자에게 문의 바랍니다만"), ("해당 정보가 없음: ", ""), ("", ""))


@r.query(r"""WITH a AS (SELECT conv_id, turn, length(text) % 9 AS k, CASE WHEN turn % 5 = 0 THEN text[1:100] ELSE text END AS text, turn % 7 AS chunks, CASE WHEN conv_id % 11 = 0 THEN '검색된 근거 문서 없이 답했습니다' WHEN conv_id % 11 = 1 THEN '참고' END AS note FROM conversations WHERE role = 'assistant'),
x AS (SELECT *, trim(regexp_replace(CASE k WHEN 0 THEN '제공된 문서에는 ' || text || ' 포함되어 있지 않습니다' WHEN 1 THEN '제공된 문서들을 보면 직접적인 ' || text || ' 정보는 찾을 수 없습니다' WHEN 2 THEN '직접적인 ' || text || ' 정보를 찾을 수 없습니다' WHEN 3 THEN '현재 제공된 정보로는 ' || text || ' 어렵습니다' WHEN 4 THEN text || ' 관련 부서에 문의하세요' WHEN 5 THEN text || ' 담당자에게 문의 바랍니다' WHEN 6 THEN text || ' 담당자에게 문의 바랍니다만' WHEN 7 THEN '해당 정보가 없음: ' || text ELSE text END, '[ 	

]+', ' ', 'g'), E' 	

') AS x FROM a)
SELECT conv_id, turn, x = '' OR chunks = 0 OR coalesce(contains(note, '검색된 근거 문서 없이'), false) OR (length(x) <= 200 AND (regexp_matches(x, '(?i)^제공된 문서들?에는 .*포함되어 있지 않') OR regexp_matches(x, '^제공된 문서들?.*직접적인 .*정보.*찾을 수 없') OR regexp_matches(x, '^직접적인 .*정보를 .*찾을 수 없') OR regexp_matches(x, '^현재 제공된 정보로는 .*어렵') OR contains(x, '관련 부서에 문의') OR contains(x, '확인 후 답변') OR contains(x, '정보를 찾을 수 없습니다') OR contains(x, '해당 정보가 없') OR contains(x, '관련 자료가 충분하지 않') OR contains(x, '답변을 드리기 어렵') OR contains(x, '확인이 필요합니다') OR regexp_matches(x, '담당자에게 문의.*바랍니다$'))) AS replaced FROM x""")
def replaced_answers(spark, sf_dir):
    """Whether an answer says nothing: by its own length and words, its chunks and the note beside it."""
    k = F.length("raw") % len(_FRAMES)
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumnRenamed("text", "raw").withColumn("text", F.when(F.col("turn") % 5 == 0, F.substring("raw", 1, 100)).otherwise(F.col("raw")))
    x = F.coalesce(*(F.when(k == i, F.concat(F.lit(before), "text", F.lit(after))) for i, (before, after) in enumerate(_FRAMES)))
    note = F.when(F.col("conv_id") % 11 == 0, "검색된 근거 문서 없이 답했습니다").when(F.col("conv_id") % 11 == 1, "참고")
    return a.select("conv_id", "turn", q.is_no_answer(x, F.col("turn") % 7, note).alias("replaced"))


_TIMES = {"the": "차주", "of": "지난달", "and": "이번 주", "to": "다음 달", "in": "지난 주", "is": "전주", "a": "이번 달", "de": "금주", "der": "다음 주"}
_WEEK = "(year({d}) || '년 ' || month({d}) || '월 ' || ((day({d}) - 1) // 7 + 1) || '주차')"
_MONTH = "(year({d}) || '년 ' || month({d}) || '월')"


def _time_sql(x: str) -> str:
    for phrase, days in (("차주", 7), ("다음 주", 7), ("이번 주", 0), ("금주", 0), ("지난 주", -7), ("전주", -7)):
        x = f"replace({x}, '{phrase}', {_WEEK.format(d=f'(d + {days})')})"
    for phrase, months in (("이번 달", 0), ("이번달", 0), ("지난 달", -1), ("지난달", -1), ("다음 달", 1)):
        day = f"(date_trunc('month', d) + INTERVAL ({months}) MONTH)"
        x = f"replace({x}, '{phrase}', {_MONTH.format(d=day)})"
    return x


@r.query(f"WITH x AS (SELECT conv_id, turn, DATE '2023-01-01' + (conv_id * 7 + turn)::INT % 700 AS d, {_worded('text', _TIMES)} AS x FROM conversations WHERE role = 'user') SELECT conv_id, turn, sha256({_time_sql('x')})[1:16] AS resolved, len(regexp_extract_all({_time_sql('x')}, '[0-9]+월')) AS times FROM x")
def relative_times(spark, sf_dir):
    """Relative weeks and months in users' questions as absolute ones, seen from each question's day."""
    d = F.date_add(F.lit("2023-01-01").cast("date"), ((F.col("conv_id") * 7 + F.col("turn")) % 700).cast("int"))
    x = q.resolved_time(worded(F.col("text"), _TIMES), d)
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.substring(F.sha2(x, 256), 1, 16).alias("resolved"), F.regexp_count(x, F.lit("[0-9]+월")).alias("times"))


# Titles, owners, synonyms


_TITLED = {"the": "Guide", "of": "정책", "and": "FAQ", "to": "주간 Meeting", "in": "변경", "de": "절차", "la": "매뉴얼", "der": "릴리스"}


@r.query(f"""WITH x AS (SELECT doc_id, lower(array_to_string(string_split({_worded("replace(text, chr(10), ' ')", _TITLED)}, ' ')[1:12], ' ')) AS x FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(x, '가이드|guide|매뉴얼|manual') THEN 'guide' WHEN regexp_matches(x, '정책|policy|규정') THEN 'policy' WHEN regexp_matches(x, '절차|procedure|프로세스') THEN 'procedure' WHEN regexp_matches(x, 'faq|자주|질문') THEN 'faq' WHEN regexp_matches(x, '회의|meeting|미팅') THEN 'meeting_notes' WHEN regexp_matches(x, '변경|changelog|릴리스') THEN 'changelog' ELSE 'reference' END AS type FROM x""")
def document_types(spark, sf_dir):
    """The kind of each document by the first twelve words, which stand for its title."""
    title = F.array_join(F.slice(F.split(worded(F.replace("text", F.lit("\n"), F.lit(" ")), _TITLED), " "), 1, 12), " ")
    return _texts(spark, sf_dir).select("doc_id", document_type(title).alias("type"))


_NAMES = "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS w FROM documents), a AS (SELECT doc_id, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, coalesce(w[3], '') AS c FROM w)"
_OWNER = "CASE WHEN NOT regexp_matches(trim({0}), '^Unknown User \\([^)]+\\)') AND NOT regexp_matches({1}, '(?i)^unknown$|^user$|^admin$|(?i)APP$|팀$') AND regexp_matches({1}, '^([가-힣]{{2,4}}|[A-Za-z]{{2,20}})$') THEN {1} END"
_BARE = "CASE WHEN regexp_matches(trim(split_part(trim({0}), '/', 1)), '.M$') THEN regexp_replace(trim(split_part(trim({0}), '/', 1)), 'M$', '') ELSE trim(split_part(trim({0}), '/', 1)) END"


@r.query(f"""{_NAMES}, o AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'Unknown User (' || a || ')' WHEN doc_id % 6 = 1 THEN 'admin' WHEN doc_id % 6 = 2 THEN {_hangul('a')} || '팀' ELSE {_hangul('a')} || 'M/' || b END AS author, CASE WHEN doc_id % 4 = 0 THEN a || ' ' || b WHEN doc_id % 4 = 1 THEN b || 'App' ELSE b || 'M' END AS creator, '3-1_' || {_hangul('c')} || 'M_보고' AS title FROM a),
n AS (SELECT *, {_BARE.format('author')} AS n1, {_BARE.format('creator')} AS n2, regexp_extract(title, '\\d[_-]\\d[^_]*_([가-힣]{{2,4}})M?_', 1) AS n3 FROM o)
SELECT doc_id, coalesce({_OWNER.format('author', 'n1')}, {_OWNER.format('creator', 'n2')}, {_OWNER.format('n3', 'n3')}, '') AS owner FROM n""")
def document_owners(spark, sf_dir):
    """The author, the creator, or a name that the title holds: the first that is one. Names are words of the documents."""
    w = F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))
    a, b, c = (F.coalesce(F.get(w, F.lit(i)), F.lit("")) for i in range(3))
    k, m = F.col("doc_id") % 6, F.col("doc_id") % 4
    author = F.when(k == 0, F.concat(F.lit("Unknown User ("), a, F.lit(")"))).when(k == 1, "admin").when(k == 2, F.concat(hangul(a), F.lit("팀"))).otherwise(F.concat(hangul(a), F.lit("M/"), b))
    creator = F.when(m == 0, F.concat(a, F.lit(" "), b)).when(m == 1, F.concat(b, F.lit("App"))).otherwise(F.concat(b, F.lit("M")))
    title = F.concat(F.lit("3-1_"), hangul(c), F.lit("M_보고"))
    named = clean_owner(F.regexp_extract(title, r"\d[_-]\d[^_]*_([가-힣]{2,4})M?_", 1))
    return _texts(spark, sf_dir).select("doc_id", F.coalesce(clean_owner(author), clean_owner(creator), named, F.lit("")).alias("owner"))


_PAIRED = {"of": ", 일명", "and": ", 또는", "to": "로도 알려진", "in": "(이하 K8s)", "de": "(POS)", "der": ", 즉", "la": "라고도 불리는"}
_SYN = ((r"(\S+)\s*[\(（]이하\s+([^)）]+)[\)）]", "abbreviation_intro"), (r"(\S+)\s*[\(（]([^)）]+)[\)）]", "parenthetical"), (r"(\S+)\s*[,，]\s*(?:일명|또는|혹은|즉|일컫는|이른바)\s+(\S+)", "aka"), (r"(\S+)[이가]?\s*(?:라고도\s*불리는|로도\s*알려진|이라고도\s*하는)\s+(\S+)", "also_known_as"))
_PAIRS = " UNION ALL ".join(rf"SELECT doc_id, {i} AS seq, '{k}' AS kind, i AS pos, trim(regexp_extract(m, '{p}', 1)) AS a, trim(regexp_extract(m, '{p}', 2)) AS b FROM (SELECT doc_id, unnest(l) AS m, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(x, '{p}') AS l FROM t))" for i, (p, k) in enumerate(_SYN))
_ODD = r"regexp_matches({0}, '^[#*@\\/$`~^|{{}}<>]') OR regexp_matches({0}, '^[.+%,-]*\d+[.+%,-]*$') OR (length({0}) > 3 AND len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]')) / length({0}) < 0.6)".replace("\\\\", "\\")


@r.query(rf"""WITH t AS (SELECT doc_id, {_worded("replace(text, chr(10), ' ')", _PAIRED)} AS x FROM documents), p AS ({_PAIRS}), v AS (SELECT * FROM p WHERE length(a) BETWEEN 2 AND 30 AND length(b) BETWEEN 2 AND 30 AND NOT ({_ODD.format('a')}) AND NOT ({_ODD.format('b')}) AND lower(a) <> lower(b)),
o AS (SELECT doc_id, seq, pos, kind, CASE WHEN lower(b) IN ('pos', 'k8s') AND lower(a) NOT IN ('pos', 'k8s') THEN b ELSE a END AS term, CASE WHEN lower(b) IN ('pos', 'k8s') AND lower(a) NOT IN ('pos', 'k8s') THEN a ELSE b END AS synonym FROM v)
SELECT doc_id, kind, term, synonym FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term), lower(synonym) ORDER BY seq, pos) = 1""")
def discovered_synonyms(spark, sf_dir):
    """Pairs of terms that four patterns give in each document, valid ones, the known term first, each pair once."""
    rows = _texts(spark, sf_dir).select("doc_id", worded(F.replace("text", F.lit("\n"), F.lit(" ")), _PAIRED).alias("x"))
    return synonym_pairs(rows, "doc_id", "x", ("pos", "k8s"))


# Laws: each document is one, its lines that begin with two words are articles


_LAW = r"""WITH w AS (SELECT doc_id, 'law ' || source || doc_id % 3 AS name, regexp_replace(regexp_replace(regexp_replace(text, '(^|\n)([A-Z]\w*) (\w+)', '\1##### 제' || (1 + doc_id % 9) || '조의 ' || (1 + length(text) % 4) || ' (\2 \3) ', 'g'), ' of (\w+) ', ' 「law \1」 제3조 ', 'g'), ' and (\w+) ', ' 「\1 act」 제12조의2 제4항 제1호 ', 'g') AS x FROM documents)"""


def _laws(spark, sf_dir):
    article = F.concat(F.lit("$1##### 제"), 1 + F.col("doc_id") % 9, F.lit("조의 "), 1 + F.length("text") % 4, F.lit(" ($2 $3) "))
    x = F.regexp_replace("text", F.lit(r"(^|\n)([A-Z]\w*) (\w+)"), article)
    x = F.regexp_replace(F.regexp_replace(x, r" of (\w+) ", " 「law $1」 제3조 "), r" and (\w+) ", " 「$1 act」 제12조의2 제4항 제1호 ")
    return _texts(spark, sf_dir).select("doc_id", law.law_slug(F.concat(F.lit("law "), "source", F.col("doc_id") % 3)).alias("slug"), x.alias("text"))


_SLUG = r"regexp_replace(regexp_replace(trim({0}), '\s+', '', 'g'), '[「」]', '', 'g')"


@r.query(_LAW + rf""", a AS (SELECT doc_id, {_SLUG.format('name')} AS slug, unnest(l) AS m, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, name, regexp_extract_all(x, '(?m)^#{{3,6}}\s*제\s*(\d+)\s*조(?:의\s*(\d+))?\s*\(([^)]+)\)') AS l FROM w)),
b AS (SELECT doc_id, n, slug || ':제' || regexp_extract(m, '제\s*(\d+)', 1)::INT || '조' || CASE WHEN regexp_extract(m, '조의\s*(\d+)', 1) <> '' THEN '의' || regexp_extract(m, '조의\s*(\d+)', 1)::INT ELSE '' END AS id, trim(regexp_extract(m, '\(([^)]+)\)', 1)) AS title FROM a)
SELECT doc_id, id, arg_min(title, n) AS title FROM b GROUP BY doc_id, id""")
def law_articles(spark, sf_dir):
    """Articles of each law by their headings; of a number that comes twice, the first."""
    return law.articles(_laws(spark, sf_dir), "doc_id")


@r.query(_LAW + rf""", m AS (SELECT doc_id, {_SLUG.format('name')} AS source, unnest(regexp_extract_all(x, '「([^」\n]{{2,80}})」(?:\s*제\s*(\d+)\s*조(?:의\s*(\d+))?(?:\s*제\s*(\d+)\s*항)?(?:\s*제\s*(\d+)\s*호)?)?')) AS m FROM w),
p AS (SELECT doc_id, source, {_SLUG.format("regexp_extract(m, '「([^」]+)」', 1)")} AS l, regexp_extract(m, '제\s*(\d+)\s*조', 1) AS a, regexp_extract(m, '조의\s*(\d+)', 1) AS s, regexp_extract(m, '제\s*(\d+)\s*항', 1) AS c, regexp_extract(m, '제\s*(\d+)\s*호', 1) AS i FROM m)
SELECT DISTINCT doc_id, source, l || CASE WHEN a = '' THEN '' ELSE ':제' || a::INT || '조' || CASE WHEN s = '' THEN '' ELSE '의' || s::INT END || CASE WHEN c = '' THEN '' ELSE '제' || c::INT || '항' END || CASE WHEN i = '' THEN '' ELSE '제' || i::INT || '호' END END AS target, CASE WHEN a = '' THEN 'law' ELSE 'article' END AS scope FROM p WHERE l <> '' AND l <> source""")
def law_references(spark, sf_dir):
    """References to other laws' articles, or to other laws as a whole; each once."""
    return law.references(_laws(spark, sf_dir), "doc_id")


# Nodes and edges of names that documents have


_NAMED = {"the": "김철수 과장", "of": "2024-03-05에", "and": "이영희님", "to": "담당자 추정", "in": "2023년 7월 1일", "de": "박민수 팀장", "der": "최지우 대리"}


@r.query(f"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS x FROM documents), n AS (SELECT source, CASE WHEN length(x) % 7 = 0 THEN '문서 ' || {_hangul('x')} WHEN length(x) % 7 = 1 THEN {_hangul('x')} || '점' WHEN lower(x) = 'the' THEN 'POS' WHEN x LIKE '%a' THEN 'test_' || x WHEN x LIKE '%n' THEN {_hangul('x')} || ' 추정' ELSE {_hangul('x')} END AS name, ' KB-' || upper(source) || ' ' AS kb FROM w)
SELECT name, CASE WHEN name = 'POS' THEN 'System' WHEN name LIKE '%점' THEN 'Store' ELSE 'Person' END AS type, lower(replace(trim(kb), 'KB-', '')) AS kb, count(*) AS mentions FROM n WHERE NOT (contains(name, '추정') OR starts_with(name, '문서 ') OR starts_with(name, 'test_')) GROUP BY ALL""")
def cleaned_nodes(spark, sf_dir):
    """Nodes of documents' words without placeholders and test nodes; stores and systems get their own type, base ids one form."""
    x, n = F.col("x"), F.length("x") % 7
    name = F.when(n == 0, F.concat(F.lit("문서 "), hangul(x))).when(n == 1, F.concat(hangul(x), F.lit("점"))).when(F.lower(x) == "the", "POS").when(x.endswith("a"), F.concat(F.lit("test_"), x)).when(x.endswith("n"), F.concat(hangul(x), F.lit(" 추정"))).otherwise(hangul(x))
    rows = _texts(spark, sf_dir).select(F.concat(F.lit(" KB-"), F.upper("source"), F.lit(" ")).alias("kb"), F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("x")).select(name.alias("name"), "kb")
    bad = F.contains("name", F.lit("추정")) | F.col("name").startswith("문서 ") | F.col("name").startswith("test_")
    kind = F.when(F.col("name").isin("POS", "WMS"), "System").when(F.col("name").endswith("점"), "Store").otherwise("Person")
    return rows.where(~bad).groupBy("name", kind.alias("type"), F.lower(F.replace(F.trim("kb"), F.lit("KB-"), F.lit(""))).alias("kb")).agg(F.count("*").alias("mentions"))


_PERSON = "([가-힣]{2,4}) ?(과장|님|팀장|대리)"


@r.query(rf"""WITH x AS (SELECT doc_id, {_worded("text", _NAMED)} AS x FROM documents), d AS (SELECT doc_id, x, coalesce(nullif(regexp_extract(x, '\d{{4}}-\d{{2}}-\d{{2}}'), ''), CASE WHEN contains(x, '2023년 7월 1일') THEN '2023-07-01' END) AS date FROM x)
SELECT doc_id, person, 'MENTIONED_IN' AS type, date, count(*) AS n FROM (SELECT doc_id, date, unnest(regexp_extract_all(x, '{_PERSON}', 1)) AS person FROM d) GROUP BY ALL""")
def mention_edges(spark, sf_dir):
    """Persons that documents name by title, with the documents' dates, as edges."""
    x = F.col("x")
    iso, ko = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
    date = F.when(x.rlike(iso), F.regexp_extract(x, iso, 0)).when(x.rlike(ko), F.concat_ws("-", F.regexp_extract(x, ko, 1), F.lpad(F.regexp_extract(x, ko, 2), 2, "0"), F.lpad(F.regexp_extract(x, ko, 3), 2, "0")))
    rows = _texts(spark, sf_dir).select("doc_id", worded(F.col("text"), _NAMED).alias("x"))
    found = rows.select("doc_id", date.alias("date"), F.explode(F.regexp_extract_all(x, F.lit(_PERSON), F.lit(1))).alias("person"))
    return found.groupBy("doc_id", "person", F.lit("MENTIONED_IN").alias("type"), "date").agg(F.count("*").alias("n"))


# Answers' sources, search texts, broken texts


_MARKED = {"the": "\\n[분석] so", "of": "\\n[출처] of", "and": "\\nand", "to": "\\n[참고] to", "de": "\\n[추론]", "la": "\\n[인용] [일반]"}


@r.query(f"""WITH a AS (SELECT conv_id, turn, replace({_worded('text', _MARKED)}, '\\n', chr(10)) AS x FROM conversations WHERE role = 'assistant'), l AS (SELECT conv_id, turn, l[i] AS line, i FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, string_split(x, chr(10)) AS l FROM a))),
m AS (SELECT *, CASE WHEN regexp_matches(line, '\\[(문서 기반|출처|인용)\\]') THEN 'document' WHEN regexp_matches(line, '\\[(분석|추론|해석)\\]') THEN 'inference' WHEN regexp_matches(line, '\\[(권장 사항|일반|참고)\\]') THEN 'general' END AS mark FROM l),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i), 'document') AS source FROM m), c AS (SELECT *, (source IS DISTINCT FROM lag(source, 1, source) OVER (PARTITION BY conv_id, turn ORDER BY i))::INT AS new FROM s), g AS (SELECT *, 1 + sum(new) OVER (PARTITION BY conv_id, turn ORDER BY i) AS section FROM c)
SELECT conv_id, turn, section::BIGINT AS section, source, sha256(string_agg(line, chr(10) ORDER BY i))[1:16] AS content FROM g GROUP BY ALL""")
def answer_sections(spark, sf_dir):
    """Assistants' answers in sections by what their lines say they rest on."""
    x = F.replace(worded(F.col("text"), _MARKED), F.lit("\\n"), F.lit("\n"))
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", x.alias("text"))
    return structure.source_sections(answers, ["conv_id", "turn"]).withColumn("content", F.substring(F.sha2("content", 256), 1, 16))


@r.query("""WITH g AS (SELECT lower(split_part(p_name, ' ', 1)) AS term, list(DISTINCT lower(split_part(p_name, ' ', 2)) ORDER BY lower(split_part(p_name, ' ', 2)) DESC)[1:5] AS syn FROM part GROUP BY 1),
t AS (SELECT p_partkey, list_concat(list_concat([p_name], coalesce(a.syn, [])), coalesce(b.syn, [])) AS l FROM part LEFT JOIN g a ON a.term = lower(split_part(p_name, ' ', 1)) LEFT JOIN g b ON b.term = lower(split_part(p_name, ' ', 2)))
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS search_text FROM t""")
def vector_search_texts(spark, sf_dir):
    """A query and the synonyms of its words as one text for vector search, each term once, in order."""
    part = table(spark, sf_dir, "part")
    word = lambda i: F.lower(F.split_part("p_name", F.lit(" "), F.lit(i)))  # noqa: E731
    glossary = part.groupBy(word(1).alias("term")).agg(F.slice(F.sort_array(F.collect_set(word(2)), asc=False), 1, 5).alias("syn"))
    first, second = glossary.toDF("t1", "s1"), glossary.toDF("t2", "s2")
    none = F.array().cast("array<string>")
    rows = part.select("p_partkey", "p_name", word(1).alias("t1"), word(2).alias("t2")).join(first, "t1", "left").join(second, "t2", "left")
    return rows.select("p_partkey", F.array_join(q.in_order(F.array("p_name"), F.coalesce("s1", none), F.coalesce("s2", none)), " ").alias("search_text"))


_FONTS = "CASE doc_id % 4 WHEN 0 THEN translate(lower(text), 'aeiou', '가가나나가') WHEN 1 THEN regexp_replace(text, '[a-m]', 'x', 'g') WHEN 2 THEN text[1:9] ELSE text END"


@r.query(f"""WITH x AS (SELECT doc_id, {_FONTS} AS x FROM documents), c AS (SELECT doc_id, x, replace(replace(trim(x, E' \\t\\n\\x0B\\f\\r'), ' ', ''), chr(10), '') AS c, length(trim(x, E' \\t\\n\\x0B\\f\\r')) AS n FROM x),
k AS (SELECT doc_id, ch, count(*) AS k, min(i) AS first FROM (SELECT doc_id, ch, i FROM (SELECT doc_id, string_split(c, '') AS l FROM c), LATERAL (SELECT unnest(l) AS ch, generate_subscripts(l, 1) AS i)) WHERE ch <> '' GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, first) AS p FROM k), w AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS p, count(*) OVER (PARTITION BY doc_id) AS m FROM o WHERE p <= 10 AND (unicode(ch) BETWEEN 19968 AND 40959 OR unicode(ch) BETWEEN 44032 AND 55203)),
t AS (SELECT doc_id, sum(k) AS total, max(k) AS top, count(*) AS kinds FROM k GROUP BY doc_id), v AS (SELECT doc_id, sum(k) FILTER (p <= 3) AS wide, any_value(m) AS m FROM w GROUP BY doc_id)
SELECT c.doc_id, coalesce(c.n >= 10 AND total > 0 AND (top / total > 0.25 OR (coalesce(m, 0) >= 2 AND wide / total > 0.4) OR (kinds / total < 0.08 AND total > 30)), false) AS garbled FROM c LEFT JOIN t USING (doc_id) LEFT JOIN v USING (doc_id)""")
def garbled_texts(spark, sf_dir):
    """Which texts look like those of a broken font; some letters of the documents are spelled by few others."""
    k, text = F.col("doc_id") % 4, F.col("text")
    x = F.when(k == 0, F.translate(F.lower(text), "aeiou", "가가나나가")).when(k == 1, F.regexp_replace(text, "[a-m]", "x")).when(k == 2, F.substring(text, 1, 9)).otherwise(text)
    return _texts(spark, sf_dir).select("doc_id", matching.is_garbled(x).alias("garbled"))


# Entities in names


_ASKS = {"the": "강남점", "of": "김철수M", "and": "서초점과", "to": "회의록", "de": "역삼점", "la": "이영희M"}
_FILES = {"the": "강남점_보고", "of": "근무_김철수m", "and": "역삼점", "de": "서초점", "la": "이영희"}


@r.query(f"""WITH h AS ({_SPARSE} SELECT query, id FROM k WHERE rank <= 10), x AS (SELECT h.query AS item_id, h.id AS doc_id, {_worded("b.text", _ASKS)} AS q, lower(array_to_string(string_split({_worded("d.text", _FILES)}, ' ')[1:10], ' ')) AS name FROM h JOIN benchmark b ON b.item_id = h.query JOIN documents d ON d.doc_id = h.id)
SELECT item_id, doc_id, CASE WHEN len(list_filter(list_concat(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+점'), regexp_extract_all(q, '[가-힣]{{2,4}}M')), lambda x: contains(name, lower(x)))) > 0 THEN 0.12 ELSE 0 END::DOUBLE AS bonus FROM x""")
def entity_bonuses(spark, sf_dir):
    """Whether a retrieved document's name, its first ten words, has a store or a person that the item names."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    hits = stored(_sparse(spark, sf_dir, 10).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id")))
    x = hits.join(b.select("item_id", worded(F.col("text"), _ASKS).alias("q")), "item_id").join(d.select("doc_id", F.array_join(F.slice(F.split(worded(F.col("text"), _FILES), " "), 1, 10), " ").alias("name")), "doc_id")
    return x.select("item_id", "doc_id", ranking.entity_bonus(F.col("q"), F.col("name")).alias("bonus"))


@r.query()
def domain_corrections(spark, sf_dir):
    """Misread words of two to eight syllables, of users' questions, as the frequent words of the documents that they stand for."""
    letters = F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{2,8}"), F.lit(0))).alias("x")
    terms = _texts(spark, sf_dir).select(letters).groupBy(hangul(F.col("x")).alias("word")).agg(F.count("*").alias("n")).where("n >= 20 and length(word) <= 8")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(letters).select(hangul(F.col("x")).alias("word")).distinct()
    return matching.domain_words(asked, stored(terms))
