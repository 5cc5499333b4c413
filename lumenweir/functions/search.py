"""Column functions over search queries and answers: normal forms, identifiers, time expressions, keys, masks and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed, stripped

# Patterns, words and tables that results depend on.
IDENTIFIERS = (r"\d{1,3}(?:,\d{3})+", r"[A-Z]+-\d{3,}", r"[A-Z]{2}\d{3}", r"E-\d{4}", r"[\w\-\.]+\.(?:xml|java|py|json|yaml|yml|properties|sql|csv|xlsx)", r"[A-Z][a-z]+(?:[A-Z][a-z]+){2,}")
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "up", "about", "into", "over", "after", "and", "or", "but", "not", "this", "that", "these", "those", "it", "its",
    "what", "which", "who", "whom", "when", "where", "why", "how",
    "은", "는", "이", "가", "을", "를", "의", "에", "에서", "로", "으로", "와", "과", "도", "만", "뿐", "부터", "까지", "하다", "되다", "있다", "없다", "것", "수", "등",
    "대해", "대해서", "대한", "관한", "관해", "관해서", "해서", "하고", "합니다", "입니다", "습니다", "에요", "이에요", "같은", "어떤", "어떻게", "무엇", "알고", "싶어", "알고싶어", "알려", "알려줘", "알려주세요", "궁금",
)
PERSON_STOP_WORDS = ("이행에", "대하여", "위하여", "관하여", "통하여", "인하여", "따르면", "따라서", "있는", "없는", "이러한", "같은", "다른", "그러나", "그리고", "그러면", "그래서", "하지만", "또는", "그것을", "이것을", "저것을", "어떤", "모든", "각각")
PERSON_PARTICLES = "에의을를이가은는로과와도만께랑"
NAMESPACE = "a1b2c3d4e5f67890abcdef1234567890"
NOTIFICATION_MASKS = (
    (r"/etc/[^\s]*", "/etc/<MASKED>"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"), (r"\b(\d{1,3}\.){3}\d{1,3}\b", "<IP>"), (r"\b[a-f0-9]{32,64}\b", "<HEX>"),
)
GENERALITY = (
    r"매장\s*번호", r"점포\s*코드", r"[A-Z]{2,}\d{3,}", r"\d{4}년", r"\d{1,2}월\s*\d{1,2}일", "오늘|어제|내일|그제|모레", r"이번\s*주|지난\s*주|다음\s*주", r"[가-힣]{2,4}\s*(님|씨|과장|대리|매니저|팀장|점장)",
)
NOT_STORES = ("편의점", "시점", "관점", "장점", "약점", "특점", "요점", "중점", "거점", "지점")
NO_ANSWER = (
    "^제공된 문서들?에는 .*포함되어 있지 않", "^제공된 문서들?.*직접적인 .*정보.*찾을 수 없", "^직접적인 .*정보를 .*찾을 수 없", "^현재 제공된 정보로는 .*어렵", "관련 부서에 문의", "확인 후 답변", "정보를 찾을 수 없습니다", "해당 정보가 없",
    "관련 자료가 충분하지 않", "답변을 드리기 어렵", "확인이 필요합니다", "담당자에게 문의.*바랍니다$",
)
SECTION_MARKS = (("document", ("문서 기반", "출처", "인용")), ("inference", ("분석", "추론", "해석")), ("general", ("권장 사항", "일반", "참고")))
NO_SOURCES = "검색된 근거 문서 없이"
NO_PREVIEW = "본문 미리보기를 제공할 수 없습니다."


def words_of(c: Column) -> Column:
    """Words between white space, none empty."""
    return F.filter(F.split(squeezed(c), " "), lambda x: x != "")


def normalized_query(c: Column) -> Column:
    """White space as one space, none at the ends or before punctuation."""
    return F.regexp_replace(squeezed(c), r"\s+([,.:;!?])", "$1")


def identifiers(c: Column) -> Column:
    """Amounts, ticket keys, store and error codes, file names and CamelCase names, by kind in this order."""
    return F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in IDENTIFIERS))


def query_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits or of Hangul, without stop words."""
    return F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+|[가-힣]+"), F.lit(0)), lambda x: ~F.lower(x).isin(*STOP_WORDS))


def compound_parts(c: Column) -> Column:
    """The ASCII and Hangul runs of each word; a word without any is taken whole from two characters on."""
    parts = lambda w: F.regexp_extract_all(w, F.lit("[a-zA-Z0-9]+|[가-힣]+"), F.lit(0))
    return F.flatten(F.transform(words_of(c), lambda w: F.when(F.size(parts(w)) > 0, parts(w)).when(F.length(w) >= 2, F.array(w)).otherwise(F.array().cast("array<string>"))))


def likely_person(c: Column) -> Column:
    """Two to four Hangul syllables, no stop word; of up to three, none that ends in a particle."""
    return c.rlike("^[가-힣]{2,4}$") & ~c.isin(*PERSON_STOP_WORDS) & ~((F.length(c) <= 3) & c.rlike(f"[{PERSON_PARTICLES}]$"))


def week_of_month(d: Column) -> Column:
    """Year, month and week of the month as a Korean phrase."""
    return F.concat(F.year(d), F.lit("년 "), F.month(d), F.lit("월 "), F.floor((F.dayofmonth(d) - 1) / 7) + 1, F.lit("주차"))


def resolved_time(c: Column, now: Column) -> Column:
    """Relative weeks and months as absolute ones, seen from a date."""
    month = lambda d: F.concat(F.year(d), F.lit("년 "), F.month(d), F.lit("월"))
    week = {"차주": 7, "다음 주": 7, "이번 주": 0, "금주": 0, "지난 주": -7, "전주": -7}
    for phrase, days in week.items():
        c = F.replace(c, F.lit(phrase), week_of_month(F.date_add(now, days)))
    for phrase, months in {"이번 달": 0, "이번달": 0, "지난 달": -1, "지난달": -1, "다음 달": 1}.items():
        c = F.replace(c, F.lit(phrase), month(F.add_months(F.trunc(now, "month"), months)))
    return c


def week_filters(c: Column) -> Column:
    """A struct (kind, filters) from the first kind of week or date that the query names: A, E, D3, D1, or none."""
    part = lambda p, i: F.regexp_extract(c, p, i).cast("int").cast("string")
    two = lambda x: F.lpad(x, 2, "0")
    a, e, d1 = r"(\d{1,2})월\s*(\d{1,2})주차", r"(\d{4})년\s*(\d{1,2})주차", r"(\d{1,2})월\s*(\d{1,2})일"
    iso, ko = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
    m, w = part(a, 1), part(a, 2)
    day = lambda p: F.array(F.concat_ws("-", F.regexp_extract(c, p, 1), two(part(p, 2)), two(part(p, 3))))
    weeks = F.array(F.concat(m, F.lit("월 "), w, F.lit("주차")), F.concat(two(m), F.lit("월 "), two(w), F.lit("주차")), F.concat(two(m), F.lit("월 0"), w, F.lit("주차")), F.concat(m, F.lit("월 0"), w, F.lit("주차")))
    kind = F.when(c.rlike(a), "A").when(c.rlike(e), "E").when(c.rlike(iso) | c.rlike(ko), "D3").when(c.rlike(d1), "D1").otherwise("")
    filters = F.when(c.rlike(a), weeks).when(c.rlike(e), F.array(F.concat_ws("_", F.regexp_extract(c, e, 1), two(part(e, 2))))).when(c.rlike(iso), day(iso)).when(c.rlike(ko), day(ko))
    filters = filters.when(c.rlike(d1), F.array(F.concat(two(part(d1, 1)), F.lit("월")))).otherwise(F.array().cast("array<string>"))
    return F.struct(kind.alias("kind"), filters.alias("filters"))


def date_in_name(name: Column, month: Column, day: Column) -> Column:
    """Whether a date is in the (MM/DD~MM/DD) range of a name; a name without a range that names a week counts."""
    span = r"\((\d{2})/(\d{2})\s*~\s*(\d{2})/(\d{2})\)"
    m1, d1, m2, d2 = (F.regexp_extract(name, span, i).cast("int") for i in range(1, 5))
    inside = F.when(m1 == m2, (month == m1) & day.between(d1, d2)).when(month == m1, day >= d1).when(month == m2, day <= d2).otherwise(False)
    return F.when(name.rlike(span), inside).otherwise(F.contains(name, F.lit("주차")))


def cache_key(query: Column, kbs: Column, prefix: str = "knowledge", top_k: int = 0) -> Column:
    """prefix, a hash of the sorted bases if there are any, and one of the lower-cased query with bases and top_k."""
    bases = F.array_join(F.array_sort(kbs), ",")
    some = F.size(kbs) > 0
    raw = F.concat(squeezed(F.lower(query)), F.when(some, F.concat(F.lit("::"), bases)).otherwise(""), F.lit(f"::top_k={top_k}" if top_k else ""))
    own = F.substring(F.sha2(raw, 256), 1, 16)
    return F.when(some, F.concat_ws(":", F.lit(prefix), F.substring(F.sha2(bases, 256), 1, 8), own)).otherwise(F.concat_ws(":", F.lit(prefix), own))


def request_hash(query: Column, kbs: Column) -> Column:
    bases = F.when(F.size(kbs) > 0, F.concat(F.lit("::"), F.array_join(F.array_sort(kbs), ","))).otherwise("")
    return F.substring(F.sha2(F.concat(stripped(F.lower(query)), bases), 256), 1, 24)


def name_uuid(c: Column, namespace: str = NAMESPACE) -> Column:
    """A version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def inject_score(query: Column, name: Column) -> Column:
    """By how many of the query's words of two letters or more a document's name holds."""
    n = F.size(F.filter(words_of(F.lower(query)), lambda w: (F.length(w) >= 2) & F.contains(F.lower(name), w)))
    return F.when(n >= 2, 0.75).when(n == 1, 0.55).otherwise(0.35)


def mask_notification(c: Column) -> Column:
    for pattern, tag in NOTIFICATION_MASKS:
        c = F.regexp_replace(c, pattern, tag)
    return c


def generality(c: Column) -> Column:
    """How general a question is: less for each kind of store, date or person, and each store name, that it has."""
    kinds = reduce(lambda a, b: a + b, (c.rlike(p).cast("int") for p in GENERALITY))
    stores = F.size(F.filter(F.regexp_extract_all(c, F.lit(r"(?U)[가-힣]{2,}점\b"), F.lit(0)), lambda x: ~x.isin(*NOT_STORES)))
    n = kinds + stores
    return F.when(n >= 3, 0.1).when(n == 2, 0.3).when(n == 1, 0.5).otherwise(1.0)


def strict_score(c: Column) -> Column:
    """A number from 0 to 1 that is all of the first line that isn't blank; else 0.5."""
    line = F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([^\n]*)", 1))
    return F.when(line.rlike(r"^(0(\.\d+)?|1(\.0+)?)$"), line.try_cast("double")).otherwise(0.5)


def clean_answer(c: Column) -> Column:
    """Without references, Markdown, phrases about the source, and surplus white space."""
    c = F.regexp_replace(c, r"\[(\d+|문서\s*\d+)\]", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"#{1,4}\s*", ""), r"\*{1,2}([^*]+)\*{1,2}", "$1"), "---+", "")
    c = F.regexp_replace(c, "제공된 문서[들]?[에서을를]*\\s*(따르면|종합하[면여]|바탕으로|분석한 결과)", "")
    return stripped(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), "  +", " "))


def character_overlap(a: Column, b: Column) -> Column:
    """The share of the longer text that characters of the shorter one, found in it, make up; of equal lengths the first is the longer."""
    a, b = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    found = F.size(F.filter(F.filter(F.split(a, ""), lambda x: x != ""), lambda x: F.contains(b, x)))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), found / F.length(b)).otherwise(0.0)


def valid_variation(text: Column, original: Column) -> Column:
    """Eight to 200 characters, and not (nearly) the original."""
    return F.length(text).between(8, 200) & (text != original) & (character_overlap(text, original) <= 0.9)


def content_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    return F.array_distinct(F.filter(words_of(F.regexp_replace(c, r"(?U)[^\w\s]", " ")), lambda x: (F.length(x) >= 2) & (~x.isin(*stop) if stop else F.lit(True))))


def answer_leak(variation: Column, original: Column, answer: Column, least: float = 0.3) -> Column:
    """Whether so large a share of the words that a variation adds to a question are words of the answer, or hold one of three letters or more."""
    old = content_tokens(original)
    new, told = F.array_except(content_tokens(variation), old), F.array_except(content_tokens(answer), old)
    leaked = F.filter(new, lambda x: F.exists(told, lambda y: (x == y) | ((F.length(y) >= 3) & F.contains(x, y))))
    return F.when(F.size(new) > 0, F.size(leaked) / F.size(new) >= least).otherwise(False)


def is_no_answer(answer: Column, chunks: Column, disclaimer: Column | None = None) -> Column:
    """Whether an answer should be replaced: blank, without chunks, with a disclaimer that there were no sources, or a short text of
    a pattern that says nothing."""
    plain = squeezed(answer)
    says = reduce(lambda a, b: a | b, (plain.rlike(f"(?iu){p}") for p in NO_ANSWER))
    unsourced = F.lit(False) if disclaimer is None else F.coalesce(F.contains(disclaimer, F.lit(NO_SOURCES)), F.lit(False))
    return (plain == "") | (chunks == 0) | unsourced | ((F.length(plain) <= 200) & says)


def grounded_snippet(c: Column, most: int = 180) -> Column:
    plain = squeezed(c)
    return F.when(plain == "", NO_PREVIEW).when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…")))


def top_section(path: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(path, F.lit("")), " > "), 1))


def citation_refs(c: Column) -> Column:
    """The numbers in brackets that a text names, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))))


def citation_line(ref: Column, name: Column, uri: Column, score: Column) -> Column:
    head = F.concat(F.lit("["), ref, F.lit("] "))
    body = F.when(F.coalesce(uri, F.lit("")) != "", F.concat(F.lit("["), name, F.lit("]("), uri, F.lit(")"))).otherwise(name)
    return F.concat(head, body, F.when(score.isNotNull(), F.concat(F.lit(" (score="), F.format_string("%.2f", score), F.lit(")"))).otherwise(""))


def line_source(line: Column) -> Column:
    """What a line of an answer says it rests on, by its mark in brackets; null without one."""
    return F.coalesce(*(F.when(line.rlike("|".join(rf"\[{w}\]" for w in words)), kind) for kind, words in SECTION_MARKS))


def in_order(*terms: Column) -> Column:
    """Single terms and arrays of them as one array, each once, in the order of its first place."""
    return F.array_distinct(F.array_compact(F.concat(*terms)))
