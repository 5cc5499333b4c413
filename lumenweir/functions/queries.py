"""Column functions over search queries: type, keywords, identifiers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query types in order of priority, each with its patterns.
QUERY_TYPES = {
    "chitchat": [
        r"^안녕\s*(?:하세요|하십니까|히|요|!|$)", r"^(?:하이|헬로|hello|hi|hey)\b", r"^반갑습니다", r"^좋은\s*(?:아침|오후|저녁)", r"^고마워|^감사합니다|^감사해", r"^잘\s*(?:지내|있)",
        r"^수고하세요|^수고했", r"^오랜만", r"^뭐해\s*$|^심심\s*$", r"^ㅎㅎ\s*$|^ㅋㅋ\s*$|^ㅎ+\s*$|^ㅋ+\s*$", r"^네\s*$|^응\s*$|^아니\s*$|^아뇨\s*$", r"^(?:넌|너)\s*(?:누구|뭐야|뭐)", r"^자기\s*소개",
    ],
    "multi_hop": [r"먼저.*다음", r".*한\s*후에", r"순서.*뭐", r"단계.*뭐"],
    "comparative": [r".*vs\s", r"차이.*뭐", r"비교.*해", r".*다른\s*점"],
    "analytical": [r"왜\s", r"원인.*뭐", r"이유.*뭐", r"분석.*해", r"장단점", r"영향.*뭐"],
    "advisory": [r"추천.*해", r"제안.*해", r"어떻게\s*하면", r"방안.*뭐", r"개선.*방법", r".*좋을까"],
    "factual": [
        r"담당자.*누구", r"연락처.*알려", r".*절차.*뭐", r".*방법.*어떻게", r".*정책.*무엇", r".*규정.*뭐", r"누가.*담당", r"어디서.*신청", r"언제.*까지", r"몇.*일", r"얼마.*인가", r"무슨.*이", r"어떤.*있",
        r"담당자", r"관리자", r"정책", r"절차", r"프로세스",
    ],
}


def classified(query: Column) -> Column:
    """(type, confidence): the first type of which a pattern matches, surer with each further one; factual at 0.5 without any."""
    q = F.trim(query)
    out = F.when(q == "", F.struct(F.lit("unknown").alias("type"), F.lit(0.0).alias("confidence")))
    for name, patterns in QUERY_TYPES.items():
        n = sum((q.rlike("(?iu)" + p).cast("int") for p in patterns), F.lit(0))
        out = out.when(n > 0, F.struct(F.lit(name).alias("type"), F.least(F.lit(0.95), 0.7 + 0.1 * n).cast("double").alias("confidence")))
    return out.otherwise(F.struct(F.lit("factual").alias("type"), F.lit(0.5).alias("confidence")))


def keywords(query: Column, stop: list[str] | None = None) -> Column:
    """Words of two or more characters, lower case, without stop words, each once."""
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.array_except(words, F.array(*(F.lit(s) for s in stop))) if stop else words)


def date_tokens(text: Column) -> Column:
    """Days written as yyyy-mm-dd, yyyy.mm.dd or yyyy/mm/dd, as yyyy-mm-dd."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2}[-./](?:0[1-9]|1[0-2])[-./](?:0[1-9]|[12]\d|3[01]))\b"), F.lit(1)), lambda x: F.regexp_replace(x, "[./]", "-"))
