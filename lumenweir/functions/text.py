"""Column functions over text: cleaning, normal forms, n-gram similarity, masking, language and query traits."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on.
SSN = r"(?U)\b\d{6}[- ]?\d{7}\b"
CARD = r"(?U)\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"
PHONE = r"(?U)\b01[016789][- ]?\d{3,4}[- ]?\d{4}\b"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
DEPRECATED = r"(?i)\bdeprecated\b|\bobsolete\b|폐기|중단|사용\s*금지"
PARTICLES_LONG, PARTICLES_SHORT = ("에서", "으로", "까지", "부터", "처럼", "같이", "에게", "한테", "보다"), "가를에의는은도와과이로만서"


#: All characters that Unicode calls white space, and the four separators of ASCII.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.btrim(c, F.lit(SPACES))


def trimmed(c: Column) -> Column:
    """Without white space at either end; null as empty."""
    return stripped(F.coalesce(c, F.lit("")))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words between white space; none of an empty text."""
    return F.filter(F.split(F.lower(squeezed(c)), " "), lambda x: x != "")


def mask_pii(c: Column) -> Column:
    """Resident numbers, cards, phones and e-mails, in this order, as tags."""
    for pattern, tag in ((SSN, "[SSN]"), (CARD, "[CARD]"), (PHONE, "[PHONE]"), (EMAIL, "[EMAIL]")):
        c = F.regexp_replace(c, pattern, tag)
    return c


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.lower(stripped(c)), 256), 1, 32)


def chunk_fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(stripped(c), 256), 1, 16)


def percent_bucket(*parts: Column) -> Column:
    """A stable number from 0 to 99 from lower-cased, trimmed parts."""
    joined = F.concat_ws("||", *(F.lower(F.trim(p)) for p in parts))
    return (F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def nfc(c: Column) -> Column:
    """Composed characters, canonically; no built-in does this. Arrow batches, not rows, go to Python."""
    return F.pandas_udf(_nfc, "string")(c)


def _nfc(c):
    return c.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalized_term(c: Column) -> Column:
    """Spaces and underscores as hyphens, runs of them as one, lower case, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"[\s_]+", "-"), r"-{2,}", "-")), r"^-+|-+$", "")


def comparable_term(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[-\s_]", "")


def initials(c: Column) -> Column:
    """The first letters of a term's words, upper case."""
    return F.upper(F.array_join(F.transform(F.filter(F.split(F.trim(c), r"[\s\-_]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))


def is_abbreviation(c: Column) -> Column:
    return c.rlike(r"^[A-Z][A-Z0-9&]{1,9}$")


def strip_particles(c: Column) -> Column:
    """Without particles at the end, the longer first, as long as three characters before the particle are there; three at
    most follow one another."""
    for _ in range(3):
        c = F.regexp_replace(c, f"^(.{{3,}}?)({'|'.join(PARTICLES_LONG)}|[{PARTICLES_SHORT}])$", "$1")
    return c


def search_term(c: Column) -> Column:
    """Lower case, signs, hyphens and underscores as spaces."""
    return F.lower(squeezed(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s-]", " "), "[_-]", " ")))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is one itself. The text, and its characters, are made once: a substring is found
    from the text's beginning each time, which costs the square of its length."""

    def many(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))

    def grams(x: Column) -> Column:
        chars = F.array(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)))
        return F.array_distinct(F.when(F.length(x) >= n, F.transform(chars, many)[0]).otherwise(F.array(x)))

    return F.transform(F.array(c), grams)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def lexical_score(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return 0.7 * jaccard(char_ngrams(a), char_ngrams(b)) + 0.3 * normalized_levenshtein(a, b)


def script_language(c: Column) -> Column:
    """ko, en or mixed by the share of Hangul among letters; unknown without letters."""
    ko, en = F.regexp_count(c, F.lit("[가-힣]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    share = ko / (ko + en)
    return F.when(ko + en == 0, "unknown").when(share >= 0.7, "ko").when(share <= 0.3, "en").otherwise("mixed")


def shingles(w: Column, n: int = 3) -> Column:
    """Distinct runs of n words, joined by a space, of an array of words; a shorter array is one run. Best over a column of
    its own: the words are zipped with themselves, shifted, and so read n times."""
    runs = w
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - k, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    runs = F.when(F.size(w) >= n, F.filter(runs, lambda x: x.isNotNull())).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(runs)


def word_shingles(c: Column, n: int = 3) -> Column:
    return shingles(tokens(c), n)


def clean_for_embedding(c: Column) -> Column:
    """Without tags and control characters; spaces as one, blank lines at most one."""
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return stripped(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\S\n]+", " "), r"\n{3,}", "\n\n"))


def noise_score(c: Column) -> Column:
    """The share of characters that are neither letters, digits, white space nor plain punctuation."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"[^0-9A-Za-z가-힣À-ÿ\s.,!?()\-]")) / F.length(c)).otherwise(0.0)


def truncated(c: Column, most: int = 8000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def lead_summary(c: Column, most: int = 200) -> Column:
    """The start of a text, up to the last end of a sentence: the first kind of end that is last found beyond place 50."""
    lead, out = stripped(F.substring(c, 1, most)), None
    for end in (".", "。", "\n", "다.", "요."):
        at = F.length(lead) - F.instr(F.reverse(lead), end[::-1]) - len(end) + 1
        found = (F.instr(lead, end) > 0) & (at > 50)
        cut = F.substring(lead, F.lit(1), at + 1)
        out = F.when(found, cut) if out is None else out.when(found, cut)
    return F.when(F.length(c) <= most, stripped(c)).otherwise(out.otherwise(lead))


def lucene_or(c: Column, most: int = 10) -> Column:
    """Words joined by OR for a full-text index, without its signs and operators."""
    plain = F.split(squeezed(F.regexp_replace(c, r'[+\-&|!(){}\[\]^"~*?:\\/]', " ")), " ")
    words = F.filter(plain, lambda x: (x != "") & ~F.upper(x).isin("AND", "OR", "NOT"))
    return F.array_join(F.slice(words, 1, most), " OR ")


def specificity(c: Column) -> Column:
    """How specific a query is: distinct words, length and longer words."""
    w = F.filter(F.split(squeezed(c), " "), lambda x: x != "")
    n = F.size(w)
    unique = F.size(F.array_distinct(w)) / n
    length = F.least(n / F.lit(10.0), F.lit(1.0))
    keywords = F.size(F.filter(w, lambda x: F.length(x) >= 3)) / n
    return F.when(n == 0, 0.0).otherwise(0.4 * unique + 0.3 * length + 0.3 * keywords)
