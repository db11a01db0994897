"""Row-level normalizers as column expressions; only NFKC and entity decoding need Python (Arrow batches)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the reference's normalizers.
ORGANIZATION = r"(?i)\b(university|universit[yéèà]|hospital|institute|institut|academy|college|school|centre|center|laboratory|foundation|clinic)\b"
ORGANIZATION_PRIORITY = ("university", "hospital", "institute", "academy", "college", "center", "centre")
GENERIC_TERMS = ("humans", "human", "male", "female", "adult", "middle aged", "aged", "young adult", "adolescent", "child", "animals", "journal article")
KEYWORD_ALIASES = {
    "artificial intelligence": "Artificial intelligence",
    "large language model": "Large language models",
    "large language models": "Large language models",
    "chatgpt": "ChatGPT",
    "bibliometric analysis": "Bibliometric analysis",
    "bibliometrics": "Bibliometrics",
    "machine learning": "Machine learning",
    "deep learning": "Deep learning",
    "natural language processing": "Natural language processing",
    "generative artificial intelligence": "Generative artificial intelligence",
}
DOCUMENT_TYPES = (
    ("systematic review", "Systematic review"),
    ("meta-analysis", "Meta-analysis"),
    ("review", "Review"),
    ("clinical trial", "Clinical trial"),
    ("preprint", "Preprint"),
    ("research article", "Research article"),
    ("journal article", "Journal article"),
    ("editorial", "Editorial"),
    ("letter", "Letter"),
    ("case reports", "Case report"),
)
LOW_INFORMATION = ("dan", "las", "los", "nda", "two decades", "study", "research", "article", "analysis")


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    import html
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Full case folding, where ``lower`` would differ (ß, final sigma)."""
    return text.map(lambda t: None if t is None else t.casefold())


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """Tags to blanks, entities decoded, NFKC, white space collapsed; null when empty."""
    return F.nullif(squeezed(_decoded(F.regexp_replace(text, "<[^>]+>", " "))), F.lit(""))


def clean_ascii(text: Column) -> Column:
    """:func:`clean_text` without its Python step, for text known to hold no entities and no compatibility characters."""
    return F.nullif(squeezed(F.regexp_replace(text, "<[^>]+>", " ")), F.lit(""))


def normalize_doi(value: Column) -> Column:
    text = F.lower(F.trim(value))
    text = F.regexp_replace(F.regexp_replace(text, r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", "")
    text = F.regexp_replace(text, r"[ .;,]+$", "")
    return F.when(text.rlike(r"^10\.\d{4,9}/\S+$"), text)


def normalize_orcid(value: Column) -> Column:
    text = F.replace(F.trim(value), F.lit("https://orcid.org/"), F.lit(""))
    return F.when(text.rlike(r"^\d{4}-\d{4}-\d{4}-[\dX]{4}$"), text)


def normalize_title(value: Column) -> Column:
    return F.coalesce(squeezed(F.regexp_replace(folded(clean_text(value)), r"(?U)[^\w\s-]+", " ")), F.lit(""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix: and 20 hex digits of the SHA-1 of the folded, stripped parts; null parts count as empty."""
    texts = [F.coalesce(F.trim(folded(p.cast("string"))), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(F.concat_ws("\x1f", *texts).cast("binary")), 1, 20))


def normalize_affiliation(value: Column) -> Column:
    text = F.regexp_replace(clean_text(value), r"\b\S+@\S+\b", "")
    parts = F.transform(F.filter(F.split(text, ","), lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(squeezed(p), r"^[ .;]+|[ .;]+$", ""))
    matched = F.filter(parts, lambda p: p.rlike(ORGANIZATION))

    def first_with(token: str) -> Column:
        return F.try_element_at(F.filter(matched, lambda p: F.contains(F.lower(p), F.lit(token))), F.lit(1))

    found = F.coalesce(*[first_with(t) for t in ORGANIZATION_PRIORITY], F.try_element_at(matched, F.lit(-1)))
    return F.substring(F.when(F.size(matched) > 0, found).otherwise(text), 1, 180)


def normalize_document_type(labels: Column) -> Column:
    """The first priority type that some label contains, else the first label."""
    held = F.filter(F.transform(labels, lambda x: squeezed(x)), lambda x: x.isNotNull() & (x != ""))

    def hit(token: str) -> Column:
        return F.exists(held, lambda x: F.contains(F.lower(x), F.lit(token)))

    chain = reduce(lambda acc, p: F.when(hit(p[0]), p[1]).otherwise(acc), reversed(DOCUMENT_TYPES), F.try_element_at(held, F.lit(1)))
    return F.when(F.size(held) > 0, chain)


def normalize_keyword(value: Column, clean=clean_text) -> Column:
    text = clean(value)
    norm = F.regexp_replace(squeezed(F.replace(F.lower(text), F.lit("_"), F.lit(" "))), r"^[ .;,]+|[ .;,]+$", "")
    acronym = (F.length(text) <= 5) & (text == F.upper(text)) & (text != F.lower(text))
    shown = F.concat(F.upper(F.substring(norm, 1, 1)), F.substring(norm, 2, 1_000_000))
    known = reduce(lambda acc, kv: F.when(norm == kv[0], kv[1]).otherwise(acc), KEYWORD_ALIASES.items(), F.when(acronym, text).otherwise(shown))
    return F.when(text.isNotNull() & ~norm.isin(*GENERIC_TERMS), known)


def date_parts(*dates: Column) -> tuple[Column, Column]:
    """(year, date) of the first non-empty of several ``date-parts`` arrays."""
    parts = F.coalesce(*[F.when(F.size(F.get(d, F.lit(0))) > 0, F.get(d, F.lit(0))) for d in dates])
    texts = [F.lpad(F.get(parts, F.lit(i)).cast("string"), n, "0") for i, n in ((0, 4), (1, 2), (2, 2))]
    return F.get(parts, F.lit(0)).cast("long"), F.when(parts.isNotNull(), F.concat_ws("-", *texts))


def inverted_abstract(index: Column) -> Column:
    """Text of a word -> positions map."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda s: s["word"]), " "), F.lit(""))


def year_of(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"\b((?:18|19|20|21)\d{2})\b", 1), F.lit("")).cast("long")


def split_list(value: Column, separators: str = r";|\|") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), separators), lambda x: F.trim(x)), lambda x: x != "")


def slug(value: Column, most: int = 80) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def completeness(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def citation_label(author: Column, year: Column, doi: Column, title: Column, ident: Column) -> Column:
    """author (year), else DOI, else title, else id."""
    who = F.nullif(F.trim(author), F.lit(""))
    named = F.when(who.isNotNull(), F.when(year.isNotNull(), F.concat(who, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(who))
    return F.coalesce(named, F.nullif(F.trim(doi), F.lit("")), F.nullif(F.trim(title), F.lit("")), ident.cast("string"))


def reference_label(title: Column, author: Column, year: Column) -> Column:
    """Title, else author and year without placeholders, else a fixed label."""

    def told(value: Column) -> Column:
        text = F.trim(value.cast("string"))
        return F.when(~F.lower(text).isin("", "author unknown", "unknown", "0"), text)  # fixed values

    both = F.nullif(F.concat_ws(" ", told(author), told(year)), F.lit(""))
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), both, F.lit("Unresolved reference"))


@F.pandas_udf(StringType())
def normalize_statement(text: pd.Series) -> pd.Series:
    """NFKC, case folded, dashes as hyphens, white space collapsed, no full stops, colons or semicolons at the end."""
    import re
    import unicodedata

    def one(t):
        if t is None:
            return None
        t = re.sub(r"[‐-―−]", "-", unicodedata.normalize("NFKC", t).casefold())
        return re.sub(r"\s+", " ", t).strip().rstrip(" .;:")

    return text.map(one)


def evidence_ids(text: Column) -> Column:
    """All ids E001 in a text, ranges such as E001-E004 expanded, distinct and sorted."""
    spans = F.regexp_extract_all(text, F.lit(r"E\d{3,}(?:\s*[-–—]\s*E\d{3,})?"), F.lit(0))

    def expand(s: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
        low, high = F.get(numbers, F.lit(0)), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0)))
        return F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda n: F.concat(F.lit("E"), F.lpad(n.cast("string"), 3, "0")))).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(spans, expand))))


def wilson_upper(errors: Column, n: Column, z: float = 1.6448536269514722) -> Column:
    p, k = errors / n, z * z
    return F.when(n > 0, F.least(F.lit(1.0), (p + k / (2 * n) + z * F.sqrt(p * (1 - p) / n + k / (4 * n * n))) / (1 + k / n))).otherwise(1.0)


def clopper_pearson_lower(successes: int, n: int, alpha: float = 0.05) -> float:
    """One-sided exact lower bound by bisection on the binomial tail."""
    import math

    if successes <= 0 or n <= 0:
        return 0.0

    def tail(p: float) -> float:
        if p <= 0 or p >= 1:
            return float(p >= 1)
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(successes, n + 1))

    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) < alpha else (low, mid)
    return (low + high) / 2


def hash_fraction(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the SHA-256 of the joined parts."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def is_placeholder(ident: Column) -> Column:
    """Ids whose last part is empty, none, null or nan."""
    return ident.isNull() | F.lower(F.trim(ident)).rlike(r"(^|[:/])\s*(none|null|nan|)/?$")


def tolerant_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def word_tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def low_information(term: Column) -> Column:
    return (F.length(F.trim(term)) < 3) | F.lower(F.trim(term)).isin(*LOW_INFORMATION)


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the JSON of the named columns in name order; stable within this engine."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
