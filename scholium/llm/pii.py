"""Operator 1 [native]: personal data by patterns, checksums and context words.

Only DataFrame functions: patterns propose spans, validators confirm them (Luhn for cards and
device numbers, mod-97 and the country's length for IBANs, number ranges for addresses and
social security numbers), and words near a span move its score: a kind's context words raise
it, words such as "example" lower it. The base kinds (email, ip, card, phone) always stay,
whatever their score. Further kinds stay from ``threshold`` on, so context decides them:

* ``iban``: kept by its checksum alone, dropped beside "example" without a word of context;
* ``ssn``, ``imei`` and ``secret`` (a run of 20 or more letters and digits): kept only beside
  a word of context.

A span's place comes from the text between matches: ``split`` by the pattern gives the gaps,
and gaps and matches add up to positions in code points, block by block, so that a text costs
in proportion to its length and matches. Context is read from the ``reach`` characters of the
gap on either side. Values used more than once are bound by :func:`let`, since an expression
named inside a lambda would be evaluated again for every element.

Java matches unbounded repeated groups by recursion, so the patterns have none: single
separators inside a number, or dots inside a domain, are first replaced one for one by a
marker character, and the chain becomes a run of one character class. Look-behinds and
``\\G`` keep long runs from being tried again at every start.

Defined cases: null and empty text give zero counts, empty strings and the SHA-256 of the
empty string; null or repeated ids are carried as they are; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = chr(0xE000)
BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "imei", "secret")
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: ("NO",),
    16: ("BE",),
    18: ("DK", "FK", "FO", "FI", "GL", "NL", "SD"),
    19: ("MK", "SI"),
    20: ("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"),
    21: ("CH", "HR", "LI", "LV"),
    22: ("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"),
    23: ("AE", "GI", "IL", "IQ", "OM", "SO", "TL"),
    24: ("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"),
    25: ("LY", "PT", "ST"),
    26: ("IS", "TR"),
    27: ("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"),
    28: ("AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "NI", "PL", "SV"),
    29: ("BR", "EG", "PS", "QA", "UA"),
    30: ("JO", "KW", "MU", "YE"),
    31: ("MT", "SC"),
    32: ("LC",),
    33: ("RU",),
}
IBAN_BODY = "|".join(f"(?:{'|'.join(codes)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
# The patterns; those of the base kinds are rewritten as described above.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+MARK-]))[A-Za-z0-9._%+MARK-]++@[A-Za-z0-9-]++MARK[A-Za-z0-9MARK-]++".replace("MARK", MARK)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = "[0-9MARK]{16,}+".replace("MARK", MARK)
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = f"(?<![A-Za-z0-9_])(?:{IBAN_BODY})(?![A-Za-z0-9_])"
SSN = r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"
IMEI = r"(?<![A-Za-z0-9_])[0-9]{15}(?![A-Za-z0-9_])"
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"
IP_PARTS = "^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
SSN_PARTS = "^(00[1-9]|0[1-9][0-9]|[1-578][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])-(0[1-9]|[1-9][0-9])-(000[1-9]|00[1-9][0-9]|0[1-9][0-9][0-9]|[1-9][0-9][0-9][0-9])$"
SECRET_PARTS = "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"
CONTEXT = {
    "email": "e-?mail|contact|@",
    "ip": "ip|server|host|address",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "ssn|social security|taxpayer",
    "imei": "imei|device|handset",
    "secret": "token|secret|passw|api.?key|credential",
}
UNREAL = "example|sample|dummy|placeholder|fictitious"
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4, "imei": 0.4, "secret": 0.4}
RAISE, LOWER = 0.2, 0.3
SPAN = "array<struct<kind:string,start:int,end:int,match:string,near:string>>"
BLOCK = 256


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is evaluated once, however often the body names it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def luhn(number: str) -> str:
    """Luhn's check of a string of digits."""
    digit = "CAST(substring(digits, i, 1) AS INT)"
    twice = f"CASE WHEN (length(digits) - i) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END"
    return let(number, "digits", f"aggregate(sequence(1, greatest(length(digits), 1)), 0, (total, i) -> total + {twice}) % 10 = 0")


def mod97(code: str) -> str:
    """ISO 7064 mod 97-10 of an IBAN without spaces: 1 when valid."""
    c = "ascii(substring(turned, i, 1))"
    step = f"CASE WHEN {c} >= 65 THEN (rest * 100 + {c} - 55) % 97 ELSE (rest * 10 + {c} - 48) % 97 END"
    return let(let(code, "code", "concat(substring(code, 5), substring(code, 1, 4))"), "turned", f"aggregate(sequence(1, length(turned)), 0, (rest, i) -> {step})")


def found(kind: str, text: str, pattern: str, reach: int) -> str:
    """All matches of ``pattern`` as spans of ``kind``, with the text near each."""
    span = "named_struct('kind', '{}', 'start', {}, 'end', {}, 'match', {x}.match, 'near', {x}.near)"
    left = f"zip_with(slice(gaps, 1, size(hits)), hits, (gap, hit) -> named_struct('skip', length(gap), 'left', right(gap, {reach}), 'match', hit))"
    rows = f"zip_with({left}, slice(gaps, 2, size(hits)), (x, gap) -> named_struct('skip', x.skip, 'match', x.match, 'near', concat(x.left, ' ', left(gap, {reach}))))"
    end = "acc.at + x.skip + length(x.match)"
    step = f"named_struct('at', {end}, 'out', concat(acc.out, array({span.format(kind, 'acc.at + x.skip', end, x='x')})))"
    block = f"aggregate(slice(rows, CAST(b AS INT) * {BLOCK} + 1, {BLOCK}), named_struct('at', 0, 'out', CAST(array() AS {SPAN})), (acc, x) -> {step})"
    blocks = let(rows, "rows", f"transform(sequence(0, CAST(floor((size(hits) - 1) / {BLOCK}) AS INT)), b -> {block})")
    join = "named_struct('at', sums.at + part.at, 'out', concat(sums.out, array(named_struct('by', sums.at, 'spans', part.out))))"
    moved = f"transform(p.spans, s -> {span.format(kind, 's.start + p.by', 's.end + p.by', x='s')})"
    start = f"named_struct('at', 0, 'out', CAST(array() AS array<struct<by:int,spans:{SPAN}>>))"
    placed = f"aggregate({blocks}, {start}, (sums, part) -> {join}, sums -> flatten(transform(sums.out, p -> {moved})))"
    bound = let(f"split({text}, r'{pattern}', -1)", "gaps", placed)
    return let(f"regexp_extract_all({text}, r'{pattern}', 0)", "hits", f"CASE WHEN size(hits) > 0 THEN {bound} ELSE CAST(array() AS {SPAN}) END")


def span_column(text: str, reach: int) -> Column:
    """Confirmed spans of all kinds, by kind and then by start. ``text`` is a column's name."""
    plain = f"translate({text}, '{MARK}', '\n')"  # in no pattern
    dotted = rf"regexp_replace({plain}, r'(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])', '{MARK}')"
    joined = f"regexp_replace({plain}, '(?<=[0-9])[ -](?=[0-9])', '{MARK}')"
    digits = "regexp_replace(s.match, '[^0-9]', '')"

    def spans(kind: str, where: str, pattern: str, gate: str, valid: str) -> str:
        """Spans of texts that pass ``gate``, a cheap test that every text with a span passes."""
        return f"CASE WHEN {gate} THEN filter({found(kind, where, pattern, reach)}, s -> {valid}) ELSE CAST(array() AS {SPAN}) END"

    def named(kind: str) -> str:
        return f"{text} RLIKE r'(?i){CONTEXT[kind]}'"

    kinds = (
        spans("email", dotted, EMAIL, f"contains({text}, '@')", "true"),
        spans("ip", text, IP, rf"{text} RLIKE r'[0-9]\.[0-9]++\.[0-9]'", f"s.match RLIKE r'{IP_PARTS}'"),
        spans("card", joined, CARD, f"{text} RLIKE r'[0-9][0-9 -]{{14}}'", f"length({digits}) BETWEEN 16 AND 19 AND {luhn(digits)}"),
        spans("phone", text, PHONE, f"contains({text}, '+')", f"length({digits}) BETWEEN 8 AND 15"),
        spans("iban", text, IBAN, f"{text} RLIKE r'[A-Z]{{2}}[0-9]{{2}}'", f"{mod97("replace(s.match, ' ', '')")} = 1"),
        spans("ssn", text, SSN, f"{named('ssn')} AND {text} RLIKE r'[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'", f"s.match RLIKE r'{SSN_PARTS}'"),
        spans("imei", text, IMEI, f"{named('imei')} AND {text} RLIKE r'[0-9]{{15}}'", luhn("s.match")),
        spans("secret", text, SECRET, named("secret"), f"s.match RLIKE r'{SECRET_PARTS}'"),
    )
    return F.expr(f"concat({', '.join(kinds)})")


def score(span: str) -> str:
    """The kind's prior, raised where words of its context are near and lowered where the span is said to be unreal; 0 to 1."""
    kinds = " ".join(f"WHEN '{k}' THEN {p}D + CASE WHEN near RLIKE r'{CONTEXT[k]}' THEN {RAISE}D ELSE 0D END" for k, p in PRIOR.items())
    return let(f"lower({span}.near)", "near", f"round(CASE {span}.kind {kinds} END - CASE WHEN near RLIKE r'{UNREAL}' THEN {LOWER}D ELSE 0D END, 1)")


def find_pii(docs: DataFrame, reach: int = 32, threshold: float = 0.5) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end, score), start and end in code points, end exclusive."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("body")).withColumn("raw", span_column("body", reach))
    scored = f"transform(raw, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'score', {score('s')}))"
    keep = f"filter({scored}, s -> s.kind IN {BASE} OR s.score >= {threshold}D)"
    return rows.select("doc_id", F.expr(keep).alias("found"))


def digest(found_rows: DataFrame) -> DataFrame:
    """The contract's counts and strings of :func:`find_pii`."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in (*BASE, *MORE)]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("found", lambda s: F.format_string("%.1f", s["score"])), ",")
    total = F.size("found").cast("long").alias("n_spans")
    return found_rows.select("doc_id", *counts, total, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), scores.alias("scores"))


def _sql() -> str:
    """DuckDB SQL with the patterns as the contract states them."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": rf"\b(?:{IBAN_BODY})\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "imei": r"\b[0-9]{15}\b",
        "secret": r"[A-Za-z0-9_]{20,}",
    }  # fixed values
    digits = "regexp_replace(match, '[^0-9]', '', 'g')"
    luhn_of = f"list_aggregate(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN (2 * substr({digits}, i, 1)::INT) // 10 + (2 * substr({digits}, i, 1)::INT) % 10 ELSE substr({digits}, i, 1)::INT END), 'sum') % 10 = 0"
    area = "substr(match, 1, 3)"
    valid = {
        "email": "true",
        "ip": "list_aggregate(list_transform(string_split(match, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) <= 255 THEN 0 ELSE 1 END), 'sum') = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn_of}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": "list_reduce(list_transform(string_split(substr(replace(match, ' ', ''), 5) || substr(replace(match, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1",
        "ssn": f"{area} NOT IN ('000', '666') AND {area} < '900' AND substr(match, 5, 2) <> '00' AND substr(match, 8, 4) <> '0000'",
        "imei": luhn_of,
        "secret": "regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]')",
    }
    parts = []
    for n, (kind, p) in enumerate(patterns.items()):
        parts.append(f"""
SELECT rid, doc_id, {n} AS rank, '{kind}' AS kind, match, end_ - length(match) AS start, end_ AS stop, {PRIOR[kind]} AS prior, '{CONTEXT[kind]}' AS words, near FROM (
  SELECT rid, doc_id, hits[i] AS match, right(gaps[i], 32) || ' ' || left(gaps[i + 1], 32) AS near,
         CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda h: length(h))) AS BIGINT) AS end_
  FROM (SELECT rid, doc_id, regexp_extract_all(body, '{p}') AS hits, string_split_regex(body, '{p}') AS gaps, unnest(range(1, 1 + len(regexp_extract_all(body, '{p}')))) AS i FROM d))
WHERE {valid[kind]}""")
    counts = ", ".join(f"CAST(coalesce(c.n_{k}, 0) AS BIGINT) AS n_{k}" for k in (*patterns, "spans"))
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in patterns)
    moved = f"CASE WHEN regexp_matches(lower(near), words) THEN {RAISE} ELSE 0.0 END - CASE WHEN regexp_matches(lower(near), '{UNREAL}') THEN {LOWER} ELSE 0.0 END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT * FROM (SELECT *, prior + {moved} AS score FROM f) WHERE rank < 4 OR score >= 0.5),
c AS (SELECT rid, {sums}, count(*) AS n_spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (WHERE rank < 4) AS base,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans, string_agg(printf('%.1f', score), ',' ORDER BY rank, start) AS scores FROM s GROUP BY rid)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN c USING (rid)"""


SQL = _sql()
