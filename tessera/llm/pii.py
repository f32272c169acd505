"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

All of it is built-in column functions. Positions come from cutting the text at the matches: the
lengths of the pieces and of the matches, added up, are the offsets, in code points.

The four base kinds and their patterns are fixed by the contract; possessive quantifiers and guards
only keep the matcher from trying starts that cannot match, so that time stays linear in the text.
The method adds IBANs (mod-97), payment cards of 13 to 15 digits (Luhn and a word such as "visa"
nearby) and social security numbers (only with a word nearby).

Defined results: a null text counts as empty; an empty text has no spans; an empty table gives an
empty result; repeated rows each give their row; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, with pattern, cheap test that a match is possible, confidence.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", 0.9),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digits", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "digits", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+') and digits", 0.6),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "digits", 0.9),
    "short_card": (r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9])", "digits", 0.4),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digits", 0.4),
}
BASE = ("email", "ip", "card", "phone")
#: Words that raise the score of a span when they stand near it, and that lower it.
CONTEXT = {
    "email": ("e-?mail|contact|write to", "example"),
    "ip": ("address|host|server|\\bip\\b", "version|release|section"),
    "card": ("card|visa|master|amex|credit|debit|payment", "order|serial|isbn|tracking"),
    "phone": ("phone|tel|call|mobile|fax", "order|serial|version"),
    "iban": ("iban|bank|account|transfer", "serial|version"),
    "short_card": ("card|visa|amex|diners|credit|debit", "order|serial|isbn|tracking"),
    "ssn": ("social security|\\bssn\\b", "serial|version|part"),
}
#: Code points looked at on either side of a span, and what a word found there adds or takes.
NEAR, STEP = 40, 0.15
#: Added kinds are reported from this score on.
LEAST = 0.5


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _mod97(x: str) -> str:
    """The remainder of an IBAN, four leading characters moved to the end and letters as 10 to 35."""
    plain = f"replace({x}, ' ', '')"
    turned = f"concat(substr({plain}, 5), substr({plain}, 1, 4))"
    value = "(case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)"
    return f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (r, c) -> cast((r * (case when c between '0' and '9' then 10 else 100 end) + {value}) % 97 as int))"


#: What confirms a proposed span, of x.m, its text.
CONFIRM = {
    "email": "true",
    "ip": r"not exists(split(x.m, r'\.'), p -> not p rlike '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
    "card": f"length({_digits('x.m')}) between 16 and 19 and luhn_check({_digits('x.m')})",
    "phone": f"length({_digits('x.m')}) between 8 and 15",
    "iban": f"length(replace(x.m, ' ', '')) between 15 and 34 and {_mod97('x.m')} = 1",
    "short_card": f"length({_digits('x.m')}) between 13 and 15 and luhn_check({_digits('x.m')})",
    "ssn": "not x.m rlike '^(?:000|666|9)' and not x.m rlike '-00-' and not x.m rlike '0000$'",
}
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _spans(kind: str) -> Column:
    pattern, possible, base = KINDS[kind]
    up, down = CONTEXT[kind]
    cut = f"arrays_zip(split(t, r'{pattern}', -1), regexp_extract_all(t, r'{pattern}', 0))"
    # A match is confirmed where it is found, so that the list holds spans only and not every number of the text.
    one = "named_struct('s', a.at + length(z['0']), 'e', a.at + length(z['0']) + length(z['1']), 'm', z['1'])"
    found = f"""aggregate({cut},
        named_struct('at', 0L, 'out', cast(array() as array<struct<s:bigint,e:bigint,m:string>>)),
        (a, z) -> if(z['1'] is null, a, named_struct('at', a.at + length(z['0']) + length(z['1']),
            'out', concat(a.out, filter(array({one}), x -> {CONFIRM[kind]})))),
        a -> a.out)"""
    near = f"lower(substring(t, cast(greatest(x.s - {NEAR}, 0) + 1 as int), cast(x.e - x.s + 2 * {NEAR} as int)))"
    score = f"round(least(1D, greatest(0D, {base}D + if({near} rlike r'{up}', {STEP}D, 0D) - if({near} rlike r'{down}', {STEP}D, 0D))), 4)"
    spans = f"transform({found}, x -> named_struct('kind', '{kind}', 'start', x.s, 'end', x.e, 'score', {score}))"
    if kind not in BASE:
        spans = f"filter({spans}, x -> x.score >= {LEAST})"
    return F.expr(f"case when {possible} then {spans} else cast(array() as {SPAN}) end")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end, score), by kind in the order of KINDS, then start."""
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    text = text.withColumn("digits", F.col("t").rlike("[0-9]"))
    for kind in KINDS:
        text = text.withColumn(f"__{kind}", _spans(kind))
    return text.select("doc_id", F.concat(*[F.col(f"__{k}") for k in KINDS]).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from what ``find`` returns."""
    listed = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    base = "filter(found, x -> x.kind in ('email', 'ip', 'card', 'phone'))"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.expr(f"sha2({listed.format(base)}, 256)").alias("base_sha256"), F.expr(listed.format("found")).alias("spans"), F.expr("array_join(transform(found, x -> cast(x.score as string)), ',')").alias("scores"))
