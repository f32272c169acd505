"""Detection and masking of secrets in text, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detectors in order: type, pattern, confidence.
DETECTORS = (
    ("PEM_KEY", r"(?i)-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z ]+ )?PRIVATE KEY-----", 1.0),
    ("AUTH_BEARER", r"(?i)(\bAuthorization\s*:\s*Bearer\s+)[A-Z0-9._+/=-]+", 0.95),
    ("KEY_VALUE", r"""(?i)((?:api[_-]?key|token|secret|password)[A-Z0-9_-]*\b\s*[:=]\s*)(?:"[^"]*"|'[^']*'|[^\s'";]+)""", 0.85),
    ("JWT", r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{8,}+", 0.95),
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.90),
    ("CREDIT_CARD", r"(?<!\d)(?:\d[ -]*){13,19}(?!\d)", 0.98),
)
#: Of these the first group stands before the secret and is not part of it.
PREFIXED = ("AUTH_BEARER", "KEY_VALUE")
#: What must be in a text for a detector to look at it; telling that costs little.
HINTS = {"PEM_KEY": r"PRIVATE KEY", "AUTH_BEARER": r"(?i)bearer", "KEY_VALUE": r"(?i)key|token|secret|password", "JWT": r"\.", "EMAIL": "@", "CREDIT_CARD": r"\d[ -]*\d"}
#: The card as the masking by turns takes it: as short as it can be.
SHORT_CARD = r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"
MASK = "[REDACTED]"
BLOCK_AT, MASK_AT = 0.90, 0.60
FULL_WIDTH = "".join(map(chr, (*range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A))))
HALF_WIDTH = "abcdefghijklmnopqrstuvwxyz0123456789"
SPAN = "array<struct<type:string,start:int,end:int,confidence:double>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used there."""
    return F.transform(F.array(value), then)[0]


#: Marks around a match, from Unicode's noncharacters; texts that hold them are looked at with other ones in their place.
OPENS, SPLITS, CLOSES, OTHER = "\ufdd0", "\ufdd1", "\ufdd2", "\ufffd"


def marked(text: Column) -> Column:
    """The text as the detectors look at it."""
    return F.translate(text, OPENS + SPLITS + CLOSES, OTHER * 3)


def spans_of(text: Column, kind: str, pattern: str, confidence: float) -> Column:
    """Leftmost matches as (type, start, end, confidence). The pattern passes the text once: it puts marks around its matches, and lengths between them are offsets.

    What stands before a secret, and quotes around it, are no part of its span; cards must pass Luhn's check.
    """
    none = F.array().cast(SPAN)
    put = f"{OPENS}{'$1' if kind in PREFIXED else ''}{SPLITS}$0{CLOSES}"

    def step(a: Column, p: Column) -> Column:
        head, found = F.substring_index(p, SPLITS, 1), F.substring_index(F.substring_index(p, CLOSES, 1), SPLITS, -1)
        begin, end = a["at"] + F.length(head), a["at"] + F.length(found)
        if kind in PREFIXED:
            quotes = F.when(F.substring(found, F.length(head) + 1, F.lit(1)).isin('"', "'"), 1).otherwise(0)
            begin, inner = begin + quotes, end - quotes
        else:
            inner = end
        one = F.array(F.struct(F.lit(kind).alias("type"), begin.alias("start"), inner.alias("end"), F.lit(confidence).alias("confidence")))
        if kind == "CREDIT_CARD":
            one = F.when(F.call_function("luhn_check", F.regexp_replace(found, r"\D", "")), one).otherwise(none)
        return F.struct((end + F.length(F.substring_index(p, CLOSES, -1))).alias("at"), F.concat(a["out"], one).alias("out"))

    def told(parts: Column) -> Column:
        start = F.struct(F.length(parts[0]).alias("at"), none.alias("out"))
        return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda a: a["out"])).otherwise(none)

    found = once(F.split(F.regexp_replace(text, pattern, put), OPENS, -1), told)
    return F.when(text.rlike(HINTS[kind]), found).otherwise(none) if kind in HINTS else found


def fold_width(text: Column | str) -> Column:
    """Lower case, full-width letters and digits made half-width."""
    return F.translate(F.lower(_col(text)), FULL_WIDTH, HALF_WIDTH)


def dictionary_spans(text: Column | str, deny: tuple[str, ...], allow: tuple[str, ...] = (), words: bool = False, confidence: float = 0.80) -> Column:
    """Every place of a denied term, overlapping ones too, or whole words only."""
    folded, parts = fold_width(text), [F.array().cast(SPAN)]
    for term in deny:
        if term in allow:
            continue
        marks = [c if c.isalnum() or c == " " else "\\" + c for c in term]
        if words:
            parts.append(spans_of(folded, "DICTIONARY", rf"\b{''.join(marks)}\b", confidence))
        else:
            # The first letter, where the others follow: places may overlap, and the text is passed once.
            starts = spans_of(folded, "DICTIONARY", marks[0] + (f"(?={''.join(marks[1:])})" if marks[1:] else ""), confidence)
            parts.append(F.transform(starts, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), (s["start"] + len(term)).alias("end"), s["confidence"].alias("confidence"))))
    return F.concat(*parts)


#: Detectors by name, in the order in which they look; more can be registered.
REGISTRY: dict[str, Callable[[Column], Column]] = {d[0]: (lambda text, d=d: spans_of(text, *d)) for d in DETECTORS}


def register(name: str, detector: Callable[[Column], Column]) -> None:
    """Add a detector: from a text column to its spans."""
    if name in REGISTRY:
        raise ValueError(f"there is a detector {name}")
    REGISTRY[name] = detector


def unregister(name: str) -> None:
    """Take a detector away; columns made with it stay as they are."""
    REGISTRY.pop(name, None)


def detect(text: Column | str, only: tuple[str, ...] | None = None) -> Column:
    """All findings of the detectors, or of those named, in their order."""
    said = F.coalesce(_col(text), F.lit(""))
    return once(marked(said), lambda x: F.concat(*[f(x) for name, f in REGISTRY.items() if only is None or name in only], F.array().cast(SPAN)))


def counts(spans: Column, kinds: tuple[str, ...]) -> Column:
    """A struct of how many findings there are of each kind, by one pass of the spans."""
    names = [f"n_{k.lower()}" for k in kinds]
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    return F.aggregate(spans, start, lambda a, s: F.struct(*[(a[n] + F.when(s["type"] == k, 1).otherwise(0)).alias(n) for n, k in zip(names, kinds)]))


def resolve_overlaps(spans: Column) -> Column:
    """By start, then falling confidence, then as they were found; a span that overlaps the last kept one replaces it only if it is surer."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (-s["confidence"]).alias("less"), i.alias("nth"), s.alias("span")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["span"])

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when(F.size(kept) == 0, F.array(s)).when((s["start"] >= last["end"]) | (s["end"] <= last["start"]), F.concat(kept, F.array(s))).when(s["confidence"] > last["confidence"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))).otherwise(kept)

    return F.aggregate(ordered, F.array().cast(SPAN), step)


def mask(text: Column | str, spans: Column, with_: str = MASK, least: float = MASK_AT) -> Column:
    """The text with all spans of at least that confidence replaced; they must not overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def told(said: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            return F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(said, a["at"] + 1, s["start"] - a["at"]), F.lit(with_)).alias("out"))

        return F.aggregate(F.filter(spans, lambda s: s["confidence"] >= least), start, step, lambda a: F.concat(a["out"], F.substring(said, a["at"] + 1, F.length(said))))

    return once(F.coalesce(_col(text), F.lit("")), told)


def policy(text: Column | str, spans: Column, mode: str = "enforce", block_at: float = BLOCK_AT) -> Column:
    """Struct (text, blocked): ``off`` changes nothing, ``report`` only tells, ``enforce`` masks and blocks."""
    if mode != "enforce":
        return F.struct(_col(text).alias("text"), F.lit(False).alias("blocked"))

    def told(found: Column) -> Column:
        blocked = F.coalesce(F.array_max(F.transform(found, lambda s: s["confidence"])) >= block_at, F.lit(False))
        return F.struct(mask(text, found).alias("text"), blocked.alias("blocked"))

    return once(spans, told)


def mask_in_turn(text: Column | str, with_: str = MASK) -> Column:
    """Mask kind after kind, each on what the one before left, which is computed once."""
    said, put = F.coalesce(_col(text), F.lit("")), with_.replace("$", r"\$")

    def turn(kind: str, pattern: str, confidence: float) -> Callable[[Column], Column]:
        if kind == "CREDIT_CARD":
            return lambda x: F.when(x.rlike(HINTS[kind]), mask(x, spans_of(marked(x), kind, SHORT_CARD, confidence), with_, 0.0)).otherwise(x)
        if kind == "KEY_VALUE":
            key = pattern.split("(?:\"")[0]
            masked = [(key + '"[^"]*"', f'$1"{put}"'), (key + "'[^']*'", f"$1'{put}'"), (key + r"[^\s'\";]+", f"$1{put}")]
        else:
            masked = [(pattern, ("$1" if kind in PREFIXED else "") + put)]

        def told(x: Column) -> Column:
            out = x
            for p, by in masked:
                out = F.regexp_replace(out, p, by)
            return F.when(x.rlike(HINTS[kind]), out).otherwise(x)

        return told

    for d in DETECTORS:
        said = once(said, turn(*d))
    return said


def without_allowed(text: Column | str, spans: Column, allow: tuple[str, ...]) -> Column:
    said = _col(text)
    return F.filter(spans, lambda s: ~F.substring(said, s["start"] + 1, s["end"] - s["start"]).isin(*allow)) if allow else spans
