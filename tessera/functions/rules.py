"""Rates, scores, bands and decision lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and weights.
TRUST_HIGH, TRUST_MEDIUM = 0.9, 0.6
SEVERITY_WEIGHT = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
BANDS = ((5, "simple"), (10, "moderate"), (20, "complex"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null if there is no whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounded half up by floor, as SQL engines agree on."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def weighted_mean(x: Column, w: Column) -> Column:
    """An aggregate; weights under 1 count as 1."""
    w = F.greatest(F.lit(1), w)
    return F.try_divide(F.sum(x * w).cast("double"), F.sum(w).cast("double"))


def complexity_band(x: Column | str) -> Column:
    out = F.lit("very_complex")
    for top, name in reversed(BANDS):
        out = F.when(_col(x) <= top, name).otherwise(out)
    return out


def risk_score(complexity: Column, most: Column, loc: Column, methods: Column) -> Column:
    """62 parts complexity against the global maximum, up to 22 size, up to 16 methods; 8 to 100."""
    raw = F.coalesce(F.try_divide(complexity * 62.0, most), F.lit(0.0)) + F.least(F.lit(22.0), loc / 18.0) + F.least(F.lit(16.0), methods * 1.5)
    return F.least(F.lit(100), F.greatest(F.lit(8), F.floor(raw + 0.5))).cast("long")


def token_estimate(text: Column | str) -> Column:
    """A token for every four characters begun; none for null."""
    return F.coalesce(F.ceil(F.length(_col(text)) / 4), F.lit(0)).cast("long")


def effective_total(total: Column, prompt: Column, completion: Column) -> Column:
    parts = F.greatest(F.coalesce(prompt, F.lit(0)), F.lit(0)) + F.greatest(F.coalesce(completion, F.lit(0)), F.lit(0))
    return F.when(total > 0, total).otherwise(parts)


def trust_level(confidence: Column | str, verified: Column | None = None) -> Column:
    """HIGH, MEDIUM or LOW; NaN and null are LOW, and so is what evidence denies."""
    c = _col(confidence)
    c = F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    level = F.when(c >= TRUST_HIGH, "HIGH").when(c >= TRUST_MEDIUM, "MEDIUM").otherwise("LOW")
    return level if verified is None else F.when(F.lower(verified) == "false", "LOW").otherwise(level)


def severity_weight(severity: Column | str) -> Column:
    out = F.lit(0)
    for name, w in SEVERITY_WEIGHT.items():
        out = F.when(_col(severity) == name, w).otherwise(out)
    return out


def service_confidence(providers: Column, concrete: Column) -> Column:
    """Declared providers or a single candidate are certain, several likely, none weak."""
    return F.when((F.size(providers) > 0) | (F.size(concrete) == 1), 1.0).when(F.size(concrete) > 1, 0.8).otherwise(0.3)


def normalize_reason(reason: Column | str) -> Column:
    """A reason without its figures; null for blank ones."""
    said = F.trim(_col(reason))
    return (
        F.when(said == "", None)
        .when(said.rlike(r"^low_conf(?:idence)?\([0-9.]+\)<[0-9.]+$"), "low_conf")
        .when(said.rlike(r"^unresolved\([0-9]+\)\*[0-9.]+$"), "unresolved")
        .when(said.rlike(r"^external\([0-9]+\)\*[0-9.]+$"), "external")
        .when(said.rlike(r"^SKIP:min_conf<[0-9.]+$"), "skip_low_conf")
        .otherwise(said)
    )


def task_status(selected: Column, available: Column, found: Column, failed: Column, present: Column | None = None, readable: Column | None = None) -> Column:
    """A task's status: ``available`` reports were made, ``present`` ones lie there, its own was ``found`` and is ``readable``, tests in it failed."""
    missing = F.lit("test_not_found") if present is None else F.when(present, "test_not_found").otherwise("build_failed")
    out = F.when(~F.coalesce(selected, F.lit(True)), "not_selected").when(~available, "build_failed").when(~found, missing)
    if readable is not None:
        out = out.when(~readable, "build_failed")
    return out.when(failed > 0, "test_failed").otherwise("success")


def _dynamic_penalty(breakdown: Column) -> Column:
    return F.coalesce(F.get_json_object(breakdown, "$.penalties.DYNAMIC_REASONS").try_cast("double") > 0, F.lit(False))


def would_be_excluded(breakdown: Column) -> Column:
    """By an open JSON map: a shadow score of 0 or less, a penalty for dynamic reasons, or a reason to skip."""
    shadow = F.coalesce(F.get_json_object(breakdown, "$.shadow_score").try_cast("double") <= 0, F.lit(False))
    reasons = F.from_json(F.get_json_object(breakdown, "$.dynamic_reasons"), "array<string>")
    return shadow | _dynamic_penalty(breakdown) | F.coalesce(F.exists(reasons, lambda r: F.coalesce(r.startswith("SKIP:"), F.lit(False))), F.lit(False))


def is_excluded(breakdown: Column, selected: Column, reason: Column, score: Column) -> Column:
    """A penalty, not selected for a dynamic reason or confidence, or a score of 0 or less."""
    said = F.coalesce((selected == F.lit(False)) & (reason.contains("dynamic") | reason.contains("confidence")), F.lit(False))
    return _dynamic_penalty(breakdown) | said | F.coalesce(score <= 0, F.lit(False))


def quality_score(resolution_rate: Column, dynamic: Column, preprocess: Column | None = None, classpath: Column | None = None) -> Column:
    """100 times the rate, less up to 30 for dynamic features and what preprocessing and class path cost; 0 at least."""
    less = F.least(dynamic, F.lit(30)) + (F.lit(0) if preprocess is None else preprocess) + (F.lit(0) if classpath is None else classpath)
    return F.greatest(F.lit(0), F.floor(resolution_rate * 100 + 0.5) - less).cast("long")


def recommendations(resolution_rate: Column, dynamic: Column, preprocess_mode: Column | None = None, preprocess: Column | None = None, classpath: Column | None = None, lombok: Column | None = None, hotspots: Column | None = None) -> Column:
    """What to do, in order; ``none`` if there is nothing."""
    no = F.lit(False)

    def told(x: Column | None, when) -> Column:
        return no if x is None else F.coalesce(when(x), no)

    rules = [
        (resolution_rate < 0.8, "raise_type_resolution"),
        (dynamic > 20, "review_dynamic_features"),
        ((dynamic > 20) & told(hotspots, lambda x: F.size(x) > 0), "focus_dynamic_hotspots"),
        (told(preprocess_mode, lambda x: x == "OFF") & told(lombok, lambda x: x), "preprocess_for_lombok"),
        (told(preprocess, lambda x: x == "FAILED"), "mend_preprocessing"),
        (told(preprocess, lambda x: x == "FAILED_FALLBACK"), "look_at_fallback"),
        (told(classpath, lambda x: x == "NO"), "give_a_class_path"),
    ]
    out = F.array_compact(F.array(*[F.when(F.coalesce(when, no), name) for when, name in rules]))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit("none")))


def selection_penalty(least: Column, unresolved: Column, external: Column, low: float, each_unresolved: float, each_external: float, skip: float, low_below: float = 0.6) -> Column:
    """Struct (penalty, skip, reasons) of a task's dynamic features."""
    penalty = F.when(least < low_below, low).otherwise(0.0) + unresolved * each_unresolved + external * each_external
    reasons = F.array_compact(F.array(F.when(least < low_below, "low_conf"), F.when(unresolved > 0, "unresolved"), F.when(external > 0, "external"), F.when(least < skip, "skip_low_conf")))
    return F.struct(penalty.alias("penalty"), (least < skip).alias("skip"), reasons.alias("reasons"))


def selection_strength(excluded: Column, wasted: Column, failed: Column, concentration: Column) -> Column:
    """TOO_STRICT: much is excluded that would have passed. TOO_WEAK: many fail, mostly for one reason."""
    return F.when((excluded > 0.20) & (wasted >= 0.30), "TOO_STRICT").when((failed >= 0.15) & (concentration >= 0.50), "TOO_WEAK").otherwise("OK")


# Parameters as they are where nothing else is said, rates beyond which they are changed, and steps.
PARAMETERS = {"skip_threshold": 0.5, "penalty_unresolved_each": 0.1, "penalty_low_confidence": 0.4, "penalty_external_each": 0.2}
MANY_FAIL, MANY_PASS = 0.30, 0.70
STEP_THRESHOLD, STEP_PENALTY, STEP_MINOR, STEP_MAJOR = 0.1, 0.05, 0.02, 0.1


def parameter_advice(strength: Column, dominant: Column, fails: Column, passes: Column, now: dict[str, Column | float] | None = None) -> Column:
    """Which parameters to change: structs (name, current, advised, trigger), in the order of the rules.

    ``fails`` and ``passes`` map reasons to the rates at which their tasks fail to compile and pass. (1) Doubtful confidence fails often: a higher threshold, 1 at most.
    (2) What is unresolved fails often: a higher penalty. (3) Candidates by branch mostly pass: a lower one, unless it was raised. (4) TOO_STRICT: a lower threshold, 0 at least, unless it was
    raised. (5) TOO_WEAK: a much higher penalty for the dominant reason, that of low confidence for all that have none of their own.
    """
    current = {k: F.lit(v).cast("double") if isinstance(v, float) else v.cast("double") for k, v in (PARAMETERS | (now or {})).items()}

    def of(rates: Column, reason: str) -> Column:
        return F.coalesce(F.element_at(rates, F.lit(reason)), F.lit(0.0))

    def change(when: Column, name: str | Column, value: Column, trigger: Column, was: Column | None = None) -> Column:
        was = current[name] if was is None else was
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), was.alias("current"), value.alias("advised"), trigger.alias("trigger")))

    low, provided = of(fails, "low_conf"), of(fails, "spi_low_conf")
    raised = F.least(F.lit(1.0), current["skip_threshold"] + STEP_THRESHOLD)
    first = (F.greatest(low, provided) > MANY_FAIL) & (raised != current["skip_threshold"])
    second = of(fails, "unresolved") > MANY_FAIL
    lowered = F.greatest(F.lit(0.0), current["skip_threshold"] - STEP_THRESHOLD)
    fourth = (strength == "TOO_STRICT") & ~first & (lowered != current["skip_threshold"])
    reason = F.coalesce(dominant, F.lit("too_weak"))
    name = F.when(reason == "unresolved", "penalty_unresolved_each").when(reason.isin("external", "external_not_found"), "penalty_external_each").otherwise("penalty_low_confidence")
    was = F.when(reason == "unresolved", current["penalty_unresolved_each"]).when(reason.isin("external", "external_not_found"), current["penalty_external_each"]).otherwise(current["penalty_low_confidence"])
    rules = [
        change(first, "skip_threshold", raised, F.when(low >= provided, "low_conf").otherwise("spi_low_conf")),
        change(second, "penalty_unresolved_each", current["penalty_unresolved_each"] + STEP_PENALTY, F.lit("unresolved")),
        change((of(passes, "branch_candidates") > MANY_PASS) & ~second, "penalty_unresolved_each", F.greatest(F.lit(0.0), current["penalty_unresolved_each"] - STEP_MINOR), F.lit("branch_candidates")),
        change(fourth, "skip_threshold", lowered, F.lit("too_strict")),
        change(strength == "TOO_WEAK", name, was + STEP_MAJOR, reason, was),
    ]
    return F.array_compact(F.array(*rules))
