"""Per-field scores: structure, vendor history, their minimum, and the escalation rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.amounts import amount, math_reconciles
from ledgerwright.functions.dates import is_valid_date


def is_blank(value: Column) -> Column:
    return F.coalesce(value == "", F.lit(True))


def missing_required(values: dict[str, Column]) -> Column:
    """Names of the required fields that are null or empty, in field order."""
    names = [F.when(is_blank(values[f]), F.lit(f)) for f in fixed.REQUIRED_FIELDS]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def is_empty_reading(values: dict[str, Column], failed: Column) -> Column:
    """Failed outright, or every required field blank: send to the second reader."""
    blank = F.lit(True)
    for name in fixed.REQUIRED_FIELDS:
        blank = blank & is_blank(values[name])
    return F.coalesce(failed, F.lit(False)) | blank


def is_valid_currency(value: Column) -> Column:
    return F.coalesce(F.upper(F.trim(value)).isin(*fixed.CURRENCY_CODES), F.lit(False))


def math_passed(values: dict[str, Column]) -> Column:
    return math_reconciles(*[amount(values[f]) for f in fixed.AMOUNT_FIELDS])


def structural_scores(values: dict[str, Column], passed: Column) -> dict[str, Column]:
    """Score of each field from its own shape and the arithmetic of the amounts."""
    scores = {
        f: F.when(values[f].isNull(), 0.9).when(passed, 1.0).otherwise(0.2)
        for f in fixed.AMOUNT_FIELDS
    }
    for name, valid in (("invoice_date", is_valid_date), ("currency", is_valid_currency)):
        value = values[name]
        scores[name] = F.when(is_blank(value), 0.0).when(valid(value), 1.0).otherwise(0.3)
    for name in ("vendor_name", "invoice_number"):
        scores[name] = F.when(is_blank(values[name]), 0.0).otherwise(0.9)
    return scores


def history_score(total: Column, n: Column, mean: Column, std: Column) -> Column:
    """Score of a total by its distance from the vendor's mean; null without usable history."""
    z = F.abs(F.try_divide(total.try_cast("double") - mean, std))
    usable = (n >= fixed.MIN_HISTORY) & (std > 0) & z.isNotNull()
    return F.when(
        usable, F.when(z < 1, 1.0).when(z < 2, 0.85).when(z < 3, 0.6).otherwise(0.3)
    )


def composite_scores(
    structural: dict[str, Column],
    history: dict[str, Column],
    overrides: dict[str, Column] | None = None,
) -> dict[str, Column]:
    """Minimum of structure, history (0.85 where unknown) and agreement (1.0 where unknown)."""
    out = {}
    for name, score in structural.items():
        terms = [score]
        known = history.get(name)
        floor = F.lit(fixed.DEFAULT_HISTORY_SCORE)
        terms.append(floor if known is None else F.coalesce(known, floor))
        if overrides and name in overrides:
            terms.append(F.coalesce(overrides[name], F.lit(1.0)))
        out[name] = F.least(*terms)
    return out


def score_map(scores: dict[str, Column]) -> Column:
    return F.create_map(*[x for f in fixed.SCORED_FIELDS for x in (F.lit(f), scores[f])])


def min_confidence(scores: Column) -> Column:
    """Smallest value of a score map; null for an empty one."""
    return F.array_min(F.map_values(scores))


def should_escalate(scores: Column, passed: Column, unseen_vendor: Column) -> Column:
    """Read again with a stronger tier?"""
    low = min_confidence(scores)
    return (
        ~passed
        | low.isNull()
        | (low < fixed.ESCALATION_THRESHOLD)
        | (unseen_vendor & (low < fixed.UNSEEN_VENDOR_FLOOR))
    )


# --- hashes ---------------------------------------------------------------

def hash_to_long(text: Column) -> Column:
    """16 hex digits as a signed 64-bit number; null for any other text."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex texts; null where their lengths differ."""
    return F.when(
        F.length(a) == F.length(b), F.bit_count(hash_to_long(a).bitwiseXOR(hash_to_long(b)))
    )


def hash_similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - distance / float(fixed.HASH_BITS))


def duplicate_class(content_match: Column, distance: Column) -> Column:
    """Struct (method, similarity), null where neither signal fires."""
    near = F.coalesce(distance <= fixed.HASH_THRESHOLD, F.lit(False))
    made = lambda m, s: F.struct(F.lit(m).alias("method"), s.alias("similarity"))
    return (
        F.when(content_match & near, made("both", F.lit(1.0)))
        .when(content_match, made("content_fingerprint", F.lit(1.0)))
        .when(near, made("perceptual_hash", hash_similarity(distance)))
    )


# --- model usage ----------------------------------------------------------

def model_tier(model: Column) -> Column:
    """The tier whose name a (dated) model name holds; other names as they are."""
    tier = F.when(F.lit(False), model)
    for name in fixed.TIER_PRICES:
        tier = tier.when(F.lower(model).contains(name), name)
    return tier.otherwise(model)


def usage_cost(model: Column, usage: dict[str, Column]) -> Column:
    """USD of one call, priced by the tier name found in the model name; 0 if none is."""
    def rate(which: int) -> Column:
        chain = F.when(F.lit(False), 0.0)
        for tier, prices in fixed.TIER_PRICES.items():
            chain = chain.when(F.lower(model).contains(tier), prices[which] / 1_000_000)
        return F.coalesce(chain, F.lit(0.0))

    count = lambda name: F.coalesce(usage[name].cast("double"), F.lit(0.0))
    return (
        count("input_tokens") * rate(0)
        + count("output_tokens") * rate(1)
        + count("cache_creation_input_tokens") * rate(0) * fixed.CACHE_WRITE_FACTOR
        + count("cache_read_input_tokens") * rate(0) * fixed.CACHE_READ_FACTOR
    )


def tier_of_model(model: Column, tier_models: dict[str, str]) -> Column:
    """Tier label of an exactly named model; an unknown model counts as the lowest tier."""
    table = F.create_map(*[F.lit(x) for t, m in tier_models.items() for x in (m, t)])
    return F.coalesce(F.element_at(table, model), F.lit(fixed.TIER_NAMES[0]))
