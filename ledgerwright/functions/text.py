"""Names, tokens, fingerprints and the text clean-up used by soft comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwright import fixed


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_name(name: Column) -> Column:
    """Vendor join key: lower case, punctuation dropped, blanks collapsed (Unicode aware)."""
    bare = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]+", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def _capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def display_name(name: Column) -> Column:
    """Title-case a name written wholly in capitals; anything else passes unchanged."""
    letters = F.regexp_replace(name, r"[^\p{L}]", "")
    shouted = (F.length(letters) >= 6) & letters.rlike(r"^\p{Lu}+$")
    kept = F.array(*[F.lit(token) for token in fixed.KEPT_NAME_TOKENS])
    words = F.transform(
        F.split(name, " ", -1),
        lambda w: F.when(
            F.array_contains(kept, F.upper(F.regexp_replace(w, r"[.,;:]+$", ""))), w
        ).otherwise(_capitalize(w)),
    )
    return F.when(shouted, F.array_join(words, " ")).otherwise(name)


def normalize_token(text: Column) -> Column:
    """Word form used to match field values against page words."""
    return F.lower(F.regexp_replace(F.trim(text), r"[.,:;]+$", ""))


def value_tokens(text: Column) -> Column:
    """Normalised tokens of a field value, split on any whitespace."""
    parts = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    return F.transform(parts, normalize_token)


def clean_amount(text: Column) -> Column:
    """Amount text without separators, currency marks and a trailing dash or dot."""
    bare = F.regexp_replace(text, fixed.AMOUNT_NOISE, "")
    return F.regexp_replace(bare, fixed.AMOUNT_TAIL, "")


def normalize_date_text(text: Column) -> Column:
    """Date text with each run of separators turned into one slash."""
    joined = F.regexp_replace(F.trim(text), fixed.DATE_SEPARATORS, "/")
    return F.regexp_replace(joined, r"^/+|/+$", "")


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def storage_key(content: Column) -> Column:
    return F.concat(fingerprint(content), F.lit(".pdf"))


def short_fingerprint(content: Column) -> Column:
    return F.substring(fingerprint(content), 1, 16)


def word_tokens(text: Column) -> Column:
    """Distinct lower-case letter/digit runs of a text."""
    return F.array_distinct(
        F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    )
