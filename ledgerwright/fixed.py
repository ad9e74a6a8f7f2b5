"""Names, word lists, thresholds and price points that results depend on."""

from __future__ import annotations

# --- Fixed values: fields -------------------------------------------------
REQUIRED_FIELDS = ("vendor_name", "invoice_number", "invoice_date", "total", "currency")
AMOUNT_FIELDS = ("subtotal", "tax", "total")
HEADER_FIELDS = (*REQUIRED_FIELDS, "subtotal", "tax")
# Order in which scores are kept, and so the order of low-confidence reasons.
SCORED_FIELDS = ("subtotal", "tax", "total", "invoice_date", "currency", "vendor_name", "invoice_number")

# --- Fixed values: states -------------------------------------------------
CONFIDENT, NEEDS_REVIEW, LIKELY_DUPLICATE = "confident", "needs_review", "likely_duplicate"
PENDING, CONFIRMED, UNPROCESSABLE = "pending", "confirmed", "unprocessable"
BLOCKING_REASONS = ("math_fails", "anomaly", "missing_field", "low_confidence")

# --- Fixed values: tolerances and thresholds ------------------------------
AMOUNT_TOLERANCE = "0.02"
AGREEMENT_TOLERANCE = "0.01"
DEFAULT_HISTORY_SCORE = 0.85
ESCALATION_THRESHOLD = 0.7
UNSEEN_VENDOR_FLOOR = 0.85
DISPUTE_THRESHOLD = 0.3
MIN_HISTORY = 3
OUTLIER_Z = 3.0
ACK_FRACTION = 0.10
HISTORY_LIMIT = 11
HASH_BITS = 64
HASH_THRESHOLD = 5
PAGE_SIZE = 25

# --- Fixed values: currency codes taken as valid --------------------------
CURRENCY_CODES = (
    "USD", "EUR", "GBP", "INR", "CAD", "AUD", "JPY", "CHF", "CNY",
    "SEK", "NOK", "DKK", "SGD", "HKD", "MXN", "BRL", "ZAR",
)
CURRENCY_SYMBOLS = {
    "$": "USD", "US$": "USD", "C$": "CAD", "CA$": "CAD", "A$": "AUD", "AU$": "AUD",
    "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY",
}

# --- Fixed values: tokens a de-shouted name keeps in capitals -------------
KEPT_NAME_TOKENS = (
    "LLC", "INC", "LTD", "PLC", "LLP", "CORP", "LP", "CO",
    "GMBH", "AG", "KG", "SE", "SA", "SARL", "BV", "NV",
    "PTY", "PTE", "KK", "AB", "USA", "UK", "EU", "US", "UAE",
)

# --- Fixed values: date text ----------------------------------------------
RANGE_SEPARATORS = (" - ", " – ", " — ", " to ", " through ")
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# --- Fixed values: USD per million tokens (input, output) by tier ---------
TIER_PRICES = {"haiku": (1.0, 5.0), "sonnet": (3.0, 15.0), "opus": (15.0, 75.0)}
CACHE_WRITE_FACTOR = 1.25
CACHE_READ_FACTOR = 0.10
TIER_NAMES = ("haiku", "sonnet", "opus")

# --- Fixed values: provenance labels --------------------------------------
IMAGE_SOURCE = "claude-vision"
TEXT_SOURCE_PREFIX = "pymupdf+"
CORRECTION_SOURCE = "manual-correction"

# --- Fixed values: annotation field types and the fields they feed --------
ANNOTATION_FIELDS = {
    "vendor_name": "vendor_name",
    "document_id": "invoice_number",
    "date_issue": "invoice_date",
    "amount_total_gross": "total",
    "amount_total_base": "subtotal",
    "amount_total_tax": "tax",
    "currency_code_amount_due": "currency",
}

# --- Fixed values: patterns stripped before soft comparison ---------------
AMOUNT_NOISE = r"[,$£€¥₹\s]|USD|EUR|GBP|INR|JPY|US\$|CAD|AUD"
AMOUNT_TAIL = r"[.\-−–—\s]+$"
DATE_SEPARATORS = r"[\s/\-.l|]+"

# --- Fixed values: English stop words (the published Snowball list) -------
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()
