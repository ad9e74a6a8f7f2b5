"""Declared Spark types of the model tables and their nested columns."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.ArrayType(T.DoubleType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FIELD = _struct(
    value=T.StringType(), bbox=BBOX, page=T.IntegerType(), confidence=T.DoubleType(),
    source=T.StringType(), iso_from=T.StringType(), iso_to=T.StringType(),
)
FIELD_MAP = T.MapType(T.StringType(), FIELD)
SCORE_MAP = T.MapType(T.StringType(), T.DoubleType())

LINE_ITEM = _struct(
    description=T.StringType(), quantity=T.DoubleType(), unit_price=T.DoubleType(),
    line_total=T.DoubleType(), bbox=BBOX, page=T.IntegerType(), confidence=T.DoubleType(),
)
TAX_ROW = _struct(
    jurisdiction=T.StringType(), rate=T.DoubleType(), amount=T.DoubleType(),
    bbox=BBOX, page=T.IntegerType(), confidence=T.DoubleType(),
)

# One wide row type holds every kind of reason; unused members stay null.
REASON = _struct(
    type=T.StringType(), field=T.StringType(), subtotal=T.DoubleType(), tax=T.DoubleType(),
    total=T.DoubleType(), delta=T.DoubleType(), vendor_mean=T.DoubleType(),
    vendor_std=T.DoubleType(), z_score=T.DoubleType(), invoice_id=T.StringType(),
    similarity=T.DoubleType(), match_method=T.StringType(), score=T.DoubleType(),
    reason=T.StringType(), vendor_name=T.StringType(), stage=T.StringType(),
    detail=T.StringType(),
)
REASONS = T.ArrayType(REASON)

USAGE = _struct(
    input_tokens=T.LongType(), output_tokens=T.LongType(),
    cache_creation_input_tokens=T.LongType(), cache_read_input_tokens=T.LongType(),
)
TIER = _struct(model=T.StringType(), usage=USAGE, self_confidence=SCORE_MAP)

STATS = _struct(n=T.LongType(), avg=T.DoubleType(), std=T.DoubleType(), m2=T.DoubleType())

INVOICES = _struct(
    invoice_id=T.StringType(), storage_key=T.StringType(), file_hash=T.StringType(),
    perceptual_hash=T.StringType(), vendor_id=T.StringType(), uploaded_at=T.TimestampType(),
    review_status=T.StringType(), duplicate_dismissals=T.ArrayType(T.StringType()),
)
EXTRACTIONS = _struct(
    extraction_id=T.StringType(), invoice_id=T.StringType(), model=T.StringType(),
    tiers=T.ArrayType(TIER), fields=FIELD_MAP, confidence=SCORE_MAP, state=T.StringType(),
    reasons=REASONS, line_items=T.ArrayType(LINE_ITEM), tax_rows=T.ArrayType(TAX_ROW),
    raw_text=T.StringType(), is_current=T.BooleanType(), created_at=T.TimestampType(),
)
#: What is stored besides, so that filters reach the file reader and no search stems texts.
STORED_EXTRACTIONS = T.StructType([
    *EXTRACTIONS.fields,
    *[T.StructField(name, kind) for name, kind in {
        "vendor_text": T.StringType(), "currency": T.StringType(), "total_amount": T.DecimalType(38, 9),
        "subtotal_amount": T.DecimalType(38, 9), "tax_amount": T.DecimalType(38, 9), "period_start": T.DateType(),
        "lexemes": T.ArrayType(T.StringType()),
    }.items()],
])
VENDORS = _struct(
    vendor_id=T.StringType(), name=T.StringType(), tax_id=T.StringType(),
    normalized_name=T.StringType(), first_seen_at=T.TimestampType(), stats=STATS,
)
ACKS = _struct(
    invoice_id=T.StringType(), subtype=T.StringType(), field=T.StringType(),
    acknowledged_at=T.TimestampType(), user_id=T.StringType(), notes=T.StringType(),
)
USAGE_LOG = _struct(
    id=T.StringType(), created_at=T.TimestampType(), model=T.StringType(),
    spec_name=T.StringType(), input_tokens=T.LongType(), output_tokens=T.LongType(),
    cache_creation_input_tokens=T.LongType(), cache_read_input_tokens=T.LongType(),
    cost_usd=T.DoubleType(),
)
TIER_RESULTS = _struct(
    invoice_id=T.StringType(), tier=T.IntegerType(), model=T.StringType(),
    fields=T.MapType(T.StringType(), T.StringType()), self_confidence=SCORE_MAP,
    extraction_failed=T.BooleanType(), failure_reason=T.StringType(), usage=USAGE,
)
WORD_BOXES = _struct(
    doc_id=T.StringType(), page=T.IntegerType(), word_no=T.IntegerType(), text=T.StringType(),
    x0=T.DoubleType(), y0=T.DoubleType(), x1=T.DoubleType(), y1=T.DoubleType(),
)
