"""Deterministic identities and the text forms they hash, as column expressions.

Identities are SHA-256 digests of canonical JSON (keys sorted, no spaces, every character outside printable ASCII as
``\\uXXXX``, in surrogate pairs where needed: the text of Python's ``json.dumps``), cut to a fixed number of hex digits.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\\N"
FIELD_SEP = "\x1f"


def digest(text: Column, length: int = 64) -> Column:
    """hex SHA-256 of text, shortened to ``length`` digits."""
    h = F.sha2(text, 256)
    return h if length >= 64 else F.substring(h, 1, length)


class JsonText(NamedTuple):
    """A column that already holds JSON, such as the text of a number."""

    text: Column


_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """A JSON string. Plain texts are only quoted; others go through their UTF-16 units, four hex digits each."""

    def unit(u: Column) -> Column:
        out = F.when(u.between("0020", "007e"), F.chr(F.conv(u, 16, 10).cast("int")))
        for char, escape in _SHORT.items():
            out = F.when(u == f"{ord(char):04x}", F.lit(escape)).otherwise(out)
        return F.coalesce(out, F.concat(F.lit("\\u"), u))

    units = F.regexp_extract_all(F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit("(....)"), F.lit(1))
    plain = text.rlike(r"^[ !#-\[\]-~]*\z")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(units, unit), "")), F.lit('"'))


def canonical_json(fields: Mapping[str, Column | JsonText | str | int | Sequence[str]]) -> Column:
    """JSON object text with keys in sorted order and no whitespace; columns are written as strings."""
    parts = []
    for i, key in enumerate(sorted(fields)):
        parts.append(F.lit(("," if i else "{") + json.dumps(key) + ":"))
        value = fields[key]
        if isinstance(value, Column):
            parts.append(json_string(value.cast("string")))
        elif isinstance(value, JsonText):
            parts.append(value.text)
        else:
            parts.append(F.lit(json.dumps(value, separators=(",", ":"))))
    return F.concat(*parts, F.lit("}"))


def _require_present(fields: Mapping[str, Column], value: Column) -> Column:
    """An empty or null identity field fails the job, as in the reference."""
    bad = None
    for name in sorted(fields):
        cond = fields[name].isNull() | (fields[name].cast("string") == F.lit(""))
        bad = cond if bad is None else bad | cond
    return F.when(bad, F.raise_error(F.lit("identity fields must not be empty"))).otherwise(value)


_ZONED = r"[T ]\d{1,2}:.*([zZ]|[+-]\d{1,2}(:?\d{2})?|[A-Za-z]+(/[A-Za-z_]+)*)\s*$"


def utc_text(instant: str) -> str:
    """A time given as text, with or without an offset, as zone-less UTC text."""
    parsed = dt.datetime.fromisoformat(instant.strip())
    if parsed.tzinfo is not None:
        parsed = parsed.astimezone(dt.UTC).replace(tzinfo=None)
    return parsed.isoformat(sep=" ")


def utc_ntz(col: Column, kind: T.DataType) -> Column:
    """An instant as a zone-less UTC timestamp, whatever the session's time zone.

    Zone-less timestamps are UTC already; zoned ones are counted in microseconds from the zone-less epoch; texts are read
    with their offset where they have one, and as UTC where they have none.
    """
    if isinstance(kind, T.StringType):
        # An offset without a colon is one that the cast does not read.
        text = F.regexp_replace(F.trim(col), r"([T ]\d{1,2}:.*[+-]\d{2})(\d{2})$", "$1:$2")
        zoned = F.when(col.rlike(_ZONED), text).cast("timestamp")
        return F.coalesce(utc_ntz(zoned, T.TimestampType()), F.when(~col.rlike(_ZONED), text).cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampType):
        seconds = (F.unix_micros(col).cast("decimal(20,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return col.cast("timestamp_ntz")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 UTC text like Python's ``isoformat()`` (no fraction when it is zero) of a zone-less UTC timestamp."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))


def prediction_id(
    *,
    source_batch_id: Column,
    entity_id: Column,
    correlation_id: Column,
    prediction_ts: Column,
    model_name: Column,
    model_version: Column,
    mapping_version: Column,
) -> Column:
    """``pred_`` + 32 hex digits over the seven provenance fields."""
    fields = {
        "entity_id": entity_id,
        "correlation_id": correlation_id,
        "mapping_version": mapping_version,
        "model_name": model_name,
        "model_version": model_version,
        "prediction_ts": prediction_ts,
        "source_batch_id": source_batch_id,
    }
    return _require_present(fields, F.concat(F.lit("pred_"), digest(canonical_json(fields), 32)))


def retraining_job_name(event_id: Column) -> Column:
    """``retrain-`` + 24 hex digits over the delivery id of an event."""
    fields = {"event_grid_event_id": event_id}
    return _require_present(fields, F.concat(F.lit("retrain-"), digest(canonical_json(fields), 24)))


def candidate_material(
    *,
    snapshot_sha256: Column,
    source_cutoff: str | Column,
    mapping_version: str | Column,
    random_seed: int | JsonText,
    model_implementation: str,
    training_features_query: str,
    actuals_query: str,
    entity_column: str,
    feature_timestamp_column: str,
    correlation_column: str,
    feature_columns: Sequence[str],
) -> dict[str, Column | JsonText | str | int | list[str]]:
    """what a training run is made of: its snapshot, its bounds, its queries, its columns and its model."""
    return {
        "actuals_query_sha256": digest(F.lit(actuals_query)),
        "correlation_column": correlation_column,
        "entity_column": entity_column,
        "feature_columns": list(feature_columns),
        "feature_timestamp_column": feature_timestamp_column,
        "mapping_version": mapping_version,
        "model_implementation": model_implementation,
        "random_seed": random_seed,
        "snapshot_sha256": snapshot_sha256,
        "source_cutoff": source_cutoff,
        "training_features_query_sha256": digest(F.lit(training_features_query)),
    }


def candidate_version(material: Mapping[str, Column | JsonText | str | int | Sequence[str]]) -> Column:
    """16 hex digits over the provenance material of a training run."""
    return digest(canonical_json(material), 16)


def version_slug(version: Column) -> Column:
    """deployment name ``v-<version>``, lower case, runs of other characters as ``-``."""
    slug = F.regexp_replace(F.lower(F.concat(F.lit("v-"), version)), "[^a-z0-9-]+", "-")
    return F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, 32)


def is_blank(text: Column) -> Column:
    """null or only (Unicode) whitespace."""
    return text.isNull() | text.rlike(r"^(?U)\s*$")


def double_text(col: Column) -> Column:
    """A double, exactly: ``<mantissa>p<exponent>`` with a 53-bit whole mantissa, value = mantissa * 2^exponent.

    Scaling by a power of two is exact, so any engine with IEEE doubles writes the same text, and unequal values never share
    one. Zeros of both signs are ``0``, as they are equal.
    """
    d = col.cast("double")
    size = F.abs(d)
    guess = F.floor(F.log2(size))  # may be one off beside a power of two
    lead = size / F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(lead >= 2, 1).when(lead < 1, -1).otherwise(0)
    mantissa = (size / F.pow(F.lit(2.0), exponent) * F.lit(float(2**52))).cast("long")
    finite = F.concat(
        F.when(d < 0, "-").otherwise(""), mantissa.cast("string"), F.lit("p"), (exponent - 52).cast("string")
    )
    return (
        F.when(F.isnan(d), "NaN")
        .when(size == float("inf"), F.when(d < 0, "-Infinity").otherwise("Infinity"))
        .when(d == 0, "0")
        .when(d.isNotNull(), finite)
    )


def render(col: Column, kind: str) -> Column:
    """Text form of one value for row hashing; null is an explicit marker.

    Doubles are written exactly, decimals as they are (never through a double), timestamps as ISO UTC.
    """
    return F.coalesce(_text(col, kind), F.lit(NULL_MARK))


def _text(col: Column, kind: str) -> Column:
    if kind == "double":
        return double_text(col)
    if kind == "timestamp":
        return iso_utc(col)
    if kind == "instant":
        return iso_utc(utc_ntz(col, T.TimestampType()))
    return col.cast("string")


def row_text(cols: Sequence[tuple[str, str]]) -> Column:
    """All columns as text joined by the unit separator (0x1F).

    Nulls are marked by a function over the array of texts: it keeps them out of whole-stage code, where the texts of some
    ten columns make one method that is too long to be compiled (10 columns of 1.5 million rows: 16 s, and 5 s so).
    """
    texts = F.array(*[_text(F.col(c), kind) for c, kind in cols])
    return F.concat_ws(FIELD_SEP, F.transform(texts, lambda text: F.coalesce(text, F.lit(NULL_MARK))))


def row_hash(cols: Sequence[tuple[str, str]]) -> Column:
    """SHA-256 of the row text."""
    return digest(row_text(cols))


def kinds(schema: T.StructType, names: Sequence[str] | None = None) -> list[tuple[str, str]]:
    """(column, rendering kind) pairs for a schema."""
    out = []
    for f in schema.fields:
        if names is not None and f.name not in names:
            continue
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((f.name, "double"))
        elif isinstance(f.dataType, T.TimestampNTZType):
            out.append((f.name, "timestamp"))
        elif isinstance(f.dataType, T.TimestampType):
            out.append((f.name, "instant"))
        else:
            out.append((f.name, "text"))
    return out
