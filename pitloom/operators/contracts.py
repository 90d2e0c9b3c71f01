"""Data-contract checks as violation counters, and the PASS/BLOCK decision.

Every check returns a rule table ``(population, rule, ordinal, violations)``. Row
checks of one population run as one aggregate with ``count_if`` per rule; key
uniqueness is a ``groupBy`` with map-side partial counts. Nothing collects rows to
the driver; the decision is an aggregate over the (tiny) union of rule tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.functions.identity import is_blank
from pitloom.functions.quantity import QUANTITY_RULES, ContractViolation, QuantityContract
from pitloom.schemas import LABEL_COLUMNS, NULLABLE_PREDICTION_COLUMNS, PREDICTION_COLUMNS

RULE_COLUMNS = ("population", "rule", "ordinal", "violations")


def require_columns(populations: Mapping[str, tuple[DataFrame, T.StructType]]) -> dict[str, DataFrame]:
    """Each population projected to its declared columns, after one look at all of them.

    Absent columns, and columns whose type cannot be read as the declared one, are reported together, for all populations,
    before any job runs. Texts can be read as any type; numbers as each other; times as each other.
    """
    faults = []
    for name, (frame, schema) in populations.items():
        for field in schema.fields:
            if field.name not in frame.columns:
                faults.append(f"{name}.{field.name} is absent")
            elif not _readable(frame.schema[field.name].dataType, field.dataType):
                kind = frame.schema[field.name].dataType.simpleString()
                faults.append(f"{name}.{field.name} is {kind}, not {field.dataType.simpleString()}")
    if faults:
        raise ContractViolation("; ".join(faults))
    return {name: frame.select(*schema.fieldNames()) for name, (frame, schema) in populations.items()}


def _readable(have: T.DataType, want: T.DataType) -> bool:
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(have, T.StringType) or isinstance(want, T.StringType):
        return isinstance(have, T.AtomicType)
    return have == want or any(isinstance(have, kind) and isinstance(want, kind) for kind in (T.NumericType, times))


def label_leak(columns: Iterable[str]) -> list[str]:
    """Label columns (any case) present in a scoring population."""
    return sorted({c.lower() for c in columns} & set(LABEL_COLUMNS))


def validate_scoring_population(frame: DataFrame) -> None:
    """P2 at plan time: rows to be scored carry nothing that the model is to predict."""
    if known := label_leak(frame.columns):
        raise ContractViolation(f"rows to score already hold {len(known)} label column(s): {', '.join(known)}")


EMPTY = "empty"


def rule_table(
    frame: DataFrame, population: str, rules: Sequence[tuple[str, Column | None]], first_ordinal: int
) -> DataFrame:
    """One aggregate pass: ``count_if`` per rule, stacked into rule rows.

    A rule with condition ``None`` is the empty-population rule (P7): one violation
    when the population has no rows, counted in the same pass.
    """
    counts = frame.agg(
        *[
            (F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long") if cond is None else F.count_if(cond)).alias(
                f"r{i}"
            )
            for i, (_, cond) in enumerate(rules)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(population).alias("population"),
                F.lit(name).alias("rule"),
                F.lit(first_ordinal + i).alias("ordinal"),
                F.col(f"r{i}").alias("violations"),
            )
            for i, (name, _) in enumerate(rules)
        ]
    )
    return counts.select(F.inline(rows))


def _single_rule(value: DataFrame, population: str, rule: str, ordinal: int) -> DataFrame:
    return value.select(
        F.lit(population).alias("population"),
        F.lit(rule).alias("rule"),
        F.lit(ordinal).alias("ordinal"),
        F.coalesce(F.col("v"), F.lit(0)).cast("long").alias("violations"),
    )


def empty_population(frame: DataFrame, population: str, ordinal: int) -> DataFrame:
    """One violation when the population has no rows (reads at most one row)."""
    return _single_rule(
        frame.limit(1).agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("v")), population, "empty", ordinal
    )


def duplicate_keys(frame: DataFrame, keys: Sequence[str], population: str, rule: str, ordinal: int) -> DataFrame:
    """Surplus rows per key (rows beyond the first), summed; null keys excluded."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    surplus = frame.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _single_rule(surplus.agg(F.sum(F.col("n") - 1).alias("v")), population, rule, ordinal)


def duplicate_grain(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P6 detail: every key that occurs more than once, with its row count."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def null_key_rules(keys: Sequence[str]) -> list[tuple[str, Column]]:
    """Entity and timestamp keys present."""
    return [(f"null_{k}", F.col(k).isNull()) for k in keys]


def null_feature_rules(features: Sequence[str]) -> list[tuple[str, Column]]:
    """Feature values present; NaN counts as missing."""
    return [(f"null_{c}", F.col(c).isNull() | F.isnan(F.col(c))) for c in features]


def correlation_rules(frame: DataFrame, column: str, population: str, first_ordinal: int) -> DataFrame:
    """P5: correlation id present, not blank, unique."""
    blank = rule_table(frame, population, [(f"blank_{column}", is_blank(F.col(column)))], first_ordinal)
    return blank.unionByName(duplicate_keys(frame, [column], population, f"duplicate_{column}", first_ordinal + 1))


def require_unique_ids(frame: DataFrame, column: str, *, population: str) -> None:
    """P5 as a gate (monitor inputs): fail unless every id is present, not blank and unique."""
    bad = correlation_rules(frame, column, population, 1).where(F.col("violations") > 0).limit(1).collect()
    if bad:
        raise ValueError(f"{population}: rule {bad[0]['rule']} is broken by {bad[0]['violations']} row(s)")


def quantity_rules(frame: DataFrame, contract: QuantityContract, column: str, population: str, first_ordinal: int) -> DataFrame:
    """One counter per quantity rule (missing, non-finite, not whole, out of domain)."""
    contract.check_type(frame, column)
    v = contract.violation(F.col(column))
    return rule_table(frame, population, [(r, v == F.lit(r)) for r in QUANTITY_RULES], first_ordinal)


def feature_frame_rules(
    frame: DataFrame, population: str, keys: Sequence[str], features: Sequence[str], first_ordinal: int
) -> DataFrame:
    """P3 + P4 in one pass, then P6 (grain uniqueness)."""
    rules = null_key_rules(keys) + null_feature_rules(features)
    table = rule_table(frame, population, rules, first_ordinal)
    return table.unionByName(
        duplicate_keys(frame, keys, population, "duplicate_grain", first_ordinal + len(rules))
    )


def prediction_contract_rules(frame: DataFrame, population: str = "predictions") -> DataFrame:
    """19 columns in order, non-nullable columns present, ``PREDICTION_ID`` unique."""
    upper = frame.toDF(*[c.upper() for c in frame.columns])
    missing = [c for c in PREDICTION_COLUMNS if c not in upper.columns]
    if missing:
        raise ContractViolation(f"a prediction needs {', '.join(missing)} too")
    ordered = upper.select(*PREDICTION_COLUMNS)
    required = [c for c in PREDICTION_COLUMNS if c not in NULLABLE_PREDICTION_COLUMNS]
    nulls = rule_table(ordered, population, [(f"null_{c.lower()}", F.col(c).isNull()) for c in required], 1)
    return nulls.unionByName(duplicate_keys(ordered, ["PREDICTION_ID"], population, "duplicate_prediction_id", 1 + len(required)))


def decision(rules: DataFrame, *, mapping_version: str, counts: DataFrame | None = None) -> DataFrame:
    """P10: the first failing rule (lowest ordinal) blocks; otherwise PASS.

    ``counts`` is an optional one-row frame of row counts reported with the decision.
    """
    failing = rules.where(F.col("violations") > 0)
    first = failing.agg(
        F.min_by(F.struct("population", "rule", "violations"), F.col("ordinal")).alias("f"),
        F.count(F.lit(1)).alias("failing_rules"),
    )
    out = first.select(
        F.when(F.col("f").isNull(), F.lit("PASS")).otherwise(F.lit("BLOCK")).alias("decision"),
        F.when(F.col("f").isNotNull(), F.concat_ws(":", F.col("f.population"), F.col("f.rule"))).alias("reason"),
        F.coalesce(F.col("f.violations"), F.lit(0)).cast("long").alias("violations"),
        F.col("failing_rules"),
        F.lit(mapping_version).alias("mapping_version"),
    )
    if counts is not None:
        # Both frames have one row: stack them and fold each column to its non-null value.
        merged = out.unionByName(counts, allowMissingColumns=True).agg(
            *[F.max(n).alias(n) for n in (*out.columns, *counts.columns)]
        )
        return merged.select(*out.columns, *counts.columns)
    return out
