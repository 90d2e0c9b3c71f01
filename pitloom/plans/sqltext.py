"""DuckDB text forms of the column expressions, used only to write oracle SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

NULL_MARK = "\\N"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def iso(col: str) -> str:
    return f"(regexp_replace(strftime({col}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') || '+00:00')"


def double_text(col: str) -> str:
    """Mantissa and exponent of a finite double, as ``pitloom.functions.identity.double_text`` writes them."""
    size, guess = f"abs({col})", f"floor(log2(abs({col})))"
    lead = f"({size} / pow(2.0::DOUBLE, {guess}))"
    exponent = f"({guess} + CASE WHEN {lead} >= 2 THEN 1 WHEN {lead} < 1 THEN -1 ELSE 0 END)"
    mantissa = f"CAST({size} / pow(2.0::DOUBLE, {exponent}) * 4503599627370496.0::DOUBLE AS BIGINT)"
    finite = f"CASE WHEN {col} < 0 THEN '-' ELSE '' END || {mantissa} || 'p' || CAST({exponent} - 52 AS BIGINT)"
    return f"CASE WHEN {col} = 0 THEN '0' WHEN {col} IS NOT NULL THEN {finite} END"


def json_string(col: str) -> str:
    """A JSON string in ASCII: ``\\uXXXX`` (a pair beyond 16 bits) for every other character."""
    escapes = " ".join(f"WHEN {ord(c)} THEN {lit(e)}" for c, e in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")))
    wide = "printf('\\u%04x\\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024)"
    other = f"CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) > 65535 THEN {wide} ELSE printf('\\u%04x', unicode(c)) END"
    return f"('\"' || array_to_string(list_transform(string_split({col}, ''), lambda c: CASE unicode(c) {escapes} ELSE {other} END), '') || '\"')"


def render(col: str, kind: str) -> str:
    if kind == "double":
        text = double_text(col)
    elif kind == "timestamp":
        text = iso(col)
    else:
        text = f"CAST({col} AS VARCHAR)"
    return f"COALESCE({text}, {lit(NULL_MARK)})"


def row_hash(cols: Sequence[tuple[str, str]]) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(render(c, k) for c, k in cols) + "))"


def quoted(col: str) -> str:
    return f"'\"' || {col} || '\"'"


def json_object(fields: Mapping[str, str], escaped: bool = False) -> str:
    """Canonical JSON text of string-valued SQL expressions (keys sorted, no spaces)."""
    parts = []
    for i, k in enumerate(sorted(fields)):
        sep = "{" if i == 0 else ","
        parts.append(f"'{sep}\"{k}\":' || {json_string(fields[k]) if escaped else quoted(fields[k])}")
    return "(" + " || ".join(parts) + " || '}')"


def prediction_id(fields: Mapping[str, str], escaped: bool = False) -> str:
    return f"('pred_' || substr(sha256({json_object(fields, escaped)}), 1, 32))"


def digest_select(source: str, cols: Sequence[tuple[str, str]], schema: str) -> str:
    """A15 in DuckDB: the same multiset hash as ``pitloom.operators.digest``."""
    words = ", ".join(f"SUM(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT) AS s{i}" for i in range(4))
    folded = ", ".join(f"CAST(COALESCE(s{i} % 1152921504606846976, 0) AS VARCHAR)" for i in range(4))
    return f"""
SELECT CAST(rows AS BIGINT) AS rows, {lit(schema)} AS schema,
       sha256(concat_ws('|', {lit(schema)}, CAST(rows AS VARCHAR), {folded})) AS snapshot_sha256
FROM (SELECT COUNT(*) AS rows, {words} FROM (SELECT {row_hash(cols)} AS h FROM {source}) hashed) sums"""


def chi2_survival(stat: str, df: str) -> str:
    """Upper tail of chi-squared by the gamma functions of the engine: a series or a fraction for odd df, then the terms."""
    y = f"({stat} / 2)"
    series = f"list_sum(list_transform(range(0, 60), lambda n: exp(n * ln({y}) + lgamma(0.5::DOUBLE) - lgamma(n + 1.5::DOUBLE))))"
    fraction = (
        "list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(100, 0, -1), lambda i: i::DOUBLE)), "
        f"lambda f, i: i * (i - 0.5) / ({y} + 2 * i + 0.5 - f))"
    )
    scale = f"(exp(-{y}) * sqrt({y}) / sqrt(pi()))"
    half = f"CASE WHEN {y} < 2 THEN 1 - {scale} * {series} ELSE {scale} / ({y} + 0.5 - {fraction}) END"
    start = f"(CASE WHEN {df} % 2 = 1 THEN 0.5 ELSE 1.0 END)::DOUBLE"
    terms = f"coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: exp(({start} + j) * ln({y}) - {y} - lgamma({start} + j + 1)))), 0)"
    return f"(CASE WHEN {df} % 2 = 1 THEN {half} ELSE exp(-{y}) END + {terms})"
