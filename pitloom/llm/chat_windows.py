"""Operator 6: chat formatting in budgeted windows, native throughout.

Every turn costs tokens (a fixed estimate from its bytes, or a given column). Prefix sums of the costs cut the
conversation into turn-aligned spans: with room for ``span`` tokens, turns that begin and end in the same multiple of
it form one span, and a turn that crosses a multiple is a span of its own; so no span exceeds its room unless a single
turn does, and no turn is cut or dropped. A window is the conversation's system turn, the latest earlier turns that
fit in ``history`` tokens, and one span. Only the span's assistant texts are targets: the system turn and the history
are repeated without loss, so every assistant text is learned once.

A turn is written as ``<|turn|>`` role newline text ``<|end|>``. Control strings inside texts and roles are escaped by a
backslash behind their first character (and one more where backslashes stand there already), which
``unescape`` takes back exactly.

Prefix sums work in two levels (blocks of turns, then blocks), and windows meet their history by an equi-join on
(conversation, bucket of tokens), so a conversation with any share of the rows is dealt over many tasks.

Defined results: null texts and roles are empty; null conv_ids are one conversation; rows of a conversation are in
order of turn, then role, then text, nulls first (repeated rows stay); an empty table gives no windows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitloom.llm.common import materialise

#: Tokens of a window's span, of its repeated history, and bytes a token.
SPAN, HISTORY, BYTES_A_TOKEN = 384, 128, 4
TURN, END = "<|turn|>", "<|end|>"
_BLOCK = 256

# Markers of this template and the control strings of common others.
_CONTROL = "([<\\[])(\\\\*)(\\||/?s>|/?INST\\]|/?SYS>)"
_ESCAPED = "([<\\[])\\\\(\\\\*)(\\||/?s>|/?INST\\]|/?SYS>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role has no newline once escaped: it is written as backslash n, a backslash as two."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.regexp_replace(unescape(role), "(?<!\\\\)((?:\\\\\\\\)*)\\\\n", "$1\n")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def _written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape_role(role), F.lit("\n"), escape(text), F.lit(END))


def _key(conv: Column) -> Column:
    """Conversations as keys that compare equal when null."""
    return F.struct(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("id"))


def numbered(rows: DataFrame) -> DataFrame:
    """conv, nth (position in the conversation), role, text, written, cost and before (cost of all earlier turns)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    base = rows.select(
        _key(F.col("conv_id").cast("long")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    ).withColumn("written", _written(F.col("role"), F.col("text")))
    base = base.withColumn("cost", F.ceil(F.octet_length("written") / BYTES_A_TOKEN).cast("long"))
    # Blocks of turn numbers; equal and null turns share one.
    base = base.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / _BLOCK).cast("long"))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.withColumn("k", F.row_number().over(inside)).withColumn("local", F.sum("cost").over(upto))
    sums = base.groupBy("conv", "block").agg(F.sum("cost").alias("block_cost"), F.count(F.lit(1)).alias("block_rows"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "conv",
        "block",
        F.coalesce(F.sum("block_cost").over(earlier), F.lit(0)).alias("cost_before"),
        F.coalesce(F.sum("block_rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    return local.join(offsets, ["conv", "block"]).select(
        "conv",
        (F.col("rows_before") + F.col("k") - 1).alias("nth"),
        "role",
        "text",
        "written",
        "cost",
        (F.col("cost_before") + F.col("local") - F.col("cost")).alias("before"),
    )


def windows(rows: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """One row per window: conv (struct none, id), window (its first turn's position), formatted, n_repeated (turns that
    only repeat) and loss_spans (start and length, in characters, of each target text in ``formatted``)."""
    turns = materialise(numbered(rows))
    spanned = turns.withColumn("low", F.expr(f"before div {span}")).withColumn(
        "high", F.expr(f"(before + cost - 1) div {span}")
    )
    ends = spanned.groupBy("conv", "low", "high").agg(
        F.min("nth").alias("window"),
        F.min("before").alias("starts"),
        F.array_sort(F.collect_list(F.struct("nth", "role", "text", "written"))).alias("new"),  # within ``span`` tokens
    )
    system = (
        turns.filter((F.col("nth") == 0) & (F.lower("role") == "system"))
        .select("conv", F.col("written").alias("system"))
    )
    # A turn can be history of windows that start up to ``history`` tokens behind its start: one or two buckets.
    bucket = F.expr(f"starts div {max(1, history)}")
    past = turns.filter(~((F.col("nth") == 0) & (F.lower("role") == "system"))).filter(F.col("cost") <= history)
    first, last = F.expr(f"(before + cost) div {max(1, history)}"), F.expr(f"(before + {history}) div {max(1, history)}")
    past = past.withColumn("bucket", F.explode(F.sequence(first, last)))
    starts = ends.select("conv", "window", "starts", bucket.alias("bucket"))
    repeated = (
        past.select("conv", "bucket", "nth", "before", "cost", F.col("written").alias("old"))
        .join(starts, ["conv", "bucket"])
        .filter((F.col("before") + F.col("cost") <= F.col("starts")) & (F.col("starts") - F.col("before") <= history))
        .groupBy("conv", "window")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "old"))).alias("past"))  # within ``history`` tokens
    )
    joined = ends.join(repeated, ["conv", "window"], "left").join(system, "conv", "left")
    heads = F.when(F.col("system").isNotNull() & (F.col("window") > 0), F.array("system")).otherwise(F.array().cast("array<string>"))
    olds = F.coalesce(F.transform("past", lambda p: p["old"]), F.array().cast("array<string>"))
    parts = joined.withColumn("repeats", F.concat(heads, olds))
    prefix = F.array_join("repeats", "")
    # Where each new turn begins, and in it its text.
    begun = F.aggregate(
        "new",
        F.struct(F.length(prefix).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["written"])).alias("at"),
            F.when(
                F.lower(t["role"]) == "assistant",
                F.concat(
                    a["spans"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(F.concat(F.lit(TURN), escape_role(t["role"]))) + 1).alias("start"),
                            F.length(escape(t["text"])).cast("long").alias("length"),
                        )
                    ),
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return parts.select(
        "conv",
        "window",
        F.concat(prefix, F.array_join(F.transform("new", lambda t: t["written"]), "")).alias("formatted"),
        F.size("repeats").alias("n_repeated"),
        begun["spans"].alias("loss_spans"),
    )


def parsed(formatted: Column, n_repeated: Column) -> Column:
    """The new turns (role, text) of a window, read back from its text."""
    split = F.split(formatted, "<\\|turn\\|>")
    pieces = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))  # nothing stands before the first mark
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))
            ).alias("text"),
        ),
    )
    return F.slice(turns, n_repeated + 1, F.greatest(F.size(pieces) - n_repeated, F.lit(0)))


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    told = F.transform(parsed(F.col("formatted"), F.col("n_repeated")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    targets = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    each = made.select(
        "conv",
        "window",
        F.size(told).alias("n"),
        F.array_join(told, "").alias("told"),
        F.array_join(targets, "").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    # A digest is of the whole conversation's text, so that text meets in one row; nothing else of it does.
    whole = each.groupBy("conv").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "told", "loss"))).alias("parts"),
    )
    told_all = F.array_join(F.transform("parts", lambda p: p["told"]), "")
    loss_all = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"),
        "n_turns",
        F.sha2(told_all.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss_all).cast("long").alias("loss_chars"),
        F.sha2(loss_all.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def with_control_conversation(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose two texts are control strings of another template."""
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(more)


ORACLE_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')),
w AS (
  SELECT *, '{TURN}' || role || chr(10) || regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g') || '{END}' AS written
  FROM r),
t AS (
  SELECT *, (strlen(written) + {BYTES_A_TOKEN - 1}) // {BYTES_A_TOKEN} AS cost,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS nth FROM w),
p AS (SELECT *, (sum(cost) OVER (PARTITION BY conv_id ORDER BY nth) - cost)::BIGINT AS before FROM t),
s AS (SELECT *, before // {SPAN} AS low, (before + cost - 1) // {SPAN} AS high FROM p),
wins AS (SELECT conv_id, low, high, min(before) AS starts, min(nth) AS first, sum(length(written)) AS chars FROM s GROUP BY ALL),
sys AS (SELECT conv_id, length(written) AS chars FROM p WHERE nth = 0 AND lower(role) = 'system'),
hist AS (
  SELECT wins.conv_id, wins.first, sum(length(p.written)) AS chars
  FROM wins JOIN p ON p.conv_id = wins.conv_id AND p.before + p.cost <= wins.starts AND wins.starts - p.before <= {HISTORY}
                  AND NOT (p.nth = 0 AND lower(p.role) = 'system')
  GROUP BY ALL),
f AS (
  SELECT wins.conv_id, sum(wins.chars + coalesce(hist.chars, 0) + CASE WHEN wins.first > 0 THEN coalesce(sys.chars, 0) ELSE 0 END)::BIGINT AS formatted_chars
  FROM wins LEFT JOIN hist ON hist.conv_id = wins.conv_id AND hist.first = wins.first LEFT JOIN sys ON sys.conv_id = wins.conv_id
  GROUP BY wins.conv_id)
SELECT p.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (lower(role) = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (lower(role) = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars) AS formatted_chars
FROM p JOIN f USING (conv_id) GROUP BY p.conv_id
"""
