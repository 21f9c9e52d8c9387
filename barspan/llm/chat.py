"""Chat formatting into budgeted windows, with DataFrame functions only.

Turns get their place in the conversation by one range sort whose ranges may cut through a
conversation, so a conversation of any length is spread over tasks.  Spans of `chunk` turns are
then formatted on their own: prefix sums of turn tokens choose turn-aligned windows, each opens
with the system turn and a limited history, and only the assistant texts that are new in it are
under its loss mask.

A turn is written as <|im_start|>ROLE, a line feed, TEXT, <|im_end|>, a line feed.  Inside texts and
roles a backslash is put after each < that stands before a | (or before backslashes and a |), so no
text holds a control string; taking one backslash out again gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read_table

START, END = "<|im_start|>", "<|im_end|>"
#: Runs of other characters are words, each ASCII sign is a token of its own.
TOKEN = r"[^\x00-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]"
#: Tokens of a turn's own marks.
MARKS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at a line feed, so its own are written as %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def token_count(role: Column, text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint") + MARKS


def placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, pos (from 0 in each conversation), total (its turns), role, text.

    A range sort is written once; a conversation's rows in one range have consecutive numbers, so
    counts per range shift them to places and no window orders a whole conversation's rows.
    """
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), part(role_col).alias("role"), part(text_col).alias("text"))
    order = ["conv_id", "turn", F.xxhash64("role", "text")]
    numbered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "turns")
    ranges = numbered.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select(F.col("conv_id").alias("_id"), F.col("part").alias("_part"), (before - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    same = F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part"))
    return numbered.join(shifts, same).select("conv_id", (F.col("seq") + F.col("shift")).alias("pos"), "total", "role", "text")


def windows(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 512, history_tokens: int = 128, history_turns: int = 4, target: str = "assistant", system: str = "system", cost=token_count, chunk: int = 1024) -> DataFrame:
    """Formatted windows: conv_id, first_turn, turns, text, new_from, loss, tokens, over_budget.

    first_turn is the place of the first turn that is new in the window, turns how many are new.
    New turns are taken while their tokens fit budget - the system turn's - history_tokens; before
    them come the conversation's first turn if its role is `system`, and the longest run of at most
    history_turns turns and history_tokens tokens that ends where they begin.  A turn that does not
    fit is a window of its own and over_budget; no turn is cut or dropped.  Every chunk-th turn
    begins a window, whatever room is left.  new_from is where the new part begins and loss the
    (start, length) of each new target text in it, in code points of text; repeated ones are masked.

    Turns are ordered by turn (null first), ties by a hash of role and text; repeated rows are
    turns each.  Null conversation ids form one conversation, null roles and texts count as empty,
    texts of any length stay whole, an empty table gives an empty result and other columns are not
    read.
    """
    rows = placed(turns, conv_col, turn_col, role_col, text_col)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    lead = (F.col("pos") == 0) & (F.col("role") == system)
    at, last = F.floor(F.col("pos") / chunk), F.floor((F.col("total") - 1) / chunk)
    halo = F.when((F.pmod("pos", F.lit(chunk)) >= chunk - history_turns) & (at < last), F.array(at + 1)).otherwise(F.array().cast("array<bigint>"))
    every = F.when(lead & (last > 0), F.sequence(F.lit(1).cast("bigint"), last)).otherwise(F.array().cast("array<bigint>"))
    turn = rows.select(
        "conv_id", "pos", lead.alias("lead"), cost(F.col("role"), F.col("text")).alias("cost"),
        F.concat(head, body, F.lit(END + "\n")).alias("block"), F.length(head).cast("bigint").alias("loss_at"), F.length(body).cast("bigint").alias("loss_len"),
        (F.col("role") == target).alias("target"), F.explode(F.array_distinct(F.concat(F.array(at), halo, every))).alias("chunk"),
    )
    # Prefix sums inside a chunk: tokens without the system turn, for which room is kept, and code points.
    w = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    repeated = F.col("lead") & (F.col("chunk") > 0)
    sums = turn.withColumns({
        "upto": F.sum(F.when(F.col("lead"), F.lit(0)).otherwise(F.col("cost"))).over(w),
        "chars": F.sum(F.when(repeated, F.lit(0)).otherwise(F.length("block"))).over(w),
    })
    fields = F.struct("pos", "lead", "cost", "upto", "chars", "block", "loss_at", "loss_len", "target")
    grouped = sums.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(fields)).alias("all"))
    none = F.lit("")
    first = F.col("chunk") * chunk
    grouped = grouped.select(
        "conv_id", first.alias("first"),
        F.get(F.filter("all", lambda t: t["lead"]), F.lit(0)).alias("sys"),
        F.filter("all", lambda t: ~t["lead"] | (first == 0)).alias("line"),
    ).withColumn("room", F.greatest(F.lit(1), budget - history_tokens - F.coalesce(F.col("sys.cost"), F.lit(0))))
    own = F.filter("line", lambda t: t["pos"] >= F.col("first"))
    begin = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(0).cast("bigint").alias("base"))
    step = lambda s, t: F.when((F.size(s["starts"]) == 0) | (t["upto"] - s["base"] > F.col("room")), F.struct(F.concat(s["starts"], F.array(t["pos"])).alias("starts"), F.when(t["lead"], t["upto"]).otherwise(t["upto"] - t["cost"]).alias("base"))).otherwise(s)
    chosen = grouped.withColumn("starts", F.aggregate(own, begin, step)["starts"]).withColumns({"end": F.element_at("line", -1)["pos"] + 1, "low": F.element_at("line", 1)["pos"]})

    def window(start: Column, stop: Column) -> Column:
        new = F.slice("line", (start - F.col("low") + 1).cast("int"), (stop - start).cast("int"))
        opens = F.element_at("line", (start - F.col("low") + 1).cast("int"))
        before = F.when(opens["lead"], opens["upto"]).otherwise(opens["upto"] - opens["cost"])
        reach = F.least(F.lit(history_turns).cast("bigint"), start - F.col("low"))
        back = F.slice("line", (start - F.col("low") - reach + 1).cast("int"), reach.cast("int"))
        past = F.filter(back, lambda h: ~h["lead"] & (before - (h["upto"] - h["cost"]) <= history_tokens))
        joined = lambda x: F.array_join(F.transform(x, lambda t: t["block"]), "")
        opening = F.concat(F.when((start > 0) & F.col("sys").isNotNull(), F.col("sys.block")).otherwise(none), joined(past))
        origin = F.length(opening) - (opens["chars"] - F.length(opens["block"]))
        loss = F.transform(F.filter(new, lambda t: t["target"]), lambda t: F.struct((origin + t["chars"] - F.length(t["block"]) + t["loss_at"]).alias("start"), t["loss_len"].alias("length")))
        total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, t: s + F.when(t["lead"], F.lit(0)).otherwise(t["cost"]))
        tokens = F.coalesce(F.col("sys.cost"), F.lit(0)) + total(past) + total(new)
        return F.struct(start.alias("first_turn"), (stop - start).cast("int").alias("turns"), F.concat(opening, joined(new)).alias("text"), F.length(opening).cast("bigint").alias("new_from"), loss.alias("loss"), tokens.alias("tokens"), (tokens > budget).alias("over_budget"))

    stops = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("end"))
    built = chosen.withColumn("stops", stops).select("conv_id", F.explode(F.zip_with("starts", "stops", window)).alias("w"))
    return cut(built.select("conv_id", "w.*"), "windows")


def read_windows(formatted: DataFrame) -> DataFrame:
    """Read windows back: conv_id, first_turn, turns as array of (role, text), loss as array of texts, chars.

    Only the new part of each window is read, so each turn comes back once.
    """
    parts = F.split(F.substring("text", F.col("new_from").cast("int") + 1, F.length("text")), r"<\|im_end\|>\n", -1)

    def turn(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(inner, F.length(role) + 2, F.length(inner))).alias("text"))

    held = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.select("conv_id", "first_turn", F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn).alias("turns"), held.alias("loss"), F.length("text").cast("bigint").alias("chars"))


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation takes it whole: this, unlike the windows, gathers one
    conversation's text in a row.
    """
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    piece = F.struct("first_turn", told.alias("told"), F.array_join("loss", "").alias("loss"))
    whole = read.groupBy("conv_id").agg(F.sum(F.size("turns")).alias("n_turns"), F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("chars").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", F.array_join(F.col("pieces.told"), "").alias("told"), F.array_join(F.col("pieces.loss"), "").alias("loss"), "formatted_chars")
    return whole.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op12_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(END + START + "assistant ok").alias("text"))
    return digests(read_windows(windows(turns.unionByName(odd))))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length(role) + 24 AS chars,
    len(regexp_extract_all(text, '[^\x00-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]')) + 4 AS cost
  FROM t),
s AS (SELECT conv_id, cost, chars FROM p WHERE pos = 0 AND role = 'system'),
c AS (
  SELECT p.*, coalesce(s.cost, 0) AS sys_cost, coalesce(s.chars, 0) AS sys_chars, s.conv_id IS NOT NULL AND pos = 0 AS lead,
    sum(CASE WHEN s.conv_id IS NOT NULL AND pos = 0 THEN 0 ELSE p.cost END) OVER (PARTITION BY p.conv_id ORDER BY pos) AS upto
  FROM p LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
b AS (SELECT *, upto - CASE WHEN lead THEN 0 ELSE cost END AS base FROM c),
nxt AS (
  SELECT x.conv_id, x.pos, min(y.pos) AS stop FROM b x JOIN b y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND y.pos > x.pos
    AND (y.upto - x.base > greatest(1, 512 - 128 - x.sys_cost) OR y.pos % 1024 = 0) GROUP BY ALL),
w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos FROM p
  UNION ALL SELECT w.conv_id, nxt.stop FROM w JOIN nxt ON nxt.conv_id IS NOT DISTINCT FROM w.conv_id AND nxt.pos = w.pos),
again AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT w.conv_id, h.chars FROM w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.pos = w.pos
      JOIN b h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.pos BETWEEN w.pos - 4 AND w.pos - 1 AND NOT h.lead AND b.base - h.base <= 128
    UNION ALL SELECT w.conv_id, b.sys_chars FROM w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.pos = 0 WHERE w.pos > 0)
  GROUP BY conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss, sum(chars) AS chars
  FROM p GROUP BY conv_id)
SELECT d.conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  (d.chars + coalesce(again.chars, 0))::BIGINT AS formatted_chars
FROM d LEFT JOIN again ON again.conv_id IS NOT DISTINCT FROM d.conv_id
"""
