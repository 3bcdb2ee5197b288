"""Chat formatting in DataFrame functions: budgeted, turn-aligned windows of a conversation.

Prefix sums of the turns' tokens cut a conversation into spans: a turn belongs to the span in which its
tokens begin, so spans are turn-aligned and hold at most ``budget`` tokens plus the end of their last
turn. A window is the conversation's system turn, a limited number of repeated turns before the span
(context, never trained on), and the span's own turns, whose assistant texts are the targets. Each turn is
new in exactly one window, so each target counts once.

Control strings inside texts are escaped reversibly: backslashes are doubled, and a backslash is put between the
first two characters of anything that could be read as a mark. Only the next character decides, so what follows an
inserted backslash is what decided on it, and no doubled backslash can be taken for one.

Scale: positions and prefix sums come from two levels of windows (blocks of 64 turn numbers, then the
blocks' totals), and repeated turns from joins on (conversation, position), so that a conversation
with a large share of all turns is spread over tasks; its windows are rows of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import land

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The second characters of what this or another common template could take for a mark: <|im_start|>, <s>, </s>, <<SYS>>, [INST], [/INST].
_MARKS = r"[|/sS<I]"
_BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={_MARKS})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([<\[])\\(?={_MARKS})", "$1"), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    """Plain names as they are, others (null is empty) as = and Base64."""
    role = F.coalesce(role, F.lit(""))
    return F.when(role.rlike(r"^[A-Za-z0-9_-]+\z"), role).otherwise(F.concat(F.lit("="), F.replace(F.base64(F.encode(role, "UTF-8")), F.lit("\r\n"), F.lit(""))))


def _unescape_role(role: Column) -> Column:
    return F.when(role.startswith("="), F.decode(F.unbase64(F.substr(role, F.lit(2))), "UTF-8")).otherwise(role)


def count_tokens(text: Column) -> Column:
    """The default measure of a turn: its white-space separated words, and four for its marks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 4


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv``, ``at`` (position from 0), ``role``, ``text``, ``tokens``, ``before`` (tokens of all
    turns before it). Turns are in order of their number (null last), ties by role and text."""
    base = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    base = base.withColumn("tokens", count_tokens(F.col("text")).cast("long")).withColumn("block", F.floor(F.col("turn") / _BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    within = base.withColumn("__at", F.count(F.lit(1)).over(inside)).withColumn("__before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    totals = base.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("conv").alias("__conv"), F.col("block").alias("__block"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("__turns"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("__sum"),
    )
    joined = within.join(starts, F.col("conv").eqNullSafe(F.col("__conv")) & F.col("block").eqNullSafe(F.col("__block")))
    return joined.select("conv", (F.col("__at") + F.col("__turns")).alias("at"), "role", "text", "tokens", (F.col("__before") + F.col("__sum")).alias("before"))


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 2, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Training windows, one row each: ``conv_id``, ``window`` (from 0, with gaps where a long turn fills several spans),
    ``formatted``, ``n_context`` (leading turns that are repeated), ``loss`` (array of (start, length), code
    points in ``formatted``: the assistant texts among the new turns, escaped as they stand).

    Null text and null role are empty. Null conversation id: one conversation. Repeated rows are turns like
    others. A system turn is one of role "system" in first place. Empty table: no rows. Other columns are not
    looked at.
    """
    rows = land(numbered_turns(turns, conv_col, turn_col, role_col, text_col).withColumn("window", F.floor(F.col("before") / budget).cast("long")), "turns")
    own = rows.select("conv", "window", "at", "role", "text", F.lit(True).alias("new"))
    heads = rows.groupBy("conv", "window").agg(F.min("at").alias("start")).filter("start > 0")
    # the turns at start - 1 .. start - history of each later window, and the system turn
    asked = heads.select(F.col("conv").alias("__conv"), F.col("window").alias("__window"), F.explode(F.sequence(F.lit(1), F.lit(history))).alias("back"), "start")
    asked = asked.select("__conv", "__window", (F.col("start") - F.col("back")).alias("__at")).filter("__at >= 0") if history else asked.select("__conv", "__window", F.lit(-1).cast("long").alias("__at")).filter("false")
    first = heads.select(F.col("conv").alias("__conv"), F.col("window").alias("__window"), F.lit(0).cast("long").alias("__at"))
    same = F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("at") == F.col("__at"))
    past = asked.filter("__at > 0").join(rows.drop("window"), same)
    zero = first.join(rows.filter("at = 0").drop("window"), same).join(asked.filter("__at = 0").select(F.col("__conv").alias("__c"), F.col("__window").alias("__w")), F.col("__conv").eqNullSafe(F.col("__c")) & (F.col("__window") == F.col("__w")), "left")
    zero = zero.filter((F.col("role") == "system") | F.col("__w").isNotNull())
    repeated = past.select("conv", F.col("__window").alias("window"), "at", "role", "text", F.lit(False).alias("new")).union(
        zero.select("conv", F.col("__window").alias("window"), "at", "role", "text", F.lit(False).alias("new"))
    )
    parts = own.union(repeated).select(
        "conv", "window",
        F.struct(
            "at", "new",
            F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
            escape(F.col("text")).alias("body"),
            ((F.col("role") == "assistant") & F.col("new")).alias("target"),
        ).alias("p"),
    )
    end = CLOSE + "\n"
    joined = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    sizes = F.transform("parts", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(end))
    spans = F.aggregate(
        F.arrays_zip(F.col("parts").alias("p"), F.col("sizes").alias("n")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["n"]).alias("at"),
            F.when(x["p"]["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(x["p"]["head"])).alias("start"), F.char_length(x["p"]["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return joined.withColumn("sizes", sizes).select(
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(end))), "").alias("formatted"),
        F.size(F.filter("parts", lambda p: ~p["new"])).alias("n_context"),
        spans.alias("loss"),
    )


def parse_windows(windows: DataFrame) -> DataFrame:
    """Windows read back: ``turns`` (array of (role, text), the new ones) and ``targets`` (array of text under the loss)
    beside the columns of ``windows``."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_context") + 2, F.size(F.split("formatted", r"<\|im_start\|>", -1)))
    role = lambda x: _unescape_role(F.substring_index(x, "\n", 1))
    text = lambda x: unescape(F.substr(x, F.char_length(F.substring_index(x, "\n", 1)) + 2, F.char_length(x) - F.char_length(F.substring_index(x, "\n", 1)) - 1 - len(CLOSE + "\n")))
    turns = F.transform(pieces, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))
    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.withColumn("turns", turns).withColumn("targets", targets)
