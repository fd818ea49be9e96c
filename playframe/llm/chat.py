"""Chat formatting by prefix-target expansion, in built-in functions only.

Every assistant turn becomes an example: all turns before it are context, and
its own text is the only part under the loss mask. Turns after the last
assistant turn (or all turns, where there is none) are one more example without
a target, so that nothing of a conversation is lost.

A turn is written as ``<s>[INST]role[/INST]\\n`` text ``</s>\\n``. Control strings
inside a text are escaped by one backslash more after their first character
than they have (``</s>`` -> ``<\\/s>``, ``<\\/s>`` -> ``<\\\\/s>``), which is undone by
taking one away; nothing else changes.

Defined results: null texts and roles count as empty; turns are ordered by turn
(null first), and repeated turn numbers by role and text; a conversation is one
value, as its last example holds all of its turns; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values of the template
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]\n", "</s>\n"
CONTROL = r"/?s>|/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", r"$1$2$3")


def examples(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), formatted, and the mask: mask_start and
    mask_length in code points of ``formatted`` (null without a target)."""
    one = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text"), F.lit("")).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    parts = F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(OPEN), escape(x["role"]), F.lit(MIDDLE)).alias("head"), escape(x["text"]).alias("body"),
        (x["role"] == target).alias("target")))
    conv = conv.select("conv_id", parts.alias("parts"))
    p = F.col("parts")
    last = F.size(p)
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.get(p, i - 1)["target"])
    conv = conv.withColumn("ends", ends)
    e = F.col("ends")
    stops = F.concat(e, F.when((F.size(e) == 0) | (F.element_at(e, -1) < last), F.array(last)).otherwise(F.array().cast("array<int>")))
    rows = conv.select("conv_id", "parts", F.posexplode(stops).alias("example", "stop"))
    whole = F.array_join(F.transform(F.slice(p, F.lit(1), F.col("stop")), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    final = F.get(p, F.col("stop") - 1)
    rows = rows.select("conv_id", "example", whole.alias("formatted"), final["target"].alias("target"), F.length(final["body"]).alias("size"))
    return rows.select(
        "conv_id", "example", "formatted",
        F.when(F.col("target"), F.length("formatted") - F.col("size") - len(CLOSE)).alias("mask_start"),
        F.when(F.col("target"), F.col("size")).alias("mask_length"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    body = F.substr(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))
    return F.transform(F.split(body, r"</s>\n<s>\[INST\]", -1), lambda x: F.struct(
        unescape(F.substring_index(x, MIDDLE, 1)).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, MIDDLE, 1)) + F.lit(len(MIDDLE) + 1))).alias("text")))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, from its examples: n_turns, turns_sha256, loss_chars,
    loss_sha256, and formatted_chars summed over the examples."""
    masked = F.substr("formatted", F.col("mask_start") + 1, F.col("mask_length"))
    conv = made.select("conv_id", "example", "formatted", F.when(F.col("mask_start").isNotNull(), unescape(masked)).alias("loss"))
    conv = conv.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("loss"))
    conv = conv.select("conv_id", "formatted_chars", "n_examples", read_back(F.col("longest")).alias("turns"),
                       F.array_join(F.transform("loss", lambda x: x["loss"]), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
