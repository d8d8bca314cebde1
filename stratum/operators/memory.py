"""Bounded views of conversations (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.functions.text import MESSAGE_BASE, MESSAGE_EACH, collapsed, token_estimate, trimmed

MESSAGES, TOTAL, USER_CHARS, ASSISTANT_CHARS = 20, 6_000, 1_200, 2_000
CHAT_TOKENS = 24_000


def line_contents(user_chars: int, assistant_chars: int) -> Column:
    """A message's text (role, text) as a line of the memory has it."""
    return F.left(collapsed(trimmed(F.coalesce("text", F.lit("")))), F.when(F.col("role") == "user", user_chars).otherwise(assistant_chars))


def bounded_memory(messages: DataFrame, last: int = MESSAGES, total: int = TOTAL, user_chars: int = USER_CHARS, assistant_chars: int = ASSISTANT_CHARS) -> DataFrame:
    """(conv_id, memory, n_lines): of each conversation's last messages those of users and assistants, from the newest
    back while their lines have ``total`` characters together, put in order again."""
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    recent = messages.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last).where(F.col("role").isin("user", "assistant"))
    user = F.col("role") == "user"
    lines = recent.withColumn("content", line_contents(user_chars, assistant_chars)).where("content <> ''").withColumn("line", F.concat(F.when(user, "用户：").otherwise("助手："), "content"))
    used = F.sum(F.length("line")).over(W.partitionBy("conv_id").orderBy("back").rowsBetween(W.unboundedPreceding, 0))
    fit = lines.withColumn("used", used).where(F.col("used") <= total)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return fit.groupBy("conv_id").agg(joined.alias("memory"), F.count(F.lit(1)).alias("n_lines"))


def message_totals(messages: DataFrame) -> DataFrame:
    each = MESSAGE_EACH + token_estimate("role") + token_estimate(F.coalesce("text", F.lit("")))
    return messages.groupBy("conv_id").agg((F.sum(each) + MESSAGE_BASE).alias("tokens"), F.count(F.lit(1)).alias("n_messages"))


def trimmed_chat(messages: DataFrame, budget: int = CHAT_TOKENS, least: int = 2) -> DataFrame:
    """The newest messages that fit the budget together; the last ``least`` stay whatever they cost."""
    each = MESSAGE_EACH + token_estimate("role") + token_estimate(F.coalesce("text", F.lit("")))
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    tokens = MESSAGE_BASE + F.sum("cost").over(newest.rowsBetween(W.unboundedPreceding, 0))
    return messages.withColumn("cost", each).withColumn("back", F.row_number().over(newest)).withColumn("tokens", tokens).where((F.col("tokens") <= budget) | (F.col("back") <= least)).select("conv_id", "turn", "role", "text", "tokens")


def history_view(messages: DataFrame, turns: int = 10, user_chars: int = 2_000, assistant_chars: int = 4_000) -> DataFrame:
    """The last ``turns`` turns of user and assistant, cut to what a client stores."""
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = messages.where(F.col("role").isin("user", "assistant")).withColumn("back", F.row_number().over(newest)).where(F.col("back") <= 2 * turns)
    return kept.select("conv_id", "turn", "role", F.left("text", F.when(F.col("role") == "user", user_chars).otherwise(assistant_chars)).alias("content"))
