"""Context building: dropping repeats, balancing documents, token budgets, conversation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.functions.text import collapse


def fingerprint(document: str, page: str, text: str) -> Column:
    """Identity of a chunk: its document, page and text without regard to case and white space."""
    return F.sha1(F.concat_ws("|", F.coalesce(F.col(document), F.lit("")), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lower(F.coalesce(collapse(text), F.lit("")))))


def drop_repeats(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each ``fp`` in a group, in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by, "fp").orderBy(*order))).where("_n = 1").drop("_n")


def balance(rows: DataFrame, by: str, document: str, order: list[Column], per_document: int = 4, total: int = 12) -> DataFrame:
    """At most ``per_document`` rows of a document and ``total`` rows of a group, in order; ``place`` is the position."""
    inside = F.row_number().over(W.partitionBy(by, document).orderBy(*order))
    kept = rows.withColumn("_n", inside).where(F.col("_n") <= per_document).drop("_n")
    return kept.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= total)


def within_budget(rows: DataFrame, by: str, text: str, order: list[Column], tokens: int = 6000) -> DataFrame:
    """Rows up to the one that exceeds the budget (a quarter of the characters counts as tokens, 1 at least); the first always stays."""
    w = W.partitionBy(by).orderBy(*order)
    cost = F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("int"))
    used = rows.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("place", F.row_number().over(w))
    return used.where((F.col("used") <= tokens) | (F.col("place") == 1))


def messages(chats: DataFrame) -> DataFrame:
    """One row per message of each chat (its latest delivery): ``chat_id``, ``turn`` from 0, ``role``, ``content``."""
    newest = chats.withColumn("_n", F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("ingested_at")))).where("_n = 1")
    return newest.select("chat_id", F.posexplode("conversation").alias("turn", "m")).select("chat_id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def recent(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` messages of each chat with their turns."""
    return turns.withColumn("_n", F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("turn")))).where(F.col("_n") <= n).drop("_n")


def answers(turns: DataFrame) -> DataFrame:
    """User turns with the turn of the answer that follows before the next user turn; null if none does."""
    w = W.partitionBy("chat_id").orderBy("turn")
    role, at = F.lead("role").over(w), F.lead("turn").over(w)
    return turns.withColumn("_r", role).withColumn("_t", at).where("role = 'user'").select("chat_id", "turn", F.when(F.col("_r") == "assistant", F.col("_t")).alias("answer_turn"))


def memory_segments(chats: DataFrame, keep: int = 6, step: int = 6) -> DataFrame:
    """Chats whose messages beyond the summarised ones number ``step`` or more, with the segment to summarise next (all but the last ``keep``)."""
    done, total = F.coalesce(F.col("memory.summarized_count"), F.lit(0)), F.size("conversation")
    rows = chats.where("conversation IS NOT NULL").select("chat_id", done.alias("done"), total.alias("total"), F.greatest(done, total - keep).alias("until")).distinct()
    return rows.where((F.col("total") - F.col("done")) >= step)


def cited(turns: DataFrame) -> DataFrame:
    """Citations ``[Cn]`` of assistant messages, each once."""
    return turns.where("role = 'assistant'").select("chat_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[C(\d+)\]"), F.lit(1)))).alias("citation"))


def transcripts(turns: DataFrame) -> DataFrame:
    """A chat's messages as one text with roles in front."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    return turns.groupBy("chat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("dialogue"))


# What a request asks for, tried in this order.
INTENTS = (("quiz", r"(?i)\b(?:quiz|mcqs?|test me|questions? on|practice questions?)\b"), ("summary", r"(?i)\b(?:summar(?:y|ise|ize|ies)|overview|tl;?dr|key points)\b"))


def intents(turns: DataFrame) -> DataFrame:
    """User messages with ``intent`` (quiz before summary, else general) and the number of items asked for, 1 to 20."""
    kind = F.when(F.lit(False), "")
    for name, pattern in INTENTS:
        kind = kind.when(F.col("content").rlike(pattern), name)
    count = F.regexp_extract("content", r"\b(\d{1,2})\b", 1).try_cast("int")
    return turns.where("role = 'user'").select("chat_id", "turn", kind.otherwise("general").alias("intent"), F.when(count.between(1, 20), count).alias("asked"))


def windows_of_text(rows: DataFrame, key: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Fixed windows over each text: ``chunk_no`` from 0, ``start_index`` and ``chunk``; blank texts give none."""
    step = size - overlap
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
    return rows.where(F.col(text).rlike(r"\S")).select(key, F.posexplode(starts).alias("chunk_no", "start_index"), text).select(key, "chunk_no", "start_index", F.substring(F.col(text), F.col("start_index") + 1, F.lit(size)).alias("chunk"))
