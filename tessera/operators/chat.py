"""Conversations: context of turns, conversion of tool-calling sources, checks of format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chat, drop_system_prefix, parse_marker_chat, parse_paragraph_chat, role_name, sharegpt
from ..functions.udfs import function_call, tool_call
from .relational import limited, seeded_order


def last_user_before(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df with ``user_text``: what the user said last before each turn."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("user_text", F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(w))


def earlier_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df with ``earlier``: the turns before each that aren't blank, in order."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.trim(text) != "", F.struct(F.col(role).alias("role"), F.col(text).alias("content")))
    return df.withColumn("earlier", F.collect_list(said).over(w))


def has_roles(messages: Column, *roles: str, field: str = "from") -> Column:
    names = F.transform(messages, lambda m: m[field])
    out = F.lit(True)
    for r in roles:
        out = out & F.array_contains(names, r)
    return F.coalesce(out, F.lit(False))


def to_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation with its messages in order."""
    turns = F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(conv).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def convert_marked(df: DataFrame, most: int | None = None, position: str = "position") -> DataFrame:
    """(system, chat) rows in order of position: for each assistant turn with JSON, system if any, the user before it, and the JSON."""
    turns = df.select(position, drop_system_prefix(F.col("system")).alias("system"), F.posexplode(parse_marker_chat(F.col("chat"))).alias("turn", "t")).select(position, "system", "turn", "t.*")
    turns = last_user_before(turns, position, "turn", "role", "content").withColumn("json", function_call("content"))
    kept = turns.where("role = 'assistant' and json is not null and user_text is not null")
    both = chat(("user", F.col("user_text")), ("assistant", F.col("json")))
    kept = kept.withColumn("messages", F.when(F.col("system") != "", F.concat(chat(("system", F.col("system"))), both)).otherwise(both))
    return limited(kept, most, position, "turn").select(position, "turn", "messages")


def convert_tool_calls(df: DataFrame, most: int | None = None, position: str = "position") -> DataFrame:
    """(conversations) rows in order of position: for each assistant turn with exactly one tool call, all turns before it and the call."""
    turns = df.select(position, F.posexplode("conversations").alias("turn", "t")).select(position, "turn", role_name(F.col("t.from")).alias("role"), F.col("t.value").alias("content"))
    turns = earlier_turns(turns, position, "turn", "role", "content").withColumn("json", tool_call("content"))
    kept = turns.where(F.col("role").eqNullSafe("assistant") & F.col("json").isNotNull() & F.exists("earlier", lambda m: m["role"] == "user"))
    kept = kept.withColumn("messages", F.concat("earlier", chat(("assistant", F.col("json")))))
    return limited(kept, most, position, "turn").select(position, "turn", "messages")


def paragraph_conversations(df: DataFrame, most: int | None = None, seed: int = 42, position: str = "position") -> DataFrame:
    """(system, chat) rows, in seeded order: conversations with both human and gpt, the system in front if there is one."""
    system = drop_system_prefix(F.col("system"))
    rows = df.select(position, system.alias("system"), parse_paragraph_chat(F.col("chat")).alias("turns")).where(has_roles(F.col("turns"), "human", "gpt"))
    rows = rows.withColumn("conversations", F.when(F.col("system") != "", F.concat(sharegpt(("system", F.col("system"))), "turns")).otherwise(F.col("turns")))
    return rows.orderBy(seeded_order(seed, position)).limit(most).select("conversations") if most is not None else rows.select("conversations")


def tool_conversations(df: DataFrame, most: int | None = None, seed: int = 42, position: str = "position") -> DataFrame:
    """(conversations) rows with both human and gpt, unchanged, in seeded order."""
    rows = df.where(has_roles(F.col("conversations"), "human", "gpt"))
    return (rows.orderBy(seeded_order(seed, position)).limit(most) if most is not None else rows).select("conversations")


def merged(old: DataFrame, *new: DataFrame, merge: bool = True) -> DataFrame:
    """Existing and new records, one after another, with duplicates; without ``merge`` the new ones alone."""
    out = old if merge else None
    for n in new:
        out = n if out is None else out.unionByName(n, allowMissingColumns=True)
    return out


def errors_of(m: Column, needed: tuple[str, ...] = ("user", "assistant")) -> Column:
    """What is wrong with messages: that they aren't there, roles that lack, contents that are blank."""
    checks = [F.when(m.isNull(), F.lit("messages: not a list"))]
    for r in needed:
        checks.append(F.when(~has_roles(m, r, field="role"), F.lit(f"no {r} message")))
    blank = F.filter(F.transform(m, lambda x, i: F.when(F.coalesce(F.trim(x["content"]), F.lit("")) == "", F.concat(F.lit("blank content at "), i.cast("string")))), lambda e: e.isNotNull())
    return F.concat(F.filter(F.array(*checks), lambda e: e.isNotNull()), F.coalesce(blank, F.array().cast("array<string>")))


def format_errors(df: DataFrame, key: str = "conv_id", needed: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """(key, error) of the column messages."""
    return df.select(key, F.explode(errors_of(F.col("messages"), needed)).alias("error"))
