"""Conversation tables: histories, prompts, thread states, tool calls, answers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.schema import PROMPT_HUMAN, PROMPT_SYSTEM

# Step kind in the store -> message kind in a history; other steps are left out.
KINDS = {"user": "human", "assistant": "ai"}
STREAM, END = "on_chat_model_stream", "on_chat_model_end"


def joined(text: Column | str, *order: str, sep: str = "") -> Column:
    """Aggregate: text pieces in order, as one string."""
    text = F.col(text) if isinstance(text, str) else text
    pairs = F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("_piece"))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["_piece"]), sep)


def rebuild_history(conversations: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """Messages of a stored thread, a row each: conv_id, turn, kind, text.

    Rows keep their order in ``turn``; nothing is gathered, so a thread may be
    of any length.
    """
    kind = F.lit(None).cast("string")
    for step, name in kinds.items():
        kind = F.when(F.col("role") == step, name).otherwise(kind)
    return (
        conversations.where(F.col("role").isin(*kinds))
        .select("conv_id", "turn", kind.alias("kind"), "text")
    )


def append_turns(history: DataFrame, user: DataFrame, tools: DataFrame, answers: DataFrame) -> DataFrame:
    """History with one more exchange: the user's message, tool responses, the answer.

    All inputs have conv_id, turn, text; the result adds kind and ``rank``,
    which orders the messages of a turn.
    """
    def tagged(df: DataFrame, kind: str, rank: int) -> DataFrame:
        return df.select("conv_id", "turn", F.lit(kind).alias("kind"), "text", F.lit(rank).alias("rank"))

    parts = [
        history.select("conv_id", "turn", "kind", "text", F.lit(0).alias("rank")),
        tagged(user, "human", 1), tagged(tools, "tool", 2), tagged(answers, "ai", 3),
    ]
    return reduce(DataFrame.unionByName, parts)


def _line() -> Column:
    return F.concat("kind", F.lit(": "), "text")


_SLOT = re.compile(r"\{(user_message|chat_history)\}")


def _filled(template: str, said: Column, lines: Column | None) -> Column:
    """The template with its slots filled; all of it up to the history where that comes as rows."""
    parts = _SLOT.split(template)
    if lines is None:
        if parts[-2:] != ["chat_history", ""] or parts.count("chat_history") != 1:
            raise ValueError("a template for lines must end with {chat_history}")
        parts = parts[:-2]
    slots = {"user_message": F.coalesce(said, F.lit("")), "chat_history": lines}
    return F.concat(F.lit("Human: "), *[slots[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def _said() -> Column:
    return F.max_by("text", F.when(F.col("kind") == "human", F.col("turn")))


def prompts(history: DataFrame, system: str = PROMPT_SYSTEM, human: str = PROMPT_HUMAN) -> DataFrame:
    """Prompt of the latest user message of every thread: conv_id, prompt.

    ``human`` has the slots ``{user_message}`` and ``{chat_history}``; the history already holds that message.  A prompt is one
    string, so it is for threads that fit a model; ``prompt_lines`` serves threads of any length.
    """
    said = _filled(human, _said(), joined(_line(), "turn", sep="\n"))
    return history.groupBy("conv_id").agg(F.concat(F.lit(f"System: {system}\n"), said).alias("prompt"))


def prompt_lines(history: DataFrame, system: str = PROMPT_SYSTEM, human: str = PROMPT_HUMAN) -> DataFrame:
    """The same prompts as rows: conv_id, pos, line; the head has no ``pos`` and comes first.

    The lines after the head, in order and joined by line breaks, follow it directly, so ``human`` ends with the
    history.  Nothing but the latest user message is gathered.
    """
    head = F.concat(F.lit(f"System: {system}\n"), _filled(human, _said(), None))
    heads = history.groupBy("conv_id").agg(head.alias("line"))
    return history.select("conv_id", F.col("turn").alias("pos"), _line().alias("line")).unionByName(
        heads.select("conv_id", F.lit(None).cast("long").alias("pos"), "line"))


def latest_run(runs: DataFrame, by: str = "thread", tie: str = "run_id") -> DataFrame:
    """Newest run of every thread.

    The newest of each thread is found on times and ids alone; only the winners' rows are joined, by thread, time and id, so a thread
    of many runs spreads and no message sits in an aggregate.
    """
    newest = runs.select(by, "start_time", tie).groupBy(by).agg(F.max(F.struct("start_time", tie)).alias("_newest"))
    newest = newest.select(F.col(by).alias("_by"), F.col("_newest.start_time").alias("_at"), F.col(f"_newest.{tie}").alias("_tie"))
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("start_time").eqNullSafe(F.col("_at")) & F.col(tie).eqNullSafe(F.col("_tie"))
    # A run that is there twice counts once.
    nth = F.row_number().over(Window.partitionBy(by).orderBy(tie))
    return runs.join(newest, same, "left_semi").withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def thread_state(runs: DataFrame, by: str = "thread", tie: str = "run_id") -> DataFrame:
    """Messages of every thread now: what its newest run was given and what it said."""
    return latest_run(runs.select(by, tie, "start_time", "messages", "output"), by, tie).select(
        by, F.concat("messages", F.array("output")).alias("messages")
    )


def tool_calls(events: DataFrame, final_pass: int = 1) -> DataFrame:
    """Tool calls of the first pass, a row each; calls of later passes are ignored."""
    keys = [c for c in ("conv_id", "run_id", "run_started_at") if c in events.columns]
    return (
        events.where((F.col("event") == END) & (F.col("pass") <= final_pass))
        .select(*keys, "seq", F.posexplode("tool_calls").alias("pos", "call"))
        .select(*keys, "seq", "pos", F.col("call.id").alias("tool_call_id"), F.col("call.name").alias("name"),
                F.col("call.arg").alias("arg"))
    )


def registry_rows(registry: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All tools' records as one table (name, arg, and a column of records for each tool)."""
    kinds = [df.schema for df, _ in registry.values()]
    parts = [
        df.select(F.lit(tool).alias("name"), F.col(key).cast("string").alias("arg"), *[
            (F.struct("*") if i == at else F.lit(None).cast(kind)).alias(f"_record_{i}") for i, kind in enumerate(kinds)])
        for at, (tool, (df, key)) in enumerate(registry.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def dispatch(calls: DataFrame, registry: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Responses to tool calls: the call with ``content`` (the record as JSON) and ``error``.

    One left join for all tools; only records that were asked for become JSON.  A name that is
    no tool is an error, an argument without a record gives a null content.  Works on a stream of calls
    as a stream-static join; no broadcast is forced.
    """
    out = calls.join(registry_rows(registry), ["name", "arg"], "left")
    records = [f"_record_{i}" for i in range(len(registry))]
    content = F.coalesce(*[F.when(F.col(r).isNotNull(), F.to_json(r)) for r in records])
    known = F.coalesce(F.col("name").isin(*registry), F.lit(False))
    error = F.when(~known, F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit(""))))
    return out.withColumn("content", content).withColumn("error", error).drop(*records)


def with_tools(runs: DataFrame, responses: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs that got any tool response and so go on to a second pass."""
    answered = responses.where(F.col("error").isNull()).select(key)
    return runs.join(answered, key, "left_semi")


def answers(events: DataFrame, tools: Sequence[str] | None = None) -> DataFrame:
    """Answer text of every run: conv_id, run_id, text.

    The chunks of the first pass in order, then those of the second pass if a known tool was
    called, as in ``with_tools``; without ``tools`` every name is known.
    """
    is_chunk = F.col("event") == STREAM
    known = lambda call: call["name"].isin(*tools) if tools is not None else F.lit(True)
    called = (F.col("event") == END) & (F.col("pass") == 1) & F.coalesce(F.exists("tool_calls", known), F.lit(False))
    piece = lambda p: joined(F.when(is_chunk & (F.col("pass") == p), F.col("chunk")), "seq")
    return events.groupBy("conv_id", "run_id").agg(
        F.concat(piece(1), F.when(F.max(F.coalesce(called, F.lit(False))), piece(2)).otherwise("")).alias("text"))
