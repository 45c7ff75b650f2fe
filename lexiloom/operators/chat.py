"""Chats: message rules, sessions, tool loops; over a corpus one ordered fold per conversation."""

from __future__ import annotations

import asyncio
import inspect
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.structure import schema_error, tool_schema
from lexiloom.operators import runtime
from lexiloom.plans.specs import Model

ROLES = ("system", "user", "assistant", "tool")
TOOLS: dict[str, Callable] = {}


class ToolError(RuntimeError):
    """A tool that is not registered, or gave something other than a string."""


def register_tool(func: Callable) -> Callable:
    """Make a function callable by models, under its name; its schema is made at once so that mistakes show."""
    func.tool_schema = tool_schema(func)
    TOOLS[func.__name__] = func
    return func


def check_message(m: dict) -> str | None:
    """Why a message breaks the rules of its role; None if it does not."""
    if m.get("role") not in ROLES:
        return "unknown role"
    content = m.get("content")
    if isinstance(content, list):
        for part in content:
            kind = part.get("type") if isinstance(part, dict) else None
            if kind == "text" and not isinstance(part.get("text"), str) or kind == "image_url" and not isinstance((part.get("image_url") or {}).get("url"), str) or kind not in ("text", "image_url"):
                return "bad content part"
    elif content is not None and not isinstance(content, str):
        return "content is text or parts"
    if m["role"] == "tool":
        if not m.get("tool_call_id") or not isinstance(content, str):
            return "a tool message has an id and text"
    elif m.get("tool_call_id"):
        return "only tool messages have a tool_call_id"
    if m.get("tool_calls") and m["role"] != "assistant":
        return "only the assistant calls tools"
    if content is None and not m.get("tool_calls"):
        return "no content"
    if m.get("response_succeeded") is not None and m["role"] != "user":
        return "response_succeeded is for user messages"
    return None


@dataclass
class Session:
    """A chat so far: at most one system message, and that first."""

    messages: list[dict] = field(default_factory=list)

    def add(self, message: dict) -> None:
        if why := check_message(message):
            raise ValueError(why)
        if message["role"] == "system" and self.messages:
            raise ValueError("the system message is the first one, and the only one")
        self.messages.append(message)

    def ask(self, prompt: str, system: str | None = None) -> dict:
        """The user message of a prompt; an unanswered message of the same text is used again."""
        if system and not self.messages:
            self.add({"role": "system", "content": system})
        last = self.messages[-1] if self.messages else None
        if last and last["role"] == "user" and last.get("response_succeeded") is False and last["content"] == prompt:
            return last
        message = {"role": "user", "content": prompt, "response_succeeded": False}
        self.add(message)
        return message

    def reset(self) -> None:
        self.messages = []


def finished(awaitable):
    """What a coroutine gives, run to its end; in a thread of its own where a loop runs already."""

    async def whole():
        return await awaitable

    try:
        asyncio.get_running_loop()
    except RuntimeError:
        return asyncio.run(whole())
    with ThreadPoolExecutor(1) as pool:
        return pool.submit(lambda: asyncio.run(whole())).result()


def run_tool(call: dict, tools: dict[str, Callable]) -> str:
    """A tool's answer; bad JSON, a schema mismatch or an exception of the tool become an error payload."""
    func = tools.get(call["name"])
    if func is None:
        raise ToolError(f"no tool is named {call['name']!r}")
    try:
        args = json.loads(call.get("arguments") or "{}")
    except ValueError as e:
        return json.dumps({"error": f"arguments are not JSON: {e}"})
    schema = getattr(func, "tool_schema", None) or tool_schema(func)
    if why := schema_error(args, schema["function"]["parameters"]):
        return json.dumps({"error": why})
    try:
        out = func(**args)
        if inspect.isawaitable(out):
            out = finished(out)
    except Exception as e:
        return json.dumps({"error": f"{type(e).__name__}: {e}"})
    if not isinstance(out, str):
        raise ToolError(f"{call['name']} must return a string")
    return out


def chat(session: Session, prompt: str, complete, model: Model, system: str | None = None, tools: dict[str, Callable] | None = None, parallel: bool = False, retries: int | None = None) -> str:
    """One turn. ``complete(messages, tools allowed) -> {"content", "tool_calls"}``, or a pair of such, the second for the model's fallback.

    No content, or an exception, is tried again ``retries`` times (the model's ``retries_invalid`` by default), then by the
    fallback. Tools are run for ``tool_max_rounds`` rounds; calls left over, and unknown tools, are an error at once.
    """
    tools = {n: (tools or TOOLS)[n] for n in model.tools}
    message = session.ask(prompt, system)
    history = list(session.messages)
    first, second = complete if isinstance(complete, tuple) else (complete, complete)
    why = "no content"
    for attempt, ask in ((model, first), (model.fallback, second)):
        if attempt is None:
            continue
        for _ in range(1 + (attempt.retries_invalid if retries is None else retries)):
            try:
                reply, extra = _turn(history, ask, attempt, tools, parallel)
            except ToolError:
                raise
            except Exception as e:
                why = f"{type(e).__name__}: {e}"
                continue
            if reply and reply.get("content") is not None:
                message["response_succeeded"] = True
                for m in extra:
                    session.add(m)
                session.add({"role": "assistant", "content": reply["content"]})
                return reply["content"]
    raise RuntimeError(f"no reply from the model or its fallback; last: {why}")


def _turn(history: list[dict], ask: Callable, model: Model, tools: dict[str, Callable], parallel: bool) -> tuple[dict | None, list[dict]]:
    """The reply after all tool rounds, and the messages that the rounds added."""
    reply, extra, rounds = ask(history, bool(tools)), [], 0
    while reply and reply.get("tool_calls") and rounds < model.tool_max_rounds:
        calls = reply["tool_calls"]
        if parallel:
            with ThreadPoolExecutor(len(calls)) as pool:
                answers = list(pool.map(lambda c: run_tool(c, tools), calls))
        else:
            answers = [run_tool(c, tools) for c in calls]
        extra.append({"role": "assistant", "content": reply.get("content"), "tool_calls": calls})
        extra += [{"role": "tool", "content": a, "tool_call_id": c["id"], "name": c["name"]} for a, c in zip(answers, calls)]
        rounds += 1
        reply = ask(history + extra, rounds < model.tool_max_rounds)
    if reply and reply.get("tool_calls"):
        raise ToolError(f"tools are still called after {rounds} rounds")
    return reply, extra


# ---- over a table of messages (conv_id, turn, role, text)


def ordered(messages: DataFrame) -> DataFrame:
    """Messages with their place, the role before them, and how many user messages came so far."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.select("*", (F.row_number().over(w) - 1).alias("seq"), F.lag("role").over(w).alias("role_before"), F.lead("role").over(w).alias("role_after"), F.sum((F.col("role") == "user").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("users_so_far"))


def session_checks(messages: DataFrame) -> DataFrame:
    """Per conversation: turns, system messages, whether a system message stands elsewhere than first."""
    system = F.col("role") == "system"
    at = ordered(messages)
    return at.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(system.cast("long")).alias("n_system"), F.max((system & (F.col("seq") > 0)).cast("int")).alias("late_system"))


def unanswered(messages: DataFrame) -> DataFrame:
    """User messages that no assistant message follows."""
    return ordered(messages).where("role = 'user' AND (role_after IS NULL OR role_after <> 'assistant')").select("conv_id", "turn", "text")


def histories(messages: DataFrame) -> DataFrame:
    """Per user message: what a call would carry - messages and characters so far."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return messages.select("conv_id", "turn", "role", F.count(F.lit(1)).over(w).alias("n_messages"), F.sum(F.length("text")).over(w).alias("n_chars")).where("role = 'user'")


def replay(messages: DataFrame, reply: Callable[[list[dict]], str], system: str | None = None) -> DataFrame:
    """Answer every user message of every conversation in order: (conv_id, seq, role, content, response_succeeded).

    Conversations are the unit of order, so one is folded in one task.
    """
    runtime.prepare(messages.sparkSession)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        session = Session()
        for text in pdf.sort_values("turn").query("role == 'user'")["text"]:
            message = session.ask(text or "", system)
            answer = reply(list(session.messages))
            if answer is not None:
                message["response_succeeded"] = True
                session.add({"role": "assistant", "content": answer})
        rows = [(pdf["conv_id"].iloc[0], i, m["role"], m["content"], m.get("response_succeeded")) for i, m in enumerate(session.messages)]
        return pd.DataFrame(rows, columns=["conv_id", "seq", "role", "content", "response_succeeded"])

    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(fold, "conv_id long, seq int, role string, content string, response_succeeded boolean")


def valid_json_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False
