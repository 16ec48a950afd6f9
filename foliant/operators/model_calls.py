"""Calls of a multimodal model: messages, guards, payloads, answers, retries. The client is pluggable.

Messages are MESSAGE structs. What needs no network is Column expressions or plain functions; run() calls a
client for each row, once for each partition's worker.
"""

from __future__ import annotations

import hashlib
import inspect
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let, strip
from foliant.model import MESSAGE

GUARD = "\n\n[Output] Put the whole answer into the message's content; never into reasoning fields, and without steps or remarks."
RETRY_GUARD = "\nThe last answer was empty: write the final text now."
CONCISE_GUARD = "\nKeep any thinking short."
EMPTY_PAGE = "（本页转写未成功）\n"


# Messages


def message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content")).cast(MESSAGE)


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image"))


def user_message(text: Column, images: Column) -> Column:
    """Images first, then the text."""
    pictures = F.transform(images, lambda i: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), i.alias("image")))
    return F.struct(F.lit("user").alias("role"), F.concat(pictures, F.array(text_part(text))).alias("content")).cast(MESSAGE)


def prompt(task: str, *sections: tuple[str, Column]) -> Column:
    """An instruction followed by titled sections; empty ones are left out."""
    parts = [F.lit(task), *[F.when(strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"\n\n## {title}\n"), c)) for title, c in sections]]
    return F.concat_ws("", *parts)


TASKS = {
    "cleanup": "Repair this Markdown without changing facts, image references or the number of table rows.",
    "table_cleanup": "Repair this table. Keep its rows and columns; answer with the table alone.",
    "table_caption": "Say in one sentence what this table holds.",
    "image_caption": "Say in one sentence what this image shows.",
    "quality": "Compare both versions. Answer with QC_SCORE, NEED_RERUN, SUGGEST_OCR_QUALITY, SUGGEST_TABLE_ACCURACY and SUGGEST_GENERATE_PAGE_IMAGES, one KEY=value a line.",
}


def guard(thinking: bool, max_reasoning: int | None, retry: bool = False) -> str:
    limit = f"\nThink in at most {max_reasoning} tokens." if thinking and max_reasoning is not None else ""
    return GUARD + limit + (RETRY_GUARD if retry else "")


def guarded(messages: Column, text: str) -> Column:
    """The guard at the end of the first system text, else of the last user text; once only."""
    note = F.lit(text)
    roles = F.transform(messages, lambda m: m["role"])
    system = F.array_position(roles, "system")
    last_user = F.coalesce(F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i + 1))), F.lit(0))
    target = F.when(system > 0, system.cast("int")).otherwise(last_user.cast("int"))

    def amended(parts: Column) -> Column:
        at = F.coalesce(F.array_max(F.transform(parts, lambda p, i: F.when(p["text"].isNotNull(), i))), F.lit(-1))
        added = lambda p: F.struct(p["type"], F.when(p["text"].contains(text), p["text"]).otherwise(F.concat(p["text"], note)).alias("text"), p["image"])
        kept = let(at, lambda k: F.transform(parts, lambda p, i: F.when(i == k, added(p)).otherwise(p)))
        new = F.struct(F.lit("text").alias("type"), F.trim(note).alias("text"), F.lit(None).cast("string").alias("image"))
        return F.when(at < 0, F.concat(parts, F.array(new))).otherwise(kept)

    return let(target, lambda t: F.transform(messages, lambda m, i: F.struct(m["role"], F.when(i + 1 == t, amended(m["content"])).otherwise(m["content"]).alias("content")))).cast(f"array<{MESSAGE}>")


def summary(messages: Column) -> Column:
    """Roles, images and characters, for logs that must not hold texts."""
    images = lambda m: F.size(F.filter(m["content"], lambda p: p["image"].isNotNull()))
    chars = lambda m: F.aggregate(m["content"], F.lit(0), lambda a, p: a + F.coalesce(F.length(p["text"]), F.lit(0)))
    line = lambda m, i: F.concat(i.cast("string"), F.lit(":"), m["role"], F.lit(" images="), images(m).cast("string"), F.lit(" text_chars="), chars(m).cast("string"))
    return F.when(F.size(messages) == 0, "(empty)").otherwise(F.array_join(F.transform(messages, line), "; "))


def openai_messages(messages: Column) -> Column:
    """The JSON of the chat-completions form."""
    url = lambda p: F.struct(p["image"].alias("url"))
    part = lambda p: F.struct(F.when(p["image"].isNotNull(), "image_url").otherwise("text").alias("type"), p["text"].alias("text"), F.when(p["image"].isNotNull(), url(p)).alias("image_url"))
    return F.to_json(F.transform(messages, lambda m: F.struct(m["role"], F.transform(m["content"], part).alias("content"))))


# Endpoints and payloads


def is_compatible(url: Column) -> Column:
    """Whether an address takes chat completions: compatible mode, or any /v1 but the native API's."""
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""))
    return u.contains("compatible-mode") | (u.endswith("/v1") & ~(u.contains("dashscope") & u.endswith("/api/v1")))


def is_local_server(url: Column) -> Column:
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""))
    return ~u.contains("dashscope") & ~u.contains("compatible-mode") & u.endswith("/v1") & u.contains("11434")


def endpoint_kind(url: Column) -> Column:
    tail = F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"([^/]*)$", 1)
    return F.when(url.contains("chat/completions"), "openai-chat-completions").when(url.contains("multimodal-generation"), "multimodal-generation").when(url.contains("text-generation"), "text-generation").otherwise(tail)


def payload(model: str, messages: list[dict], temperature: float | None, max_tokens: int | None, *, thinking: bool, max_reasoning: int | None, local: bool) -> dict:
    """A request's body; thinking flags stand at its top, and no thinking means no reasoning tokens."""
    out: dict = {"model": model, "messages": messages, "enable_thinking": thinking}
    if temperature is not None:
        out["temperature"] = float(temperature)
    if max_tokens is not None:
        out["max_tokens"] = int(max_tokens)
    if not thinking:
        out["max_reasoning_tokens"] = 0
    elif max_reasoning is not None:
        out["max_reasoning_tokens"] = int(max_reasoning)
    return out | ({"reasoning_effort": "none"} if local and not thinking else {})


def token_limit(kind: str, longest: int, max_tokens: int) -> int:
    return min(max_tokens, max(32, longest)) if kind == "table" else max(128, min(2048, longest))


# Answers

_PARTS = "array<struct<type:string,text:string>>"


def answer_text(response: Column) -> Column:
    """The text of a response's JSON: chat content as text or parts, else the native form's; reasoning never counts."""

    def of(path: str, glue: str) -> Column:
        raw = F.get_json_object(response, path)
        parts = F.array_join(F.filter(F.transform(F.from_json(raw, _PARTS), lambda p: p["text"]), lambda t: t.isNotNull()), glue)
        found = F.when(F.startswith(F.trim(raw), F.lit("[")), parts).otherwise(raw)
        return F.when(strip(found) != "", found)

    return F.coalesce(of("$.choices[0].message.content", ""), of("$.output.choices[0].message.content", "\n"), F.lit(""))


def is_reasoning_only(response: Column) -> Column:
    field = lambda f: strip(F.coalesce(F.get_json_object(response, f"$.choices[0].message.{f}"), F.lit(""))) != ""
    raw = F.trim(F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit("")))
    parts = F.exists(F.coalesce(F.from_json(raw, _PARTS), F.array().cast(_PARTS)), lambda p: strip(F.coalesce(p["text"], F.lit(""))) != "")
    filled = F.when(raw.startswith("["), parts).otherwise(raw != "")
    return (field("reasoning_content") | field("thinking")) & ~filled


def usage_line(response: Column) -> Column:
    part = lambda sign, key: F.concat(F.lit(sign), F.get_json_object(response, f"$.usage.{key}"))
    return F.concat_ws(" · ", part("入", "prompt_tokens"), part("出", "completion_tokens"), part("计", "total_tokens"))


def streamed_text(lines: Column) -> Column:
    """The content of `data:` lines of an event stream up to [DONE]; lines that aren't JSON are skipped."""
    data = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data:"))), lambda x: strip(F.substring(x, 6, 1 << 30)))
    end = F.array_position(data, "[DONE]")
    live = F.when(end > 0, F.slice(data, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(data)
    return F.array_join(F.filter(F.transform(live, lambda d: F.get_json_object(d, "$.choices[0].delta.content")), lambda t: t.isNotNull()), "")


# Retries


def backoff(attempts: Column, base: float) -> Column:
    """Seconds to wait after each failed try but the last."""
    return F.when(attempts > 1, F.transform(F.sequence(F.lit(1), attempts - 1), lambda k: F.lit(base) * F.pow(F.lit(2.0), k - 1))).otherwise(F.array().cast("array<double>"))


@dataclass(frozen=True)
class Attempt:
    temperature: float | None
    thinking: bool
    max_reasoning: int | None
    retry: bool


def attempts(n: int, temperature: float | None, thinking: bool, max_reasoning: int | None, reasoning_only: Iterable[bool]) -> list[Attempt]:
    """The tries of a call whose answers stay empty: cooler, with less thinking, and none after an answer of thoughts alone."""
    out, only = [], [False, *reasoning_only]
    for k in range(max(1, min(10, n))):
        on = thinking and not (k and only[min(k, len(only) - 1)])
        limit = (max_reasoning if not k else min(512, 512 if max_reasoning is None else max_reasoning)) if on else 0
        out.append(Attempt(temperature if not k else min(temperature or 0.0, 0.2), on, limit, k > 0))
    return out


class ModelClient(Protocol):
    def generate(self, messages: list[dict], stage: str) -> str: ...


class EchoClient:
    """A deterministic stand-in: it answers with the last text's final section, or a caption made of its digest."""

    def generate(self, messages: list[dict], stage: str) -> str:
        text = next((p["text"] for m in reversed(messages) for p in reversed(m["content"]) if p["text"] is not None), "")
        body = text.rpartition("\n\n## ")[2].partition("\n")[2].removesuffix(GUARD)
        return f"caption {hashlib.md5(body.encode()).hexdigest()[:8]}" if "caption" in stage else f"```markdown\n{body}\n```"


def generate(client: ModelClient, messages: list[dict], stage: str) -> str:
    """A client's answer; stand-ins that know no stage are called without one."""
    known = inspect.signature(client.generate).parameters
    takes_stage = "stage" in known or len(known) > 1 or any(p.kind is p.VAR_POSITIONAL for p in known.values())
    return client.generate(messages, stage) if takes_stage else client.generate(messages)


def call(client: ModelClient, messages: list[dict], stage: str, tries: int = 3, base: float = 0.0, wait: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """(answer, error): up to `tries` calls while the answer is empty or the client fails, waiting longer each time."""
    error: str | None = "empty"
    for k in range(tries):
        try:
            got = generate(client, messages, stage)
            if got.strip():
                return got, None
            error = "empty"
        except Exception as e:  # noqa: BLE001  whatever a client raises is a failed try
            error = repr(e)[:500]
        if k + 1 < tries and base:
            wait(base * 2**k)
    return "", error


def run(requests: DataFrame, make: Callable[[], ModelClient], stage: str, tries: int = 3, base: float = 0.0) -> DataFrame:
    """requests (id, messages) with answer and error. The client is made once for each task; save the result before reading it twice."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        client = make()
        for f in frames:
            got = [call(client, [{"role": m["role"], "content": list(m["content"])} for m in ms], stage, tries, base) for ms in f["messages"]]
            yield pd.DataFrame({"id": f["id"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    kind = requests.schema["id"].dataType.simpleString()
    return requests.select("id", "messages").mapInPandas(work, f"id {kind}, answer string, error string")
