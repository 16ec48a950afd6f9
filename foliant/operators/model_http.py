"""A model client over HTTP: routing by address, payloads, retries of requests and of empty answers, streamed answers.

Python's own HTTP is the transport; another one plugs in as `send`.
"""

from __future__ import annotations

import base64
import json
import logging
import mimetypes
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from foliant.config import Settings
from foliant.logs import log_event
from foliant.operators import model_calls

log = logging.getLogger("model")
NATIVE_PATH = "/services/aigc/multimodal-generation/generation"
CHAT_PATH = "/chat/completions"


@dataclass(frozen=True)
class Timeout:
    """Seconds to connect and to wait for bytes: the first of a long answer may take most of it."""

    connect: float
    read: float

    @classmethod
    def of(cls, seconds: float) -> Timeout:
        seconds = max(30.0, float(seconds))
        return cls(min(120.0, seconds), seconds)


#: url, body, headers, timeout: the lines of the answer.
Send = Callable[[str, dict, dict[str, str], Timeout], Iterable[bytes]]


def send(url: str, body: dict, headers: dict[str, str], timeout: Timeout) -> Iterator[bytes]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST")  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout.read) as answer:  # noqa: S310
        yield from answer


def is_compatible(url: str) -> bool:
    """model_calls.is_compatible() for one address."""
    u = url.rstrip("/").lower()
    return "compatible-mode" in u or (u.endswith("/v1") and not ("dashscope" in u and u.endswith("/api/v1")))


def is_local_server(url: str) -> bool:
    u = url.rstrip("/").lower()
    return u.endswith("/v1") and "11434" in u and "dashscope" not in u and "compatible-mode" not in u


def image_url(ref: str) -> str:
    """Addresses and data URLs as they are, files as data URLs."""
    if ref.startswith(("http://", "https://", "data:")):
        return ref
    kind = mimetypes.guess_type(ref)[0]
    with open(ref.removeprefix("file://"), "rb") as f:
        return f"data:{kind if (kind or '').startswith('image/') else 'image/png'};base64,{base64.b64encode(f.read()).decode()}"


def chat_messages(messages: list[dict]) -> list[dict]:
    def part(p: dict) -> dict:
        return {"type": "text", "text": p["text"]} if p.get("image") is None else {"type": "image_url", "image_url": {"url": image_url(p["image"])}}

    return [{"role": m["role"], "content": [part(p) for p in m["content"]]} for m in messages]


def native_messages(messages: list[dict]) -> list[dict]:
    return [{"role": m["role"], "content": [{"text": p["text"]} if p.get("image") is None else {"image": p["image"]} for p in m["content"]]} for m in messages]


def guarded(messages: list[dict], note: str) -> list[dict]:
    """model_calls.guarded() for one call's messages."""
    roles = [m["role"] for m in messages]
    at = roles.index("system") if "system" in roles else max((i for i, r in enumerate(roles) if r == "user"), default=None)
    if at is None:
        return messages
    parts = [dict(p) for p in messages[at]["content"]]
    texts = [i for i, p in enumerate(parts) if p.get("text") is not None]
    if not texts:
        parts.append({"type": "text", "text": note.strip(), "image": None})
    elif note not in parts[texts[-1]]["text"]:
        parts[texts[-1]]["text"] += note
    return [m if i != at else {**m, "content": parts} for i, m in enumerate(messages)]


def text_of(content: object, glue: str) -> str:
    if isinstance(content, str):
        return content
    parts = content if isinstance(content, list) else []
    return glue.join(p if isinstance(p, str) else p.get("text") or "" for p in parts if isinstance(p, str) or isinstance(p, dict))


def first_message(response: dict) -> dict:
    return ((response.get("choices") or (response.get("output") or {}).get("choices") or [{}])[0]).get("message") or {}


def answer_of(response: dict) -> tuple[str, bool]:
    """(text, whether there are thoughts and no text)."""
    message, native = first_message(response), "output" in response
    text = text_of(message.get("content"), "\n" if native else "")
    thoughts = any((message.get(k) or "").strip() for k in ("reasoning_content", "thinking") if isinstance(message.get(k), str))
    return text, thoughts and not text.strip()


def gathered(lines: Iterable[bytes]) -> dict:
    """A streamed answer as if it had come whole; what isn't JSON is skipped, [DONE] ends it."""
    content, thoughts, rest = [], [], {}
    for line in lines:
        data = line.decode("utf-8", "replace").strip()
        if not data.startswith("data:"):
            continue
        if (data := data[5:].strip()) == "[DONE]":
            break
        try:
            chunk = json.loads(data)
        except ValueError:
            continue
        rest |= {k: chunk[k] for k in ("id", "usage") if chunk.get(k)}
        delta = (chunk.get("choices") or [{}])[0].get("delta") or {}
        content.append(text_of(delta.get("content"), ""))
        thoughts += [delta[k] for k in ("reasoning_content", "thinking") if isinstance(delta.get(k), str)]
    return {"choices": [{"message": {"content": "".join(content), "reasoning_content": "".join(thoughts)}}], **rest}


@dataclass
class HttpModel:
    """model_calls.ModelClient over HTTP."""

    base_url: str
    model: str
    api_key: str = ""
    temperature: float | None = None
    max_tokens: int | None = None
    seconds: float = 300.0
    retries: int = 3
    backoff: float = 1.5
    empty_tries: int = 3
    thinking: bool = False
    max_reasoning: int | None = None
    stream: bool = False
    send: Send = send
    wait: Callable[[float], None] = time.sleep
    asked: list[dict] = field(default_factory=list, repr=False)

    def post(self, url: str, body: dict, stage: str) -> dict:
        """One request, again after a failure, waiting twice as long each time."""
        for k in range(max(1, self.retries)):
            began = time.perf_counter()
            try:
                lines = self.send(url, body, {"Authorization": f"Bearer {self.api_key}"}, Timeout.of(self.seconds))
                found = gathered(lines) if body.get("stream") else json.loads(b"".join(lines))
                log_event(log, logging.INFO, "model.done", stage=stage, model=self.model, seconds=round(time.perf_counter() - began, 1), request=found.get("request_id") or found.get("id"))
                return found
            except Exception as e:
                log_event(log, logging.WARNING, "model.failed", stage=stage, attempt=k + 1, error=repr(e))
                if k + 1 >= self.retries:
                    raise
                self.wait(self.backoff * 2**k)
        raise AssertionError

    def generate(self, messages: list[dict], stage: str) -> str:
        base = self.base_url.rstrip("/")
        if not is_compatible(base):
            settings = {"result_format": "message", "temperature": self.temperature, "max_tokens": self.max_tokens}
            body = {"model": self.model, "input": {"messages": native_messages(messages)}, "parameters": {k: v for k, v in settings.items() if v is not None}}
            return answer_of(self.post(base + NATIVE_PATH, body, stage))[0]
        only_thoughts: list[bool] = []
        tries = max(1, min(10, self.empty_tries))
        for k in range(tries):
            plan = model_calls.attempts(k + 1, self.temperature, self.thinking, self.max_reasoning, only_thoughts)[k]
            asked = guarded(messages, model_calls.guard(plan.thinking, self.max_reasoning, plan.retry))
            if plan.retry:
                asked = guarded(asked, model_calls.CONCISE_GUARD)
            body = model_calls.payload(self.model, chat_messages(asked), plan.temperature, self.max_tokens, thinking=plan.thinking, max_reasoning=plan.max_reasoning, local=is_local_server(base))
            text, thoughts = answer_of(self.post(base + CHAT_PATH, body | ({"stream": True} if self.stream else {}), stage))
            if text.strip():
                return text
            only_thoughts.append(thoughts)
        raise RuntimeError(f"no text in {tries} answers")


def from_settings(settings: Settings, base_url: str, model: str, api_key: str = "", **more: object) -> Callable[[], HttpModel]:
    """A factory that each task calls once: clients aren't sent to executors, settings are."""
    fixed = {
        "max_tokens": settings.llm_max_tokens, "seconds": settings.llm_timeout, "retries": settings.llm_retries, "backoff": settings.llm_backoff,
        "empty_tries": settings.llm_empty_attempts, "thinking": settings.llm_thinking, "max_reasoning": settings.llm_max_reasoning_tokens,
    }
    return lambda: HttpModel(base_url, model, api_key, **(fixed | more))

