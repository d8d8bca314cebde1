"""Models that answer prompts: any function from (role, messages) to a text or a ``Reply``, and two of them.

The extractive one quotes the sentences of the evidence that share most with the query; it needs no network, so it
serves for acceptance runs and as a fallback. The other one speaks to a chat-completions endpoint.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from stratum.plans.config import SPECIALISTS


@dataclass(frozen=True)
class Reply:
    """A model's text, and the tokens that the service counted, if it said so."""

    text: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


Model = Callable[[str, list[dict[str, str]]], "str | Reply"]
Fetch = Callable[[str, dict[str, str], bytes, float], tuple[int, bytes]]


class ModelError(RuntimeError):
    """The service gave no usable answer. The message holds no key."""


_SENTENCE = re.compile(r"[^。！？!?；;\n]+[。！？!?；;]?")
_PART = re.compile(r"[、；，,;\n]|总体目标：|是什么|什么|哪些|多少|请|以及|并且|同时|分别|和|及")
_WORD = re.compile(r"[0-9a-z_]+(?:[-.][0-9a-z_]+)*|[㐀-鿿]+")
QUOTES, LEAST_SHARE = 3, 0.25


def _grams(text: str) -> set[str]:
    """Words, and pairs of ideographs that follow each other."""
    out: set[str] = set()
    for run in _WORD.findall(text.lower()):
        out.update((run[i : i + 2] for i in range(len(run) - 1)) if run > "㐀" and len(run) > 1 else [run])
    return out


def _share(parts: list[set[str]], sentence: str) -> float:
    """How much of the best met part of a query a sentence holds."""
    own = _grams(sentence)
    return max((len(p & own) / len(p) for p in parts), default=0.0)


def _specialist(prompt: str) -> dict:
    head, _, blocks = prompt.partition("\n可用材料：\n")
    asked = re.search(r"^查询：(.*?)(?:\n先前的对话|\Z)", head, re.S | re.M)
    parts = [g for p in _PART.split(asked[1] if asked else head) if (g := _grams(p))]
    quotes = []
    for block in re.split(r"(?=\[artifact_id=)", blocks):
        key, _, content = block.partition("]\n")
        quotes += [(_share(parts, s), -len(quotes), s.strip(), key.removeprefix("[artifact_id=")) for s in _SENTENCE.findall(content) if s.strip()]
    best = sorted((q for q in quotes if q[0] >= LEAST_SHARE), reverse=True)[:QUOTES]
    return {"summary": " ".join(dict.fromkeys(q[2] for q in best)) or "所给证据中没有相关语句。", "claims": list(dict.fromkeys(q[2] for q in best)), "evidence_ids": list(dict.fromkeys(q[3] for q in best)), "confidence": round(best[0][0], 3) if best else 0.0}


def _value(prompt: str):
    """The JSON value that a prompt begins with."""
    return json.JSONDecoder().raw_decode(prompt)[0]


def _reducer(prompt: str) -> dict:
    members = sorted(_value(prompt), key=lambda m: -float(m.get("confidence") or 0))
    claims = list(dict.fromkeys(c for m in members for c in m["claims"]))[:20]
    return {"summary": " ".join(claims) or members[0]["summary"], "claims": claims, "evidence_ids": list(dict.fromkeys(i for m in members for i in m["evidence_ids"])), "confidence": max(float(m.get("confidence") or 0) for m in members)}


def extractive_model(role: str, messages: list[dict[str, str]]) -> str:
    """Deterministic answers made of the evidence alone."""
    prompt = messages[-1]["content"]
    if role == "supervisor":
        question = prompt.rpartition("问题：")[2]
        parts = [p.strip(" ?？。") for p in _PART.split(question)]
        found = [p for p in parts if len(p) > 1] or [question]
        return json.dumps({"tasks": [{"objective": p, "query": p, "agent_type": SPECIALISTS[0], "priority": 60} for p in found]}, ensure_ascii=False)
    if role in SPECIALISTS:
        return json.dumps(_specialist(prompt), ensure_ascii=False)
    if role == "reducer":
        return json.dumps(_reducer(prompt), ensure_ascii=False)
    if role == "validator":
        return json.dumps({"semantic_pass": _value(prompt)["hard_validation"]["passed"], "missing_task_ids": [], "contradictions": [], "notes": ""})
    if role == "finalizer":
        reduced = _value(prompt)["reduced"]
        return "\n".join(reduced["claims"]) or reduced["summary"]
    return "这个模型只摘录文档，不作通用问答。"


def _post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except OSError as e:
        raise ModelError(f"no connection to the model: {type(e).__name__}") from e


def redacted(body: str, key: str) -> str:
    """The error's own message without keys, 300 characters at most; as ``functions.text.redacted`` does on columns."""
    try:
        value = json.loads(body)
        inner = value.get("error")
        body = (inner.get("message") if isinstance(inner, dict) else None) or value.get("message") or body
    except (ValueError, AttributeError):
        pass
    return re.sub(r"sk-[A-Za-z0-9_-]+", "[redacted]", str(body).replace(key, "[redacted]") if key else str(body))[:300]


def chat_model(base_url: str, key: str, name: str, timeout: float = 90.0, temperature: float = 0.1, max_tokens: int = 2_000, fetch: Fetch = _post) -> Model:
    """A model behind ``base_url``/chat/completions. ``fetch`` (url, headers, body, timeout) sends a request."""

    def whole(value: object) -> int | None:
        return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None

    def model(role: str, messages: list[dict[str, str]]) -> Reply:
        request = json.dumps({"model": name, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}, ensure_ascii=False)
        status, raw = fetch(base_url.rstrip("/") + "/chat/completions", {"Authorization": f"Bearer {key}", "Content-Type": "application/json", "Accept": "application/json"}, request.encode(), timeout)
        if status >= 400:
            raise ModelError(f"HTTP {status}: {redacted(raw.decode('utf-8', 'replace'), key)}")
        try:
            answer = json.loads(raw)
            text = answer["choices"][0]["message"]["content"]
        except (ValueError, KeyError, IndexError, TypeError) as e:
            raise ModelError("the answer is no chat completion") from e
        if not isinstance(text, str) or not text.strip():
            raise ModelError("the answer is empty")
        usage = answer.get("usage") if isinstance(answer.get("usage"), dict) else {}
        return Reply(text.strip(), whole(usage.get("prompt_tokens")), whole(usage.get("completion_tokens")))

    return model
