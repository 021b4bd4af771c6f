"""Chat completions over HTTP. The transport is a parameter: nothing here opens a connection by itself."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import urlsplit

#: (url, headers, body, seconds) to (status, reply text)
Transport = Callable[[str, dict[str, str], str, float], tuple[int, str]]

#: fixed values: names of the usage numbers in a reply
USAGE = {"input_tokens": "prompt_tokens", "output_tokens": "completion_tokens", "total_tokens": "total_tokens", "cache_hit_tokens": "prompt_cache_hit_tokens", "cache_miss_tokens": "prompt_cache_miss_tokens"}


def _units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


@dataclass(frozen=True)
class Completions:
    """A checked endpoint; ``complete`` sends one request and returns id, model, text, usage and the raw reply."""

    base_url: str
    api_key: str = field(repr=False)
    transport: Transport = field(repr=False)
    headers: dict[str, str] = field(default_factory=dict, repr=False)
    timeout_ms: int = 30_000
    max_messages: int = 10_000
    max_characters: int = 16 << 20
    max_error_characters: int = 500

    def __post_init__(self):
        url = urlsplit(self.base_url)
        if url.scheme not in ("http", "https") or not url.netloc:
            raise ValueError("base_url must use http or https")
        if not self.api_key:
            raise ValueError("api_key must not be empty")
        if not 1 <= self.timeout_ms <= 300_000 or self.max_messages < 1 or min(self.max_characters, self.max_error_characters) < 0:
            raise ValueError("limits out of range")

    def complete(self, model: str, messages: Sequence[dict], temperature: float | None = None, max_tokens: int | None = None, json_reply: bool = False, thinking: bool | None = None) -> dict:
        if len(messages) > self.max_messages:
            raise ValueError(f"more than {self.max_messages} messages")
        if _units(model) + sum(_units(m["role"]) + _units(m["content"]) for m in messages) > self.max_characters:
            raise ValueError(f"request exceeds {self.max_characters} characters")
        body = {"model": model, "messages": list(messages), "temperature": temperature, "max_tokens": max_tokens}
        body["response_format"] = {"type": "json_object"} if json_reply else None
        body["thinking"] = None if thinking is None else {"type": "enabled" if thinking else "disabled"}
        own = {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"}
        headers = {k: v for k, v in self.headers.items() if k.lower() not in ("authorization", "content-type")} | own
        sent = json.dumps({k: v for k, v in body.items() if v is not None}, ensure_ascii=False)
        status, reply = self.transport(self.base_url.removesuffix("/") + "/chat/completions", headers, sent, self.timeout_ms / 1000)
        if not 200 <= status < 300:
            raise RuntimeError(f"HTTP {status}: " + re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", reply[: self.max_error_characters]))
        raw = json.loads(reply)
        usage, choice = raw.get("usage"), (raw.get("choices") or [{}])[0]
        return {
            "id": raw.get("id") or "",
            "model": raw.get("model") or model,
            "text": (choice.get("message") or {}).get("content") or "",
            "usage": {k: usage.get(v) or 0 for k, v in USAGE.items()} if usage else None,
            "raw": raw,
        }


#: fixed values: addresses of known services
SERVICES = {"deepseek": "https://api.deepseek.com"}


def service(name: str, api_key: str, transport: Transport, **about) -> Completions:
    """The endpoint of a known service."""
    return Completions(SERVICES[name], api_key, transport, **about)
