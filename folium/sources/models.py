"""A generator that asks a chat model over HTTP, on hosts that are allowed only."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass, field
from urllib.parse import urlsplit

LOCAL = frozenset({"127.0.0.1", "localhost", "::1"})


@dataclass(frozen=True)
class ChatModel:
    """A model behind a chat endpoint that takes {model, messages, options} and gives {message: {content}}.

    Set up on the driver, used in tasks: it holds no connection. The host is checked before every call.
    """

    name: str
    url: str = "http://127.0.0.1:11434/api/chat"
    allowed_hosts: frozenset = LOCAL
    path: str = "/api/chat"
    options: dict = field(default_factory=lambda: {"num_ctx": 4096, "num_predict": 450, "temperature": 0.1})
    keep_alive: str = "10m"
    timeout: float = 300.0

    def check(self) -> None:
        at = urlsplit(self.url)
        if at.scheme not in ("http", "https") or (at.hostname or "").lower() not in self.allowed_hosts:
            raise PermissionError(f"host {at.hostname!r} isn't allowed; allowed are {sorted(self.allowed_hosts)}")
        if at.path.rstrip("/") != self.path:
            raise ValueError(f"the endpoint must end in {self.path}")

    def answer(self, system: str, prompt: str) -> str:
        self.check()
        body = {"model": self.name, "stream": False, "keep_alive": self.keep_alive, "options": self.options, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            content = (json.load(response).get("message") or {}).get("content")
        if not isinstance(content, str) or not content.strip():
            raise ValueError("the model gave no content")
        return content.strip()
