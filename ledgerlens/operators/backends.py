"""Reply backends: a callable from a batch of prompts to (reply, error) pairs.

A backend object is plain configuration; it is pickled into each task and
``open()`` builds any client there (clients do not pickle). ``fingerprint``
names the backend in the reply store, so replies from one backend are never
reused for another.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Sequence

Reply = tuple  # (response: str | None, error: str | None)


@dataclass(frozen=True)
class Settings:
    """Backend options, read once on the driver and shipped to tasks inside
    the backend object (executors never read the environment)."""

    base_url: str = "http://localhost:11434"
    model: str = "gemma3:latest"
    temperature: float = 0.1
    max_concurrency: int = 10
    timeout_s: float = 120.0

    @classmethod
    def from_env(cls, prefix: str = "LEDGERLENS_", env=None) -> "Settings":
        env = os.environ if env is None else env
        d = cls()
        return cls(base_url=env.get(f"{prefix}MODEL_URL", d.base_url),
                   model=env.get(f"{prefix}MODEL", d.model),
                   temperature=float(env.get(f"{prefix}TEMPERATURE", d.temperature)),
                   max_concurrency=int(env.get(f"{prefix}MAX_CONCURRENCY", d.max_concurrency)),
                   timeout_s=float(env.get(f"{prefix}TIMEOUT_S", d.timeout_s)))


class Backend:
    """Base class. Subclasses implement ``call_one`` (or ``call_batch``)."""

    name = "backend"

    def fingerprint(self) -> str:
        payload = json.dumps(self.describe(), sort_keys=True, default=str)
        return f"{self.name}-{hashlib.sha1(payload.encode()).hexdigest()[:12]}"

    def describe(self) -> dict:
        return {"name": self.name}

    def open(self) -> None:
        """Build clients; runs once per task, on the executor."""

    def close(self) -> None:
        pass

    def call_one(self, prompt: str, system_prompt: str | None) -> str:
        raise NotImplementedError

    def call_batch(self, prompts: Sequence[str], system_prompt: str | None,
                   pool_size: int = 1) -> list[Reply]:
        """Replies in prompt order; one failing prompt never fails the batch."""
        def safe(p):
            try:
                return (self.call_one(p, system_prompt), None)
            except Exception as e:  # per-row error capture
                return (None, str(e) or type(e).__name__)
        if pool_size <= 1 or len(prompts) <= 1:
            return [safe(p) for p in prompts]
        with ThreadPoolExecutor(max_workers=pool_size) as ex:
            return list(ex.map(safe, prompts))


class CallableBackend(Backend):
    """Wrap a plain function ``f(prompt, system_prompt) -> reply``. ``label``
    names the function in the reply store: another function, another label."""

    name = "callable"

    def __init__(self, fn: Callable[[str, str | None], str], label: str):
        if not label:
            raise ValueError("label must name the function")
        self.fn = fn
        self.label = label

    def describe(self) -> dict:
        return {"name": self.name, "label": self.label}

    def call_one(self, prompt, system_prompt):
        return self.fn(prompt, system_prompt)


class ScriptedBackend(Backend):
    """Deterministic offline backend: the reply is picked from a fixed list by
    the prompt's length (in characters). ``None`` entries simulate a failed
    call with the given error text. Used for tests and the offline demo."""

    name = "scripted"

    def __init__(self, replies: Sequence[str | None], error_text: str = "timeout"):
        self.replies = list(replies)
        self.error_text = error_text

    def describe(self) -> dict:
        return {"name": self.name, "replies": self.replies, "error": self.error_text}

    def call_one(self, prompt, system_prompt):
        r = self.replies[len(prompt) % len(self.replies)]
        if r is None:
            raise TimeoutError(self.error_text)
        return r


class EchoBackend(Backend):
    """Offline backend that answers with the remark of the prompt, all its words and slots kept. Used to test templates."""

    name = "echo"

    def call_one(self, prompt, system_prompt):
        from ledgerlens.operators.prompts import REMARK_PROMPT_HEAD, REMARK_PROMPT_TAIL
        text = prompt.removeprefix(REMARK_PROMPT_HEAD).removesuffix(REMARK_PROMPT_TAIL)
        return json.dumps({"cleaned_remark": f"Seen: {text}", "notes_doubts": ""}, ensure_ascii=False)


class ChatHttpBackend(Backend):
    """Chat-completion backend for a model server speaking the common
    ``/api/chat`` JSON protocol (system message + user message). Uses only
    the standard library; nothing is contacted until a task runs."""

    name = "chat-http"

    def __init__(self, base_url: str, model: str, temperature: float = 0.1,
                 timeout_s: float = 120.0, retries: int = 1):
        self.base_url = base_url.rstrip("/")
        self.model = model
        self.temperature = temperature
        self.timeout_s = timeout_s
        self.retries = retries

    @classmethod
    def from_settings(cls, s: Settings) -> "ChatHttpBackend":
        return cls(s.base_url, s.model, s.temperature, s.timeout_s)

    def describe(self) -> dict:
        return {"name": self.name, "model": self.model, "temperature": self.temperature}

    def call_one(self, prompt, system_prompt):
        import urllib.request
        messages = ([{"role": "system", "content": system_prompt}] if system_prompt else [])
        messages.append({"role": "user", "content": prompt})
        body = json.dumps({"model": self.model, "messages": messages, "stream": False,
                           "options": {"temperature": self.temperature}}).encode()
        last = None
        for _ in range(self.retries + 1):
            try:
                req = urllib.request.Request(f"{self.base_url}/api/chat", data=body,
                                             headers={"Content-Type": "application/json"})
                with urllib.request.urlopen(req, timeout=self.timeout_s) as resp:
                    return json.loads(resp.read())["message"]["content"]
            except Exception as e:  # retried, then reported as the row's error
                last = e
        raise last


class NativeBackend:
    """Marker for backends computed with DataFrame expressions instead of
    per-prompt calls (see :class:`ledgerlens.operators.rules.RuleBackend`)."""

    name = "native"
