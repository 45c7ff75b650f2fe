"""Where replies come from. A backend is ``complete(prompt, payload) -> text`` and can be sent to executors."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import time
import urllib.error
import urllib.request
import uuid
from dataclasses import dataclass, field
from typing import Protocol


class CallFailed(RuntimeError):
    """A backend could not give a reply."""


class Backend(Protocol):
    def complete(self, prompt: str, payload: dict) -> str: ...


def prompt_key(prompt: str) -> str:
    return hashlib.sha256(prompt.encode("utf-8")).hexdigest()


@dataclass
class RuleBackend:
    """Deterministic: each spec's ``rule`` is looked for in the chunk's paragraphs, and the reply is the call's envelope.

    A rule is a pattern, or a mapping with ``pattern`` and, by kind: ``group``
    (strings, numbers, dates), ``labels`` (label -> pattern, tried in order),
    ``ratings`` (value -> pattern), ``fields`` (field -> pattern). Strings, numbers and
    dates give an item for every match; with ``each`` false, for a paragraph's first one only.

    Prompts are not read, so none is rendered unless the ledger keeps them.
    """

    flags: int = 0
    needs_prompt = False
    _compiled: dict = field(default_factory=dict, repr=False)

    def _re(self, pattern: str):
        if pattern not in self._compiled:
            self._compiled[pattern] = re.compile(pattern, self.flags)
        return self._compiled[pattern]

    def __getstate__(self):
        return {"flags": self.flags, "_compiled": {}}

    @staticmethod
    def _rule(spec) -> dict:
        return {"pattern": spec.rule} if isinstance(spec.rule, str) else dict(spec.rule or {})

    def _values(self, spec, text: str) -> list:
        rule = self._rule(spec)
        kind = getattr(spec, "kind", "aspect")
        if kind == "label":
            found = [x for x, p in rule["labels"].items() if self._re(p).search(text)]
            return [{"labels": found[:1] if spec.classification == "multi_class" else found}] if found else []
        if kind == "rating":
            return [v for v, p in rule["ratings"].items() if self._re(p).search(text)][:1]
        if kind == "json_object":
            got = {f: m[rule.get("group", 0)] for f, p in rule["fields"].items() if (m := self._re(p).search(text))}
            return [got] if got else []
        matches = list(self._re(rule["pattern"]).finditer(text)) if "pattern" in rule else []
        if kind == "boolean":
            return [True] if matches else []
        out = [m[rule.get("group", 0)] for m in (matches if rule.get("each", True) else matches[:1])]
        if kind == "numerical":
            return [float(v) if spec.numeric_type == "float" or "." in v else int(v) for v in out]
        return [v for v in out if kind != "string" or v.strip()]

    def complete(self, prompt: str, payload: dict) -> str:
        specs, paras, sents, params = (payload[k] for k in ("specs", "paras", "sents", "params"))
        deep, why = params["reference_depth"] == "sentences", params["add_justifications"]
        out = []
        for n, spec in enumerate(specs):
            if payload["kind"] == "aspect":
                found = self._re(self._rule(spec).get("pattern", r"(?!)"))
                if deep:
                    rows = []
                    for i in range(len(paras)):
                        hit = [{"sentence_id": f"P{i}-S{j}"} | ({"justification": "matches its rule"} if why else {}) for j, s in enumerate(sents[i]) if found.search(s)]
                        rows += [{"paragraph_id": f"P{i}", "sentences": hit}] if hit else []
                    out.append({"aspect_id": f"A{n}", "paragraphs": rows})
                else:
                    ids = [f"P{i}" for i, p in enumerate(paras) if found.search(p)]
                    out.append({"aspect_id": f"A{n}"} | ({"paragraphs": [{"paragraph_id": p, "justification": "matches its rule"} for p in ids]} if why else {"paragraph_ids": ids}))
                continue
            items = []
            for i, p in enumerate(paras):
                for v in self._values(spec, p):
                    item = {"value": v} | ({"justification": "matches its rule"} if why else {})
                    if params["add_references"] and deep:
                        held = [f"P{i}-S{j}" for j, s in enumerate(sents[i]) if self._values(spec, s)]
                        item["reference_paragraphs"] = [{"reference_paragraph_id": f"P{i}", "reference_sentence_ids": held}]
                    elif params["add_references"]:
                        item["reference_paragraph_ids"] = [f"P{i}"]
                    items.append(item if len(item) > 1 else v)
            if self._rule(spec).get("first") or (spec.kind in ("boolean", "rating", "label") and items):
                items = items[:1]
            out.append({"concept_id": f"C{n}", "extracted_items": items})
        return json.dumps(out, ensure_ascii=False)


@dataclass
class ReplayBackend:
    """Recorded replies by prompt hash; several replies to one prompt are given in turn, the last one again."""

    replies: dict[str, list[str]]
    default: list[str] | None = None

    def complete(self, prompt: str, payload: dict) -> str:
        found = self.replies.get(prompt_key(prompt), self.default)
        if not found:
            raise CallFailed("nothing recorded for this prompt")
        return found[min(payload.get("attempt", 0), len(found) - 1)]


class Rejected(CallFailed):
    """The service refused the request itself; asking again with the same one is of no use."""


@dataclass
class HttpBackend:
    """Chat completions over HTTP, in the form that most services share: POST ``{url}/chat/completions``.

    The API key is read on the executor from the environment variable ``key_name``. Time-outs, connection
    errors and the statuses 408, 409, 429 and 5xx are tried again, after what ``Retry-After`` says or twice the
    wait before; a status 400 that names a parameter of the request drops this parameter once and asks again;
    every other status is an error. ``send`` replaces the transport: ``send(request) -> response as a dict``.
    """

    url: str = ""
    key_name: str | None = None
    retries: int = 3
    wait: float = 1.0
    headers: dict = field(default_factory=dict)
    send: object = None

    OPTIONAL = ("temperature", "max_completion_tokens", "max_tokens", "response_format", "seed", "top_p")

    def request(self, prompt: str, payload: dict) -> dict:
        """The body of a call: messages, the model's parameters, tools."""
        more = {k: v for k, v in payload.get("request", {}).items() if k not in ("timeout", "num_retries")}
        more["model"] = more.get("model", "").partition("/")[2] or more.get("model", "")
        tools = {"tools": payload["tools"]} if payload.get("tools") else {}
        return {"messages": payload.get("messages") or [{"role": "user", "content": prompt}], **more, **tools}

    def post(self, body: dict, timeout: float) -> dict:
        if self.send is not None:
            return self.send(body)
        headers = {"Content-Type": "application/json", **self.headers}
        if self.key_name:
            headers["Authorization"] = f"Bearer {os.environ[self.key_name]}"
        call = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(call, timeout=timeout) as answer:
            return json.loads(answer.read())

    def answer(self, prompt: str, payload: dict) -> dict:
        """The service's whole response."""
        body, wait, left = self.request(prompt, payload), self.wait, self.retries
        while True:
            try:
                return self.post(body, payload.get("request", {}).get("timeout", 120))
            except urllib.error.HTTPError as e:
                said = e.read().decode("utf-8", "replace")[:2000]
                named = next((k for k in self.OPTIONAL if k in body and k in said), None) if e.code == 400 else None
                if named:
                    del body[named]
                    continue
                if e.code not in (408, 409, 429) and e.code < 500:
                    raise Rejected(f"status {e.code}: {said[:200]}") from e
                why, pause = f"status {e.code}", e.headers.get("Retry-After", "")
                wait = float(pause) if pause.isdigit() else wait
            except (OSError, ValueError) as e:
                why = f"{type(e).__name__}: {e}"
            if not left:
                raise CallFailed(f"{why} after {self.retries + 1} attempts")
            left -= 1
            time.sleep(wait)
            wait *= 2

    def complete(self, prompt: str, payload: dict) -> str:
        got = self.answer(prompt, payload)
        try:
            return got["choices"][0]["message"]["content"] or ""
        except (KeyError, IndexError, TypeError):
            raise CallFailed("a response without a message") from None


@dataclass
class StoredBackend:
    """Another backend whose replies are kept in a shared folder, one file a call, so that a task that runs again does not pay again.

    The key is the prompt, the attempt and the call's images. ``folder`` is anything that ``pyarrow.fs`` opens.
    """

    inner: object
    folder: str

    def complete(self, prompt: str, payload: dict) -> str:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        key = prompt_key(json.dumps([prompt, payload.get("attempt", 0), payload.get("images") or []]))
        at = f"{top.rstrip('/')}/{key[:2]}/{key}"
        if system.get_file_info(at).type == fs.FileType.File:
            with system.open_input_stream(at) as f:
                return f.read().decode("utf-8")
        text = self.inner.complete(prompt, payload)
        system.create_dir(f"{top.rstrip('/')}/{key[:2]}", recursive=True)
        part = f"{at}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(text.encode("utf-8"))
        system.move(part, at)
        return text


class Limiter:
    """At most ``n`` calls in ``seconds``. ``shared_by`` tasks at work at a time keep this rate together, each a part of it."""

    def __init__(self, n: int, seconds: float, shared_by: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.n, self.seconds, self.clock, self.sleep = max(1, n // shared_by), seconds * max(1.0, shared_by / n), clock, sleep
        self.taken: list[float] = []
        self.lock = threading.Lock()

    def acquire(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                self.taken = [t for t in self.taken if now - t < self.seconds]
                if len(self.taken) < self.n:
                    self.taken.append(now)
                    return
                wait = self.seconds - (now - self.taken[0])
            self.sleep(wait)
