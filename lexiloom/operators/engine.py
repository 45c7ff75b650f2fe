"""Extraction from one document: group specs, chunk, call, check, retry, resolve. Plain Python, run on executors."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from lexiloom.functions import envelope
from lexiloom.operators.backends import CallFailed, Limiter
from lexiloom.plans import prompts
from lexiloom.plans.specs import Model, Pipeline, SpecError

PARAMS = ("add_justifications", "justification_depth", "justification_max_sents", "add_references", "reference_depth")


class ExtractionFailed(RuntimeError):
    """No valid reply after all attempts."""


@dataclass(frozen=True)
class Settings:
    """How calls are cut. ``concurrent`` makes one call for each spec unless ``items_per_call`` is above 1."""

    items_per_call: int = 0
    paragraphs_per_call: int = 0
    images_per_call: int = 0
    concurrent: bool = False
    raise_errors: bool = True
    throttle: bool = False
    render: str | None = None
    workers: int = 16


def grouped(specs) -> list[list]:
    """Specs with the same five parameters together, in order of first appearance."""
    out: dict = {}
    for s in specs:
        out.setdefault(tuple(getattr(s, p) for p in PARAMS), []).append(s)
    return list(out.values())


def cut(values: list, n: int) -> list[list]:
    """Pieces of at most n values, one piece if n is 0."""
    return [values[i : i + n] for i in range(0, len(values), n)] if n else [values] if values else []


def spec_chunks(specs: list, settings: Settings) -> list[list]:
    n = settings.items_per_call
    if settings.concurrent and n <= 1:
        n = 1
    return [chunk for group in grouped(specs) for chunk in cut(group, n)]


@dataclass
class Document:
    doc_id: object
    text: str
    paras: list[str]
    sents: list[list[str]]
    images: list[tuple[str, str]] = field(default_factory=list)
    #: Markdown of paragraphs; prompts show it where every paragraph of a call has it.
    md: list[str | None] = field(default_factory=list)


@dataclass
class Found:
    """Items of one spec with absolute references, and whether a reply named it."""

    items: list[dict] = field(default_factory=list)
    processed: bool = False


class Run:
    """All calls for one document. ``backends``: role -> (backend, fallback's backend or None)."""

    def __init__(self, doc: Document, models: dict[str, Model], backends: dict, settings: Settings, limiter: Callable[[Model], Limiter] | None = None, keep_prompts: bool = True):
        self.keep_prompts = keep_prompts
        self.doc, self.models, self.backends, self.settings = doc, models, backends, settings
        self.calls: list[dict] = []
        self.errors: list[str] = []
        self.limiter = limiter
        self.render = prompts.renderer(settings.render) if settings.render else prompts.render

    def extract(self, kind: str, specs, where: list[int] | None = None) -> dict[str, Found]:
        """Name -> found for specs over the paragraphs at ``where`` (all by default).

        With ``concurrent`` the calls of a model's spec chunks are made at the same time; what they found and the
        record of calls keep the chunks' order.
        """
        out = {s.name: Found() for s in specs}
        jobs = [(chunk, model) for role, model in self.models.items() for chunk in spec_chunks([s for s in specs if s.llm_role == role], self.settings)]
        if self.settings.concurrent and len(jobs) > 1:
            runs = [Run(self.doc, self.models, self.backends, self.settings, self.limiter, self.keep_prompts) for _ in jobs]
            with ThreadPoolExecutor(min(len(jobs), self.settings.workers)) as pool:
                waiting = [pool.submit(run._with_retries, kind, chunk, model, where) for run, (chunk, model) in zip(runs, jobs)]
            for run in runs:
                self.calls += run.calls
                self.errors += run.errors
            results = (w.result() for w in waiting)
        else:
            results = (self._with_retries(kind, chunk, model, where) for chunk, model in jobs)
        for got in results:
            out |= got or {}
        return out

    def _with_retries(self, kind, chunk, model, where):
        primary, second = self.backends[model.role]
        plan = [(model, primary, i) for i in range(model.retries_invalid + 1)]
        if model.fallback:
            plan += [(model.fallback, second or primary, i) for i in range(max(1, model.fallback.retries_invalid + 1))]
        why = ""
        for number, (m, backend, _) in enumerate(plan):
            try:
                return self._all_chunks(kind, chunk, m, backend, where, number)
            except (envelope.Invalid, CallFailed) as e:
                why = f"{type(e).__name__}: {e}"
        message = f"no valid reply for {[s.name for s in chunk]} after {len(plan)} attempts; last: {why}"
        self.errors.append(message)
        if self.settings.raise_errors:
            raise ExtractionFailed(message)
        return None

    def _text_chunks(self, role: str, where):
        """(positions, images) of each call: text first, then images, as the role has it."""
        out = []
        if not role.endswith("_vision"):
            places = list(range(len(self.doc.paras))) if where is None else where
            out += [(c, []) for c in cut(places, self.settings.paragraphs_per_call)]
        if role.endswith(("_vision", "_multimodal")):
            out += [([], c) for c in cut(self.doc.images, self.settings.images_per_call)]
        return out

    def _all_chunks(self, kind, chunk, model, backend, where, attempt):
        found: dict[str, Found] = {s.name: Found() for s in chunk}
        chunks = self._text_chunks(model.role, where)
        for number, (places, images) in enumerate(chunks):
            left = [s for s in chunk if not (kind == "concept" and s.singular and found[s.name].items)]
            if not left:
                break
            params = {p: getattr(left[0], p) for p in PARAMS}
            if images:
                params |= {"add_references": False}
            paras, sents = [self.doc.paras[i] for i in places], [self.doc.sents[i] if self.doc.sents else [] for i in places]
            md = [self.doc.md[i] for i in places] if self.doc.md else []
            shown = md if md and all(md) else paras
            text = "\n\n".join(md) if md and shown is md else self.doc.text
            whole = text if kind == "concept" and where is None and not params["add_references"] and len(chunks) == 1 and not images else None
            numbered = kind == "aspect" or params["add_references"]
            prompt = self.render(kind, left, params, shown, sents, numbered, whole) if self.keep_prompts or getattr(backend, "needs_prompt", True) else ""
            reply = self._call(prompt, {"kind": kind, "specs": left, "paras": paras, "sents": sents, "params": params, "images": images, "text_chunk": number}, model, backend, attempt)
            read = envelope.aspect_items if kind == "aspect" else envelope.concept_items
            try:
                got = read(reply, left, paras, sents, params)
            except envelope.Invalid as e:
                self.calls[-1]["error"] = str(e)
                raise
            for n, items in got.items():
                f = found[left[n].name]
                f.processed = True
                for item in items:
                    f.items.append(item | {"paras": [places[p] for p in item["paras"]], "sents": [(places[p], s) for p, s in item["sents"]]})
        return found

    def _call(self, prompt, payload, model, backend, attempt):
        if self.limiter:
            self.limiter(model).acquire()
        record = {"role": model.role, "model": model.model, "is_fallback": model.is_fallback, "attempt": attempt, "prompt": prompt, "response": None, "in_tokens": prompts.tokens_estimate(prompt), "out_tokens": 0, "error": None}
        self.calls.append(record)
        if record["in_tokens"] > model.context_tokens:
            record["error"] = "the prompt is longer than the model's context"
            raise CallFailed(record["error"])
        try:
            text = backend.complete(prompt, payload | {"attempt": attempt, "messages": [{"role": "system", "content": prompts.system_message(model.output_language)}, prompts.user_message(prompt, payload["images"])], "request": model.request()})
            record |= {"response": text, "out_tokens": prompts.tokens_estimate(text or "")}
            reply = envelope.parse(text)
            if reply is None:
                raise envelope.Invalid("no JSON array or object")
            return reply
        except (envelope.Invalid, CallFailed) as e:
            record["error"] = str(e)
            raise

    # ---- the four extractions

    def aspects(self, specs, prefix: str = "", where: list[int] | None = None) -> list[tuple[str, object, Found]]:
        """(owner, spec, found) of aspects, then of their sub-aspects over the parents' paragraphs."""
        out = []
        found = self.extract("aspect", specs, where)
        for s in specs:
            f = found[s.name]
            out.append((f"{prefix}aspect:{s.name}", s, f))
        for s in specs:
            places = referenced(found[s.name])
            if s.aspects and places:
                out += self.aspects(s.aspects, f"{prefix}aspect:{s.name}/", places)
        return out

    def concepts_of(self, owner: str, aspect, found: Found):
        """Concepts of an aspect over its paragraphs; the aspect must have been processed."""
        if not found.processed:
            raise SpecError(f"{owner} has not been processed")
        places = referenced(found)
        if not aspect.concepts or not places:
            return []
        got = self.extract("concept", aspect.concepts, places)
        return [(f"{owner}/concept:{c.name}", c, got[c.name]) for c in aspect.concepts]

    def concepts(self, specs):
        got = self.extract("concept", specs)
        return [(f"concept:{c.name}", c, got[c.name]) for c in specs]

    def all(self, pipeline: Pipeline):
        """Aspects with sub-aspects, their concepts, then the document's concepts."""
        found = self.aspects(pipeline.aspects)
        out = list(found)
        for owner, spec, f in found:
            if f.processed:
                out += self.concepts_of(owner, spec, f)
        return out + self.concepts(pipeline.concepts)


def referenced(found: Found) -> list[int]:
    """Distinct paragraphs of all items, in document order."""
    return sorted({p for i in found.items for p in i["paras"]})


def rolled_up(found: Found, depth: str, sents: list[list[str]]) -> tuple[list[int], list[tuple[int, int]]]:
    """An aspect's own references: its items' paragraphs and, by sentence, every sentence of those."""
    places = referenced(found)
    return places, [(p, s) for p in places for s in range(len(sents[p]))] if depth == "sentences" and sents else []
