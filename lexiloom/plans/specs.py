"""What to extract: aspects, typed concepts, pipelines, models. Frozen values; checks run when they are made."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

TEXT_ROLES = ("extractor_text", "reasoner_text")
ROLES = (*TEXT_ROLES, "extractor_vision", "reasoner_vision", "extractor_multimodal", "reasoner_multimodal")
DEPTHS = ("paragraphs", "sentences")
JUSTIFICATIONS = ("brief", "balanced", "comprehensive")
KINDS = ("string", "boolean", "numerical", "rating", "json_object", "date", "label")
NUMERIC = ("int", "float", "any")
CLASSIFICATIONS = ("multi_class", "multi_label")
MAX_NESTING = 1


class SpecError(ValueError):
    """A specification breaks one of its rules."""


def need(ok: Any, why: str) -> None:
    if not ok:
        raise SpecError(why)


def _named(x) -> None:
    for what in ("name", "description"):
        value = getattr(x, what)
        need(isinstance(value, str) and value.strip(), f"{what} must be a non-empty string")
        object.__setattr__(x, what, value.strip())
    need(x.reference_depth in DEPTHS, f"reference_depth is one of {DEPTHS}")
    need(x.justification_depth in JUSTIFICATIONS, f"justification_depth is one of {JUSTIFICATIONS}")
    need(x.justification_max_sents >= 1, "justification_max_sents is at least 1")


def unique(items: Iterable, what: str) -> None:
    """Names, and descriptions, differ regardless of case."""
    items = list(items)
    for attr in ("name", "description"):
        values = [getattr(i, attr).lower() for i in items]
        need(len(set(values)) == len(values), f"{what} must have unique values of {attr}")


class Holder:
    """Methods shared by what holds aspects or concepts; each returns a new value."""

    def _change(self, **fields):
        return replace(self, **fields)

    def add_concepts(self, *new):
        return self._change(concepts=(*self.concepts, *new))

    def add_aspects(self, *new):
        return self._change(aspects=(*self.aspects, *new))

    @staticmethod
    def _find(items, name):
        for i in items:
            if i.name == name:
                return i
        raise SpecError(f"nothing is named {name!r}")

    def get_aspect(self, name):
        return self._find(self.aspects, name)

    def get_aspects(self, names):
        return [self.get_aspect(n) for n in names]

    def get_concept(self, name):
        return self._find(self.concepts, name)

    def get_concepts(self, names):
        return [self.get_concept(n) for n in names]

    def without_aspects(self, *names):
        """Without the named aspects; without any if no name is given."""
        return self._change(aspects=tuple(a for a in self.aspects if names and a.name not in names))

    def without_concepts(self, *names):
        return self._change(concepts=tuple(c for c in self.concepts if names and c.name not in names))

    @property
    def roles(self) -> set[str]:
        """Roles its aspects, their concepts and its own concepts ask for."""
        found = {c.llm_role for c in self.concepts}
        for a in self.aspects:
            found |= {a.llm_role} | {c.llm_role for c in a.concepts}
        return found


@dataclass(frozen=True)
class Concept:
    """A typed data point. ``kind`` decides which further fields count."""

    name: str
    description: str
    kind: str = "string"
    llm_role: str = "extractor_text"
    add_references: bool = False
    reference_depth: str = "paragraphs"
    singular: bool = False
    add_justifications: bool = False
    justification_depth: str = "brief"
    justification_max_sents: int = 2
    numeric_type: str = "any"
    rating: tuple[int, int] | None = None
    labels: tuple[str, ...] = ()
    classification: str = "multi_class"
    structure: Any = None
    examples: tuple = ()
    rule: Any = None
    custom_data: Any = None

    def __post_init__(self):
        _named(self)
        need(self.kind in KINDS, f"kind is one of {KINDS}")
        need(self.llm_role in ROLES, f"llm_role is one of {ROLES}")
        need(not (self.add_references and self.llm_role.endswith("_vision")), "vision concepts have no references")
        need(self.numeric_type in NUMERIC, f"numeric_type is one of {NUMERIC}")
        if self.kind == "rating":
            need(self.rating and self.rating[0] >= 0 and self.rating[1] > self.rating[0], "a rating has a scale 0 <= start < end")
        if self.kind == "label":
            need(len(self.labels) >= 2, "a label concept has two labels at least")
            need(len({x.lower() for x in self.labels}) == len(self.labels), "labels differ regardless of case")
            need(self.classification in CLASSIFICATIONS, f"classification is one of {CLASSIFICATIONS}")
        if self.kind == "json_object":
            from lexiloom.functions.structure import compile_structure

            validator = compile_structure(self.structure)
            for example in self.examples:
                need(validator(example) is None, "an example does not fit the structure")

    @property
    def value_type(self) -> str:
        """How prompts name the type of its value."""
        if self.kind == "numerical":
            return {"int": "int", "float": "float", "any": "int or float"}[self.numeric_type]
        return {"string": "str", "boolean": "bool", "rating": "int", "json_object": "dict", "date": "str (in 'DD-MM-YYYY' format)", "label": "dict"}[self.kind]


def StringConcept(name, description, **more):
    return Concept(name, description, "string", **more)


def BooleanConcept(name, description, **more):
    return Concept(name, description, "boolean", **more)


def NumericalConcept(name, description, **more):
    return Concept(name, description, "numerical", **more)


def RatingConcept(name, description, rating, **more):
    return Concept(name, description, "rating", rating=tuple(rating), **more)


def JsonObjectConcept(name, description, structure, **more):
    return Concept(name, description, "json_object", structure=structure, **more)


def DateConcept(name, description, **more):
    return Concept(name, description, "date", **more)


def LabelConcept(name, description, labels, classification="multi_class", **more):
    return Concept(name, description, "label", labels=tuple(labels), classification=classification, **more)


@dataclass(frozen=True)
class Aspect(Holder):
    """A topic whose text is wanted; may hold concepts and, once, sub-aspects."""

    name: str
    description: str
    llm_role: str = "extractor_text"
    reference_depth: str = "paragraphs"
    add_justifications: bool = False
    justification_depth: str = "brief"
    justification_max_sents: int = 2
    aspects: tuple = ()
    concepts: tuple = ()
    rule: Any = None
    custom_data: Any = None

    add_references = False
    kind = "aspect"

    def __post_init__(self):
        object.__setattr__(self, "aspects", tuple(self.aspects))
        object.__setattr__(self, "concepts", tuple(self.concepts))
        _named(self)
        need(self.llm_role in TEXT_ROLES, f"an aspect's llm_role is one of {TEXT_ROLES}")
        need(all(c.llm_role in TEXT_ROLES for c in self.concepts), "an aspect's concepts use text roles")
        unique(self.aspects, "sub-aspects")
        unique(self.concepts, "concepts")
        for a in self.aspects:
            need(not a.aspects, f"aspects nest {MAX_NESTING} level deep")
            need(a.name.lower() != self.name.lower() and a.description.lower() != self.description.lower(), "a sub-aspect differs from its parent in name and description")


@dataclass(frozen=True)
class Pipeline(Holder):
    """Aspects and concepts to be applied to every document."""

    aspects: tuple = ()
    concepts: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "aspects", tuple(self.aspects))
        object.__setattr__(self, "concepts", tuple(self.concepts))
        unique(self.aspects, "aspects")
        unique(self.concepts, "concepts")

    @property
    def needs_sentences(self) -> bool:
        """Some aspect, or concept with references, is wanted by sentence."""

        def deep(c):
            return c.add_references and c.reference_depth == "sentences"

        def asks(a):
            return a.reference_depth == "sentences" or any(map(deep, a.concepts)) or any(map(asks, a.aspects))

        return any(map(deep, self.concepts)) or any(map(asks, self.aspects))

    def assign(self, earlier: Pipeline | None, overwrite: bool = False) -> Pipeline:
        """The pipeline a document has after this one is assigned to it."""
        need(overwrite or earlier is None or not (earlier.aspects or earlier.concepts), "the document has aspects or concepts already")
        return self


@dataclass(frozen=True)
class Pricing:
    """Price of a million tokens, in and out."""

    input: Decimal
    output: Decimal

    def __post_init__(self):
        for f in ("input", "output"):
            value = Decimal(str(getattr(self, f)))
            need(value >= 0, "prices are not negative")
            object.__setattr__(self, f, value)


@dataclass(frozen=True)
class Model:
    """A language model's settings."""

    model: str
    role: str = "extractor_text"
    pricing: Pricing | None = None
    auto_pricing: bool = False
    temperature: float = 0.3
    max_tokens: int = 4096
    max_completion_tokens: int = 16000
    retries_failed: int = 3
    retries_provider: int = 0
    retries_invalid: int = 3
    timeout: int = 120
    output_language: str = "en"
    context_tokens: int = 128_000
    rate: tuple[int, float] = (3, 10.0)
    is_fallback: bool = False
    fallback: Model | None = None
    tools: tuple[str, ...] = ()
    tool_max_rounds: int = 10
    vision: bool = True
    reasoning: bool = False

    def __post_init__(self):
        need("/" in self.model, "a model is named provider/model")
        need(self.role in ROLES, f"role is one of {ROLES}")
        need(not (self.pricing and self.auto_pricing), "give a pricing or auto_pricing, not both")
        need(not (self.auto_pricing and self.model.split("/")[0] in ("ollama", "ollama_chat", "lm_studio")), "local models have no automatic pricing")
        need(self.output_language in ("en", "adapt"), "output_language is en or adapt")
        need(self.retries_invalid >= 0 and self.tool_max_rounds >= 1, "retries are not negative, tool rounds at least 1")
        f = self.fallback
        if f:
            need(f.is_fallback, "a fallback is marked is_fallback")
            need(not self.is_fallback and f.fallback is None, "a fallback has no fallback")
            need(f.role == self.role and f.output_language == self.output_language and f.tools == self.tools, "a fallback has the same role, language and tools")
            need(replace(f, is_fallback=False) != replace(self, fallback=None), "a fallback differs from its model")

    def request(self) -> dict:
        """Parameters of a completion: reasoning models take a completion budget and no temperature."""
        base = {"model": self.model, "timeout": self.timeout, "num_retries": self.retries_failed}
        return base | ({"max_completion_tokens": self.max_completion_tokens} if self.reasoning else {"max_tokens": self.max_tokens, "temperature": self.temperature})

    def check_output(self, most: int) -> None:
        need((self.max_completion_tokens if self.reasoning else self.max_tokens) <= most, "more output tokens than the model allows")


@dataclass(frozen=True)
class Group:
    """Two or more models with different roles and one output language."""

    models: tuple[Model, ...] = field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "models", tuple(self.models))
        need(len(self.models) >= 2, "a group has two models at least")
        need(len({m.role for m in self.models}) == len(self.models), "roles in a group differ")
        need(len({m.output_language for m in self.models}) == 1, "a group has one output language")
        need(not any(m.is_fallback for m in self.models), "fallbacks belong to their models")

    @property
    def roles(self) -> list[str]:
        return [m.role for m in self.models]

    def by_role(self, role: str) -> Model:
        for m in self.models:
            if m.role == role:
                return m
        raise SpecError(f"no model has the role {role!r}")

    def with_language(self, language: str) -> Group:
        return Group(tuple(replace(m, output_language=language, fallback=m.fallback and replace(m.fallback, output_language=language)) for m in self.models))


def missing_roles(pipeline: Pipeline, models) -> set[str]:
    """Roles the pipeline asks for that no model has (sub-aspects are not looked at)."""
    return pipeline.roles - {m.role for m in models}
