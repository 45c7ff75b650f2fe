"""Prompts of calls: a small renderer with our own wording, and lints for templates of users."""

from __future__ import annotations

import json
import re
from importlib import import_module

from lexiloom.functions.envelope import clean
from lexiloom.functions.structure import prompt_text
from lexiloom.plans import templates

PAIRS = {")": "(", "]": "[", "}": "{"}


def brackets_balanced(text: str) -> bool:
    stack = []
    for c in text:
        if c in "([{":
            stack.append(c)
        elif c in PAIRS and (not stack or stack.pop() != PAIRS[c]):
            return False
    return not stack


def tags_balanced(text: str) -> bool:
    stack = []
    for close, name, alone in re.findall(r"<(/?)([A-Za-z_][\w-]*)[^<>]*?(/?)>", text):
        if alone:
            continue
        if not close:
            stack.append(name)
        elif not stack or stack.pop() != name:
            return False
    return not stack


def has_tags(template: str) -> bool:
    """It has a variable or a statement to fill in."""
    return bool(re.search(r"\{\{.+?\}\}|\{%.+?%\}", template, re.DOTALL))


def lint(template: str) -> list[str]:
    """What is wrong with a rendered template."""
    found = [] if brackets_balanced(template) else ["brackets do not match"]
    found += [] if tags_balanced(template) else ["tags do not match"]
    return found + (["more than two line breaks in a row"] if re.search(r"\n{3,}", template) else [])


def fill(template: str, values: dict) -> str:
    """A template with its values, loops and conditions worked out; one without tags, or with unknown names, is an error."""
    if not has_tags(template):
        raise ValueError("the template has nothing to fill in")
    return templates.render(template, values)


def system_message(language: str) -> str:
    tail = "Write in English." if language == "en" else "Write in the language of the document."
    return f"You read documents and return what is asked for as JSON only. {tail}"


def labels_text(labels) -> str:
    return "[" + ", ".join(json.dumps(x, ensure_ascii=False) for x in labels) + "]"


def _spec_line(letter: str, i: int, spec) -> str:
    parts = [f"{letter}{i}: {clean(spec.name, False)} - {clean(spec.description, False)}"]
    if letter == "C":
        parts.append(f"type: {spec.value_type}")
        if spec.kind == "rating":
            parts.append(f"from {spec.rating[0]} to {spec.rating[1]}")
        if spec.kind == "label":
            parts.append(f"labels ({spec.classification}): {labels_text(spec.labels)}")
        if spec.kind == "json_object":
            parts.append("structure: " + prompt_text(spec.structure))
        if spec.singular:
            parts.append("at most one item")
        if spec.examples:
            parts.append("examples: " + json.dumps(list(spec.examples), ensure_ascii=False))
    return "; ".join(parts)


def _shape(kind: str, params: dict) -> str:
    deep, why = params["reference_depth"] == "sentences", params["add_justifications"]
    just = ', "justification": "..."' if why else ""
    if kind == "aspect":
        if deep:
            return f'[{{"aspect_id": "A0", "paragraphs": [{{"paragraph_id": "P0", "sentences": [{{"sentence_id": "P0-S0"{just}}}]}}]}}]'
        if why:
            return '[{"aspect_id": "A0", "paragraphs": [{"paragraph_id": "P0", "justification": "..."}]}]'
        return '[{"aspect_id": "A0", "paragraph_ids": ["P0"]}]'
    if not params["add_references"] and not why:
        return '[{"concept_id": "C0", "extracted_items": [value]}]'
    refs = ""
    if params["add_references"]:
        refs = ', "reference_paragraphs": [{"reference_paragraph_id": "P0", "reference_sentence_ids": ["P0-S0"]}]' if deep else ', "reference_paragraph_ids": ["P0"]'
    return f'[{{"concept_id": "C0", "extracted_items": [{{"value": value{just}{refs}}}]}}]'


def render(kind: str, specs, params: dict, paras, sents, numbered: bool, whole: str | None = None) -> str:
    """The prompt of a call; empty paragraphs are left out but keep their number."""
    letter = "A" if kind == "aspect" else "C"
    lines = [f"Find the {'parts of the document about these aspects' if kind == 'aspect' else 'values of these concepts'}:", ""]
    lines += [_spec_line(letter, i, s) for i, s in enumerate(specs)]
    lines += ["", "<document>"]
    if whole is not None:
        lines.append(clean(whole))
    else:
        body = []
        for i, p in enumerate(paras):
            text = clean(p, False)
            if not text:
                continue
            if not numbered:
                body.append(text)
            elif params["reference_depth"] == "sentences":
                body.append(f"P{i}: " + " ".join(f"[P{i}-S{j}] {c}" for j, s in enumerate(sents[i]) if (c := clean(s, False))))
            else:
                body.append(f"P{i}: {text}")
        lines.append("\n\n".join(body))
    lines += ["</document>", "", "Answer as JSON of this form, one entry for each of them: " + _shape(kind, params)]
    if params["add_justifications"]:
        lines.append(f"Justifications are {params['justification_depth']}, {params['justification_max_sents']} sentences at most.")
    return "\n".join(lines)


def tokens_estimate(text: str) -> int:
    """About four characters a token."""
    return -(-len(text) // 4)


def user_message(prompt: str, images=()) -> dict:
    """Plain content, or parts with data URLs when there are images."""
    if not images:
        return {"role": "user", "content": prompt}
    urls = [{"type": "image_url", "image_url": {"url": f"data:{mime};base64,{data}"}} for mime, data in images]
    return {"role": "user", "content": [{"type": "text", "text": prompt}, *urls]}


def renderer(path: str):
    """What is used instead of ``render``: a function named 'module:function', or a template's text (it has tags).

    A template's values are kind, specs, params, paragraphs (number, text, sentences; blank ones left out), numbered, whole
    (or none), and shape, the form of the answer.
    """
    if has_tags(path):
        templates.parse(path)  # mistakes show at once

        def own(kind, specs, params, paras, sents, numbered, whole=None):
            rows = [{"number": i, "text": text, "sentences": [{"number": j, "text": c} for j, s in enumerate(sents[i] if i < len(sents) else []) if (c := clean(s, False))]} for i, p in enumerate(paras) if (text := clean(p, False))]
            letter = "A" if kind == "aspect" else "C"
            lines = [{"id": f"{letter}{i}", "line": _spec_line(letter, i, s), "name": s.name, "description": s.description} for i, s in enumerate(specs)]
            return fill(path, {"kind": kind, "specs": lines, "params": params, "paragraphs": rows, "numbered": numbered, "whole": None if whole is None else clean(whole), "shape": _shape(kind, params)})

        return own
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)
