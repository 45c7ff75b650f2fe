"""Templates of users: values, loops and conditions, enough for prompts.

``{{ a.b[0] }}`` puts in a value, ``{% for x in xs %} .. {% endfor %}`` repeats,
``{% if a.b %}``, ``{% elif not c %}``, ``{% else %}``, ``{% endif %}`` choose, ``{# .. #}`` is a
remark. Conditions are values, ``not``, ``and``, ``or``, ``==`` and ``!=`` with values, numbers or quoted text. A loop
has ``loop.index`` (from 1), ``loop.index0``, ``loop.first`` and ``loop.last``. A line with nothing but a statement leaves no
empty line. Names that are not given are an error.
"""

from __future__ import annotations

import re
from typing import Any

PART = re.compile(r"(\{\{.*?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.DOTALL)
ALONE = re.compile(r"^[ \t]*(\{%-?[^\n]*?-?%\}|\{#[^\n]*?#\})[ \t]*\n", re.MULTILINE)
WORD = re.compile(r"""\s*("[^"]*"|'[^']*'|-?\d+(?:\.\d+)?|==|!=|[A-Za-z_]\w*(?:\.\w+|\[\d+\])*)""")
PLAIN = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class TemplateError(ValueError):
    """A template that cannot be read, or a name it uses that has no value."""


def look_up(path: str, values: dict) -> Any:
    """The value of ``a.b[0]``: keys of dicts, attributes of objects, places of lists."""
    parts = re.findall(r"\w+", path)
    if parts[0] not in values:
        raise TemplateError(f"{parts[0]} has no value")
    found = values[parts[0]]
    for part in parts[1:]:
        try:
            found = found[int(part)] if isinstance(found, (list, tuple)) else found[part] if isinstance(found, dict) else getattr(found, part)
        except (KeyError, IndexError, AttributeError, ValueError):
            raise TemplateError(f"{path} has no value") from None
    return found


def words_of(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = WORD.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text!r}")
        out.append(m[1])
        at = m.end()
    return out


def value(word: str, values: dict) -> Any:
    if word[0] in "\"'":
        return word[1:-1]
    if word[0].isdigit() or word[0] == "-":
        return float(word) if "." in word else int(word)
    return PLAIN[word] if word in PLAIN else look_up(word, values)


def holds(text: str, values: dict) -> bool:
    """Whether a condition holds; ``or`` binds less than ``and``, ``and`` less than ``not``."""
    words = words_of(text)

    def split(words: list[str], by: str) -> list[list[str]]:
        out: list[list[str]] = [[]]
        for w in words:
            if w == by:
                out.append([])
            else:
                out[-1].append(w)
        return out

    def one(words: list[str]) -> bool:
        if words[:1] == ["not"]:
            return not one(words[1:])
        if len(words) == 1:
            return bool(value(words[0], values))
        if len(words) == 3 and words[1] in ("==", "!="):
            return (value(words[0], values) == value(words[2], values)) is (words[1] == "==")
        raise TemplateError(f"not a condition: {text!r}")

    return any(all(one(part) for part in split(choice, "and")) for choice in split(words, "or"))


def parse(text: str) -> list:
    """Nested lists of text, ("value", path), ("for", name, path, body) and ("if", [(condition or None, body), ..])."""
    parts = PART.split(ALONE.sub(lambda m: m[1], text))
    at = 0

    def body(ends: tuple[str, ...]) -> tuple[list, str, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part, at = parts[at], at + 1
            if part.startswith("{{"):
                out.append(("value", part[2:-2].strip()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip("- \t\n").partition(" ")
                if word in ends:
                    return out, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*(\w+)\s+in\s+(\S+)\s*", rest)
                    if not m:
                        raise TemplateError(f"not a loop: {rest!r}")
                    out.append(("for", m[1], m[2], body(("endfor",))[0]))
                elif word == "if":
                    choices, condition, end = [], rest, ""
                    while end != "endif":
                        inner, end, more = body(("elif", "else", "endif") if condition is not None else ("endif",))
                        choices.append((condition, inner))
                        condition = more if end == "elif" else None
                    out.append(("if", choices))
                else:
                    raise TemplateError(f"unknown statement: {word}")
            elif part and not part.startswith("{#"):
                out.append(part)
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return out, "", ""

    return body(())[0]


def render(text: str, values: dict) -> str:
    def go(nodes: list, values: dict) -> str:
        out = []
        for node in nodes:
            if isinstance(node, str):
                out.append(node)
            elif node[0] == "value":
                out.append(str(value(words_of(node[1])[0], values)))
            elif node[0] == "for":
                rows = list(value(node[2], values))
                for i, row in enumerate(rows):
                    out.append(go(node[3], {**values, node[1]: row, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(rows) - 1}}))
            else:
                out.append(next((go(inner, values) for condition, inner in node[1] if condition is None or holds(condition, values)), ""))
        return "".join(out)

    return go(parse(text), values)
