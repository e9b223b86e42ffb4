"""Rules and range definitions as they are stored: reading, cleaning and checking them. Plain functions on the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

# The conditions, occurrences and edges of a definition, the conditions that detection knows, and other names of keys.
CONDITIONS = (">", ">=", "<", "<=", "=", "!=", "between", "outside")
THRESHOLDS = (">", ">=", "<", "<=")
OCCURRENCES, EDGES = ("first", "last", "all"), ("rising", "falling", "either", "none")
OTHER_KEYS = {"value": "valueA", "value_b": "valueB", "expression": "formula_text"}

WITH_PAIR = CONDITIONS[-2:]
_SIGNS, _BREAKS = "<>=!", ".,"


def parse_config(config: str | dict) -> dict:
    """The settings of a range rule, from JSON or as they are."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except ValueError as e:
            raise ValueError(f"a rule's config is not JSON: {e}") from e
    if not isinstance(config, dict):
        raise ValueError("a rule's config must be a JSON object")
    return config


# --- expressions ----------------------------------------------------------------------------------------------------


def tokens(text: str) -> Iterator[str]:
    """The words, signs and separators of an expression. A word ends at white space, a sign, a comma or two dots; a dot or hyphen in it belongs to
    it, so that names may hold both and numbers may be negative."""
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = at + 1
        if text[at] in _SIGNS:
            while end < len(text) and text[end] in _SIGNS:
                end += 1
        elif text[at] == "," or text.startswith("..", at):
            end = at + (1 if text[at] == "," else 2)
        else:
            while end < len(text) and not (text[end].isspace() or text[end] in _SIGNS or text[end] == "," or text.startswith("..", end)):
                end += 1
        yield text[at:end]
        at = end


def _is_number(word: str) -> bool:
    try:
        float(word)
    except ValueError:
        return False
    return True


def _is_name(word: str) -> bool:
    """A channel's name; single letters are variables of a formula."""
    return len(word) > 1 and (word[0].isalpha() or word[0] == "_") and all(c.isalnum() or c in "_.-" for c in word)


def from_expression(text: str) -> dict:
    """Channel, condition and numbers of `name sign number` or `name between|outside number .. number`, where a comma or the word `to` may stand
    for the dots; empty if the text is anything else, such as a formula."""
    words = list(tokens(text))
    if len(words) < 3 or not _is_name(words[0]) or words[1].lower() not in CONDITIONS:
        return {}
    name, op, rest = words[0], words[1].lower(), words[2:]
    numbers = [w for w in rest if _is_number(w)]
    if op not in WITH_PAIR:
        return {"channels": [name], "op": op, "value": float(rest[0])} if len(rest) == len(numbers) == 1 else {}
    if len(numbers) != 2 or len(rest) > 3 or len(rest) == 3 and rest[1].lower() not in ("..", ",", "to"):
        return {}
    return {"channels": [name], "op": op, "value": float(numbers[0]), "value_b": float(numbers[1])}


# --- conditions and definitions -------------------------------------------------------------------------------------


def _given(raw: dict, key: str):
    """The value of a key, by its other name too; texts are trimmed, and empty ones are none."""
    for name in (key, OTHER_KEYS.get(key)):
        value = raw.get(name)
        value = value.strip() if isinstance(value, str) else value
        if value is not None and value != "":
            return value
    return None


def _one_of(raw: dict, key: str, known: tuple[str, ...], default: str, what: str) -> str:
    value = str(_given(raw, key) or default).lower()
    if value not in known:
        raise ValueError(f"{what}: {key} must be one of {', '.join(known)}")
    return value


def _number(raw: dict, key: str, what: str) -> float | None:
    value = _given(raw, key)
    if value is not None and not _is_number(str(value)):
        raise ValueError(f"{what}: {key} must be a number")
    return None if value is None else float(value)


def clean_condition(raw: dict | None, what: str) -> dict:
    """A start or end condition with its channels, op, value(s), occurrence, edge and expression; raises ValueError on what can't be one.

    Fields win over the expression, which is read for what they do not say; an expression that is no threshold of a channel is kept as it is. A
    condition on channels gets the expression that its fields make.
    """
    raw = raw if isinstance(raw, dict) else {}
    out = {
        "op": _one_of(raw, "op", CONDITIONS, ">", what), "occurrence": _one_of(raw, "occurrence", OCCURRENCES, "first", what), "edge": _one_of(raw, "edge", EDGES, "none", what),
        "channels": [name for name in (str(c).strip() for c in raw.get("channels") or []) if name], "expression": _given(raw, "expression") or "",
    }
    numbers = {key: _number(raw, key, what) for key in ("value", "value_b")}
    if not out["channels"]:
        if not out["expression"]:
            raise ValueError(f"{what} needs channels or an expression")
        said = from_expression(out["expression"])
        out |= {k: said[k] for k in ("channels", "op") if k in said}
        if numbers["value"] is None:
            numbers |= {k: said[k] for k in numbers if k in said}
    elif numbers["value"] is None and not out["expression"]:
        raise ValueError(f"{what}: a value is required")
    formula = _given(raw, "formula")
    if out["channels"] and numbers["value"] is not None:
        if out["op"] not in WITH_PAIR:
            numbers["value_b"] = None
        elif numbers["value_b"] is None:
            raise ValueError(f"{what}: {out['op']} needs two numbers")
        left = formula if formula not in (None, "A") else out["channels"][0]
        out["expression"] = f"{left} {out['op']} " + "..".join(f"{v:g}" for v in numbers.values() if v is not None)
    return out | {"formula": formula or ("A" if out["channels"] else "")} | {k: v for k, v in numbers.items() if v is not None}


def clean_definition(raw: dict) -> dict:
    """A definition with cleaned nodes, whose parents exist and form no cycle."""
    name = _given(raw, "name")
    if not name:
        raise ValueError("a range definition needs a name")
    nodes = [_clean_node(row, str(name)) for row in raw.get("nodes") or []]
    check_tree(nodes, str(name))
    return {"id": str(_given(raw, "id") or uuid.uuid4()), "name": str(name), "description": _given(raw, "description"), "nodes": nodes}


def _clean_node(row, definition: str) -> dict:
    name = _given(row, "name") if isinstance(row, dict) else None
    if name is None:
        raise ValueError(f"a node of {definition!r} needs a name")
    parent = _given(row, "parent_id")
    node = {"id": str(_given(row, "id") or uuid.uuid4()), "name": str(name), "parent_id": None if parent is None else str(parent)}
    node |= {end: clean_condition(row.get(end), f"{end} of {name!r}") for end in ("start", "end")}
    return node | {key: str(value) for key in ("label", "color") if (value := _given(row, key)) is not None}


def check_tree(nodes: list[dict], name: str) -> None:
    """Ids are different, and every node is reached from those without a parent."""
    parent_of = {n["id"]: n.get("parent_id") for n in nodes}
    if len(parent_of) != len(nodes):
        raise ValueError(f"nodes of {name!r} have the same id")
    if unknown := [p for p in parent_of.values() if p is not None and p not in parent_of]:
        raise ValueError(f"parent {unknown[0]!r} is no node of {name!r}")
    if len(parents_first(nodes)) < len(nodes):
        raise ValueError(f"nodes of {name!r} form a cycle")


def parents_first(nodes: list[dict]) -> list[dict]:
    """The nodes level by level from those without a parent, each level in its own order; members of cycles are left out."""
    ids = {n["id"] for n in nodes}
    ordered = [n for n in nodes if n.get("parent_id") not in ids]
    for node in ordered:  # grows on the way
        ordered += [n for n in nodes if n.get("parent_id") == node["id"]]
    return ordered
