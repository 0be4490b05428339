"""Template libraries and subsystems in files of their own: imports with choices, new names and bound sizes, merged into the document that asks for them."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Mapping

from ..errors import QuernError
from .expressions import free_variables, is_node, substitute

NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*")
#: What a library has none of.
SYSTEMS = ("models", "reaction_systems", "data_sources", "coupling")


def loaded(ref: str, at: str, read: Callable[[str], str], seen: tuple[str, ...]) -> tuple[dict, str]:
    """The document that a reference names, by its place relative to the one that refers to it, and that place."""
    path = posixpath.normpath(posixpath.join(posixpath.dirname(at), ref))
    if path in seen:
        raise QuernError("reference_cycle", " -> ".join((*seen, path)))
    try:
        return json.loads(read(path)), path
    except (OSError, KeyError):
        raise QuernError("reference_not_found", path) from None
    except json.JSONDecodeError as e:
        raise QuernError("json", f"{path}: {e}") from None


def merge_sets(into: dict, other: Mapping, at: str) -> None:
    """Index sets beside ours; one of a name is declared alike or not at all."""
    for k, s in (other.get("index_sets") or {}).items():
        if into.setdefault("index_sets", {}).setdefault(k, s) != s:
            raise QuernError("index_set_conflict", f"{k} of {at}")


def renamed_uses(x, names: Mapping[str, str]):
    """An expression with the templates that it uses under their new names."""
    if isinstance(x, dict):
        out = {k: renamed_uses(v, names) for k, v in x.items()}
        if x.get("op") == "apply_expression_template" and x.get("name") in names:
            out["name"] = names[x["name"]]
        elif x.get("op") in names:
            out["op"] = names[x["op"]]
        return out
    return [renamed_uses(v, names) for v in x] if isinstance(x, list) else x


def exported(entry: Mapping, doc: dict, at: str, read: Callable[[str], str], seen: tuple[str, ...]) -> dict[str, dict]:
    """The templates that one import brings, under the names it gives them; the library's index sets come into `doc`."""
    library, path = loaded(entry["ref"], at, read, seen)
    if any(library.get(k) for k in SYSTEMS) or not (library.get("expression_templates") or library.get("expression_template_imports")):
        raise QuernError("not_a_library", path)
    library = with_imports(library, path, read, (*seen, path))
    values = entry.get("metaparameters") or entry.get("bindings") or {}
    if unknown := sorted(set(values) - set(library.get("metaparameters") or {})):
        raise QuernError("import_unknown_name", f"{unknown} of {path}")
    for k, p in (library.get("metaparameters") or {}).items():
        value = values.get(k, p.get("default") if isinstance(p, dict) else None)
        if value is not None:
            library = {**library, "expression_templates": {n: {**t, "body": substitute(t.get("body"), {k: value})} for n, t in library["expression_templates"].items()}}
            library["index_sets"] = {n: {**s, "size": value} if s.get("size") == k else s for n, s in (library.get("index_sets") or {}).items()}
    merge_sets(doc, library, path)
    own = dict(library["expression_templates"])
    only, rename, prefix, rebind = entry.get("only"), entry.get("rename") or {}, entry.get("prefix"), entry.get("rebind") or {}
    if only is not None:
        if unknown := sorted(set(only) - set(own)):
            raise QuernError("import_unknown_name", f"{unknown} of {path}")
        # What the chosen ones use comes too, unseen by others.
        own = {n: own[n] for n in needed(only, own)}
    if unknown := sorted(set(rename) - set(own)):
        raise QuernError("import_unknown_name", f"{unknown} of {path}")
    free = set().union(*(free_variables(t.get("body")) - set(t.get("params") or []) for t in own.values()))
    if unknown := sorted(set(rebind) - free):
        raise QuernError("import_unknown_name", f"{unknown} is free in nothing of {path}")
    names = {n: (f"{prefix}." if prefix else "") + rename.get(n, n) for n in own}
    if bad := sorted(n for n in names.values() if not NAME.fullmatch(n)):
        raise QuernError("import_name", f"{bad}")
    if len(set(names.values())) < len(names):
        raise QuernError("import_conflict", f"two templates of {path} under one name")
    changed = {n: m for n, m in names.items() if n != m}
    return {names[n]: {**t, "body": renamed_uses(substitute(t.get("body"), rebind) if rebind else t.get("body"), changed)} for n, t in own.items()}


def needed(only: list[str], templates: Mapping[str, dict]) -> list[str]:
    out, todo = [], list(only)
    while todo:
        n = todo.pop(0)
        if n in out or n not in templates:
            continue
        out.append(n)
        stack = [templates[n].get("body")]
        while stack:
            x = stack.pop()
            if is_node(x):
                todo += [k for k in (x["op"], x.get("name")) if k in templates]
                stack += [*x.get("args", []), x.get("expr"), x.get("filter"), *(x.get("bindings") or {}).values()]
    return out


def with_imports(doc: dict, at: str, read: Callable[[str], str], seen: tuple[str, ...] = ()) -> dict:
    """A document, or library, with the templates that it and its models import; another one of a name is an error."""
    out = json.loads(json.dumps(doc))
    for part in [out, *(m for m in (out.get("models") or {}).values() if isinstance(m, dict)), *(m for m in (out.get("reaction_systems") or {}).values() if isinstance(m, dict))]:
        for entry in part.pop("expression_template_imports", None) or []:
            own = part.setdefault("expression_templates", {})
            for n, t in exported(entry, out, at, read, (*seen, at) if at not in seen else seen).items():
                if own.setdefault(n, t) != t:
                    raise QuernError("import_conflict", n)
    return out


def with_subsystems(doc: dict, at: str, read: Callable[[str], str], seen: tuple[str, ...] = ()) -> dict:
    """A document whose subsystems given by reference are the one system of the documents they name."""
    out = json.loads(json.dumps(doc))

    def walk(m: dict) -> None:
        for n, s in (m.get("subsystems") or {}).items():
            if not isinstance(s, dict) or "ref" not in s:
                if isinstance(s, dict):
                    walk(s)
                continue
            other, path = loaded(s["ref"], at, read, (*seen, at))
            found = [x for k in ("models", "reaction_systems") for x in (other.get(k) or {}).values()]
            if not found and other.get("expression_templates"):
                raise QuernError("subsystem_is_library", path)
            if len(found) != 1:
                raise QuernError("ambiguous_subsystem", f"{path} has {len(found)} systems")
            merge_sets(out, other, path)
            inner = with_subsystems(other, path, read, (*seen, at))
            m["subsystems"][n] = next(x for k in ("models", "reaction_systems") for x in (inner.get(k) or {}).values())
            merge_sets(out, inner, path)

    for m in (out.get("models") or {}).values():
        if isinstance(m, dict):
            walk(m)
    return out


def resolved(doc: dict, at: str, read: Callable[[str], str]) -> dict:
    """A document that needs no other: imports and subsystems brought in by read(place). Places are relative to its own, `at`."""
    return with_subsystems(with_imports(doc, at, read), at, read)
