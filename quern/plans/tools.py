"""Document tools: references, coupling roles, edits, migration, complexity, checks, and a small command line."""

from __future__ import annotations

import argparse
import json
import os
from collections import Counter
from collections.abc import Callable, Mapping

from ..errors import QuernError
from .checks import problems
from .document import defined_name, load, save
from .expressions import Expr, check_arity, free_variables, is_node, parse, substitute, to_text
from .imports import resolved

VERSION = "1.0.0"


def resolve_refs(doc: dict, read: Callable[[str], str], seen: tuple[str, ...] = ()) -> dict:
    """{"ref": path} models and templates replaced by the documents they name; a cycle of references is an error.

    A referenced document's models come in under the referring name, its index sets and templates beside ours;
    an index set declared twice must be declared alike. `rename` gives its templates other names.
    """
    out = json.loads(json.dumps(doc))
    for name, m in list(out.get("models", {}).items()):
        if "ref" not in m:
            continue
        if m["ref"] in seen:
            raise QuernError("reference_cycle", " -> ".join((*seen, m["ref"])))
        other = resolve_refs(json.loads(read(m["ref"])), read, (*seen, m["ref"]))
        models = other.get("models", {})
        chosen = m.get("model") or (next(iter(models)) if len(models) == 1 else None)
        if chosen not in models:
            raise QuernError("unknown_model", f"{chosen} in {m['ref']}")
        out["models"][name] = models[chosen]
        for key in ("index_sets", "enums"):
            for k, v in other.get(key, {}).items():
                if out.setdefault(key, {}).setdefault(k, v) != v:
                    raise QuernError("conflicting_declaration", k)
        inject(out, other.get("expression_templates", {}), m.get("rename", {}))
    return out


def inject(doc: dict, templates: Mapping[str, dict], rename: Mapping[str, str] = {}) -> None:
    """Templates added to a document's scope under their (new) names; another one of a name is an error."""
    own = doc.setdefault("expression_templates", {})
    for name, t in templates.items():
        to = rename.get(name, name)
        if own.setdefault(to, t) != t:
            raise QuernError("conflicting_declaration", to)


def metaparameters(doc: dict, given: Mapping[str, int]) -> dict:
    """Index-set sizes and range bounds that are names of integer metaparameters, filled in."""
    values = {k: given.get(k, v.get("default")) for k, v in doc.get("metaparameters", {}).items()}
    if missing := [k for k, v in values.items() if v is None] + sorted(set(given) - set(values)):
        raise QuernError("metaparameter", ", ".join(missing))

    def walk(x):
        if isinstance(x, dict):
            return {k: values.get(v, v) if k == "size" and isinstance(v, str) else walk(v) for k, v in x.items()}
        return [values.get(v, v) if isinstance(v, str) and v in values else walk(v) for v in x] if isinstance(x, list) else x

    return walk(doc)


def coupling_roles(library: list[dict], roles: Mapping[str, str]) -> list[dict]:
    """A coupling library's entries with its roles bound to systems; every role must be bound."""
    def bind(x):
        if isinstance(x, str):
            head, dot, tail = x.partition(".")
            if head.startswith("$"):
                if head[1:] not in roles:
                    raise QuernError("unbound_role", head)
                return roles[head[1:]] + dot + tail
            return x
        if isinstance(x, dict):
            return {k: bind(v) for k, v in x.items()}
        return [bind(v) for v in x] if isinstance(x, list) else x

    return [bind(e) for e in library]


class Editor:
    """Edits of one model; each returns the editor, and a name that is still read can't be removed."""

    def __init__(self, doc: dict, model: str):
        self.doc = json.loads(json.dumps(doc))
        if model not in self.doc.get("models", {}):
            raise QuernError("unknown_model", model)
        self.model = self.doc["models"][model]

    def add(self, name: str, **fields) -> Editor:
        if name in self.model.setdefault("variables", {}):
            raise QuernError("duplicate_variable", name)
        self.model["variables"][name] = fields
        return self

    def remove(self, name: str) -> Editor:
        if readers := [e for e in self.model.get("equations", []) if name in free_variables(e["rhs"])]:
            raise QuernError("still_read", f"{name} by {len(readers)} equations")
        self.model.get("variables", {}).pop(name, None)
        self.model["equations"] = [e for e in self.model.get("equations", []) if e["lhs"] != name]
        return self

    def rename(self, old: str, new: str) -> Editor:
        v = self.model.get("variables", {})
        if new in v:
            raise QuernError("duplicate_variable", new)
        if old in v:
            v[new] = v.pop(old)
        for e in self.model.get("equations", []):
            e["lhs"], e["rhs"] = substitute(e["lhs"], {old: new}), substitute(e["rhs"], {old: new})
        return self

    def define(self, name: str, rhs: Expr | str) -> Editor:
        rhs = parse(rhs) if isinstance(rhs, str) else rhs
        self.model["equations"] = [e for e in self.model.setdefault("equations", []) if e["lhs"] != name] + [{"lhs": name, "rhs": rhs}]
        return self


def merge(a: dict, b: dict) -> dict:
    """Both documents' declarations; a name declared in two ways is an error."""
    out = json.loads(json.dumps(a))
    for key in ("index_sets", "enums", "models", "expression_templates"):
        for k, v in b.get(key, {}).items():
            if out.setdefault(key, {}).setdefault(k, v) != v:
                raise QuernError("conflicting_declaration", k)
    return out


def extract(doc: dict, model: str) -> dict:
    """One model with the shared declarations."""
    return {k: v for k, v in doc.items() if k != "models"} | {"models": {model: doc["models"][model]}}


def migrate(doc: dict) -> dict:
    """Older spellings replaced: arrayop nodes become aggregates, and the version is set."""
    return load(doc) | {"version": VERSION}


def complexity(e: Expr) -> dict[str, int]:
    """Nodes, depth, and subtrees that occur more than once."""
    seen: Counter = Counter()

    def walk(x: Expr, depth: int) -> tuple[int, int]:
        if not is_node(x):
            return 0, depth
        seen[to_text(x)] += 1
        parts = [walk(a, depth + 1) for a in x.get("args", [])]
        return 1 + sum(n for n, _ in parts), max([depth + 1, *(d for _, d in parts)])

    n, depth = walk(e, 0)
    return {"nodes": n, "depth": depth, "shared": sum(v > 1 for v in seen.values())}


def common_subexpressions(es: list[Expr]) -> list[Expr]:
    """Subtrees that occur more than once in a list of expressions, the largest first."""
    seen: dict[str, list] = {}

    def walk(x: Expr):
        if is_node(x):
            seen.setdefault(to_text(x), []).append(x)
            for a in x.get("args", []):
                walk(a)

    for e in es:
        walk(e)
    return [v[0] for k, v in sorted(seen.items(), key=lambda kv: -len(kv[0])) if len(v) > 1]


def bound_names(lhs: Expr) -> set[str]:
    """Names in a left side that its right side may use: symbols of index(), ranges of an aggregate."""
    if not is_node(lhs):
        return set()
    own = {a for a in lhs["args"][1:] if isinstance(a, str)} if lhs["op"] == "index" else set(lhs.get("ranges", {})) | set(lhs.get("output_idx", []))
    return own.union(*(bound_names(a) for a in (*lhs.get("args", []), lhs.get("expr"))))


def validate(doc: str | dict, at: str = "", read: Callable[[str], str] | None = None) -> list[str]:
    """Problems of a document, each with a code: fields, arity, undeclared sets, undefined names, equations, couplings, events, units.

    A document without a version and metadata is a part that a program holds: only its equations are looked at. With
    `read`, which gives the text at a place, what it imports and refers to is looked at too; `at` is its own place.
    """
    try:
        raw = json.loads(doc) if isinstance(doc, str) else doc
    except json.JSONDecodeError as e:
        return [f"[json] {e}"]
    found = problems(raw) if not isinstance(raw, dict) or "esm" in raw or "metadata" in raw else []
    if any(p.startswith("[schema]") for p in found):
        return found
    if read is not None and isinstance(raw, dict):
        try:
            resolved(raw, at, read)
        except QuernError as e:
            found.append(str(e))
    try:
        d = load(raw)
    except QuernError as e:
        return [*found, str(e)]
    for m, model in d.get("models", {}).items():
        known = set(model.get("variables", {})) | {defined_name(e["lhs"]) for e in model.get("equations", [])} | {"t"} | set(d.get("index_sets", {})) | set(d.get("coordinates", {})) | set().union(*(bound_names(e["lhs"]) for e in model.get("equations", [])))
        # A name with dots is looked up in the system that its first part names.
        systems_ = set(model.get("subsystems", {})) | set(d.get("models", {})) | set(d.get("reaction_systems", {})) | set(d.get("data_sources", {}))
        counts = Counter(json.dumps(e["lhs"]) for e in model.get("equations", []))
        found += [f"[duplicate_equation] {m}: {k}" for k, n in counts.items() if n > 1]
        for e in model.get("equations", []):
            try:
                check_arity(e["rhs"])
            except QuernError as err:
                found.append(f"{err} in {m}")
            # An initial condition may be a function of place.
            places = set("xyz") | {"lon", "lat", "lev"} if is_node(e["lhs"]) and e["lhs"]["op"] == "ic" else set()
            found += [f"[undefined_name] {m}: {n}" for n in sorted(free_variables(e["rhs"]) - known - places) if not n.startswith("_") and not ("." in n and n.split(".")[0] in systems_)]

            def sets(x):
                if isinstance(x, dict):
                    for r in x.get("ranges", {}).values():
                        if isinstance(r, dict) and r["from"] not in d.get("index_sets", {}):
                            found.append(f"[undeclared_index_set] {m}: {r['from']}")
                    for v in x.values():
                        sets(v)
                elif isinstance(x, list):
                    for v in x:
                        sets(v)

            sets(e["rhs"])
    return list(dict.fromkeys(found))


def to_python(rhs: Mapping[str, Expr], name: str = "rhs") -> str:
    """Source text of a function (t, y) -> rates over plain numbers."""
    body = ", ".join(to_text(e).replace("^", "**") for e in rhs.values())
    return f"from math import *\n\n\ndef {name}(t, y, **p):\n    globals().update(p)\n    ({', '.join(rhs)},) = y\n    return [{body}]\n"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("command", choices=["validate", "migrate", "show", "complexity"])
    p.add_argument("file")
    a = p.parse_args(argv)
    with open(a.file) as f:
        text = f.read()
    if a.command == "validate":
        found = validate(text, a.file, lambda path: open(path).read())  # noqa: SIM115
        print("\n".join(found) or "valid")
        return int(bool(found))
    if a.command == "migrate":
        print(save(migrate(json.loads(text))))
        return 0
    doc = resolve_refs(json.loads(text), lambda ref: open(os.path.join(os.path.dirname(a.file), ref)).read())  # noqa: SIM115
    for m, model in load(doc).get("models", {}).items():
        for e in model.get("equations", []):
            lhs = to_text(e["lhs"])
            print(f"{m}.{lhs}: {complexity(e['rhs'])}" if a.command == "complexity" else f"{m}.{lhs} = {to_text(e['rhs'])}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
