"""What a document must hold before anything runs: its fields, the names it uses, its equations, couplings, events and units.

Each check gives problems as text that begins with a code in brackets; none raises, whatever the document holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from fractions import Fraction

from ..errors import QuernError
from ..functions.scalar import ALIASES, OPS
from ..streaming.cadence import check_acyclic, check_relational
from ..types import SEMIRINGS
from .expressions import is_node
from .systems import unit

DATE = re.compile(r"\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?)?")
#: Fields of each kind of object: name, type, "!" if it must be there. Closed kinds have no others; fixed values.
FIELDS = {
    "metadata": (True, "name:str! description:str authors:list created:date modified:date tags:list license:str references:list version:str"),
    "reference": (True, "doi:doi citation:str notes:str url:url"),
    "data_source": (True, "kind:str! source:dict! temporal:dict metadata:dict reference:dict reader_options:dict record_filter:dict extent:dict description:str"),
    "source": (False, "url_template:str!"),
    "temporal": (False, "start:date end:date records_per_file:records"),
    "variable": (False, "type:str! units:str default:number shape:list description:str"),
    "species": (False, "units:str default:number description:str constant:bool"),
    "reaction": (False, "id:str! rate:expr!"),
    "model": (False, "variables:dict! equations:list! tests:list continuous_events:list discrete_events:list subsystems:dict"),
    "discrete event": (False, "trigger:dict! affects:list!"),
    "continuous event": (False, "conditions:list! affects:list!"),
}
CHOICES = {"variable type": ("parameter", "unknown"), "data source kind": ("grid", "points", "static"), "index set kind": ("interval", "categorical", "ragged", "derived"), "manifold": ("planar", "spherical", "geodesic"), "trigger type": ("preset_times", "periodic", "condition"), "transform": ("param_to_var", "identity", "additive", "multiplicative", "conversion_factor"), "update kind": ("schedule", "data", "remesh", "condition", "crossing", "wiener")}
NEEDS = {"interval": ("size",), "categorical": ("members",), "ragged": ("offsets", "values"), "derived": ("from_faq",)}
UPDATES = {"schedule": (("times", "interval"),), "data": (("source",), ("from",)), "remesh": (("hook",),), "condition": (("when",),), "crossing": (("when",),)}
COUPLINGS = {"operator_compose": ("systems",), "couple": ("systems", "connector"), "variable_map": ("from", "to", "transform"), "callback": ("callback_id",), "operator_apply": ("operator",), "event": ()}
#: Fields of an expression node that hold expressions.
INSIDE = ("args", "expr", "filter", "key", "values", "axes", "lower", "upper", "bindings")
#: Templates inside templates.
DEEPEST = 32
PLACES = {"x", "y", "z", "lon", "lat", "lev", "t"}


def _is(kind: str, v) -> bool:
    number = isinstance(v, int | float) and not isinstance(v, bool)
    return {
        "str": lambda: isinstance(v, str),
        "list": lambda: isinstance(v, list),
        "dict": lambda: isinstance(v, dict),
        "bool": lambda: isinstance(v, bool),
        "number": lambda: number or isinstance(v, list | dict),
        "expr": lambda: number or isinstance(v, str | dict),
        "date": lambda: isinstance(v, str) and DATE.fullmatch(v) is not None,
        "doi": lambda: isinstance(v, str) and re.fullmatch(r"10\.\d{4,9}/\S+", v) is not None,
        "url": lambda: isinstance(v, str) and re.fullmatch(r"(https?|ftp)://[^\s/]+\S*", v) is not None,
        "records": lambda: v == "auto" or isinstance(v, int) and not isinstance(v, bool) and v > 0,
    }[kind]()


def fields(kind: str, x, at: str) -> Iterator[str]:
    """Fields that are missing, of another type, or not of this kind."""
    closed, spec = FIELDS[kind]
    if not isinstance(x, dict):
        yield f"[schema] {at}: a {kind} is an object"
        return
    own = {}
    for f in spec.split():
        name, _, what = f.partition(":")
        own[name] = what.rstrip("!")
        if what.endswith("!") and name not in x:
            yield f"[schema] {at}: a {kind} needs {name}"
    for name, v in x.items():
        if name in own and not (v is None and own[name] != "str") and not _is(own[name], v):
            yield f"[schema] {at}.{name}: {str(v)[:60]!r} is no {own[name]}"
        elif closed and name not in own and not name.startswith("_"):
            yield f"[schema] {at}: a {kind} has no field {name}"


def chosen(kind: str, v, at: str) -> Iterator[str]:
    if v not in CHOICES[kind]:
        yield f"[schema] {at}: {v!r} is no {kind}"


def listed(x) -> list[tuple[str, object]]:
    return list(x.items()) if isinstance(x, dict) else [(str(i), v) for i, v in enumerate(x)] if isinstance(x, list) else []


def parts(e) -> Iterator[tuple[str, object]]:
    """The expressions inside a node."""
    for k in INSIDE:
        v = e.get(k)
        if isinstance(v, list):
            yield from ((k, a) for a in v)
        elif k in ("axes", "bindings") and isinstance(v, dict):
            yield from ((k, a) for a in v.values())
        elif v is not None:
            yield k, v


def nodes(x) -> Iterator[dict]:
    """Every expression node in any part of a document."""
    if isinstance(x, dict):
        if isinstance(x.get("op"), str):
            yield x
        for v in x.values():
            yield from nodes(v)
    elif isinstance(x, list):
        for v in x:
            yield from nodes(v)


def names(e, bound: frozenset = frozenset()) -> Iterator[str]:
    """Names that an expression reads and does not bind."""
    if isinstance(e, str):
        if e not in bound:
            yield e
        return
    if not is_node(e) or e["op"] in ("const", "enum"):
        return
    ranges = e.get("ranges") if isinstance(e.get("ranges"), dict) else {}
    inner = bound | set(ranges) | set(e.get("output_idx") or []) | ({e["var"]} if isinstance(e.get("var"), str) else set()) | ({e["arg"]} if isinstance(e.get("arg"), str) else set())
    for k, a in parts(e):
        # Sets and symbols of an index set are named, not read, in these.
        if e["op"] in ("rank",) or e["op"] == "makearray" and k == "values" and isinstance(a, str) and a.startswith("_"):
            continue
        yield from names(a, inner)


# --- parts of a document ---


def check_node(e: dict, at: str) -> Iterator[str]:
    """A node by itself: closed sets of names, shapes of joins, operands."""
    name, args = e["op"], e.get("args")
    if e.get("semiring") is not None and e["semiring"] not in SEMIRINGS:
        yield f"[unknown_semiring] {at}: {e['semiring']}"
    if "join" in e:
        if not isinstance(e["join"], list):
            yield f"[join_clause] {at}: join is a list of clauses"
        else:
            for c in e["join"]:
                on = c.get("on") if isinstance(c, dict) else None
                if not isinstance(c, dict) or ("on" in c) == ("overlap" in c):
                    yield f"[join_clause] {at}: a clause has on or overlap"
                elif "on" in c and (not isinstance(on, list) or not on or any(not isinstance(p, list) or len(p) != 2 or not all(isinstance(k, str) for k in p) for p in on)):
                    yield f"[join_clause] {at}: on is a list of pairs of names"
    if name in ("intersect_polygon", "polygon_intersection_area"):
        if not isinstance(args, list) or len(args) != 2:
            yield f"[arity] {at}: {name} takes two rings"
        yield from chosen("manifold", e.get("manifold"), at)
    if name == "broadcast" and ALIASES.get(e.get("fn"), e.get("fn")) not in OPS:
        yield f"[broadcast_fn] {at}: {e.get('fn')} is no scalar operator"
    if name == "D" and e.get("wrt", "t") == "t" and isinstance(args, list) and len(args) != 1:
        yield f"[arity] {at}: a time derivative has one operand"
    if name == "makearray":
        for r in e.get("regions") or []:
            if any(isinstance(b, list) and len(b) == 2 and all(isinstance(v, int) for v in b) and b[1] < b[0] - 1 for b in r if isinstance(r, list)):
                yield f"[makearray_region] {at}: {r} ends before it begins"


def check_update(name: str, v: dict, sources: Mapping, at: str) -> Iterator[str]:
    """How a parameter changes: one rule, or several in order."""
    rules = v["update"]
    if v.get("type") == "unknown":
        yield f"[update] {at}: only parameters are updated"
    if isinstance(rules, list) and (len(rules) < 2 or any(isinstance(u, dict) and u.get("kind") == "wiener" for u in rules)):
        yield f"[update] {at}: a list holds two rules or more, none of noise"
    for u in rules if isinstance(rules, list) else [rules]:
        if not isinstance(u, dict):
            yield f"[update] {at}: a rule is an object"
            continue
        yield from chosen("update kind", u.get("kind"), at)
        for some in UPDATES.get(u.get("kind"), ()):
            if not any(k in u for k in some):
                yield f"[update] {at}: {u['kind']} needs {' or '.join(some)}"
        if u.get("kind") in ("schedule", "data", "remesh") and not isinstance(v.get("shape"), list):
            yield f"[update] {at}: a {u['kind']} parameter declares its shape"
        if u.get("kind") == "data":
            if u.get("source") not in sources:
                yield f"[undefined_source] {at}: {u.get('source')}"
            if isinstance(u.get("from"), dict) and "file_variable" not in u["from"]:
                yield f"[update] {at}: from names a file_variable"


def scope_of(doc: Mapping) -> dict[str, dict]:
    """Systems by dotted name, with the names that each declares."""
    out: dict[str, dict] = {}

    def walk(path: str, m):
        if not isinstance(m, dict):
            return
        own = {}
        for k in ("variables", "species", "parameters"):
            own |= {n: v for n, v in listed(m.get(k)) if isinstance(v, dict)}
        out[path] = own
        for n, s in listed(m.get("subsystems")):
            walk(f"{path}.{n}", s)

    for k in ("models", "reaction_systems", "data_sources"):
        for n, m in listed(doc.get(k)):
            walk(n, m)
    return out


def opened(doc: Mapping, path: str) -> bool:
    """Whether a system, or one above it, is a reference whose names are not here."""
    first, *rest = path.split(".")
    m = next((doc[k][first] for k in ("models", "reaction_systems", "data_sources") if isinstance(doc.get(k), dict) and first in doc[k]), None)
    for n in rest:
        if isinstance(m, dict) and "ref" in m:
            return True
        m = (m.get("subsystems") or {}).get(n) if isinstance(m, dict) else None
    return isinstance(m, dict) and "ref" in m or isinstance(doc.get("data_sources"), dict) and first in doc["data_sources"]


def unresolved(doc: Mapping, systems: Mapping, name: str) -> str | None:
    """What is wrong with a dotted name: its system, or its variable."""
    path, _, last = name.rpartition(".")
    top = path.split(".")[0]
    if top not in systems:
        return f"[undefined_system] {name}"
    if any(opened(doc, ".".join(path.split(".")[: k + 1])) for k in range(len(path.split(".")))):
        return None
    if path not in systems or last not in systems[path]:
        return f"[unresolved_reference] {name}"
    return None


def check_names(found: Iterator[str], known: set, doc: Mapping, systems: Mapping, at: str) -> Iterator[str]:
    for n in sorted(set(found)):
        if "." in n:
            if (bad := unresolved(doc, systems, n if n.split(".")[0] in systems else f"{at}.{n}")) and n.rpartition(".")[0] not in known:
                yield bad
        elif n not in known and not n.startswith("_"):
            yield f"[undefined_name] {at}: {n}"


def left(e) -> tuple[str | None, bool]:
    """(name, whether it is the rate, an initial value or another mark) of an equation's left side."""
    mark = None
    while is_node(e):
        mark = e["op"] if e["op"] in ("D", "ic") else mark
        inner = e.get("expr") if e["op"] in ("aggregate", "arrayop") else (e.get("args") or [None])[0]
        e = inner
    return (e if isinstance(e, str) else None), mark == "ic"


def check_model(name: str, m: dict, doc: Mapping, systems: Mapping, common: set) -> Iterator[str]:
    yield from fields("model", m, name)
    variables = {k: v for k, v in listed(m.get("variables")) if isinstance(v, dict)}
    sources = doc.get("data_sources") if isinstance(doc.get("data_sources"), dict) else {}
    for k, v in listed(m.get("variables")):
        yield from fields("variable", v, f"{name}.{k}")
        if isinstance(v, dict):
            yield from chosen("variable type", v.get("type"), f"{name}.{k}")
            if "update" in v:
                yield from check_update(k, v, sources, f"{name}.{k}")
    known = common | set(variables) | set(m.get("subsystems") or {}) | {s for v in variables.values() for s in v.get("shape") or [] if isinstance(s, str)}
    equations = [e for e in m.get("equations") or [] if isinstance(e, dict)] if isinstance(m.get("equations"), list) else []
    if isinstance(m.get("equations"), list) and len(equations) < len(m["equations"]):
        yield f"[schema] {name}: an equation is an object"
    own = {}
    for e in equations:
        who, initial = left(e.get("lhs"))
        if who is not None and not initial:
            own.setdefault(who, []).append(e)
    symbols = lambda e: frozenset(s for n in nodes(e) for s in [*(n.get("ranges") or {}), *(n.get("output_idx") or []), *(a for a in (n.get("args") or [])[1:] if n["op"] == "index" and isinstance(a, str))] if isinstance(s, str))
    for e in equations:
        extra = PLACES if left(e.get("lhs"))[1] else set()
        yield from check_names(names(e.get("rhs"), symbols(e.get("lhs"))), known | extra, doc, systems, name)
    coupled = any(isinstance(c, dict) and name in str(c) for c in (doc.get("coupling") or []))
    unknowns = [k for k, v in variables.items() if v.get("type") == "unknown"]
    # What others set, and systems solved as a whole, are not counted; nor are parts that another equation fills.
    if unknowns and not coupled and not m.get("expression_template_imports") and m.get("system_kind") is None and "." not in name:
        yield from (f"[equation_count] {name}: {k} has no equation" for k in unknowns if k not in own)
        many = [k for k in own if k in variables and variables[k].get("type") == "parameter"]
        yield from (f"[equation_count] {name}: {k} is a parameter" for k in many)
        yield from (f"[equation_count] {name}: {len(own[k])} equations for {k}" for k in own if len(own[k]) > 1 and all(not is_node(e["lhs"]) or e["lhs"]["op"] == "D" for e in own[k]))
        yield from (f"[undefined_name] {name}: {k}" for k in own if k not in known and "." not in k and not k.startswith("_"))
    for e in m.get("initialization_equations") or []:
        yield from check_names(names(e.get("rhs")), known, doc, systems, name)
    for k, g in listed(m.get("guesses")):
        yield from check_names(iter([k]), known, doc, systems, name)
        yield from check_names(names(g), known, doc, systems, name)
    for v in variables.values():
        rules = v.get("update")
        for u in rules if isinstance(rules, list) else [rules] if rules else []:
            if isinstance(u, dict):
                yield from check_names((n for k in ("expression", "when") for n in names(u.get(k))), known, doc, systems, name)
                handler = u.get("handler") if isinstance(u.get("handler"), dict) else {}
                yield from check_names(iter([x for k in ("read_vars", "read_params") for x in handler.get(k) or [] if isinstance(x, str)]), known, doc, systems, name)
                if isinstance(u.get("from"), dict):
                    yield from check_names(names(u["from"].get("unit_conversion")), known, doc, systems, name)
    for kind in ("discrete", "continuous"):
        for k, e in listed(m.get(f"{kind}_events")):
            at = f"{name}.{kind}_events.{k}"
            yield from fields(f"{kind} event", e, at)
            if not isinstance(e, dict):
                continue
            if isinstance(e.get("trigger"), dict):
                yield from chosen("trigger type", e["trigger"].get("type"), at)
                yield from check_names(names(e["trigger"].get("expression")), known, doc, systems, name)
            for c in e.get("conditions") or [] if isinstance(e.get("conditions"), list) else []:
                yield from check_names(names(c), known, doc, systems, name)
            for a in [*(e.get("affects") or []), *(e.get("affect_neg") or [])]:
                if isinstance(a, dict):
                    who = a.get("lhs")
                    if who not in variables and not (isinstance(who, str) and ("." in who or who.startswith("_"))):
                        yield f"[event_target] {at}: {who}"
                    elif isinstance(who, str) and who in variables and variables[who].get("type") != "unknown":
                        yield f"[event_target] {at}: {who} is a parameter"
                    yield from check_names(names(a.get("rhs")), known, doc, systems, name)
    for t in m.get("tests") or []:
        for a in (t.get("assertions") or []) if isinstance(t, dict) else []:
            ref = a.get("reference") if isinstance(a, dict) else None
            if is_node(ref) or isinstance(ref, str):
                yield from check_names(names(ref), known | PLACES, doc, systems, name)
    yield from check_shapes(name, variables, equations)
    yield from check_classes(name, variables, equations)
    yield from check_dimensions(name, variables, equations)
    for k, s in listed(m.get("subsystems")):
        if isinstance(s, dict) and "ref" not in s:
            yield from check_model(f"{name}.{k}", s, doc, systems, known)


def bare(e) -> Iterator[str]:
    """Names that stand whole in operators that work element by element."""
    if isinstance(e, str):
        yield e
    elif is_node(e) and ALIASES.get(e["op"], e["op"]) in OPS:
        for a in e.get("args") or []:
            yield from bare(a)


def check_shapes(name: str, variables: Mapping, equations: list[dict]) -> Iterator[str]:
    """Arrays that stand whole in an equation have no axis that its result lacks."""
    for e in equations:
        lhs = e.get("lhs")
        lhs = lhs["args"][0] if is_node(lhs) and lhs["op"] in ("D", "ic") and lhs.get("args") else lhs
        if isinstance(lhs, str) and lhs in variables:
            own = set(map(str, variables[lhs].get("shape") or []))
            for n in sorted(set(bare(e.get("rhs")))):
                if extra := set(map(str, variables.get(n, {}).get("shape") or [])) - own:
                    yield f"[axis_not_in_result] {name}: {n} has {', '.join(sorted(extra))}, {lhs} has not"


def check_classes(name: str, variables: Mapping, equations: list[dict]) -> Iterator[str]:
    """Index sets and minted keys are made before time runs: none reads a state, or what follows from one."""
    reads: dict[str, set] = {}
    seeds, relational = {}, set()
    for e in equations:
        who, initial = left(e.get("lhs"))
        if who is None or initial:
            continue
        reads.setdefault(who, set()).update(n for n in names(e.get("rhs")) if n in variables and n != who)
        if any(n["op"] == "D" for n in nodes(e.get("lhs"))):
            seeds[who] = "continuous"
            reads[who] = set()
        if is_node(e.get("rhs")) and (e["rhs"].get("distinct") or e["rhs"]["op"] == "skolem"):
            relational.add(who)
    try:
        check_relational({k: v for k, v in reads.items()}, seeds, relational)
    except QuernError as err:
        if err.args and "continuous_relational" in str(err):
            yield f"{err} in {name}"


def check_templates(doc: Mapping) -> Iterator[str]:
    """Templates that use each other in a circle or too deep, and parameters of a document's sizes."""
    for where, m in [("document", doc), *((k, m) for f in ("models", "reaction_systems") for k, m in listed(doc.get(f)) if isinstance(m, dict))]:
        templates = {k: t for k, t in listed(m.get("expression_templates")) if isinstance(t, dict)}
        uses = {k: {n.get("name") for n in nodes(t.get("body")) if n["op"] == "apply_expression_template"} & set(templates) for k, t in templates.items()}
        try:
            depth: dict[str, int] = {}
            for k in check_acyclic(uses):
                depth[k] = 1 + max((depth[u] for u in uses[k]), default=0)
                if depth[k] > DEEPEST:
                    yield f"[template_depth] {where}: {k}"
        except QuernError as err:
            yield f"[template_cycle] {where}: {err}"
        for i in m.get("expression_template_imports") or []:
            prefix = i.get("prefix") if isinstance(i, dict) else None
            for p in [prefix] if prefix is not None else []:
                if not isinstance(p, str) or not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", p):
                    yield f"[template_import] {where}: {p!r} is no name"
            renamed = list((i.get("rename") or {}).values()) if isinstance(i, dict) and isinstance(i.get("rename"), dict) else []
            if len(set(map(str, renamed))) < len(renamed):
                yield f"[template_import] {where}: two templates of one name"
    given = doc.get("metaparameters")
    for k, p in listed(given):
        if isinstance(p, dict) and "default" not in p and (doc.get("models") or doc.get("reaction_systems")):
            yield f"[metaparameter_unbound] {k}"
        for n, m in listed(doc.get("models")):
            if isinstance(m, dict) and k in (m.get("variables") or {}):
                yield f"[metaparameter_name] {k} is a variable of {n}"
    values = {k: p["default"] for k, p in listed(given) if isinstance(p, dict) and isinstance(p.get("default"), int)}
    for k, s in listed(doc.get("index_sets")):
        size = s.get("size") if isinstance(s, dict) else None
        for n in nodes(size):
            a = [values.get(x, x) for x in n.get("args") or []]
            if n["op"] == "/" and len(a) == 2 and all(isinstance(x, int) for x in a) and (a[1] == 0 or a[0] % a[1]):
                yield f"[metaparameter_type] index_sets.{k}: {a[0]} / {a[1]} is no whole number"


def check_reactions(name: str, m: dict, doc: Mapping, systems: Mapping, common: set) -> Iterator[str]:
    if not isinstance(m, dict):
        yield f"[schema] {name}: a reaction system is an object"
        return
    species, parameters = dict(listed(m.get("species"))), dict(listed(m.get("parameters")))
    for k, v in species.items():
        yield from fields("species", v, f"{name}.{k}")
    known = common | set(species) | set(parameters)
    sources = doc.get("data_sources") if isinstance(doc.get("data_sources"), dict) else {}
    for k, v in parameters.items():
        if isinstance(v, dict) and "update" in v:
            yield from check_update(k, v, sources, f"{name}.{k}")
    units = {k: v.get("units") for k, v in {**species, **parameters}.items() if isinstance(v, dict)}
    for k, r in listed(m.get("reactions")):
        at = f"{name}.reactions.{k}"
        yield from fields("reaction", r, at)
        if not isinstance(r, dict):
            continue
        sides = [r.get(s) or [] for s in ("substrates", "products")]
        if not any(sides):
            yield f"[null_reaction] {at}"
        for s in (x for side in sides for x in side if isinstance(x, dict)):
            n = s.get("stoichiometry", 1)
            if s.get("species") not in species:
                yield f"[undefined_species] {at}: {s.get('species')}"
            if isinstance(n, bool) or not isinstance(n, int | float) or n <= 0:
                yield f"[stoichiometry] {at}: {n}"
        rate = r.get("rate")
        yield from check_names(names(rate), known, doc, systems, name)
        yield from check_rate(at, sides[0], rate, units)
    for e in m.get("constraint_equations") or []:
        if isinstance(e, dict) and left(e.get("lhs"))[1]:
            yield f"[initial_condition] {name}: initial values are a model's"


def check_rate(at: str, substrates: list, rate, units: Mapping) -> Iterator[str]:
    """A rate constant times its substrates is an amount a second: its own dimensions follow from their order."""
    try:
        if not isinstance(rate, str) or not isinstance(units.get(rate), str):
            return
        of = {unit(units[s["species"]])[1] for s in substrates if units.get(s.get("species"))}
        if len(of) != 1 or not any(next(iter(of))):
            return
        order = sum(s.get("stoichiometry", 1) for s in substrates)
        amount, own = next(iter(of)), unit(units[rate])[1]
        second = unit("s")[1]
        if own != tuple(a * (1 - order) - s for a, s in zip(amount, second, strict=True)) and own != tuple(a - s for a, s in zip(amount, second, strict=True)):
            yield f"[unit_dimensions] {at}: {units[rate]} is no rate of order {order} in {units[substrates[0]['species']]}"
    except (QuernError, TypeError, KeyError):
        return


def check_coupling(doc: Mapping, systems: Mapping) -> Iterator[str]:
    if "coupling" in doc and not isinstance(doc["coupling"], list):
        yield "[schema] coupling is a list"
        return
    for k, c in listed(doc.get("coupling")):
        at = f"coupling.{k}"
        if not isinstance(c, dict) or (c.get("type") not in COUPLINGS and "import" not in c and c.get("type") != "coupling_import"):
            yield f"[schema] {at}: no coupling of type {c.get('type') if isinstance(c, dict) else c}"
            continue
        for need in COUPLINGS.get(c.get("type"), ()):
            if need not in c:
                yield f"[schema] {at}: {c['type']} needs {need}"
        for s in c.get("systems") or []:
            if not isinstance(s, str) or s.split(".")[0] not in systems and not s.startswith("$"):
                yield f"[undefined_system] {at}: {s}"
        if c.get("type") == "variable_map":
            for side in ("from", "to"):
                n = c.get(side)
                if isinstance(n, str) and "." not in n:
                    yield f"[unscoped_reference] {at}: {n}"
                elif isinstance(n, str) and (bad := unresolved(doc, systems, n)):
                    yield f"{bad} in {at}"
            yield from (bad for n in names(c.get("transform") if is_node(c.get("transform")) else None) if "." in n and (bad := unresolved(doc, systems, n)))
            if isinstance(c.get("transform"), str):
                yield from chosen("transform", c["transform"], at)
            yield from check_map_units(at, c, systems)
        for e in (c.get("connector") or {}).get("equations") or [] if isinstance(c.get("connector"), dict) else []:
            for n in [e.get("from"), e.get("to"), *names(e.get("expression"))] if isinstance(e, dict) else []:
                if isinstance(n, str) and "." in n and (bad := unresolved(doc, systems, n)):
                    yield f"{bad} in {at}"
    # Systems that read each other in a circle.
    reads = {s: {n.split(".")[0] for v in [m] for n in _dotted(v) if n.split(".")[0] in systems and n.split(".")[0] != s} for s, m in listed(doc.get("models"))}
    for a in sorted(reads):
        for b in sorted(reads[a]):
            if a < b and a in reads.get(b, ()):
                yield f"[circular_coupling] {a} and {b}"


def _dotted(m) -> Iterator[str]:
    for e in (m.get("equations") or []) if isinstance(m, dict) and isinstance(m.get("equations"), list) else []:
        if isinstance(e, dict):
            yield from (n for n in names(e.get("rhs")) if "." in n)


def check_map_units(at: str, c: Mapping, systems: Mapping) -> Iterator[str]:
    own = []
    for side in ("from", "to"):
        path, _, last = str(c.get(side)).rpartition(".")
        own.append(systems.get(path, {}).get(last, {}).get("units"))
    try:
        if all(isinstance(u, str) and u for u in own):
            (a, d), (b, e) = map(unit, own)
            if d != e and c.get("transform") == "identity":
                yield f"[unit_dimensions] {at}: {own[0]} to {own[1]}"
            elif d != e:
                return
            elif c.get("transform") == "identity" and (a != b or (own[0] in OFFSET) != (own[1] in OFFSET)):
                yield f"[unit_conversion] {at}: {own[0]} to {own[1]} is no identity"
            elif c.get("transform") == "conversion_factor" and isinstance(c.get("factor"), int | float) and abs(c["factor"] - a / b) > 1e-3 * abs(a / b):
                yield f"[unit_conversion] {at}: {c['factor']} is not {a / b:g}"
    except QuernError:
        return


# --- units ---

SAME, FLAT, CIRCLE = {"+", "-", "min", "max", "abs", "neg", "floor", "ceil", "ifelse"}, {"exp", "log", "ln", "log10", "log2", "sinh", "cosh", "tanh", "asin", "acos"}, {"sin", "cos", "tan"}
#: Units whose zero is elsewhere.
OFFSET = {"degC", "°C", "Celsius", "degF", "°F"}
COMPARED = {">", "<", ">=", "<=", "==", "!=", "atan2"}


class Dimensions(Exception):
    pass


def dimensions(e, units: Mapping[str, tuple]):
    """The dimensions of an expression, None where they are not known; numbers go with any in sums and are plain in products."""
    if isinstance(e, str):
        return units.get(e)
    if not is_node(e):
        return None
    name, args = ALIASES.get(e["op"], e["op"]), e.get("args") or []
    plain = (Fraction(0),) * 7
    if name == "index":
        return units.get(args[0]) if args and isinstance(args[0], str) else None
    if name == "aggregate":
        d = dimensions(e.get("expr"), units)
        return d if e.get("semiring", "sum_product") != "bool_and_or" and e.get("reduce") != "*" else None
    d = [dimensions(a, units) for a in args]
    if name in SAME | COMPARED:
        own = [x for x, a in zip(d, args, strict=True) if x is not None] if name != "ifelse" else [x for x in d[1:] if x is not None]
        if any(x != own[0] for x in own):
            raise Dimensions(f"{name} of different dimensions")
        return plain if name in COMPARED else own[0] if own else None
    if name in FLAT | CIRCLE:
        if d and d[0] is not None and any(d[0]):
            raise Dimensions(f"{name} of a quantity with dimensions")
        return plain
    if name in ("*", "/"):
        # A number beyond small wholes, halves and quarters may stand for a quantity.
        d = [plain if isinstance(a, int | float) and abs(4 * a) in range(41) else x for x, a in zip(d, args, strict=True)]
        if any(x is None for x in d):
            return None
        return tuple(sum(x) for x in zip(*d, strict=True)) if name == "*" else tuple(x - y for x, y in zip(d[0], d[1], strict=True)) if len(d) == 2 else None
    if name in ("^", "pow") and len(args) == 2:
        if d[1] is not None and any(d[1]):
            raise Dimensions("an exponent with dimensions")
        return tuple(x * Fraction(args[1]).limit_denominator(1000) for x in d[0]) if d[0] is not None and isinstance(args[1], int | float) else None
    if name == "sqrt":
        return tuple(x / 2 for x in d[0]) if d and d[0] is not None else None
    if name == "D" and e.get("wrt", "t") == "t" and len(args) == 1:
        return tuple(x - y for x, y in zip(d[0], unit("s")[1], strict=True)) if d[0] is not None else None
    return None


def check_dimensions(name: str, variables: Mapping, equations: list[dict]) -> Iterator[str]:
    """Units that cannot be read, and equations whose sides or terms are of different dimensions."""
    units: dict[str, tuple] = {}
    for k, v in variables.items():
        if isinstance(v.get("units"), str):
            try:
                units[k] = tuple(map(Fraction, unit(v["units"])[1]))
            except QuernError as e:
                yield f"{e} in {name}.{k}"
        if isinstance(v.get("default_units"), str) and isinstance(v.get("units"), str) and v["default_units"] != v["units"]:
            yield f"[unit_conversion] {name}.{k}: a default in {v['default_units']} for {v['units']}"
    for e in equations:
        try:
            rate = any(n["op"] == "D" for n in nodes(e.get("lhs")))
            a, b = dimensions(e.get("lhs"), units), dimensions(e.get("rhs"), units)
            if rate and a is not None and b is not None:
                if not any(x for k, x in enumerate(a) if k != 2):
                    continue
                # A time without a unit is usual: rates are held against what else they are made of.
                a, b = (x[:2] + x[3:] for x in (a, b))
            if a is not None and b is not None and a != b:
                yield f"[unit_dimensions] {name}: sides of the equation of {left(e.get('lhs'))[0]}"
        except (Dimensions, TypeError, ValueError, IndexError) as err:
            # In a rate plain functions are often taken of scaled times and the like.
            if isinstance(err, Dimensions) and not (rate and "quantity" in str(err)):
                yield f"[unit_dimensions] {name}: {err}"


# --- all of it ---


def whole(where: str, found: Iterator[str]) -> Iterator[str]:
    """The problems found, as far as a part has the shape that its checks read."""
    try:
        yield from found
    except (TypeError, AttributeError, KeyError, IndexError, ValueError) as e:
        yield f"[schema] {where} has another shape: {e}"


def problems(doc) -> list[str]:
    """Everything that is wrong with a document; an empty list if nothing is."""
    if not isinstance(doc, dict):
        return ["[schema] a document is an object"]
    found: list[str] = []
    if not isinstance(doc.get("esm", doc.get("version")), str):
        found.append("[schema] a document tells its version")
    found += fields("metadata", doc.get("metadata"), "metadata")
    for k, r in listed((doc.get("metadata") or {}).get("references")) if isinstance(doc.get("metadata"), dict) else []:
        found += fields("reference", r, f"metadata.references.{k}")
        found += [f"[schema] metadata.references.{k}.{f}: empty" for f, v in listed(r) if v in ("", None)]
    if not any(doc.get(k) for k in ("models", "reaction_systems", "data_sources", "expression_templates", "coupling_roles")):
        found.append("[schema] a document holds a system, a source, templates or roles")
    for k, s in listed(doc.get("data_sources")):
        at = f"data_sources.{k}"
        found += fields("data_source", s, at)
        if isinstance(s, dict):
            found += chosen("data source kind", s.get("kind"), at)
            found += fields("source", s["source"], f"{at}.source") if "source" in s else []
            found += fields("temporal", s["temporal"], f"{at}.temporal") if "temporal" in s else []
    for k, s in listed(doc.get("index_sets")):
        at = f"index_sets.{k}"
        if not isinstance(s, dict):
            found.append(f"[schema] {at}: an index set is an object")
            continue
        found += chosen("index set kind", s.get("kind"), at)
        found += [f"[schema] {at}: {s['kind']} needs {n}" for n in NEEDS.get(s.get("kind"), ()) if n not in s]
        members = s["members"] if isinstance(s.get("members"), list) else []
        joined = {k for n in nodes(doc.get("models")) if isinstance(n.get("join"), list) for c in n.get("join") or [] if isinstance(c, dict) for p in c.get("on") or [] if isinstance(p, list) for k in p}
        ranged = {y for n in nodes(doc.get("models")) for y, r in (n.get("ranges") or {}).items() if isinstance(r, dict) and r.get("from") == k}
        if joined & (ranged | {k}):
            found += [f"[null_key] {at}: a null among keys"] if None in members else []
            found += [f"[float_key] {at}: {m} among keys" for m in members if isinstance(m, float)]
    systems = scope_of(doc)
    common = {"t"} | {k for f in ("index_sets", "coordinates", "metaparameters", "enums") for k, _ in listed(doc.get(f))}
    for k, m in listed(doc.get("models")):
        if isinstance(m, dict) and "ref" not in m:
            found += whole(k, check_model(k, m, doc, systems, common))
        elif not isinstance(m, dict):
            found.append(f"[schema] {k}: a model is an object")
    for k, m in listed(doc.get("reaction_systems")):
        found += whole(k, check_reactions(k, m, doc, systems, common))
    found += whole("coupling", check_coupling(doc, systems))
    found += whole("templates", check_templates(doc))
    for e in nodes({k: v for k, v in doc.items() if k != "metadata"}):
        found += whole(e["op"], check_node(e, e["op"]))
    return list(dict.fromkeys(found))
