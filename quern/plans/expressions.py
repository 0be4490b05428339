"""Expression trees: numbers, names, and {"op", "args", ...}; to Columns, to numpy, and rewritten."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuernError
from ..functions import closed
from ..functions.scalar import ALIASES, OPS, op, truth

Expr = Any
LOGICAL = {"and", "or", "not"}


def is_node(e: Expr) -> bool:
    return isinstance(e, dict) and "op" in e


def node(name: str, *args: Expr, **more) -> dict:
    return {"op": name, "args": list(args), **more}


def free_variables(e: Expr) -> set[str]:
    if isinstance(e, str):
        return {e}
    if not is_node(e):
        return set()
    own = set().union(*map(free_variables, e.get("args", [])), free_variables(e.get("expr")), free_variables(e.get("filter")))
    return own - set(e.get("ranges", {}))


def substitute(e: Expr, by: Mapping[str, Expr]) -> Expr:
    """Names replaced; names that an aggregate binds are left alone inside it."""
    if isinstance(e, str):
        return by.get(e, e)
    if not is_node(e):
        return e
    inner = {k: v for k, v in by.items() if k not in e.get("ranges", {})}
    out = {**e, "args": [substitute(a, inner) for a in e.get("args", [])]}
    for k in ("expr", "filter", "key"):
        if k in e:
            out[k] = substitute(e[k], inner)
    if "bindings" in e:
        out["bindings"] = {k: substitute(v, inner) for k, v in e["bindings"].items()}
    return out


def column(e: Expr, names: Mapping[str, Column]) -> Column:
    """A scalar expression as a Column; names give Columns of the row."""
    if isinstance(e, bool | int | float):
        return F.lit(e)
    if isinstance(e, str):
        if e not in names:
            raise QuernError("undefined_name", e)
        return names[e]
    name, args = ALIASES.get(e["op"], e["op"]), e.get("args", [])
    if name == "const":
        return F.lit(e["value"]) if not isinstance(e["value"], list) else F.array(*[F.lit(float(v)) for v in e["value"]])
    if name == "fn":
        return closed.call(e["name"], *[a["value"] if is_node(a) and a["op"] == "const" and isinstance(a["value"], list) else column(a, names) for a in args])
    if name not in OPS:
        raise QuernError("unlowered_operator", name)
    cols = [column(a, names) for a in args]
    boolean = [is_node(a) and ALIASES.get(a["op"], a["op"]) in OPS and OPS[ALIASES.get(a["op"], a["op"])].boolean or isinstance(a, bool) for a in args]
    if name in LOGICAL:
        cols = [c if b else truth(c) for c, b in zip(cols, boolean, strict=True)]
    elif name == "ifelse" and not boolean[0]:
        cols[0] = truth(cols[0])
    elif not (name == "ifelse"):
        cols = [c.cast("double") if b else c for c, b in zip(cols, boolean, strict=True)]
    return op(name, *cols)


_NUMPY: dict[str, Callable] = {
    "+": lambda *x: reduce(lambda a, b: a + b, x), "*": lambda *x: reduce(lambda a, b: a * b, x), "neg": lambda x: -x, "^": lambda a, b: np.power(np.asarray(a, float), b),
    "-": lambda *x: -x[0] if len(x) == 1 else reduce(lambda a, b: a - b, x), "/": lambda a, b: np.divide(np.asarray(a, float), b),
    "min": lambda *x: reduce(np.minimum, x), "max": lambda *x: reduce(np.maximum, x), "ifelse": lambda c, a, b: np.where(np.asarray(c) != 0, a, b),
    "sign": np.sign, "and": lambda *x: reduce(np.logical_and, x) * 1.0, "or": lambda *x: reduce(np.logical_or, x) * 1.0, "not": lambda x: np.logical_not(x) * 1.0,
    ">": lambda a, b: (a > b) * 1.0, "<": lambda a, b: (a < b) * 1.0, ">=": lambda a, b: (a >= b) * 1.0, "<=": lambda a, b: (a <= b) * 1.0, "==": lambda a, b: (a == b) * 1.0, "!=": lambda a, b: (a != b) * 1.0,
    "pi": lambda: math.pi, "e": lambda: math.e, "true": lambda: 1.0, "false": lambda: 0.0, "Pre": lambda x: x, "asin": np.arcsin, "acos": np.arccos, "atan": lambda x, *y: np.arctan2(x, y[0]) if y else np.arctan(x), "atan2": np.arctan2,
    "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh,
} | {n: getattr(np, n) for n in "exp log log10 sqrt abs sin cos tan sinh cosh tanh floor ceil".split()}


def numeric(e: Expr, names: Mapping[str, Any]):
    """The value of a scalar expression for numbers or arrays; IEEE results without warnings."""
    if isinstance(e, bool | int | float):
        return float(e)
    if isinstance(e, str):
        if e not in names:
            raise QuernError("undefined_name", e)
        return names[e]
    name = ALIASES.get(e["op"], e["op"])
    if name == "const":
        return np.asarray(e["value"], float)
    if name not in _NUMPY:
        raise QuernError("unlowered_operator", name)
    with np.errstate(all="ignore"):
        return _NUMPY[name](*[numeric(a, names) for a in e.get("args", [])])


def _rank(e: Expr):
    """Operands in order: numbers, names, then nodes by their canonical text."""
    return (0, e, "") if isinstance(e, int | float) else (1, 0, e) if isinstance(e, str) else (2, 0, to_text(e))


def canonical(e: Expr) -> Expr:
    """Sums and products flattened, identities gone, operands in order, unary minus as neg. The same value, so usable as a key of plans."""
    if not is_node(e):
        return e
    name, args = ALIASES.get(e["op"], e["op"]), [canonical(a) for a in e.get("args", [])]
    if name in ("+", "*"):
        flat = [x for a in args for x in (a["args"] if is_node(a) and a["op"] == name else [a])]
        one = 0 if name == "+" else 1
        flat = [a for a in flat if not (isinstance(a, int | float) and not isinstance(a, bool) and a == one)]
        if not flat:
            return one
        return flat[0] if len(flat) == 1 else {**e, "op": name, "args": sorted(flat, key=_rank)}
    if name == "-" and len(args) == 1:
        return -args[0] if isinstance(args[0], int | float) else {**e, "op": "neg", "args": args}
    return {**e, "op": name, "args": args}


def simplify(e: Expr) -> Expr:
    """Constants folded and identities removed: x + 0, x * 1, x * 0, x ^ 1, x ^ 0, x - 0, x / 1, neg neg x."""
    if not is_node(e):
        return e
    e = canonical({**e, "args": [simplify(a) for a in e.get("args", [])]})
    if not is_node(e):
        return e
    name, args = e["op"], e["args"]
    number = [isinstance(a, int | float) for a in args]
    if name in _NUMPY and args and all(number):
        return float(numeric(e, {}))
    if name in ("+", "*") and sum(number) > 1:
        total = float(numeric(node(name, *[a for a, n in zip(args, number, strict=True) if n]), {}))
        return simplify(node(name, total, *[a for a, n in zip(args, number, strict=True) if not n]))
    if name == "*" and 0 in [a for a, n in zip(args, number, strict=True) if n]:
        return 0.0
    if name == "^" and number[1]:
        return 1.0 if args[1] == 0 else args[0] if args[1] == 1 else e
    if name in ("-", "/") and len(args) == 2 and number[1] and args[1] == (0 if name == "-" else 1):
        return args[0]
    if name == "neg" and is_node(args[0]) and args[0]["op"] == "neg":
        return args[0]["args"][0]
    return e


def derivative(e: Expr, x: str) -> Expr:
    """d e / d x, simplified."""
    return simplify(_derivative(e, x))


def _derivative(e: Expr, x: str) -> Expr:
    if isinstance(e, int | float):
        return 0.0
    if isinstance(e, str):
        return 1.0 if e == x else 0.0
    name, args = ALIASES.get(e["op"], e["op"]), e["args"]
    d = [_derivative(a, x) for a in args]
    a = args[0] if args else None
    if name in ("+", "-", "neg"):
        return {**e, "args": d}
    if name == "*":
        return node("+", *[node("*", *args[:i], di, *args[i + 1 :]) for i, di in enumerate(d)])
    if name == "/":
        return node("/", node("-", node("*", d[0], args[1]), node("*", a, d[1])), node("^", args[1], 2.0))
    if name == "^":
        if x not in free_variables(args[1]):
            return node("*", args[1], node("^", a, node("-", args[1], 1.0)), d[0])
        return node("*", e, node("+", node("*", d[1], node("log", a)), node("/", node("*", args[1], d[0]), a)))
    if name == "ifelse":
        return node("ifelse", a, d[1], d[2])
    outer = {
        "exp": lambda: e, "log": lambda: node("/", 1.0, a), "log10": lambda: node("/", 1.0, node("*", a, math.log(10))), "sqrt": lambda: node("/", 0.5, e), "abs": lambda: node("sign", a), "sign": lambda: 0.0,
        "sin": lambda: node("cos", a), "cos": lambda: node("neg", node("sin", a)), "tan": lambda: node("/", 1.0, node("^", node("cos", a), 2.0)), "sinh": lambda: node("cosh", a), "cosh": lambda: node("sinh", a),
        "tanh": lambda: node("-", 1.0, node("^", e, 2.0)), "asin": lambda: node("/", 1.0, node("sqrt", node("-", 1.0, node("^", a, 2.0)))), "acos": lambda: node("/", -1.0, node("sqrt", node("-", 1.0, node("^", a, 2.0)))),
        "atan": lambda: node("/", 1.0, node("+", 1.0, node("^", a, 2.0))), "asinh": lambda: node("/", 1.0, node("sqrt", node("+", node("^", a, 2.0), 1.0))), "floor": lambda: 0.0, "ceil": lambda: 0.0,
    }
    if name not in outer:
        raise QuernError("not_differentiable", name)
    return node("*", outer[name](), d[0])


def jacobian(rhs: Mapping[str, Expr]) -> dict[tuple[str, str], Expr]:
    return {(a, b): derivative(e, b) for a, e in rhs.items() for b in rhs}


_INFIX = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "^"}
_RELATION = {ast.Gt: ">", ast.Lt: "<", ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}


def parse(text: str) -> Expr:
    """Text such as "a * x^2 + max(b, 1) > 0 and not c"; u[i, j] is index(u, i, j)."""
    try:
        tree = ast.parse(text.replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise QuernError("parse", f"{text}: {e.msg}") from None
    return _from_ast(tree)


def _from_ast(t: ast.AST) -> Expr:
    if isinstance(t, ast.Constant) and isinstance(t.value, bool | int | float):
        return t.value
    if isinstance(t, ast.Name):
        return t.id
    if isinstance(t, ast.BinOp) and type(t.op) in _INFIX:
        return node(_INFIX[type(t.op)], _from_ast(t.left), _from_ast(t.right))
    if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.USub):
        inner = _from_ast(t.operand)
        return -inner if isinstance(inner, int | float) else node("neg", inner)
    if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.Not):
        return node("not", _from_ast(t.operand))
    if isinstance(t, ast.BoolOp):
        return node("and" if isinstance(t.op, ast.And) else "or", *map(_from_ast, t.values))
    if isinstance(t, ast.Compare) and len(t.ops) == 1 and type(t.ops[0]) in _RELATION:
        return node(_RELATION[type(t.ops[0])], _from_ast(t.left), _from_ast(t.comparators[0]))
    if isinstance(t, ast.Call) and isinstance(t.func, ast.Name):
        return node(t.func.id, *map(_from_ast, t.args))
    if isinstance(t, ast.Subscript):
        at = t.slice.elts if isinstance(t.slice, ast.Tuple) else [t.slice]
        return node("index", _from_ast(t.value), *map(_from_ast, at))
    raise QuernError("parse", ast.unparse(t))


_WEIGHT = {"or": 1, "and": 2, "not": 3, ">": 4, "<": 4, ">=": 4, "<=": 4, "==": 4, "!=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "neg": 7, "^": 8}


def to_text(e: Expr, around: int = 0) -> str:
    """Text that parse() reads back."""
    if isinstance(e, bool) or not is_node(e):
        return repr(e) if isinstance(e, float | int) else str(e)
    name, args = e["op"], e.get("args", [])
    w = _WEIGHT.get(name, 9)
    if name == "index":
        return f"{to_text(args[0], 9)}[{', '.join(map(to_text, args[1:]))}]"
    if name in ("neg", "not"):
        text = ("-" if name == "neg" else "not ") + to_text(args[0], w)
    elif name in _WEIGHT and len(args) > 1:
        text = f" {name} ".join(to_text(a, w + (i > 0) if name != "^" else w + 1) for i, a in enumerate(args))
    else:
        return f"{name}({', '.join(map(to_text, args))})"
    return f"({text})" if w < around else text


_LATEX = {"*": r" \cdot ", ">=": r" \ge ", "<=": r" \le ", "!=": r" \ne ", "and": r" \land ", "or": r" \lor "}


def to_latex(e: Expr) -> str:
    if not is_node(e):
        return str(e)
    name, args = e["op"], [to_latex(a) for a in e.get("args", [])]
    if name == "/":
        return rf"\frac{{{args[0]}}}{{{args[1]}}}"
    if name == "^":
        return f"{{{args[0]}}}^{{{args[1]}}}"
    if name == "sqrt":
        return rf"\sqrt{{{args[0]}}}"
    if name == "neg":
        return f"-{args[0]}"
    if name in _WEIGHT and len(args) > 1:
        return r"\left(" + _LATEX.get(name, f" {name} ").join(args) + r"\right)"
    return rf"\operatorname{{{name}}}\left({', '.join(args)}\right)"


def match(pattern: Expr, e: Expr, found: dict[str, Expr] | None = None) -> dict[str, Expr] | None:
    """Bindings of a pattern's holes ("?x") that make it equal to e."""
    found = {} if found is None else found
    if isinstance(pattern, str) and pattern.startswith("?"):
        if pattern in found:
            return found if found[pattern] == e else None
        return {**found, pattern: e}
    if is_node(pattern) and is_node(e):
        if pattern["op"] != e["op"] or len(pattern.get("args", [])) != len(e.get("args", [])):
            return None
        for p, a in zip(pattern.get("args", []), e.get("args", []), strict=True):
            if (found := match(p, a, found)) is None:
                return None
        return found
    return found if pattern == e and type(pattern) is type(e) or isinstance(pattern, int | float) and pattern == e else None


def shape_of(e: Expr, shapes: Mapping[str, list[str]]) -> list[str] | None:
    """The axes of an expression that works element by element: those of the names in it, each once, in the order met; None where a name's are not told."""
    if isinstance(e, str):
        return list(shapes[e]) if e in shapes else None
    if not is_node(e):
        return []
    if e["op"] in ("index", "aggregate", "makearray", "reshape", "transpose", "concat"):
        return list(e.get("output_idx") or []) if e["op"] == "aggregate" else [] if e["op"] == "index" else None
    out: list[str] = []
    for a in e.get("args", []):
        own = shape_of(a, shapes)
        if own is None:
            return None
        out += [x for x in own if x not in out]
    return out


def admitted(found: Mapping[str, Expr], where: Mapping[str, Mapping], shapes: Mapping[str, list[str]]) -> bool:
    """Whether a match's bindings have the shapes that a rule asks for."""
    return all(shape_of(found.get(h if h.startswith("?") else f"?{h}"), shapes) == list(c["shape"]) for h, c in where.items() if "shape" in c)


def rewrite(e: Expr, rules: list[tuple], most: int = 64, shapes: Mapping[str, list[str]] | None = None) -> Expr:
    """Rules (pattern, result, priority, and where: {hole: {"shape": axes}}) applied from the outside in until none matches; over `most` passes is an error.

    A rule with `where` takes only what has these axes, by the shapes of names.
    """
    rules = sorted(((*r, {}) if len(r) == 3 else r for r in rules), key=lambda r: -r[2])

    def once(x: Expr) -> tuple[Expr, bool]:
        for pattern, result, _, where in rules:
            if (found := match(pattern, x)) is not None and admitted(found, where, shapes or {}):
                return substitute(result, found), True
        if not is_node(x):
            return x, False
        parts = [once(a) for a in x.get("args", [])]
        return ({**x, "args": [p for p, _ in parts]}, True) if any(c for _, c in parts) else (x, False)

    for _ in range(most):
        e, changed = once(e)
        if not changed:
            return e
    raise QuernError("rewrite_rule_nonterminating", f"after {most} passes")


def expand_templates(e: Expr, templates: Mapping[str, dict], depth: int = 64) -> Expr:
    """apply_expression_template nodes replaced by their templates' bodies with the bindings put in."""
    if not is_node(e):
        return e
    if e["op"] == "apply_expression_template":
        if depth == 0:
            raise QuernError("template_recursion", e["name"])
        if e["name"] not in templates:
            raise QuernError("unknown_template", e["name"])
        t, given = templates[e["name"]], e.get("bindings", {})
        if missing := set(t.get("params", [])) ^ set(given):
            raise QuernError("template_bindings", f"{sorted(missing)}")
        return expand_templates(substitute(t["body"], {k: expand_templates(v, templates, depth - 1) for k, v in given.items()}), templates, depth - 1)
    out = {**e, "args": [expand_templates(a, templates, depth) for a in e.get("args", [])]}
    for k in ("expr", "filter", "key"):
        if k in e:
            out[k] = expand_templates(e[k], templates, depth)
    return out


def check_arity(e: Expr) -> None:
    if not is_node(e):
        return
    name = ALIASES.get(e["op"], e["op"])
    if name == "call":
        raise QuernError("retired_operator", "call")
    if name in OPS:
        o, n = OPS[name], len(e.get("args", []))
        if n < o.least or o.most is not None and n > o.most:
            raise QuernError("arity", f"{name} with {n} operands")
    for a in [*e.get("args", []), e.get("expr"), e.get("filter")]:
        check_arity(a)
