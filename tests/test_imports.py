"""Template libraries and subsystems from other documents, read from a dictionary of places."""

import json

import pytest

from quern.errors import QuernError
from quern.plans import tools
from quern.plans.expressions import node
from quern.plans.imports import resolved, with_imports

LIB = {
    "esm": "1.0.0",
    "metadata": {"name": "lib"},
    "metaparameters": {"N": {"type": "integer", "default": 4}},
    "index_sets": {"cells": {"kind": "interval", "size": "N"}},
    "expression_templates": {
        "double": {"params": ["a"], "body": node("*", 2, "a")},
        "shifted": {"params": ["a"], "body": node("+", {"op": "apply_expression_template", "name": "double", "args": [], "bindings": {"a": "a"}}, "offset")},
        "count": {"params": [], "body": "N"},
    },
}
MESH = {"esm": "1.0.0", "metadata": {"name": "mesh"}, "index_sets": {"faces": {"kind": "interval", "size": 3}}, "models": {"Mesh": {"variables": {"a": {"type": "parameter"}}, "equations": []}}}
TWO = {**MESH, "models": {"A": MESH["models"]["Mesh"], "B": MESH["models"]["Mesh"]}}


def importing(**entry):
    return {"esm": "1.0.0", "metadata": {"name": "doc"}, "models": {"M": {"expression_template_imports": [{"ref": "../lib/a.json", **entry}], "variables": {"x": {"type": "parameter"}}, "equations": []}}}


FILES = {
    "lib/a.json": LIB,
    "lib/b.json": {"esm": "1.0.0", "metadata": {"name": "b"}, "expression_templates": {"own": {"params": [], "body": 1}}, "expression_template_imports": [{"ref": "./a.json", "only": ["double"]}]},
    "lib/loop1.json": {"esm": "1.0.0", "expression_templates": {"p": {"params": [], "body": 1}}, "expression_template_imports": [{"ref": "loop2.json"}]},
    "lib/loop2.json": {"esm": "1.0.0", "expression_templates": {"q": {"params": [], "body": 1}}, "expression_template_imports": [{"ref": "loop1.json"}]},
    "lib/mesh.json": MESH,
    "lib/two.json": TWO,
}
read = lambda place: json.dumps(FILES[place])


def test_names_are_chosen_renamed_and_prefixed():
    got = with_imports(importing(only=["shifted"], rename={"shifted": "moved"}, prefix="lib.one"), "docs/d.json", read)
    own = got["models"]["M"]["expression_templates"]
    assert set(own) == {"lib.one.moved", "lib.one.double"}
    assert own["lib.one.moved"]["body"]["args"][0]["name"] == "lib.one.double"
    assert got["index_sets"] == {"cells": {"kind": "interval", "size": 4}} and "expression_template_imports" not in got["models"]["M"]


def test_free_names_and_sizes_are_bound():
    got = with_imports(importing(rebind={"offset": "x"}, metaparameters={"N": 9}), "docs/d.json", read)
    own = got["models"]["M"]["expression_templates"]
    assert own["shifted"]["body"]["args"][1] == "x" and own["count"]["body"] == 9 and got["index_sets"]["cells"]["size"] == 9


def test_libraries_import_libraries():
    doc = importing()
    doc["models"]["M"]["expression_template_imports"][0]["ref"] = "../lib/b.json"
    assert set(with_imports(doc, "docs/d.json", read)["models"]["M"]["expression_templates"]) == {"own", "double"}


@pytest.mark.parametrize(
    ("entry", "code"),
    [
        ({"only": ["triple"]}, "import_unknown_name"),
        ({"rename": {"triple": "t"}}, "import_unknown_name"),
        ({"rebind": {"triple": "t"}}, "import_unknown_name"),
        ({"metaparameters": {"K": 1}}, "import_unknown_name"),
        ({"rename": {"double": "t", "count": "t"}}, "import_conflict"),
        ({"prefix": "9 lives"}, "import_name"),
        ({"ref": "../lib/none.json"}, "reference_not_found"),
        ({"ref": "../lib/mesh.json"}, "not_a_library"),
        ({"ref": "../lib/loop1.json"}, "reference_cycle"),
    ],
)
def test_imports_that_cannot_be(entry, code):
    with pytest.raises(QuernError, match=code):
        with_imports(importing(**entry), "docs/d.json", read)
    assert any(p.startswith(f"[{code}]") for p in tools.validate(importing(**entry), "docs/d.json", read))


def test_conflicts_with_our_own():
    doc = importing()
    doc["models"]["M"]["expression_templates"] = {"double": {"params": [], "body": 0}}
    with pytest.raises(QuernError, match="import_conflict"):
        with_imports(doc, "docs/d.json", read)
    doc = {**importing(), "index_sets": {"cells": {"kind": "interval", "size": 5}}}
    with pytest.raises(QuernError, match="index_set_conflict"):
        with_imports(doc, "docs/d.json", read)


def test_subsystems_by_reference():
    doc = {"esm": "1.0.0", "metadata": {"name": "host"}, "models": {"Host": {"variables": {}, "equations": [], "subsystems": {"m": {"ref": "../lib/mesh.json"}}}}}
    got = resolved(doc, "docs/d.json", read)
    assert got["models"]["Host"]["subsystems"]["m"] == MESH["models"]["Mesh"] and got["index_sets"]["faces"]["size"] == 3
    for ref, code in (("../lib/two.json", "ambiguous_subsystem"), ("../lib/a.json", "subsystem_is_library"), ("../lib/none.json", "reference_not_found")):
        doc["models"]["Host"]["subsystems"]["m"]["ref"] = ref
        with pytest.raises(QuernError, match=code):
            resolved(doc, "docs/d.json", read)
    doc["models"]["Host"]["subsystems"]["m"]["ref"] = "../lib/mesh.json"
    with pytest.raises(QuernError, match="index_set_conflict"):
        resolved({**doc, "index_sets": {"faces": {"kind": "interval", "size": 8}}}, "docs/d.json", read)
