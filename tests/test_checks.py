"""Documents that are refused, each for one reason, and the sound one that they are made from."""

import copy
import json

import pytest

from quern.plans import tools
from quern.plans.checks import problems
from quern.plans.systems import convert_units, unit
from quern.errors import QuernError

SOUND = {
    "esm": "1.0.0",
    "metadata": {"name": "ponds", "description": "two ponds and a river", "created": "2025-03-01", "references": [{"doi": "10.1234/abc.5", "url": "https://example.org/a"}]},
    "index_sets": {"ponds": {"kind": "interval", "size": 2}, "kinds": {"kind": "categorical", "members": ["deep", "flat"]}},
    "data_sources": {"Gauge": {"kind": "points", "source": {"url_template": "gauge-{date}.csv"}, "temporal": {"records_per_file": 24, "start": "2024-01-01T00:00:00Z"}}},
    "models": {
        "Pond": {
            "variables": {
                "h": {"type": "unknown", "units": "m", "default": 1.0},
                "depth": {"type": "unknown", "units": "m"},
                "level": {"type": "unknown", "units": "m", "shape": ["ponds"]},
                "q": {"type": "parameter", "units": "m/s", "default": 0.1, "shape": [], "update": {"kind": "data", "source": "Gauge", "from": {"file_variable": "flow"}}},
                "k": {"type": "parameter", "units": "1/s", "default": 0.5},
            },
            "equations": [
                {"lhs": {"op": "D", "args": ["h"], "wrt": "t"}, "rhs": {"op": "-", "args": ["q", {"op": "*", "args": ["k", "h"]}]}},
                {"lhs": "depth", "rhs": {"op": "+", "args": ["h", "h"]}},
                {"lhs": {"op": "index", "args": ["level", "i"]}, "rhs": {"op": "aggregate", "args": [], "output_idx": ["i"], "ranges": {"i": {"from": "ponds"}}, "expr": {"op": "*", "args": ["i", "h"]}}},
            ],
            "discrete_events": [{"name": "fill", "trigger": {"type": "periodic", "interval": 5.0}, "affects": [{"lhs": "h", "rhs": {"op": "+", "args": ["h", 1]}}]}],
            "continuous_events": [{"conditions": [{"op": "-", "args": ["h", 0.5]}], "affects": [{"lhs": "h", "rhs": 1.0}]}],
        },
        "River": {"variables": {"w": {"type": "parameter", "units": "m", "default": 2.0}, "y": {"type": "unknown", "units": "m"}}, "equations": [{"lhs": "y", "rhs": "w"}]},
    },
    "reaction_systems": {
        "Algae": {
            "species": {"A": {"units": "mol/m^3", "default": 1.0}, "B": {"units": "mol/m^3", "default": 0.0}},
            "parameters": {"r": {"units": "1/s", "default": 0.1}},
            "reactions": [{"id": "r1", "substrates": [{"species": "A", "stoichiometry": 1}], "products": [{"species": "B", "stoichiometry": 2}], "rate": "r"}],
        }
    },
    "coupling": [{"type": "variable_map", "from": "Pond.h", "to": "River.w", "transform": "param_to_var"}, {"type": "operator_compose", "systems": ["Pond", "River"]}],
}
POND, ALGAE = ("models", "Pond"), ("reaction_systems", "Algae")
NODE = (*POND, "equations", 2, "rhs")
CASES = [
    ("schema", ("esm",), None),
    ("schema", ("metadata", "name"), None),
    ("schema", ("metadata", "colour"), "blue"),
    ("schema", ("metadata", "created"), "March"),
    ("schema", ("metadata", "references", 0, "doi"), "abc"),
    ("schema", ("metadata", "references", 0, "url"), "example"),
    ("schema", ("index_sets", "kinds", "members"), None),
    ("schema", ("index_sets", "ponds", "kind"), "endless"),
    ("schema", ("data_sources", "Gauge", "kind"), "rumour"),
    ("schema", ("data_sources", "Gauge", "source"), "file.csv"),
    ("schema", ("data_sources", "Gauge", "variables"), {}),
    ("schema", ("data_sources", "Gauge", "temporal", "records_per_file"), -1),
    ("schema", (*POND, "equations"), "h = 1"),
    ("schema", (*POND, "variables", "h", "type"), "state"),
    ("schema", (*POND, "variables", "h", "units"), 4),
    ("schema", (*POND, "discrete_events", 0, "trigger"), "t > 5"),
    ("schema", (*POND, "discrete_events", 0, "trigger", "type"), "whim"),
    ("schema", ("coupling", 0, "type"), "marriage"),
    ("schema", ("coupling", 0, "transform"), "direct"),
    ("undefined_name", (*POND, "equations", 1, "rhs", "args", 0), "ghost"),
    ("undefined_name", (*NODE, "key"), {"op": "skolem", "args": ["ghost"]}),
    ("undefined_name", (*NODE, "filter"), {"op": ">", "args": ["ghost", 1]}),
    ("undefined_name", (*POND, "continuous_events", 0, "conditions", 0, "args", 0), "ghost"),
    ("undefined_name", (*POND, "discrete_events", 0, "affects", 0, "rhs", "args", 0), "ghost"),
    ("undefined_name", (*POND, "guesses"), {"h": "ghost"}),
    ("undefined_name", (*POND, "initialization_equations"), [{"lhs": "h", "rhs": "ghost"}]),
    ("undefined_name", (*POND, "tests"), [{"assertions": [{"variable": "h", "reference": {"op": "sin", "args": ["ghost"]}}]}]),
    ("undefined_name", (*POND, "variables", "q", "update", "from", "unit_conversion"), {"op": "*", "args": ["ghost", 2]}),
    ("event_target", (*POND, "discrete_events", 0, "affects", 0, "lhs"), "k"),
    ("event_target", (*POND, "continuous_events", 0, "affects", 0, "lhs"), "ghost"),
    ("update", (*POND, "variables", "h", "update"), {"kind": "schedule", "interval": 1.0}),
    ("update", (*POND, "variables", "q", "shape"), None),
    ("update", (*POND, "variables", "q", "update", "from"), {"codes": {}}),
    ("update", (*POND, "variables", "q", "update"), [{"kind": "schedule", "times": [1.0]}]),
    ("undefined_source", (*POND, "variables", "q", "update", "source"), "Satellite"),
    ("unknown_semiring", (*NODE, "semiring"), "max_max"),
    ("join_clause", (*NODE, "join"), {"on": [["i", "i"]]}),
    ("join_clause", (*NODE, "join"), [{"on": []}]),
    ("join_clause", (*NODE, "join"), [{"on": [["i"]]}]),
    ("join_clause", (*NODE, "join"), [{"on": [["i", 2]]}]),
    ("arity", (*NODE, "expr"), {"op": "intersect_polygon", "manifold": "planar", "args": ["h", "h", "h"]}),
    ("schema", (*NODE, "expr"), {"op": "polygon_intersection_area", "args": ["h", "h"]}),
    ("arity", (*POND, "equations", 0, "lhs", "args"), ["h", "k"]),
    ("broadcast_fn", (*POND, "equations", 1, "rhs"), {"op": "broadcast", "fn": "shout", "args": ["h"]}),
    ("axis_not_in_result", (*POND, "equations", 1, "rhs"), "level"),
    ("continuous_relational", (*NODE, "distinct"), True),
    ("unit", (*POND, "variables", "k", "units"), "1/blink"),
    ("unit_dimensions", (*POND, "variables", "depth", "units"), "kg"),
    ("unit_dimensions", (*POND, "equations", 1, "rhs", "args", 1), "k"),
    ("unit_dimensions", (*POND, "equations", 1, "rhs"), {"op": "*", "args": ["h", {"op": "exp", "args": ["h"]}]}),
    ("unit_dimensions", (*POND, "equations", 0, "rhs"), {"op": "*", "args": ["k", "k"]}),
    ("unit_dimensions", (*ALGAE, "parameters", "r", "units"), "kg"),
    ("null_reaction", (*ALGAE, "reactions", 0), {"id": "x", "substrates": None, "products": None, "rate": "r"}),
    ("stoichiometry", (*ALGAE, "reactions", 0, "products", 0, "stoichiometry"), 0),
    ("undefined_species", (*ALGAE, "reactions", 0, "products", 0, "species"), "Z"),
    ("undefined_name", (*ALGAE, "reactions", 0, "rate"), {"op": "*", "args": ["r", "ghost"]}),
    ("initial_condition", (*ALGAE, "constraint_equations"), [{"lhs": {"op": "ic", "args": ["A"]}, "rhs": 1}]),
    ("undefined_system", ("coupling", 0, "from"), "Lake.h"),
    ("unresolved_reference", ("coupling", 0, "from"), "Pond.ghost"),
    ("unscoped_reference", ("coupling", 0, "to"), "w"),
    ("undefined_system", ("coupling", 1, "systems"), ["Pond", "Lake"]),
    ("template_cycle", (*POND, "expression_templates"), {"a": {"params": [], "body": {"op": "apply_expression_template", "name": "b", "args": []}}, "b": {"params": [], "body": {"op": "apply_expression_template", "name": "a", "args": []}}}),
    ("template_import", (*POND, "expression_template_imports"), [{"ref": "x", "prefix": "9 lives"}]),
    ("metaparameter_unbound", ("metaparameters",), {"N": {"type": "integer"}}),
    ("metaparameter_name", ("metaparameters",), {"h": {"type": "integer", "default": 3}}),
    ("metaparameter_type", ("index_sets", "ponds", "size"), {"op": "/", "args": [5, 2]}),
]


def changed(path, value):
    doc = copy.deepcopy(SOUND)
    x = doc
    for p in path[:-1]:
        x = x[p]
    if value is None and not (isinstance(x, dict) and path[-1] not in x):
        del x[path[-1]]
    else:
        x[path[-1]] = value
    return doc


def test_the_sound_document_has_no_problem():
    assert problems(SOUND) == [] == tools.validate(json.dumps(SOUND))


@pytest.mark.parametrize(("code", "path", "value"), CASES)
def test_a_change_is_refused_with_its_code(code, path, value):
    found = tools.validate(changed(path, value))
    assert any(p.startswith(f"[{code}]") for p in found), found


def test_models_that_lack_equations_or_read_each_other():
    doc = changed(("coupling",), None)
    assert problems(doc) == []
    del doc["models"]["Pond"]["equations"][1]
    assert [p for p in problems(doc) if p.startswith("[equation_count]")]
    doc = changed(("models", "River", "equations", 0, "rhs"), "Pond.h")
    doc["models"]["Pond"]["equations"][1]["rhs"] = "River.y"
    assert [p for p in problems(doc) if p.startswith("[circular_coupling]")]


def test_keys_that_are_joined_are_neither_null_nor_floats():
    for bad, code in (([None, "deep"], "null_key"), ([1.5, 2.0], "float_key")):
        doc = changed(("index_sets", "kinds", "members"), bad)
        rhs = doc["models"]["Pond"]["equations"][2]["rhs"]
        assert problems(doc) == []
        rhs |= {"ranges": rhs["ranges"] | {"j": {"from": "kinds"}}, "join": [{"on": [["i", "j"]]}]}
        assert [p for p in problems(doc) if p.startswith(f"[{code}]")]


@pytest.mark.parametrize("junk", ["{", "[]", "3", "null", json.dumps({"esm": 1, "metadata": 3, "models": [1, {"variables": 2}], "coupling": "x", "reaction_systems": {"a": 3}})])
def test_nothing_crashes(junk):
    assert tools.validate(junk)


def test_units():
    close = lambda a, b: abs(a - b) < 1e-12 * abs(b)
    assert unit("J/mol*K")[1] == (2, 1, -2, 1, -1, 0, 0) and unit("J/(mol*K)")[1] == (2, 1, -2, -1, -1, 0, 0)
    assert unit("1/s^0.5")[1][2] * 2 == -1 and unit("m2 s-1")[1] == unit("m^2/s")[1] == unit("m²/s")[1]
    assert unit("molec/cm^3")[1] == unit("1/m^3")[1] and unit("C")[1] == unit("A*s")[1] and unit("")[1] == unit("dimensionless")[1]
    assert close(convert_units("kWh", "J"), 3.6e6) and close(convert_units("μg/m³", "kg/m^3"), 1e-9)
    for bad in ("2*m", "m^", "(m", "m)", "kdimensionless", "furlong"):
        with pytest.raises(QuernError):
            unit(bad)
