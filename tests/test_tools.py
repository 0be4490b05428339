import json

import pytest

from quern.errors import QuernError
from quern.plans import tools
from quern.plans.expressions import node, parse

DOC = {"index_sets": {"n": {"kind": "interval", "size": 3}}, "models": {"M": {"variables": {"k": {"default": 2.0}}, "equations": [{"lhs": "x", "rhs": parse("k + 1")}, {"lhs": "y", "rhs": parse("x * x + k")}]}}}


def test_references_and_templates():
    files = {"lib": json.dumps(DOC | {"expression_templates": {"sq": {"params": ["a"], "body": node("^", "a", 2)}}}), "loop": json.dumps({"models": {"A": {"ref": "loop"}}})}
    doc = tools.resolve_refs({"models": {"Mine": {"ref": "lib", "rename": {"sq": "square"}}}}, files.__getitem__)
    assert doc["models"]["Mine"]["equations"][0]["lhs"] == "x" and "square" in doc["expression_templates"] and doc["index_sets"]["n"]["size"] == 3
    with pytest.raises(QuernError, match="reference_cycle"):
        tools.resolve_refs({"models": {"B": {"ref": "loop"}}}, files.__getitem__)
    with pytest.raises(QuernError, match="conflicting_declaration"):
        tools.inject({"expression_templates": {"a": 1}}, {"a": 2})


def test_metaparameters_and_roles():
    doc = {"metaparameters": {"N": {"default": 4}}, "index_sets": {"n": {"kind": "interval", "size": "N"}}, "r": [1, "N"]}
    assert tools.metaparameters(doc, {})["index_sets"]["n"]["size"] == 4 and tools.metaparameters(doc, {"N": 9})["r"] == [1, 9]
    with pytest.raises(QuernError, match="metaparameter"):
        tools.metaparameters(doc, {"Q": 1})
    assert tools.coupling_roles([{"type": "variable_map", "from": "$met.T", "to": "$chem.temp"}], {"met": "A", "chem": "B"})[0]["from"] == "A.T"
    with pytest.raises(QuernError, match="unbound_role"):
        tools.coupling_roles([{"from": "$x.T"}], {})


def test_edits():
    e = tools.Editor(DOC, "M").rename("x", "z").add("w", default=1.0).define("w2", "w * 2")
    assert [q["lhs"] for q in e.model["equations"]] == ["z", "y", "w2"] and "z" in str(e.model["equations"][1]["rhs"])
    with pytest.raises(QuernError, match="still_read"):
        e.remove("w")
    assert [q["lhs"] for q in e.remove("y").model["equations"]] == ["z", "w2"]
    with pytest.raises(QuernError, match="duplicate"):
        e.add("w")
    assert set(tools.merge(DOC, {"models": {"N": {}}})["models"]) == {"M", "N"} and set(tools.extract(DOC, "M")["models"]) == {"M"}
    with pytest.raises(QuernError, match="conflicting"):
        tools.merge(DOC, {"models": {"M": {}}})


def test_reports(tmp_path, capsys):
    assert tools.complexity(parse("sin(x * y) + sin(x * y)")) == {"nodes": 5, "depth": 3, "shared": 2}
    assert [len(str(x)) > 0 for x in tools.common_subexpressions([parse("a * b + c"), parse("a * b")])] == [True]
    assert tools.validate(DOC) == [] and tools.validate("{") != []
    bad = {"models": {"M": {"variables": {}, "equations": [{"lhs": "x", "rhs": parse("q")}, {"lhs": "x", "rhs": {"op": "aggregate", "args": [], "output_idx": [], "ranges": {"i": {"from": "zz"}}, "expr": 1}}]}}}
    assert {p.split("]")[0] for p in tools.validate(bad)} == {"[undefined_name", "[duplicate_equation", "[undeclared_index_set"}
    assert tools.migrate({"models": {"M": {"equations": [{"lhs": "x", "rhs": {"op": "arrayop", "args": []}}]}}})["models"]["M"]["equations"][0]["rhs"]["op"] == "aggregate"
    scope: dict = {}
    exec(tools.to_python({"x": parse("-k * x^2")}), scope)  # noqa: S102
    assert scope["rhs"](0, [3.0], k=2.0) == [-18.0]
    (tmp_path / "d.json").write_text(json.dumps(DOC))
    assert tools.main(["validate", str(tmp_path / "d.json")]) == 0 and tools.main(["show", str(tmp_path / "d.json")]) == 0 and tools.main(["complexity", str(tmp_path / "d.json")]) == 0
    assert "M.y = " in capsys.readouterr().out
