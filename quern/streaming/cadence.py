"""Cadence of a dependency graph: what is constant, what changes at refresh times, what changes always."""

from __future__ import annotations

from collections.abc import Mapping

from ..errors import QuernError

ORDER = ("const", "discrete", "continuous")


def check_acyclic(reads: Mapping[str, set[str]]) -> list[str]:
    """Names in dependency order; a cycle is an error that names it."""
    done: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str, path: tuple[str, ...]):
        if state.get(name) == 1:
            raise QuernError("cycle", " -> ".join((*path[path.index(name) :], name)))
        if state.get(name) == 2:
            return
        state[name] = 1
        for other in sorted(reads.get(name, ())):
            visit(other, (*path, name))
        state[name] = 2
        done.append(name)

    for name in sorted(reads):
        visit(name, ())
    return done


def classify(reads: Mapping[str, set[str]], seeds: Mapping[str, str]) -> dict[str, str]:
    """The class of each name: its seed's, or the highest of what it reads; never declared."""
    out: dict[str, str] = {}
    for name in check_acyclic({**{s: set() for s in seeds}, **reads}):
        below = [out[r] for r in reads.get(name, ())]
        out[name] = max([seeds.get(name, "const"), *below], key=ORDER.index)
    return out


def partition(reads: Mapping[str, set[str]], seeds: Mapping[str, str]) -> dict[str, list[str]]:
    """Schedules by class, each in dependency order."""
    by = classify(reads, seeds)
    order = check_acyclic({**{s: set() for s in seeds}, **reads})
    return {c: [n for n in order if by[n] == c] for c in ORDER}


def frontier(reads: Mapping[str, set[str]], seeds: Mapping[str, str]) -> set[str]:
    """Names of a lower class that something of a higher one reads: where to cache or checkpoint."""
    by = classify(reads, seeds)
    return {r for n, rs in reads.items() for r in rs if ORDER.index(by[r]) < ORDER.index(by[n])}


def check_expected(reads: Mapping[str, set[str]], seeds: Mapping[str, str], expected: Mapping[str, str]) -> None:
    by = classify(reads, seeds)
    for name, want in expected.items():
        if by[name] != want:
            raise QuernError("expect_cadence", f"{name} is {by[name]}, not {want}")


def check_relational(reads: Mapping[str, set[str]], seeds: Mapping[str, str], relational: set[str]) -> None:
    """Index sets and joins are made before time runs: none may read a continuous name."""
    by = classify(reads, seeds)
    for name in sorted(relational):
        if by[name] == "continuous":
            raise QuernError("continuous_relational", name)
