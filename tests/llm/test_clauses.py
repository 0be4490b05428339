"""The composed grammar against every path through its five layers, and what clauses say."""

import math
import random
from collections import Counter

import pyarrow as pa

from quern.llm import toxicity

LAYERS = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported(), toxicity.targeted()]


def heaviest(symbols):
    """Outputs of the heaviest path, layer by layer and choice by choice."""
    best = (-math.inf, ())

    def step(states, i, weight, out):
        nonlocal best
        if i == len(symbols):
            if all(s in t.final for t, s in zip(LAYERS, states)) and weight > best[0]:
                best = (weight, out)
            return

        def through(k, symbol, now, w):
            if k == len(LAYERS):
                step(now, i + 1, w, (*out, symbol) if len(symbol) > 1 else out)
                return
            for o, more, to in LAYERS[k].arcs[now[k]].get(symbol, ()):
                through(k + 1, o, (*now[:k], to, *now[k + 1 :]), w + more)

        through(0, symbols[i], states, weight)

    step(tuple(t.start for t in LAYERS), 0, 0.0, ())
    return best



def test_the_composed_grammar_equals_all_paths():
    rng, g = random.Random(11), toxicity.clause_grammar()
    for _ in range(500):
        symbols = "".join(rng.choice("ooWWWVVycemnr") for _ in range(rng.randint(0, 8)))
        weight, out = heaviest(symbols)
        assert weight > -math.inf, symbols
        got = g.best(symbols)
        assert Counter(got) == Counter(out) or total(g, symbols, got) == total(g, symbols, list(out)), (symbols, got, out)


def total(g, symbols, wanted):
    """The heaviest weight of the composed grammar's paths that give `wanted`."""
    paths = {(g.start, 0): 0.0}
    for symbol in symbols:
        new: dict = {}
        for (state, n), w in paths.items():
            for o, more, to in g.arcs[state].get(symbol, ()):
                k = n + (len(o) > 1)
                if len(o) == 1 or n < len(wanted) and wanted[n] == o:
                    new[to, k] = max(new.get((to, k), -math.inf), w + more)
        paths = new
    return max((w for (s, n), w in paths.items() if s in g.final and n == len(wanted)), default=-math.inf)


def scored(text):
    model = toxicity.Model({})
    c = next(toxicity.clauses_of(pa.array([text])))[2]
    x = model.features(c, 1)
    return {k: int(v) for k, v in zip(toxicity.LABELS, x[0]) if v}, float(model.score(x)[0])


def test_words_alone_are_neither_insults_nor_threats():
    for text in ("They shoot photographs and beat eggs every morning.", "The garbage collector is dumb luck for everyone.", "He killed the process. They burn wood.", "An old trash can and a clown car"):
        found, score = scored(text)
        assert not any(k[0] in "IT" for k in found) and score < 0.2, (text, found, score)


def test_addresses_intentions_and_commands():
    assert scored("you are such a pathetic clown")[0] == {"I1": 2} and scored("idiots like you")[0] == {"I1": 1}
    assert scored("what a moron")[0] == {"I0": 1} and scored("moron")[0] == {"I0": 1}
    assert scored("we will hurt them")[0] == {"T1": 1} and scored("kill them all")[0] == {"T1": 1}
    assert scored("we never will hurt them")[0] == {"t1": 1} and scored("do not kill them")[0] == {}
    assert scored("she said he will kill you")[0] == {"q1": 1} and scored("he called it trash")[0] == {"Q1": 1}
    assert scored("ich werde dich töten")[0] == {"T1": 1} and scored("tu es un crétin")[0] == {"I1": 1} and scored("eres un idiota")[0] == {"I1": 1}
    for text in ("you are an idiot", "I will hurt you", "kill them"):
        assert scored(text)[1] > 0.7
