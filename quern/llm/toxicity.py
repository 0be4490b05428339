"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import DIGITS, SAMPLE_ROWS, sample, times
from .lm_scoring import crc_is
from .sharded import packed, runs, shard_of, totals, unpacked
from .shared import saved, ship
from .text import LOWER, PIECE, _powers, buffers, mix, pieces

#: Words of each symbol, in English, German, French and Spanish.
LEXICON = {
    "W": "idiot idiots idiotic stupid moron morons moronic loser losers scum trash garbage worthless pathetic disgusting clown clowns dumb imbecile cretin vermin filth filthy bastard bitch asshole "
    "idiotin idioten dummkopf abschaum versager trottel wertlos widerlich arschloch idiote imbécile crétin connard ordure minable répugnant salope idiota imbécil estúpido estúpida basura escoria asqueroso patético",
    "V": "kill murder destroy hurt beat strangle shoot stab burn töten umbringen ermorden verprügeln tuer frapper massacrer matar matarte golpear destruir",
    "y": "you your yours yourself u they them he she him her everyone people you're youre they're theyre he's she's du dich dir euch ihr sie tu toi vous ils elles usted ustedes tú ti ellos ellas eres sois",
    "e": "what such quel quelle espèce qué vaya welch solch",
    "c": "are is am was were be bist ist sind seid war es est êtes sont étais son era",
    "m": "will would gonna going shall must should want wants let's i'll we'll they'll he'll she'll werde werden wirst wird sollte sollen vais vas allons vont veux doit voy vamos quiero debe deben",
    "n": "not no never isn't aren't wasn't don't doesn't nobody nicht kein keine keiner niemals pas jamais aucun aucune nunca jamás ningún ninguna",
    "r": "said says say told claims claimed called calls quoted quote wrote writes reported according alleged sagte sagt behauptet nannte zitiert dit disait affirme appelé cité dijo dice afirma llamó citó",
}
#: Bytes of the prefixes that learned insult stems may have (0: whole words), and different left neighbours that make a stem countable.
PREFIXES, CONTEXTS = (0, 4, 5, 6, 7, 8, 9, 10), 6
#: Of a stem's countable occurrences, the share that may stand in documents that aren't toxic.
STRAY = 0.05
LABELS = [f"{kind}{target}" for kind in "IiQTtqJX" for target in "01"]
#: Weights that training starts from and is drawn to: insult (plain, denied, reported), threat (the same), and by themselves an
#: insulting word and a violent verb; each without and with a target.
PRIOR = np.array([3.5, 6.5, 0.2, 0.5, 0.4, 0.8, 0.5, 6.5, 0.0, 0.3, 0.1, 0.8, 0.6, 1.0, 0.0, 0.2])
PRIOR_BIAS, DRAWN = -3.5, 0.3

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256), 0x27]] = True
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n()\""]] = True


class Transducer(NamedTuple):
    """arcs[state][symbol]: (output, weight, next state) choices; a clause's reading ends in one of `final`."""

    start: object
    arcs: dict
    final: frozenset

    def compose(self, after: Transducer) -> Transducer:
        """What `after` makes of this one's output; weights add up."""
        start = (self.start, after.start)
        arcs, todo, final = {}, [start], set()
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            a, b = state
            arcs[state] = {}
            if a in self.final and b in after.final:
                final.add(state)
            for symbol, choices in self.arcs[a].items():
                own = [(out, w1 + w2, (x, y)) for mid, w1, x in choices for out, w2, y in after.arcs[b].get(mid, ())]
                arcs[state][symbol] = own
                todo += [s for _, _, s in own]
        return Transducer(start, arcs, frozenset(final))

    def best(self, symbols: str) -> list[str]:
        """The outputs of the heaviest path that reads the symbols."""
        # Outputs as linked pairs, the last one first: paths share what they have in common.
        paths: dict = {self.start: (0.0, None)}
        for symbol in symbols:
            new: dict = {}
            for state, (weight, out) in paths.items():
                for o, w, to in self.arcs[state].get(symbol, ()):
                    if to not in new or new[to][0] < weight + w:
                        new[to] = (weight + w, (o, out) if len(o) > 1 else out)
            paths = new
        ends = [p for s, p in paths.items() if s in self.final]
        out, labels = max(ends, key=lambda p: p[0])[1] if ends else None, []
        while out:
            labels.append(out[0])
            out = out[1]
        return labels[::-1]


def insult(scope: int = 4) -> Transducer:
    """An insulting word (W) is an insult (I) after an address or an exclamation at most `scope` words before, before an address at most two words on, or alone in its clause; else it is just a word (J). Copulas (c) keep what is addressed."""
    rest = "noVmr"
    ahead = {"W": [("J", 0.0, 0), ("I", 1.0, "owed 2")]}
    arcs: dict = {"start": {c: [(c, 0.0, 0)] for c in rest} | {"c": [("o", 0.0, 0)], "W": [*ahead["W"], ("I", 0.5, "alone")]}, 0: {c: [(c, 0.0, 0)] for c in rest} | {"c": [("o", 0.0, 0)]} | ahead}
    for k in range(1, scope + 1):
        arcs[k] = {c: [(c, 0.0, k - 1)] for c in rest} | {"c": [("o", 0.0, k)], "W": [("I", 1.0, k)]}
    for k in (2, 1):
        arcs[f"owed {k}"] = ({c: [(c, 0.0, "owed 1")] for c in rest} | {"c": [("o", 0.0, "owed 1")]} if k == 2 else {}) | {"W": [("I", 1.0, f"owed {k}")]}
    for state in arcs.values():
        state |= {"y": [("y", 0.0, scope)]}
    for k in ("start", *range(scope + 1)):
        arcs[k]["e"] = [("o", 0.0, scope)]
    arcs["alone"] = {"W": [("I", 0.5, "alone")]}
    return Transducer("start", arcs, frozenset(["start", "alone", *range(scope + 1)]))


def threat(scope: int = 4) -> Transducer:
    """A violent verb (V) is a threat (T) at most `scope` words after an intention or duty (m), or as a command that begins its clause; else it is just a verb (X)."""
    arcs: dict = {}
    for k in ("start", *range(scope + 1)):
        down = max(0, k - 1) if k != "start" else 0
        arcs[k] = {c: [(c, 0.0, down)] for c in "yroIJ"} | {"n": [("n", 0.0, k if k == "start" else down)], "m": [("o", 0.0, scope)]}
        arcs[k]["V"] = [("T", 0.0, k if k != "start" else scope)] if k else [("X", 0.0, 0)]
    return Transducer("start", arcs, frozenset(arcs))


def negation(scope: int = 3) -> Transducer:
    """A negation denies insults and threats among the next `scope` words: I to i, T to t; a denied word by itself is nothing."""
    arcs = {}
    for k in range(scope + 1):
        down = max(0, k - 1)
        arcs[k] = {c: [(c, 0.0, down)] for c in "yro"} | {"n": [("n", 0.0, scope)]}
        arcs[k] |= {c: [(c.lower() if k else c, 0.0, down)] for c in "IT"}
        arcs[k] |= {c: [("o" if k else c, 0.0, down)] for c in "JX"}
    return Transducer(0, arcs, frozenset(arcs))


def reported() -> Transducer:
    """After a verb of speech the rest of a clause is reported: I to Q, T to q; a reported word by itself is nothing."""
    arcs = {k: {c: [(c, 0.0, k)] for c in "ynoit"} | {"r": [("r", 0.0, 1)]} for k in (0, 1)}
    arcs[0] |= {c: [(c, 0.0, 0)] for c in "ITJX"}
    arcs[1] |= {"I": [("Q", 0.0, 1)], "T": [("q", 0.0, 1)]} | {c: [("o", 0.0, 1)] for c in "JX"}
    return Transducer(0, arcs, frozenset(arcs))


def targeted() -> Transducer:
    """What is matched has a target if one stands before it in its clause, or after: a path may promise that."""
    match = "IiQTtqJX"
    arcs = {
        "none": {c: [(c, 0.0, "none")] for c in "nro"} | {"y": [("y", 0.0, "seen")]} | {c: [(c + "0", 1.0, "bare"), (c + "1", 2.0, "promised")] for c in match},
        "bare": {c: [(c, 0.0, "bare")] for c in "nro"} | {"y": [("y", -9.0, "seen")]} | {c: [(c + "0", 1.0, "bare")] for c in match},
        "promised": {c: [(c, 0.0, "promised")] for c in "nro"} | {"y": [("y", 0.0, "seen")]} | {c: [(c + "1", 2.0, "promised")] for c in match},
        "seen": {c: [(c, 0.0, "seen")] for c in "nroy"} | {c: [(c + "1", 2.0, "seen")] for c in match},
    }
    return Transducer("none", arcs, frozenset(["none", "bare", "seen"]))


def grammar() -> Transducer:
    """Over insults and threats as they are found."""
    return negation().compose(reported()).compose(targeted())


def clause_grammar() -> Transducer:
    """Over the words' symbols: insults and threats are composed of them first."""
    return insult().compose(threat()).compose(grammar())


class Clauses:
    """Words of letters in a piece of text, and the clause of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        letter = LETTER[data]
        start, end = letter.copy(), letter.copy()
        start[1:] &= ~letter[:-1]
        end[:-1] &= ~letter[1:]
        edge = off[:-1][off[:-1] < len(data)]
        start[edge] = letter[edge]
        edge = off[1:][off[1:] > 0] - 1
        end[edge] = letter[edge]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])
        self.hash = self.span(self.start, self.end)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.doc = doc
        self.clause = np.concatenate([[0], np.cumsum(BREAK[data])])[self.start] + doc

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def prefix(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of at least k bytes, and the hashes of their first k bytes; with k = 0 of all words whole."""
        if not k:
            return np.arange(len(self.hash)), self.hash
        own = np.flatnonzero(self.end - self.start >= k)
        return own, self.span(self.start[own], self.start[own] + k)


def clauses_of(column, most: int = PIECE):
    data, off = buffers(column)
    for i, j in pieces(off, most):
        yield i, j, Clauses(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _inside(sorted_keys: np.ndarray, q: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(q), bool)
    i = np.searchsorted(sorted_keys, q)
    i[i == len(sorted_keys)] = 0
    return sorted_keys[i] == q


class Model:
    """The lexicon with learned stems, the composed grammar, and the weights of its outputs."""

    def __init__(self, stems: dict[int, np.ndarray], weights: np.ndarray | None = None, bias: float = PRIOR_BIAS):
        self.stems = {k: np.sort(np.asarray(v, np.uint64)) for k, v in stems.items() if len(v)}
        self.words = {}
        for symbol, text in LEXICON.items():
            b = np.frombuffer(text.encode(), np.uint8)
            self.words[symbol] = np.unique(Clauses(b, np.array([0, len(b)])).hash)
        self.weights = PRIOR.copy() if weights is None else weights
        self.bias, self.grammar = bias, clause_grammar()

    def features(self, c: Clauses, n_docs: int) -> np.ndarray:
        """How often each kind of match stands in each document."""
        symbols = np.full(len(c.hash), ord("o"), np.uint8)
        for symbol in "cemynrVW":
            symbols[_inside(self.words[symbol], c.hash)] = ord(symbol)
        for k, stems in self.stems.items():
            own, h = c.prefix(k)
            own = own[_inside(stems, h)]
            # A learned stem never takes a word that the lexicon has.
            symbols[own[symbols[own] == ord("o")]] = ord("W")
        out = np.zeros((n_docs, len(LABELS)))
        hit = np.flatnonzero((symbols == ord("W")) | (symbols == ord("V")))
        for clause in np.unique(c.clause[hit]):
            a, b = np.searchsorted(c.clause, [clause, clause + 1])
            for label in self.grammar.best(symbols[a:b].tobytes().decode()):
                out[c.doc[a], LABELS.index(label)] += 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(times(np.log1p(x), self.weights[:, None])[:, 0] + self.bias, -30, 30))), DIGITS)


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, drawn: float = DRAWN) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of distinct feature rows that occur n times, drawn to PRIOR; Newton steps."""
    a = np.concatenate([np.log1p(x), np.ones((len(x), 1))], 1)
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (n * (p - y)) + drawn * (w - prior)
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + drawn * np.eye(len(w)), g)
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


SHARDS = 16


def _contexts(batches):
    """Distinct (prefix, word before, document) of toxic documents, by shards of the prefix."""
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for i, j, c in clauses_of(b.column("text")):
            before = np.zeros(len(c.hash), np.uint64)
            before[1:] = np.where(c.doc[1:] == c.doc[:-1], c.hash[:-1], np.uint64(0))
            for k in PREFIXES:
                own, h = c.prefix(k)
                order = np.lexsort((c.doc[own], before[own], h))
                h, left, doc = h[order], before[own][order], ids[i:j][c.doc[own]][order]
                at = runs(h, left, doc)
                h, left, doc = h[at], left[at], doc[at]
                cut = np.searchsorted(shard_of(h, SHARDS), np.arange(SHARDS + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array([packed(h[cut[s] : cut[s + 1]], left[cut[s] : cut[s + 1]], doc[cut[s] : cut[s + 1]]) for s in some], pa.binary())], ["k", "shard", "data"])


def _distinct(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each h, and with how many different others it occurs."""
    order = np.lexsort((other, h))
    h, other = h[order], other[order]
    h = h[runs(h, other)]
    at = runs(h)
    return h[at], np.diff(np.append(at, len(h)))


def _countable(key, table):
    parts = [unpacked(b) for b in table["data"].to_pylist()]
    h, left, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
    (prefix, n), (_, docs) = _distinct(h, left), _distinct(h, doc)
    n = np.minimum(n, docs)
    own = n >= CONTEXTS
    return pa.table({"k": pa.array(np.full(own.sum(), key[0].as_py()), pa.int32()), "h": pa.array(prefix[own].view(np.int64)), "n": pa.array(n[own].astype(np.int64))})


def _strays(stems):
    """How many of the other documents hold each of these prefixes."""

    def strays(batches):
        own_stems = stems.value
        for b in batches:
            for _, _, c in clauses_of(b.column("text")):
                for k, keys in own_stems.items():
                    own, h = c.prefix(k)
                    hit = _inside(keys, h)
                    d = np.unique(np.stack([h[hit], c.doc[own[hit]].astype(np.uint64)]), axis=1)[0]
                    key, n = totals(d, np.ones(len(d), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k), pa.int32()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "h", "stray"])

    return strays


def learn_stems(rows: DataFrame) -> dict[int, np.ndarray]:
    """Prefixes that stand in at least CONTEXTS toxic rows (label 1) after as many different words, and next to never in others.

    Different left neighbours are asked for, so copies of one toxic document don't make its rare words
    insults, and different documents, so one that repeats a word doesn't either. A prefix must be too frequent for chance: the toxic share of documents to the power of its
    contexts, over all prefixes tried. Bounded by the sample of labelled rows.
    """
    spark = rows.sparkSession
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    if not toxic or toxic == n:
        return {}
    tried = saved(rows.where("label = 1").select("doc_id", "text").mapInArrow(_contexts, "k int, shard int, data binary").groupBy("k", "shard").applyInArrow(_countable, "k int, h long, n long"), "toxic-prefixes")
    least = (math.log(max(1, tried.count())) + 5) / -math.log(toxic / n)
    kept = tried.where(F.col("n") >= least).collect()
    stems = {k: np.sort(np.array([r["h"] for r in kept if r["k"] == k], np.int64).view(np.uint64)) for k in PREFIXES}
    stray = rows.where("label = 0").select("text").mapInArrow(_strays(spark.sparkContext.broadcast(stems)), "k int, h long, stray long").groupBy("k", "h").agg(F.sum("stray").alias("stray"))
    bad = {(r["k"], r["h"]) for r in tried.join(stray, ["k", "h"]).where(F.col("stray") > STRAY * F.col("n")).collect()}
    out: dict[int, list] = {k: [] for k in PREFIXES}
    for r in kept:
        if (r["k"], r["h"]) not in bad:
            out[r["k"]].append(r["h"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


def _features(model: Model):
    def features(batches):
        for b in batches:
            for i, j, c in clauses_of(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(model.features(c, j - i).tolist(), pa.list_(pa.float64())), b.column("label").slice(i, j - i)], ["x", "label"])

    return features


def train(documents: DataFrame, labels: DataFrame, training, label: str = "toxic", most: int = SAMPLE_ROWS) -> Model:
    """Stems and weights from at most `most` labelled rows; without labelled rows of both kinds, the lexicon and PRIOR alone."""
    rows = saved(sample(documents, labels, label, training, most), "toxic-sample")
    model = Model(learn_stems(rows))
    # Distinct counts of matches are few; the driver gets them with their numbers, at most one row a sampled document.
    seen = rows.mapInArrow(_features(model), "x array<double>, label int").groupBy("x", "label").agg(F.count("*").alias("n")).collect()
    if seen:
        model.weights, model.bias = fit(np.array([r["x"] for r in seen]), np.array([float(r["label"]) for r in seen]), np.array([float(r["n"]) for r in seen]))
    return model


def _score(model: Model, least: float):
    def score(batches):
        for b in batches:
            x = np.concatenate([model.features(c, j - i) for i, j, c in clauses_of(b.column("text"))] or [np.zeros((0, len(LABELS)))])
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= least).astype(np.int32)), pa.array(x.sum(1).astype(np.int64)), *(b.column(c) for c in b.schema.names[3:])], ["doc_id", "held_out", "score", "predicted", "n_matches", *b.schema.names[3:]])

    return score


def toxicity(documents: DataFrame, labels: DataFrame, held_out, least: float = 0.7, most: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `least` on), n_matches and the columns `keep` (as kept_<name>) of every row.

    Clauses end at punctuation, brackets, quotes and newlines. Their words become symbols by the lexicon and
    the stems learned from labels, and the grammar - insult, threat, negation, reported speech and target, composed -
    turns each clause into matches: insults (an insulting word with an address, an exclamation or alone) and threats (a
    violent verb with an intention, or as a command), plain, denied or reported, and such words by themselves, with or
    without a target.
    The score is logistic in their numbers. The Column `held_out` (of an id) marks rows whose labels aren't
    learned from. Null and empty texts have no match and the score of the bias; null ids are scored; rows that
    repeat an id are scored each; other columns are ignored.
    """
    ship(documents.sparkSession)
    model = train(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, ~held_out, most=most)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return rows.mapInArrow(_score(model, least), f"doc_id long, held_out boolean, score double, predicted int, n_matches long{kept}")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_is("doc_id", 3, 1))
