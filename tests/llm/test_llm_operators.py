"""Each operator against brute force on small tables that hold nulls, empty and very long texts, ties, copies and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination, graph, labelled, line_dedup, lm_scoring, mixing, near_dedup, quality, sharded, suffix_dedup, text, token_counts, topk_search, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, size long, score double, held_out boolean, dropped string, key string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(lower(t))


def corpus(seed=5, n=60):
    """Random texts with exact copies, near copies, shared passages and lines, and the awkward rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared, line = say(60), say(12)
    docs = []
    for i in range(n):
        parts = [say(rng.randint(5, 40)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            parts.insert(rng.randint(0, len(parts)), shared)
        if i % 4 == 0:
            parts.append(line if i % 8 else line[:-1] + "x")
        docs.append("\n".join(parts))
    for i in range(0, n, 6):
        w = docs[i].split(" ")
        docs.append(docs[i])
        w[rng.randrange(len(w))] = "edited"
        docs.append(" ".join(w))
    docs += [None, "", " \n\t ", "one", "two words", say(6000), "A " * 500, "Ünï cödé text  with odd\x1fspaces 😀"]
    return [(i, t, "en", None if i % 17 == 3 else f"s{i % 4}", len(t or ""), -i, i, 7, 0.5, i % 2 == 0, "d", "k") for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def with_oddities(docs, spark):
    """A row twice, and rows without an id."""
    again = docs.where("doc_id = 4")
    return docs.unionByName(again).unionByName(docs.where("doc_id in (1, 2)").withColumn("doc_id", F.lit(None).cast("long")))


# --- words ---


def test_words_are_those_of_the_pattern(rows):
    texts = [r[1] for r in rows]
    got, seen = [], {}
    for i, j, data, _, w in text.batches_of_words(pa.array(texts, pa.string()), most=500):
        raw = data.tobytes()
        for d in range(j - i):
            a, b = w.first[d], w.first[d + 1]
            got.append([lower(raw[s:e].decode()) for s, e in zip(w.start[a:b], w.end[a:b])])
            for word, h in zip(got[-1], w.hash[a:b]):
                assert seen.setdefault(int(h), word) == word
    assert got == [words(t) for t in texts]
    assert len(set(seen.values())) == len(seen)
    assert list(text.counts_of_words(pa.array(texts, pa.string()))) == [len(words(t)) for t in texts]


def test_shingles_of_short_and_long_texts():
    for _, _, _, _, w in text.batches_of_words(pa.array(["a b c", "A b C", "a b c d e f", "", None])):
        s = text.shingle_sets(w)
    assert [len(x) for x in s] == [1, 1, 2, 0, 0] and s[0][0] == s[1][0]


def test_packed_arrays_round_trip():
    a, b = np.arange(5, dtype=np.uint64), np.array([1, 200, 3], np.uint8)
    x, y = sharded.unpacked(sharded.packed(a, b))
    assert (x == a).all() and (y == b).all() and y.dtype == np.uint8


# --- op1 ---


def kneser_ney(train, order):
    """A dictionary version of the model, straight from its definition."""
    seqs = [["<s> ", *t, "</s> "] for t in train]
    counts = [Counter() for _ in range(order + 1)]
    for s in seqs:
        for i in range(1, len(s)):
            counts[min(i + 1, order)][tuple(s[max(0, i - order + 1) : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    level = []
    for k in range(1, order + 1):
        n = [sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4)]
        d, sums, rest = [0.0, *lm_scoring.discounts(n)], Counter(), Counter()
        for g, v in counts[k].items():
            sums[g[:-1]] += v
            rest[g[:-1]] += d[min(v, 3)]
        level.append((counts[k], d, sums, rest))

    def p(context, word):
        c, d, sums, rest = level[0]
        q = (max(c[(word,)] - d[min(c[(word,)], 3)], 0) + rest[()] / (len(c) + 1)) / sums[()] if sums[()] else 1 / (len(c) + 1)
        for k in range(2, order + 1):
            h = tuple(context[len(context) - k + 1 :]) if len(context) >= k - 1 else None
            c, d, sums, rest = level[k - 1]
            if h is not None and sums[h]:
                q = max(c[(*h, word)] - d[min(c[(*h, word)], 3)], 0) / sums[h] + rest[h] / sums[h] * q
        return q

    return p


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_equal_the_dictionary_model(spark, docs, rows, order):
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, lm_scoring.crc_is("doc_id", 7, 2), order).collect()}
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    train = [words(r[1]) for r in rows if not held[r[0]]]
    p = kneser_ney(train, order)
    raw = Counter(w for t in train for w in [*t, "</s> "])
    n, v = sum(raw.values()), len(raw)
    for r in rows:
        s = ["<s> ", *words(r[1]), "</s> "]
        x = got[r[0]]
        assert (x.held_out, x.n_tokens, x.train_tokens) == (held[r[0]], len(s) - 1, n)
        assert x.n_known == sum(raw[w] > 0 for w in s[1:])
        assert math.isclose(x.base_score, sum(math.log10((raw[w] + 1) / (n + v + 1)) for w in s[1:]), rel_tol=1e-9)
        assert math.isclose(x.score, sum(math.log10(p(s[:i], s[i])) for i in range(1, len(s))), rel_tol=1e-9)


def test_lm_probabilities_sum_to_one(rows):
    train = [words(r[1]) for r in rows[:20]]
    p, v = kneser_ney(train, 2), {w for t in train for w in t} | {"</s> "}
    for context in (["<s> "], ["<s> ", train[0][0]], ["never"]):
        assert math.isclose(sum(p(context, w) for w in v) + p(context, "unknown"), 1.0, rel_tol=1e-9)


def test_lm_without_training_text(spark, empty):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm_scoring.lm_scores(df, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) == (3, 0, 0, 0.0, 0.0)
    assert lm_scoring.lm_scores(empty, F.lit(False)).count() == 0


# --- op2 ---


def matches(t):
    c = next(toxicity.clauses_of(pa.array([t], pa.string())))[2]
    x = toxicity.Model({}).features(c, 1)[0]
    return {k: int(v) for k, v in zip(toxicity.LABELS, x) if v}


def test_grammar_scores_clauses():
    assert matches("You are an idiot.") == {"I1": 1}
    assert matches("What an idiot, you know.") == {"I0": 1}
    assert matches("idiot that you are") == {"I1": 1}
    assert matches("You are not an idiot") == {"i1": 1}
    assert matches("You are not, idiot") == {"I0": 1}
    assert matches("He said you are an idiot") == {"Q1": 1}
    assert matches("I will kill you! I will kill time.") == {"T1": 1, "T0": 1}
    assert matches("I will never hurt you") == {"t1": 1}
    assert matches("plain text only") == {} and matches("") == {} and matches(None) == {}
    assert matches("stupid scum and you moron") == {"I1": 3}


def test_composition_prefers_targets_and_adds_weights():
    g = toxicity.grammar()
    assert g.best("oIoy") == ["I1"] and g.best("oIo") == ["I0"] and g.best("rnI") == ["i0"] and g.best("") == []


def test_toxicity_learns_stems_but_not_copies(spark):
    rng = random.Random(2)
    say = lambda k: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(k))
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = say(30)
        if bad:
            t = f"{say(8)} zorgu{rng.choice(['ra', 'ton', 'mi', 'x'])} {say(8)}"
        if 100 <= i < 120 and bad:
            t = "copied plimflam words of one toxic document zorgura"
        docs.append((i, t))
        labels.append((i, int(bad)))
    docs += [(1000, None), (1001, "")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (2000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, lab, F.lit(True))
    own = lambda w, k: int(next(toxicity.clauses_of(pa.array([w])))[2].prefix(k)[1][0]) in {int(h) for h in model.stems.get(k, [])}
    assert own("zorgura", 5) and not own("plimflam", 5)
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab, lm_scoring.crc_is("doc_id", 3, 1)).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert got[1000].predicted == 0 and 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, none, F.lit(False)).count() == docs.count()
    assert toxicity.toxicity(empty, none, F.lit(False)).count() == 0


# --- op3 ---


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(3)
    for _ in range(2000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            if rng.random() < 0.4:
                b.insert(at, rng.choice(b"abc"))
            elif at < len(b):
                b[at : at + 1] = b"" if rng.random() < 0.5 else bytes([rng.choice(b"abc")])
        assert line_dedup.within(a, bytes(b)) == (distance(a, b) <= 2)


def lines_of(t):
    return [lower(x.strip(" \t\r\x0b\x0c")).encode() for x in (t or "").split("\n")]


def brute_drops(rows):
    every = {(i, k): x for i, t in rows if i is not None for k, x in enumerate(lines_of(t)) if x}
    distinct = sorted(set(every.values()))
    up = {x: x for x in distinct}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in distinct:
        for b in distinct:
            if a < b and min(len(a), len(b)) >= line_dedup.LEAST and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                up[top(a)] = top(b)
    first = {}
    for at in sorted(every):
        first.setdefault(top(every[at]), at)
    out = defaultdict(list)
    for at in sorted(every):
        if first[top(every[at])] != at:
            out[at[0]].append(at[1])
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 45))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x[rng.randrange(len(x))] = rng.choice(["", "q", "Z"])
            lines.append("".join(x))
        docs.append((i, "\n".join([*lines, "", "short", "Short "][: rng.randint(0, 9)])))
    docs += [(100, None), (101, ""), (102, " \n \n")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = brute_drops(docs)
    for i, t in docs:
        assert list(got[i].dropped) == want[i]
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in want[i] and x.strip()]
        assert t is None and got[i].text is None or [x for x in got[i].text.split("\n") if x.strip()] == left


def test_line_keys_meet_for_every_close_pair():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randint(26, 60)))
        b = list(a)
        for _ in range(rng.randint(1, 2)):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "yz"])
        both = []
        for x in (a, "".join(b)):
            _, _, lines = next(line_dedup._pieces(pa.array([x])))
            both.append(set(line_dedup.line_keys(lines, np.arange(1))[1].tolist()))
        if distance(a.encode(), "".join(b).encode()) <= 2:
            assert both[0] & both[1]


def test_line_dedup_keeps_columns_and_rows_without_id(spark, docs, empty):
    odd = with_oddities(docs, spark)
    got = line_dedup.dedup_lines(odd, keep=("lang", "dropped", "key"))
    assert got.count() == odd.count() and {"kept_lang", "kept_dropped", "kept_key"} <= set(got.columns)
    assert line_dedup.dedup_lines(empty).count() == 0


# --- op4 ---


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.1, (230, 16))
    v[50:90] = v[7]
    data = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    data += [(300, None, 1), (301, [0.1, None] + [0.0] * 14, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] * 16, 1), (304, [0.5] * 4, 1), (305, [], 1), (None, [0.9] * 16, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int").repartition(3)
    got = defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = {i: np.floor(256 * np.array(r + [0.0] * (16 - len(r)))).astype(int) for i, r, _ in data if i is not None and r is not None and all(x is not None and math.isfinite(x) for x in r)}
    for q in [i for i in ok if i % 10 == 0]:
        best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:5]
        assert got[q] == [(k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert set(got) == {i for i in ok if i % 10 == 0}


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk_search.top_k(df.where("false"), F.lit(True)).count() == 0


# --- op5 ---


def test_quality_tells_shapes_apart(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(500):
        w = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(40)]
        bad = i % 5 == 0
        docs.append((i, " ".join(f"{x}!!" for x in w) if bad and i % 2 else " ".join([w[0]] * 40) if bad else " ".join(w)))
        labels.append((i, int(not bad)))
    docs += [(900, None), (901, "")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(d, lab, lm_scoring.crc_is("doc_id", 5, 0)).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(docs, none, F.lit(False)).collect()} == {0.5}
    assert quality.quality(empty, none, F.lit(False)).count() == 0


def test_sample_is_bounded_and_leaves_held_out_rows(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", F.col("doc_id") >= 10, most=20).collect()
    assert len(got) == 20 and all(r.doc_id >= 10 for r in got)


# --- op6 ---


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers")


def test_counts_equal_the_library(spark, rows, docs, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer.path("byte_bpe_50k.json"))
    extra = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|", "it's  we'll\n\n x\t\t y ", "\r\n\r\n  end  ", "ﷺ 中文字   \u0085 \x1f", "x" * 3000]
    more = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(extra)] + [(1000, None)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    cache = f"file://{tmp_path}/cache"
    args = (tokenizer.path("byte_bpe_50k.json"), cache, tokenizer.path("byte_bpe_50k.tiktoken"))
    first = token_counts.token_counts(df, *args)
    got = sorted(map(tuple, first.collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in df.collect()), key=str)
    assert got == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({r.text or "" for r in df.collect()})
    assert sorted(map(tuple, token_counts.token_counts(df, *args).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == stored
    token_counts.token_counts(spark.createDataFrame([(1, "quite new")], "doc_id long, text string"), *args).collect()
    assert spark.read.parquet(cache).count() == stored + 1


def test_counts_of_nothing(spark, empty, tokenizer, tmp_path):
    assert token_counts.token_counts(empty, tokenizer.path("byte_bpe_50k.json"), f"file://{tmp_path}/none").count() == 0


# --- op7 ---


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, goal, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return goal | {s: level * w[s] for s in open_}
        goal |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return goal


def test_mix_meets_targets(spark, docs, rows):
    got = mixing.mix(docs, block=16).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goal, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert (r.source_size, r["size"]) == (sizes[r.source], len(words(rows[r.doc_id][1])))
        assert math.isclose(r.target, goal[r.source]) and r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    # No choice of whole copies can be nearer than half of a document that is most of its source.
    largest = Counter()
    for r in rows:
        largest[r[3]] = max(largest[r[3]], len(words(r[1])))
    assert all(abs(taken[s] - goal[s]) <= max(0.02 * goal[s], 40, largest[s] / 2 if largest[s] > sizes[s] / 2 else 0) for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block=16).collect()))


def test_flight_keeps_totals():
    rng = random.Random(1)
    size = sorted((rng.randint(1, 400) for _ in range(200)), reverse=True)
    p = [rng.random() for _ in size]
    q = mixing.flight(p, size, 3)
    assert sum(0 < x < 1 for x in q) <= 2
    assert math.isclose(sum(q), sum(p), rel_tol=1e-6) and math.isclose(sum(a * b for a, b in zip(q, size)), sum(a * b for a, b in zip(p, size)), rel_tol=1e-6)
    assert all(x in (0.0, 1.0) for x in mixing.fly_and_land(p, size, 3))
    assert set(mixing.fly_and_land([0.5] * 64, [7] * 64, 1)) == {0.0, 1.0}


def test_mix_of_odd_tables(spark, docs, empty):
    odd = with_oddities(docs, spark)
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]


# --- op8 ---


def brute_tiles(item, doc, least):
    """Greedy string tiling as first written: every pair of places, the longest match first, ties by place."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        out.append((i, j, k))
        a[i : i + k], b[j : j + k] = [True] * k, [True] * k


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(60):
        item = rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64)
        doc = np.concatenate([item[len(item) // 2 :], rng.integers(0, 4, 10).astype(np.uint64), item[: len(item) // 2]])
        got, want = decontamination.tiles(item, doc, 3), brute_tiles(item.tolist(), doc.tolist(), 3)
        assert sorted(k for _, _, k in got) == sorted(k for _, _, k in want)
        assert all((item[i : i + k] == doc[j : j + k]).all() for i, j, k in got)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination_by_both_ways(spark, limit):
    rng = random.Random(7)
    say = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(k))
    items = [(i, say(24)) for i in range(6)] + [(10, "Three word item"), (11, None), (12, ""), (13, " ")]
    halves = items[1][1].split(" ")
    docs = [(0, say(80)), (1, f"{say(9)} {items[0][1].upper()} {say(9)}"), (2, " ".join([*halves[12:], *say(5).split(" "), *halves[:12]])), (3, " ".join(halves[:8])), (4, None), (5, ""), (6, f"has a three word item {say(3)}"), (7, f"{items[2][1]} {items[3][1]}"), (None, items[4][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontamination.contaminated(d, b, broadcast_bytes=limit).collect()), key=str)
    want = [(1, 0), (2, 1), (6, 10), (7, 2), (7, 3), (None, 4)]
    assert got == sorted(want, key=str)
    assert decontamination.contaminated(d.where("false"), b, broadcast_bytes=limit).count() == 0
    assert decontamination.contaminated(d, b.where("false"), broadcast_bytes=limit).count() == 0


# --- op9 ---


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    s = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return s, {i: top(i) for i in s}


def family(seed=11, n=90):
    """A base text and copies with a few to many edited words: similarities from 1 to far below the bound."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark, rows):
    data = [(r[0], r[1]) for r in rows] + [(200 + i, t) for i, t in enumerate(family())] + [(500, "a b"), (501, "A  B"), (502, "a b c")]
    s, want = brute_components(data)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(s[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_in_blocks(spark, monkeypatch):
    data = list(enumerate(family(3, 60)))
    _, want = brute_components(data)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 10)
    monkeypatch.setattr(near_dedup, "RESIDUAL", 5)
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_of_odd_tables(spark, docs, empty):
    odd = with_oddities(docs, spark)
    got = near_dedup.near_duplicates(odd)
    assert got.count() == odd.count()
    assert got.where("doc_id is null and (component_id is not null or kept)").count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0


def test_joint_estimates_are_near_the_truth():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.6, 0.75, 0.95):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 1500).astype(np.uint64)
            n = int(1000 * share)
            a, b = np.unique(x[:1000]), np.unique(np.concatenate([x[:n], x[1000 : 1000 + (1000 - n) // 2]]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            e = near_dedup.joint_estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([float(len(a))]), np.array([float(len(b))]))[0]
            errors.append(e - j)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < near_dedup.DOUBT


def test_registers_merge_by_maximum():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(2))
    assert (near_dedup.registers(np.union1d(a, b)) == np.maximum(near_dedup.registers(a), near_dedup.registers(b))).all()


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(50, i) for i in range(30)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]}[shape]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


# --- op10 ---


def brute_passages(rows, least):
    w = {i: words(t) for i, t in rows if i is not None}
    who = defaultdict(set)
    for i, x in w.items():
        for p in range(len(x) - least + 1):
            who[tuple(x[p : p + least])].add(i)
    out = {}
    for i, x in w.items():
        mark = [False] * len(x)
        for p in range(len(x) - least + 1):
            if len(who[tuple(x[p : p + least])]) > 1:
                mark[p : p + least] = [True] * least
        out[i] = mark
    return out


def marks(got, rows):
    out = {i: [False] * len(words(t)) for i, t in rows if i is not None}
    for r in got:
        out[r.doc_id][r.first_word : r.first_word + r.n_words] = [True] * r.n_words
    return out


def test_passages_equal_brute_force(spark, rows):
    data = [(r[0], r[1]) for r in rows] + [(200 + i, t) for i, t in enumerate(family())]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert marks(got, data) == brute_passages(data, suffix_dedup.LEAST)
    assert all(r.doc_id != r.other_doc for r in got)


def test_passages_at_the_bound(spark):
    a = [f"a{i}" for i in range(200)]
    data = [(0, " ".join(a)), (1, " ".join(["x"] * 30 + a[20:70] + ["y"] * 30)), (2, " ".join(["z"] * 30 + a[100:149] + ["v"] * 30)), (3, " ".join(["r"] * 300))]
    got = sorted((r.doc_id, r.first_word, r.n_words) for r in suffix_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(0, 20, 50), (1, 30, 50)]


def test_passages_of_odd_tables(spark, docs, empty):
    assert suffix_dedup.repeated_passages(with_oddities(docs, spark)).where("doc_id is null").count() == 0
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_sliding_windows():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1000, 101).astype(np.uint64)
    for n in (1, 2, 7, 31, 101):
        assert (suffix_dedup.sliding(x, n, np.minimum) == [x[i : i + n].min() for i in range(len(x) - n + 1)]).all()
    assert len(suffix_dedup.sliding(x[:3], 7, np.minimum)) == 0
