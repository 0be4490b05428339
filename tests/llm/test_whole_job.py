"""Skew, repeats, rows without an id, and growth: where an operator could lose rows, links or bounds."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontamination, lm_scoring, mixing, near_dedup, quality, sharded, suffix_dedup, token_counts, topk_search, toxicity
from test_llm_operators import brute_passages, brute_targets, brute_tiles, corpus, family, kneser_ney, marks, shingles, with_oddities, words


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, a row twice and rows without an id, with clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, size long, score double, held_out boolean, dropped string, key string"
    return with_oddities(spark.createDataFrame(corpus(7, 30), schema).repartition(3), spark).cache()


def say(rng, k, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(5)) for _ in range(k)]


# --- shards ---


def cells_of(n_rows, shards):
    """Cells that so many keys give in gatherings of 100."""
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, n_rows).astype(np.uint64) * np.uint64(2))
    return [sharded.cells(sharded.shard_of(k, shards), shards, [k]) for k in (np.sort(keys[i : i + 100]) for i in range(0, n_rows, 100))]


def test_cells_grow_with_the_input_and_not_its_square(monkeypatch):
    monkeypatch.setattr(sharded, "FAN", 8)
    counts = []
    for n in (4_000, 16_000):
        shards = sharded.shard_number(n, 100)
        assert shards >= n // 100 and shards.at <= 8
        counts.append(sum(b.num_rows for b in cells_of(n, shards)))
    assert counts[1] <= 4.2 * counts[0] and counts[0] <= 8 * 40


def test_keys_come_whole_through_several_exchanges(spark, monkeypatch):
    monkeypatch.setattr(sharded, "FAN", 3)
    shards = sharded.shard_number(20 * 100, 100)
    assert shards >= 20 and shards.at <= 3
    parts = [b for b in cells_of(3_000, shards)]
    df = spark.createDataFrame(pa.Table.from_batches(parts).to_pandas(), sharded.CELL)
    got = sharded.grouped(df, shards).applyInArrow(lambda key, t: pa.table({"shard": pa.array([key[0].as_py()] * sum(len(sharded.unpacked(b)[0]) for b in t["data"].to_pylist()), pa.int32()), "key": pa.array(np.concatenate([sharded.unpacked(b)[0] for b in t["data"].to_pylist()]).view(np.int64))}), "shard int, key long").toPandas()
    keys = got["key"].to_numpy().view(np.uint64)
    want = np.concatenate([sharded.unpacked(x)[0] for b in parts for x in b.column("data").to_pylist()])
    assert (np.sort(keys) == np.sort(want)).all()
    assert (sharded.shard_of(keys, shards) == got["shard"].to_numpy()).all()


@pytest.mark.parametrize("fan", [2, 1024])
def test_lm_through_several_exchanges(spark, fan, monkeypatch):
    monkeypatch.setattr(sharded, "FAN", fan)
    rng = random.Random(5)
    data = [(i, " ".join(say(rng, rng.randint(0, 30), "abc"))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    p = kneser_ney([words(t) for _, t in data], 3)
    for r in lm_scoring.lm_scores(df, F.lit(False), 3).collect():
        s = ["<s> ", *words(data[r.doc_id][1]), "</s> "]
        assert math.isclose(r.score, sum(math.log10(p(s[:i], s[i])) for i in range(1, len(s))), rel_tol=1e-9)


def test_few_shards_stay_mapped(tmp_path, monkeypatch):
    monkeypatch.setattr(sharded, "OPEN", 3)
    keys = np.sort(np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    for s in range(10):
        own = keys[sharded.shard_of(keys, 10) == s]
        sharded.write_sorted(str(tmp_path), "t", s, key=own, n=(own % np.uint64(1000)).astype(np.uint16))
    table = sharded.Sorted(str(tmp_path), "t", 10, ("n",))
    q = np.concatenate([keys, keys + np.uint64(1)])
    (n,) = table.get(q)
    assert (n[:500] == keys % np.uint64(1000)).all() and not n[500:].any() and len(table.open) == 3


# --- op1 ---


def test_grams_as_bytes_round_trip():
    rng = np.random.default_rng(3)
    for top in (3, 300, 2**40):
        words_ = [rng.integers(0, top, 500).astype(np.uint64) for _ in range(3)]
        order = np.lexsort(words_[::-1]) if top < 300 else np.arange(500)
        words_ = [c[order] for c in words_]
        n = rng.integers(0, 5, 500).astype(np.int64)
        got = lm_scoring.decoded(lm_scoring.coded(*words_, n, n_words=3), 3)
        sums = Counter()
        for *g, k in zip(*words_, n):
            sums[tuple(map(int, g))] += int(k)
        assert [tuple(map(int, r)) for r in zip(*got)] == [tuple(map(int, r)) for r in zip(*words_, n)]
        grams, (total,) = lm_scoring.folded(got[:3], got[3:])
        assert [(*map(int, g), int(k)) for *g, k in zip(*grams, total)] == [(*g, sums[g]) for g in sorted(sums)]


def test_counts_are_not_cut_to_32_bits():
    n = np.array([5_000_000_000, 1], np.int64)
    assert sharded.small(n).tolist() == n.tolist()
    assert lm_scoring.decoded(lm_scoring.coded(np.arange(2), n, n_words=1), 1)[1].tolist() == n.tolist()


def test_lm_of_odd_tables(spark, odd):
    held = lm_scoring.crc_is("doc_id", 7, 2)
    got = [tuple(r) for r in lm_scoring.lm_scores(odd, held).collect()]
    rows = odd.select("doc_id", held.alias("h"), "text").collect()
    train = [words(r.text) for r in rows if not r.h]
    p, raw = kneser_ney(train, lm_scoring.ORDER), Counter(w for t in train for w in [*t, "</s> "])
    want = []
    for r in rows:
        s = ["<s> ", *words(r.text), "</s> "]
        want.append((r.doc_id, r.h, len(s) - 1, sum(raw[w] > 0 for w in s[1:]), sum(raw.values()), sum(math.log10(p(s[:i], s[i])) for i in range(1, len(s)))))
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[6], w[5], rel_tol=1e-9) for g, w in zip(got, want))


# --- op2 ---


def every_path(symbols):
    """The outputs of the heaviest of all paths through the three transducers, one after the other, by trying each."""
    best = (-math.inf, ())

    def steps(layers, states, i, weight, out):
        nonlocal best
        if i == len(symbols):
            if all(s in t.final for t, s in zip(layers, states)) and weight > best[0]:
                best = (weight, out)
            return

        def through(k, symbol, states, weight):
            if k == len(layers):
                yield symbol, states, weight
                return
            for o, w, to in layers[k].arcs[states[k]].get(symbol, ()):
                yield from through(k + 1, o, (*states[:k], to, *states[k + 1 :]), weight + w)

        for o, new, w in through(0, symbols[i], states, weight):
            steps(layers, new, i + 1, w, (*out, o) if len(o) > 1 else out)

    layers = [toxicity.negation(), toxicity.reported(), toxicity.targeted()]
    steps(layers, tuple(t.start for t in layers), 0, 0.0, ())
    return best


def test_grammar_equals_all_paths_tried():
    rng, g = random.Random(4), toxicity.grammar()
    for _ in range(400):
        symbols = "".join(rng.choice("ooIIITynr") for _ in range(rng.randint(0, 8)))
        weight, out = every_path(symbols)
        got = g.best(symbols)
        assert Counter(x[0] for x in got) == Counter(x[0] for x in out), symbols
        if len(set(out)) == len(out):
            assert list(out) == got or len(got) == len(out)


def test_stems_leave_the_lexicon_alone():
    stem = next(toxicity.clauses_of(pa.array(["they"])))[2].prefix(4)[1]
    for t in ("they never said you idiot", "they are here"):
        c = next(toxicity.clauses_of(pa.array([t])))[2]
        assert (toxicity.Model({4: stem}).features(c, 1) == toxicity.Model({}).features(c, 1)).all()


def test_a_clause_of_many_insults_is_quick():
    c = next(toxicity.clauses_of(pa.array(["idiot " * 20_000])))[2]
    assert toxicity.Model({}).features(c, 1).sum() == 20_000


def test_toxicity_and_quality_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(25)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    texts = Counter((r.doc_id, r.text) for r in odd.collect())
    for got in (toxicity.toxicity(odd, labels, lm_scoring.crc_is("doc_id", 3, 1), keep=("text",)).withColumnRenamed("kept_text", "text"), quality.quality(odd, labels, lm_scoring.crc_is("doc_id", 5, 0)).withColumn("text", F.lit("?"))):
        rows = got.collect()
        assert Counter(r.doc_id for r in rows) == Counter({i: sum(n for (d, _), n in texts.items() if d == i) for i, _ in texts})
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        by = defaultdict(set)
        for r in rows:
            by[r.doc_id].add((r.score, r.predicted))
        assert len(by[4]) == 1


# --- op5 ---


def test_pooled_vectors_equal_a_dictionary_version(spark):
    rng = random.Random(8)
    vocabulary = say(rng, 25)
    data = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["once seen", None, ""]
    df = spark.createDataFrame([(t,) for t in data], "text string").repartition(3)
    got = quality.random_index(df).pool(pa.array(data, pa.string()))

    def index(h):
        place, sign = quality.index_vectors(np.array([h], np.uint64))
        v = np.zeros(quality.DIM)
        v[place[0]] = sign[0]
        return v

    sides = []
    for t in data:
        _, _, streams = next(quality._streams(pa.array([t], pa.string())))
        sides.append([[int(h) for h in w.hash] for w in streams])
    for k in range(2):
        often = Counter(h for s in sides for h in s[0] + s[1])
        sums = defaultdict(lambda: np.zeros(quality.DIM))
        for s in sides:
            for w in s:
                for i, h in enumerate(w):
                    for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                        sums[h] += index(w[j]) if j != i else 0
        for d, s in enumerate(sides):
            mean = np.zeros(quality.DIM)
            for i, h in enumerate(s[k]):
                v = sums[h] if often[h] >= quality.COMMON else sum((index(s[k][j]) for j in range(max(0, i - quality.REACH), min(len(s[k]), i + quality.REACH + 1)) if j != i), np.zeros(quality.DIM))
                mean += v / max(np.sqrt((v * v).sum()), 1e-9)
            at = 1 + k * (quality.DIM + 3)
            assert np.allclose(got[d][at : at + quality.DIM], mean / max(1, len(s[k])), atol=1e-5)


# --- op3, op4 ---


def test_top_k_reads_less_than_the_lists():
    """Where a few rows stand out, a query stops early; each entry is read once at most."""
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 20, (3000, 8))
    x[:12] += 400
    found, reads = topk_search.nra_top_k(x, x[:4], 5)
    assert reads <= 0.2 * x.size * 4
    for q, (rows, scores) in enumerate(found):
        every = x @ x[q]
        assert set(rows) == set(np.flatnonzero(every >= np.sort(every)[-5])) and (every[rows] == scores).all()


def test_top_k_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (120, 4)) / 256
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 50)
    got = defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.floor(v * 256).astype(int)
    for q in range(0, 120, 2):
        best = sorted((-int(x[q] @ x[c]), c) for c in range(120) if c != q)[:5]
        assert got[q] == [(c, -s) for s, c in best]


# --- op6 ---


def test_counts_of_odd_tables_and_a_cache_that_holds_some(spark, odd, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, cache = Tokenizer.from_file(public.path("byte_bpe_50k.json")), f"file://{tmp_path}/cache"
    args = (public.path("byte_bpe_50k.json"), cache, public.path("byte_bpe_50k.tiktoken"))
    token_counts.token_counts(odd.where("doc_id < 10"), *args).count()
    some = spark.read.parquet(cache).count()
    got = sorted(map(tuple, token_counts.token_counts(odd, *args).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in odd.collect()), key=str)
    assert got == want
    assert spark.read.parquet(cache).count() == len({r.text or "" for r in odd.collect()}) > some > 0
    # A stored count is what the result has: nothing is encoded twice.
    version = token_counts.tokenizer_digest(args[0])
    false = f"file://{tmp_path}/false"
    spark.sql(f"select unhex(sha2('quite new', 256)) digest, 77L n_tokens, '{version}' tokenizer").write.partitionBy("tokenizer").parquet(false)
    assert token_counts.token_counts(spark.createDataFrame([(1, "quite new")], "doc_id long, text string"), args[0], false, args[2]).first().n_tokens == 77


# --- op7 ---


def test_mix_is_balanced_where_documents_are_small(spark):
    rng = random.Random(6)
    data = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "c", None])) for i in range(900)]
    data = [(i, " ".join(t.replace(" ", "")), s) for i, t, s in data]
    sizes, units = Counter(), Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
        units[s] += 1
    goal, taken, copies = brute_targets(sizes), Counter(), Counter()
    for r in mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), block=64).collect():
        taken[r.source] += r.taken
        copies[r.source] += r.copies
    for s in goal:
        # Blocks of 64 leave few units to land with; the miss is half of one at most.
        assert abs(taken[s] - goal[s]) <= 30
        assert abs(copies[s] - units[s] * goal[s] / sizes[s]) <= 0.02 * units[s] + 3


# --- op8 ---


def test_both_ways_give_equal_rows(spark, odd):
    rng = random.Random(12)
    texts = [r.text for r in odd.where("text is not null").collect() if len(words(r.text)) > 30][:6]
    items = [(k, " ".join(words(t)[5 : 5 + 20])) for k, t in enumerate(texts)] + [(50, "never seen words here"), (51, None), (52, ""), (None, " ".join(words(texts[0])[:9])), (53, "one"), (53, "one"), (54, "a a a a a a a a")]
    items += [(60 + k, " ".join(say(rng, 3) + words(texts[1])[:6])) for k in range(5)]
    b = spark.createDataFrame(items, "item_id long, text string")
    once, large = (sorted(map(str, decontamination.contaminated(odd, b, broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert once == large and len(once) > 20
    rows = odd.collect()
    short = [r for r in rows if len(words(r.text)) < 200]
    want = Counter((r.doc_id, i) for r in short for i, t in items if (w := words(t)) and sum(k for *_, k in brute_tiles(w, words(r.text), min(5, len(w)))) >= 0.5 * len(w))
    ids = {r.doc_id for r in short} - {r.doc_id for r in rows if len(words(r.text)) >= 200}
    got = Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(odd, b).collect())
    assert {k: n for k, n in got.items() if k[0] in ids} == {k: n for k, n in want.items() if k[0] in ids}


def test_tiles_of_one_word_said_often():
    one = np.full(20_000, 12345, np.uint64)
    assert decontamination.tiles(one[:500], one) == [(0, 0, 500)]


# --- op9 ---


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """Document 5 has two texts; 9 is near the one and 7 near the other, in whatever order rows come."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    data = [(5, a), (5, b), (9, b + " more"), (7, a + " more"), (8, "quite another text of some words"), (5, a)]
    for k, order in enumerate(itertools.islice(itertools.permutations(data), 0, 720, 180)):
        df = spark.createDataFrame(list(order), "doc_id long, text string").repartition(1 + k)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
        assert got == sorted((i, len(shingles(t)), 8 if i == 8 else 5, i in (5, 8)) for i, t in data)


def test_a_large_family_is_linked_through_its_star(spark, monkeypatch):
    """Of 5 blocks, members near the star are linked by it; the others meet all blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 20)
    data = list(enumerate(family(9, 100)))
    s = {i: shingles(t) for i, t in data}
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in itertools.combinations(s, 2):
        if 100 * len(s[x] & s[y]) >= 75 * len(s[x] | s[y]):
            up[max(top(x), top(y))] = min(top(x), top(y))
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in s}


# --- op10 ---


def passages(spark, data, parts=3, **with_):
    return marks(suffix_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(parts), **with_).collect(), data)


def test_one_word_said_often(spark):
    data = [(1, "ha " * 200), (2, "x " + "ha " * 200)]
    got = sorted((r.doc_id, r.first_word, r.n_words) for r in suffix_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(1, 0, 200), (2, 1, 200)]


@pytest.mark.parametrize("with_", [{}, {"hot": 30, "chunk": 11}])
def test_periodic_passages_equal_brute_force(spark, with_):
    rng, data = random.Random(3), []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            k = rng.choice([1, 1, 2, 3, 0])
            parts += ([f"p{k}{j}" for j in range(k)] * rng.randint(10, 160))[: rng.randint(20, 170)] if k else say(rng, rng.randint(5, 60), "ab")
        data.append((i, " ".join(parts)))
    tail = say(rng, 40)
    data += [(100, " ".join(["p10"] * 100 + tail)), (101, " ".join(["x", *["p10"] * 30, *tail])), (102, " ".join([*tail, *["p10"] * 28, "y"])), (103, " ".join([*tail, *["p10"] * 90]))]
    want = brute_passages(data, suffix_dedup.LEAST)
    assert passages(spark, data, **with_) == want
    assert sum(map(any, want.values())) > 25


def test_passages_do_not_depend_on_partitions(spark):
    """A stretch that 900 documents hold, cut into chunks far smaller than its suffixes."""
    rng = random.Random(9)
    footer = say(rng, 70)
    data = [(i, " ".join(say(rng, rng.randint(0, 9)) + footer[i % 7 :] + (say(rng, 3) if i % 2 else []))) for i in range(900)]
    found = []
    for n in (4, 50, 211):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found.append(passages(spark, data, 5, chunk=300))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] == found[2] == brute_passages(data, suffix_dedup.LEAST)


# --- the pipeline ---


def test_a_leak_without_an_id_goes(spark, tmp_path):
    item = " ".join(say(random.Random(2), 20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "x " + item, "a"), (None, "clean text", "b"), (3, item, "c"), (3, None, "d"), (3, "clean too", "e")], "doc_id long, text string, digest string")
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r.digest for r in got.collect()) == ["b", "d", "e"]
