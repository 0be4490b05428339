"""Fingerprints, importance resampling and alignment against brute force, on small tables with nulls, copies, long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import alignment, graph, importance, simhash

public_tokenizers = pytest.importorskip("public_tokenizers") if __import__("importlib").util.find_spec("public_tokenizers") else None
SCHEMA = "doc_id long, text string, fp long, key long, score double, n long, pair long, rank long, component_id long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts(seed=3, n=50):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgXYZé9ß") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    out = [say(rng.randint(3, 90)) for _ in range(n)]
    for i in range(0, n, 5):
        w = out[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out += [out[i], out[i].replace(" ", "\n\t "), " ".join(w), " ".join(w + ["more"])]
    return [*out, None, None, "", " \n ", "one", "Two words", "a-b_c d", "x" * 300 + " " + "y" * 48 + " " + "z" * 49, say(9000), "A " * 700, "<|endoftext|> and <s> 日本語 ▁ text\x00 😀  two", "don't ﬁne ｆｕｌｌ", "  spaces  "]


@pytest.fixture(scope="module")
def rows():
    data = [(i, t) for i, t in enumerate(texts())]
    return [*data, data[4], (7, "another text of a repeated id " * 9), (None, data[3][1]), (None, "text without an id " * 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 0.5, 3, 4, 5, 6) for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- op11 ---


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(nodes, linked):
    """The smallest node reachable from each, by following links."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprints_equal_brute_force(monkeypatch, rows):
    monkeypatch.setattr(simhash, "COUNTED", 100)
    got = simhash.fingerprints(pa.array([t for _, t in rows], pa.string()))
    assert got.tolist() == [fingerprint(t) for _, t in rows]


def test_simhash_components_equal_brute_force(spark, docs, rows):
    got = simhash.simhash_duplicates(docs).collect()
    named = [(i, fingerprint(t)) for i, t in rows if i is not None]
    links = [(i, j) for i, x in named for j, y in named if i < j and (x ^ y).bit_count() <= 3]
    want = smallest({i for i, _ in named}, links)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{fingerprint(t):016x}", want.get(i)) for i, t in rows)
    assert len(links) > 30


@pytest.mark.parametrize(("segments", "block"), [(4, 4096), (4, 6), (5, 50), (6, 4096), (8, 9)])
def test_links_connect_what_is_near_whatever_the_buckets(spark, segments, block):
    rng = random.Random(segments)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            # A chain of small steps, and some around its start.
            for _ in range(rng.randint(1, 5)):
                at ^= 1 << rng.randrange(64)
    prints |= {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p), rng.randint(1, 9)) for p in prints], "fp long, n long").repartition(3)
    edges = simhash.links(df, block=block, segments=segments)
    assert all(bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 64 for r in edges.collect())
    got = {r.node: r.component for r in graph.components(edges).collect()}
    want = smallest({signed(p) for p in prints}, [(signed(a), signed(b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    assert {p: got.get(p, p) for p in want} == want


def test_discarding_by_the_references_loses_no_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 3000, np.uint64)
    b = a.copy()
    for _ in range(5):
        flip = rng.random(3000) < 0.7
        b[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum(), np.uint64)
    both = np.concatenate([a, b])
    i, j = np.arange(3000), np.arange(3000) + 3000
    got = simhash.near(simhash.distances(both), both, i, j)
    assert got.tolist() == np.flatnonzero(np.bitwise_count(a ^ b) <= 3).tolist()


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.segments_for(n) for n in (0, 10**5, 10**7, 10**9, 10**10, 10**15)] == [4, 4, 5, 6, 6, 8]


def test_simhash_of_no_rows(empty):
    assert simhash.simhash_duplicates(empty).collect() == []


# --- op12 ---


def drawn(rows, target, longest=1, least=20, share=10, buckets=10_000):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for d in data for x in feats(d)[1]) for data in ([t for _, t in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + float(buckets)) / ((s[b] + 1.0) * (T + float(buckets)))))
    out, may = [], []
    for i, d in rows:
        n, f = feats(d)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                may.append((-score, i, len(f), weight))
        out.append((i, len(f), weight, score))
    may.sort()
    rank = {}
    for k, x in enumerate(may[: share * len(may) // 100]):
        rank.setdefault(x, []).append(k + 1)
    return Counter((*x, rank[key].pop(0) if x[3] is not None and rank.get(key := (-x[3], x[0], x[1], x[2])) else None) for x in out)


@pytest.mark.parametrize(("longest", "share"), [(1, 10), (2, 50), (3, 100), (1, 0)])
def test_resampling_equals_brute_force(spark, docs, rows, longest, share):
    target = [t for _, t in rows[:9]] + [None, "", "other words"]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, share=share).collect()
    assert Counter(tuple(r) for r in got) == drawn(rows, target, longest, share=share)


def test_crc_equals_the_library(monkeypatch):
    words = ["", "a", "é" * 30, "x" * 47, "x" * 48, "x" * 49, "日本" * 500, "plain"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    start = np.append(0, end[:-1])
    got = ~importance.advance(np.full(len(words), 0xFFFFFFFF, np.uint32), data, start, end)
    assert got.tolist() == [zlib.crc32(w.encode()) for w in words]


def test_resampling_of_empty_tables(spark, docs, rows, empty):
    nothing = spark.createDataFrame([], "text string")
    assert importance.resample(empty, nothing).collect() == []
    assert Counter(tuple(r) for r in importance.resample(docs, nothing).collect()) == drawn(rows, [])
    assert all(r.rank is None for r in importance.resample(docs.where("text is null"), nothing).collect())


def test_ties_of_a_score_go_to_smaller_ids(spark):
    same = spark.createDataFrame([(i, "word " * 20) for i in range(5000)], "doc_id long, text string").repartition(7)
    rows = importance.resample(same, spark.createDataFrame([("word",)], "text string"), share=50).where("rank is not null").orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, 2501))
    assert [(-r.score, r.doc_id) for r in rows] == sorted((-r.score, r.doc_id) for r in rows)
    assert len({r.score for r in rows}) < len(rows)


# --- op13 ---

needs_vocabularies = pytest.mark.skipif(public_tokenizers is None, reason="no vocabulary files")


def aligned(rows):
    """Per row, by loops over tokens: sums and the written groups."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from tokenizers.pre_tokenizers import ByteLevel

    # Every character stands for a byte: the library's own alphabet, found by encoding one byte at a time.
    letters = {}
    for code in (*range(0x00, 0x80), *range(0xA0, 0x800), *range(0x1000, 0x10000, 0x1000), 0x800, 0x10000, 0x50000, 0x90000, 0xD0000, 0x100000):
        letters |= zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0], chr(code).encode(), strict=True)
    out, held = [], Counter()
    for i, t in rows:
        a, b = [], []
        if t:
            e = first.encode(" " + t, add_special_tokens=False)
            a = [(x, bytes(letters[c] for c in w)) for x, w in zip(e.ids, e.tokens, strict=True)]
            for x in second.encode(t):
                p = second.id_to_piece(x)
                b.append((x, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()))
            if any(b"".join(w for _, w in x) != b" " + t.encode() for x in (a, b)):
                a, b = [], []
        spans = []
        for x in (a, b):
            at, own = 0, []
            for k, w in x:
                own.append((k, at, at + len(w)))
                at += len(w)
            spans.append(own)
        cuts = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        groups = [([], []) for _ in cuts]
        for side, x in enumerate(spans):
            for k, _, e in x:
                groups[bisect_left(cuts, e)][side].append(str(k))
        said = ";".join("|".join(map(",".join, g)) for g in groups)
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if s < v and u < e] if len(spans[0]) < 200 else _walked(*spans)
        held.update(set(links))
        out.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = Counter((i, a, b, g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), d) for i, a, b, g, links, d in out)
    return rows, {(x << 16 | y, n, n == most[x]) for (x, y), n in held.items()}


def _walked(a, b):
    out, j = [], 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


@needs_vocabularies
@pytest.mark.parametrize("ranks", [None, "byte_bpe_50k.tiktoken"])
def test_alignment_equals_loops(monkeypatch, docs, rows, ranks):
    monkeypatch.setattr(alignment, "PIECE", 900)
    monkeypatch.setattr(alignment, "HELD", 500)
    P = public_tokenizers
    got, pairs, tokens = alignment.token_alignment(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), ranks and P.path(ranks))
    want, counts = aligned(rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {tuple(r) for r in pairs.collect()} == counts
    assert sum(1 for r in want if not r[1]) >= 4
    texts = alignment.group_texts(tokens, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in texts) == Counter((k[0], k[7]) for k in want.elements())


@needs_vocabularies
def test_alignment_of_no_rows(empty):
    P = public_tokenizers
    got, pairs, tokens = alignment.token_alignment(empty, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert got.collect() == [] and pairs.collect() == [] and tokens.collect() == []
