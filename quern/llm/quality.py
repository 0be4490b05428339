"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import DIGITS, SAMPLE_ROWS, sample, times
from .lm_scoring import crc_is
from .sharded import CELL, Shards, Sorted, cells, gathering, grouped, packed, runs, shard_number, shard_of, unpacked, write_sorted
from .shared import new_folder, saved, ship, text_bytes
from .text import SPACE, Words, batches_of_words, mix

#: Dimensions of word vectors, non-zero places of an index vector, words to either side that count as context.
DIM, PLACES, REACH = 32, 4, 2
#: Words seen at least so often have a vector from the whole corpus, at every size; a rarer one has that of its context where it stands.
COMMON = 8
#: New words held before they are merged, those with context sums likewise; distinct ones, and those with context sums, that a task adds up before it sends them on.
GATHER, HELD, DISTINCT, SUMMED = 600_000, 120_000, 3_000_000, 350_000
HIDDEN, ROUNDS, SEED = 24, 400, 7
#: Bytes of text at a time: arrays have a row of DIM numbers for each word.
PIECE = 500_000


def _classes() -> np.ndarray:
    """Kinds of bytes in a word's shape: upper, lower (and beyond ASCII), digits; others stand for themselves."""
    kind = np.arange(256, dtype=np.uint8)
    kind[65:91], kind[97:123], kind[128:], kind[48:58] = 65, 97, 97, 48
    return kind


KIND = _classes()


def shapes(data: np.ndarray, w: Words) -> Words:
    """Words replaced by their shapes: kinds of bytes, a repeated kind once ("Ab12!!" as "Aa0!")."""
    kind = KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    new &= ~SPACE[data]
    at = np.flatnonzero(new)
    step = mix(kind[at].astype(np.uint64) + np.uint64(77))
    order = np.searchsorted(at, w.start)
    place = np.arange(len(at)) - np.repeat(order, np.diff(np.append(order, len(at))))
    h = np.add.reduceat(mix(step + place.astype(np.uint64)), order) if len(order) else np.zeros(0, np.uint64)
    return w._replace(hash=mix(h))


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, all different, and signs of the non-zero values of words' index vectors, drawn from their hashes."""
    h = mix(h ^ np.uint64(0x5DEECE66D1234567))
    place = np.zeros((len(h), PLACES), np.int64)
    for i in range(PLACES):
        # One of the places still free, counted from the left.
        p = ((h >> np.uint64(8 * i)) % np.uint64(DIM - i)).astype(np.int64)
        for taken in np.sort(place[:, :i], axis=1).T:
            p += p >= taken
        place[:, i] = p
    sign = np.stack([(h >> np.uint64(40 + i)) & np.uint64(1) for i in range(PLACES)], 1).astype(np.float64) * 2 - 1
    return place, sign


def contexts(w: Words, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Sums of the index vectors of the words near each occurrence, by the row given to it (-1: none)."""
    place, sign = index_vectors(w.hash)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    places, signs = [], []
    for d in range(1, REACH + 1):
        for a, b in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            own = (doc[a] == doc[b]) & (row[a] >= 0)
            places.append((row[a][own] * DIM)[:, None] + place[b][own])
            signs.append(sign[b][own])
    return np.bincount(np.concatenate(places).ravel(), np.concatenate(signs).ravel(), n_rows * DIM).reshape(n_rows, DIM)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None]


def _streams(column):
    """(first row, end row, words and their shapes) of pieces of a column."""
    for i, j, data, _, w in batches_of_words(column, PIECE):
        yield i, j, (w, shapes(data, w))


def folded(v: np.ndarray) -> np.ndarray:
    """Whole numbers as bytes, low bytes of all first, signs in the lowest bit: high bytes, mostly zero, pack to nothing."""
    z = ((v << 1) ^ (v >> 31)).astype(np.uint32).ravel()
    width = max(1, (int(z.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(z.view(np.uint8).reshape(-1, 4).T[:width]).ravel()


def unfolded(b: np.ndarray, n: int) -> np.ndarray:
    z = sum(p.astype(np.int64) << 8 * i for i, p in enumerate(b.reshape(-1, n)))
    return (z >> 1) ^ -(z & 1)


def _low(keys: np.ndarray) -> bytes:
    """Sorted numbers byte by byte: their high bytes hardly change and pack to nothing."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 4).T).ravel()


def pack_counts(low: np.ndarray, counts: np.ndarray) -> bytes:
    return packed(_low(low), counts.astype(np.uint8))


def unpack_counts(blob: bytes) -> list[np.ndarray]:
    low, counts = unpacked(blob)
    return [np.ascontiguousarray(low.reshape(4, -1).T).view(np.uint32).ravel(), counts]


def pack_sums(low: np.ndarray, sums: np.ndarray) -> bytes:
    return packed(_low(low), folded(sums))


def unpack_sums(blob: bytes) -> list[np.ndarray]:
    low, sums = unpack_counts(blob)
    return [low, unfolded(sums, DIM * len(low)).reshape(-1, DIM)]


def _by_shard(keys: np.ndarray, shards: Shards, value: np.ndarray, pack) -> pa.RecordBatch:
    """Cells of the low halves of sorted keys and their values: inside a shard of the high halves, 32 bits tell a corpus's words apart."""
    return cells(shard_of(keys, shards), shards, [keys.astype(np.uint32), value], pack)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their values (rows)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    if values.ndim == 1 or not len(at):
        return keys[at], np.add.reduceat(values[order], at) if len(at) else values
    out = np.empty((len(at), values.shape[1]), values.dtype)
    for c in range(0, values.shape[1], 8):
        out[:, c : c + 8] = np.add.reduceat(values[order, c : c + 8], at, axis=0)
    return keys[at], out


class Sums:
    """Sums by key. Keys that it has are added in place, new ones are held and merged from time to time."""

    def __init__(self, none: np.ndarray):
        self.keys, self.sums, self.new, self.held = np.zeros(0, np.uint64), none, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys and their values."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.sums[at[hit]] += values[hit]
        self.new.append((keys[~hit], values[~hit]))
        self.held += len(self.new[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, and their sums."""
        if self.held:
            keys, values = zip(*self.new, strict=True)
            self.keys, self.sums = summed(np.concatenate([self.keys, *keys]), np.concatenate([self.sums, *values]))
        self.new, self.held = [], 0
        return self.keys, self.sums


def _count(shards: Shards):
    def count(batches):
        seen = Sums(np.zeros(0, np.int64))
        for b in batches:
            for _, _, streams in _streams(b.column("text")):
                for w in streams:
                    seen.add(*np.unique(w.hash, return_counts=True))
                if seen.held > GATHER and len(seen.merged()[0]) > DISTINCT:
                    yield _by_shard(seen.keys, shards, np.minimum(seen.sums, COMMON), pack_counts)
                    seen = Sums(np.zeros(0, np.int64))
        keys, counts = seen.merged()
        yield _by_shard(keys, shards, np.minimum(counts, COMMON), pack_counts)

    return count


def _common(folder: str):
    def common(key, table):
        low, counts = zip(*map(unpack_counts, table["data"].to_pylist()), strict=True)
        k, n = summed(np.concatenate(low), np.concatenate(counts).astype(np.int64))
        k = k[n >= COMMON]
        write_sorted(folder, "common", key[0].as_py(), key=k, one=np.ones(len(k), np.uint8))
        return pa.table({"n": pa.array([len(k)], pa.int64())})

    return common


def _vectors(folder: str, shards: Shards):
    """Context sums of common words, added up over a task's texts."""

    def vectors(batches):
        known = Sorted(folder, "common", shards, ("one",))
        none = np.zeros((0, DIM), np.int32)
        seen = Sums(none)
        for b in batches:
            for _, _, streams in _streams(b.column("text")):
                for w in streams:
                    u, at = np.unique(w.hash, return_inverse=True)
                    own = known.get(u.astype(np.uint32), u)[0] > 0
                    row = np.where(own, np.cumsum(own) - 1, -1)
                    seen.add(u[own], contexts(w, row[at], int(own.sum())).astype(np.int32))
                if seen.held > HELD and len(seen.merged()[0]) > SUMMED:
                    yield _by_shard(seen.keys, shards, seen.sums, pack_sums)
                    seen = Sums(none)
        keys, sums = seen.merged()
        yield _by_shard(keys, shards, sums, pack_sums)

    return vectors


def _write_vectors(folder: str):
    def write(key, table):
        low, sums = zip(*map(unpack_sums, table["data"].to_pylist()), strict=True)
        k, v = summed(np.concatenate(low), np.concatenate(sums))
        write_sorted(folder, "vector", key[0].as_py(), key=k, v=unit(v.astype(np.float64)).astype(np.float32))
        return pa.table({"n": pa.array([len(k)], pa.int64())})

    return write


class Vectors:
    """Word vectors in the shared folder, and documents pooled by them."""

    def __init__(self, folder: str, shards: Shards):
        self.folder, self.shards = folder, shards

    def pool(self, column) -> np.ndarray:
        """A row for each text: means of word and shape vectors, how concentrated they are, and the length."""
        known = Sorted(self.folder, "vector", self.shards, ("v",))
        out = []
        for i, j, streams in _streams(column):
            n = np.diff(streams[0].first)
            parts = [np.log1p(n)[:, None]]
            for w in streams:
                u, at = np.unique(w.hash, return_inverse=True)
                (v,) = known.get(u.astype(np.uint32), u)
                v = v if v.ndim == 2 else np.zeros((len(u), DIM))
                rare = ~v.any(1)
                token = v[at].astype(np.float32)
                own = np.flatnonzero(rare[at])
                row = np.full(len(at), -1)
                row[own] = np.arange(len(own))
                token[own] = unit(contexts(w, row, len(own)))
                doc = np.repeat(np.arange(j - i), n)
                some = n > 0
                mean = np.zeros((j - i, DIM))
                if some.any():
                    mean[some] = np.add.reduceat(token, w.first[:-1][some], dtype=np.float64) / n[some][:, None]
                place, sign = index_vectors(w.hash)
                raw = sum(np.bincount(doc * DIM + place[:, k], sign[:, k], (j - i) * DIM) for k in range(PLACES)).reshape(-1, DIM) / np.maximum(n, 1)[:, None]
                seen = np.unique(doc.astype(np.int64) * len(u) + at) // max(1, len(u)) if len(u) else doc
                parts += [mean, (mean * mean).sum(1)[:, None], (raw * raw).sum(1)[:, None], (np.bincount(seen, minlength=j - i) / np.maximum(n, 1))[:, None]]
            out.append(np.concatenate(parts, 1))
        return np.concatenate(out) if out else np.zeros((0, 2 * DIM + 7))


def random_index(texts: DataFrame, text: str = "text") -> Vectors:
    """Word vectors from the contexts of all words of all texts: two scans, each merged by shards of word hashes."""
    ship(texts.sparkSession)
    rows = texts.select(F.col(text).alias("text"))
    size = text_bytes(rows)
    shards, folder, rows = shard_number(size), new_folder(texts.sparkSession, "words"), gathering(rows, size)
    grouped(rows.mapInArrow(_count(shards), CELL), shards, pack_counts, unpack_counts).applyInArrow(_common(folder), "n long").agg(F.sum("n")).collect()
    grouped(rows.mapInArrow(_vectors(folder, shards), CELL), shards, pack_sums, unpack_sums).applyInArrow(_write_vectors(folder), "n long").agg(F.sum("n")).collect()
    return Vectors(folder, shards)


class Network:
    """tanh layer and logistic output over standardised inputs; logits are divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        self.temperature = 1.0
        turn = rng.permutation(len(x))
        kept, fit = turn[: len(x) // 5], turn[len(x) // 5 :]
        z, t = (x[fit] - self.mean) / self.spread, y[fit]
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m = [np.zeros_like(a) for a in self.p]
        s = [np.zeros_like(a) for a in self.p]
        for step in range(1, ROUNDS + 1):
            own = rng.choice(len(z), min(len(z), 2048), replace=False)
            h = np.tanh(z[own] @ self.p[0] + self.p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - t[own]) / len(own)
            back = d[:, None] * self.p[2] * (1 - h * h)
            for k, g in enumerate((z[own].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ d + 1e-4 * self.p[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        if len(kept):
            logit = self.logit(x[kept])
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(y[kept] > 0, -1, 1) * logit / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return times(np.tanh(times((x - self.mean) / self.spread, self.p[0]) + self.p[1]), self.p[2][:, None])[:, 0] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30))), DIGITS)


class Constant:
    """Where labels are of one kind or none."""

    def __init__(self, p: float):
        self.p = p

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def _pool(vectors: Vectors):
    def pool(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(vectors.pool(b.column("text")).tolist(), pa.list_(pa.float64())), b.column("label")], ["x", "label"])

    return pool


def _score(vectors: Vectors, network, least: float):
    def score(batches):
        for b in batches:
            p = network.score(vectors.pool(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def quality(documents: DataFrame, labels: DataFrame, held_out, least: float = 0.3, most: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `least` on) of every row.

    Words and their shapes have random-indexing vectors from all texts; a document's are averaged and go
    through a two-layer network fitted on at most `most` labelled rows that the Column `held_out` (of an id)
    does not mark, with a temperature set on a fifth of them kept apart. Null and empty texts pool to zeros
    and get the network's score for that; with labels of one kind every score is their mean, with none 0.5;
    null ids are scored; rows that repeat an id are scored each; other columns are ignored.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    vectors = random_index(rows)
    chosen = sample(rows.select("doc_id", "text"), labels, label, ~held_out, most)
    # The sample is bounded, and so are its pooled rows on the driver.
    seen = saved(chosen.mapInArrow(_pool(vectors), "x array<double>, label int"), "quality-sample").toArrow()
    y = seen["label"].to_numpy().astype(np.float64)
    if len(y) and 0 < y.mean() < 1:
        x = seen["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
        network = Network(x[o := np.lexsort((*x.T[:3], y))], y[o])
    else:
        network = Constant(float(y.mean()) if len(y) else 0.5)
    return rows.mapInArrow(_score(vectors, network, least), "doc_id long, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_is("doc_id", 5, 0))
