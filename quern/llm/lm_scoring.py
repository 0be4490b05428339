"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped for scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharded import CELL, Shards, Sorted, cells, gathering, grouped, runs, shard_number, shard_of, small, totals, unpacked, write_sorted
from .shared import new_folder, ship, text_bytes
from .text import batches_of_words, mix, pair

#: Words of an n-gram, in the query and by default.
ORDER = 3
#: Words that no text holds: they contain spaces.
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Numbers of words: of the begin mark, of words that training never saw, of what fills an n-gram before the begin mark, of the first others.
AT_BEGIN, UNSEEN, FILL, FIRST = 0, 1, 2, 3
#: n-grams that a task gathers before it sends them on, and distinct words likewise.
GATHER, WORDS = 1_200_000, 3_000_000
#: Bytes of text scored at a time; shards from which they are more, as each piece of text visits every shard, and how many times as many at most.
PIECE, VISITS, PIECES = 1_000_000, 128, 4
#: Bytes of text to a shard.
SHARD_BYTES = 10 << 20
#: stats: n1, n2, n3, n4, the total of (adjusted) counts, entries.
STATS = 6


def sequences(w, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between begin and end marks: hashes, the document of each, its place in the document (0: begin)."""
    n = np.diff(w.first) + 2
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(n_docs), n)
    place = np.arange(first[-1]) - first[doc]
    seq = np.empty(first[-1], np.uint64)
    inner = (place > 0) & (place < n[doc] - 1)
    seq[inner], seq[first[:-1]], seq[first[1:] - 1] = w.hash, BEGIN, END
    return seq, doc, place


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """A hash of the numbers of an n-gram's words."""
    h = mix(words[0].astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    for c in words[1:]:
        h = pair(h, c.astype(np.uint64))
    return h


# --- n-grams as bytes ---


def folded(words: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams in order, and the sums of their values."""
    order = np.lexsort(words[::-1])
    words = [c[order] for c in words]
    at = runs(*words)
    return [c[at] for c in words], [small(np.add.reduceat(v[order].astype(np.int64), at)) if len(at) else v for v in values]


def _planes(x: np.ndarray) -> list[bytes]:
    """Numbers byte by byte, low bytes first, as far as the largest has any."""
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize)
    press = zstandard.ZstdCompressor(level=1).compress
    return [press(np.ascontiguousarray(flat[:, k]).tobytes()) for k in range(width)]


def coded(*columns: np.ndarray, n_words: int) -> bytes:
    """n-grams (their first columns) and values, row for row; each word as the step from the row before where all words before it are the same."""
    n = len(columns[0])
    columns = [c.astype("<u8" if c.dtype.itemsize == 8 else "<u4") for c in columns]
    same = np.ones(max(0, n - 1), bool)
    parts = []
    for c in columns[:n_words]:
        # Steps wrap around where shards of one cell begin again.
        step = c.copy()
        step[1:] -= np.where(same, c[:-1], c.dtype.type(0))
        same &= c[1:] == c[:-1]
        parts.append(_planes(step))
    parts += [_planes(v) for v in columns[n_words:]]
    sizes = [len(b) for p in parts for b in p]
    head = np.array([n, len(parts), *(len(p) * 16 + c.dtype.itemsize for p, c in zip(parts, columns, strict=True)), *sizes], np.int64)
    return np.int64(len(head)).tobytes() + head.tobytes() + b"".join(b for p in parts for b in p)


def decoded(blob: bytes, n_words: int) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, int(np.frombuffer(blob, np.int64, 1)[0]), 8)
    n, k = int(head[0]), int(head[1])
    sizes, at, out = iter(head[2 + k :]), 8 + head.nbytes, []
    raw = zstandard.ZstdDecompressor().decompress
    for kind in head[2 : 2 + k]:
        width, item = divmod(int(kind), 16)
        flat = np.zeros((n, item), np.uint8)
        for p in range(width):
            size = int(next(sizes))
            flat[:, p] = np.frombuffer(raw(blob[at : at + size]), np.uint8)
            at += size
        out.append(flat.view(f"<u{item}").ravel())
    new = np.zeros(n, bool)
    new[:1] = True
    for k in range(n_words):
        sums = np.cumsum(out[k], dtype=out[k].dtype)
        start = np.flatnonzero(new)
        out[k] = sums - np.repeat(sums[start] - out[k][start], np.diff(np.append(start, n)))
        new[1:] |= out[k][1:] != out[k][:-1]
    return out


def _codec(level: int):
    return (lambda *columns: coded(*columns, n_words=level)), (lambda blob: decoded(blob, level))


# --- the vocabulary ---


def _words(shards: Shards):
    def count(batches):
        keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            new = np.concatenate([keys, *held])
            return totals(new, np.concatenate([counts, np.ones(len(new) - len(keys), np.int64)]))

        for b in batches:
            for i, j, _, _, w in batches_of_words(b.column("text")):
                held += [w.hash, np.full(j - i, END)]
                size += len(w.hash) + j - i
                if size > GATHER:
                    keys, counts = merged()
                    held, size = [], 0
                    if len(keys) > WORDS:
                        yield cells(shard_of(keys, shards), shards, [keys, small(counts)])
                        keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield cells(shard_of(keys, shards), shards, [keys, small(counts)])

    return count


def _number(folder: str, shards: Shards):
    """Words of a shard numbered by falling count, shards in turn: frequent words have small numbers, which pack well."""

    def number(key, table):
        parts = [unpacked(b) for b in table["data"].to_pylist()]
        keys, n = totals(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        number = np.empty(len(keys), np.int64)
        number[np.lexsort((keys, -n))] = FIRST + np.arange(len(keys)) * int(shards) + key[0].as_py()
        write_sorted(folder, "word", key[0].as_py(), key=keys, number=small(number), n=small(n))
        return pa.table({"n": pa.array([int(n.sum())], pa.int64()), "words": pa.array([len(keys)], pa.int64())})

    return number


# --- n-grams ---


def _columns(seq: np.ndarray, place: np.ndarray, own: np.ndarray, level: int) -> list[np.ndarray]:
    """The words of the n-grams that end at `own`; FILL stands for those before the begin mark."""
    return [np.where(place[own] >= k, seq[np.maximum(own - k, 0)], seq.dtype.type(FILL)) if k else seq[own] for k in range(level - 1, -1, -1)]


def _by_shard(level: int, words: list[np.ndarray], values: list[np.ndarray], shards: Shards) -> pa.RecordBatch:
    """Cells of n-grams by the hash of the whole n-gram, so the successors of one context are in many shards."""
    where = shard_of(gram_hash(words), shards)
    order = np.argsort(where.astype(np.min_scalar_type(int(shards))), kind="stable")
    where, words, values = where[order], [c[order] for c in words], [c[order] for c in values]
    cut = [*runs(where), len(where)]
    # Added up shard by shard: short sorts are quicker than a long one.
    parts = [folded([c[a:b] for c in words], [c[a:b] for c in values]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    size = [len(w[0]) for w, _ in parts]
    return cells(np.repeat(where[cut[:-1]], size), shards, [np.concatenate(c) for c in zip(*([*w, *v] for w, v in parts), strict=True)], _codec(level)[0])


def _count(order: int, folder: str, shards: Shards):
    """Raw n-grams of the highest order; one that the begin mark cuts short is filled up in front."""

    def count(batches):
        vocabulary = Sorted(folder, "word", shards, ("number",))
        held, size = [], 0

        def flush():
            words = [np.concatenate(c) for c in zip(*held, strict=True)]
            return _by_shard(order, words, [np.ones(len(words[0]), np.uint8)], shards)

        for b in batches:
            for i, j, _, _, w in batches_of_words(b.column("text")):
                seq, _, place = sequences(w, j - i)
                u, inverse = np.unique(seq, return_inverse=True)
                # The begin mark is in no vocabulary, so its number is 0.
                seq = small(vocabulary.get(u)[0])[inverse]
                held.append(_columns(seq, place, np.flatnonzero(place > 0), order))
                size += len(seq)
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return count


def _stats(counts: np.ndarray) -> list[int]:
    return [*(int((counts == i).sum()) for i in (1, 2, 3, 4)), int(counts.sum(dtype=np.int64)), int((counts > 0).sum())]


def _kinds(types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and which one each row is: contexts with few successors look alike."""
    h = mix(types[:, 0].astype(np.uint64))
    for k in range(1, types.shape[1]):
        h = pair(h, types[:, k].astype(np.uint64))
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    return types[first], small(kind.ravel())


def _write_grams(folder: str, level: int, shard: int, words: list[np.ndarray], values: list[np.ndarray]) -> None:
    """n-grams of a shard by bits of their hash: buckets of about 16 by the higher ones, in each the lower 32 in order."""
    h = gram_hash(words)
    bits = max(0, int(len(h)).bit_length() - 5)
    bucket = (h >> np.uint64(32)) & np.uint64((1 << bits) - 1)
    order = np.lexsort((h.astype(np.uint32), bucket))
    first = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    columns = {"n": small(values[0][order])}
    if len(values) > 1:
        columns["types"], columns["kind"] = _kinds(np.stack([v[order] for v in values[1:]], 1))
    write_sorted(folder, f"grams{level}", shard, key=h[order].astype(np.uint32), first=first, stats=np.array(_stats(values[0]), np.int64), **columns)


class Grams(Sorted):
    """What _write_grams() wrote: n, and the context's total and numbers of successors with counts 1, 2 and more."""

    def __init__(self, folder: str, level: int, shards: Shards, types: bool):
        super().__init__(folder, f"grams{level}", shards, ("n", "types") if types else ("n",))

    def shard(self, s: int):
        own = super().shard(s)
        return own and own | ({"types": _Coded(own["types"], own["kind"])} if "kind" in own else {})

    def find(self, own, q):
        """A halving search inside the bucket of each key."""
        key, first = own["key"], own["first"]
        bucket = ((q >> np.uint64(32)) & np.uint64(len(first) - 2)).astype(np.int64)
        lo, hi, low = first[bucket].astype(np.int64), first[bucket + 1].astype(np.int64), q.astype(np.uint32)
        end = hi.copy()
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & (key[np.minimum(mid, len(key) - 1)] < low)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.where(lo < hi, mid, hi))
        hit = lo < end
        lo[~hit] = 0
        return lo, hit & (key[lo] == low)


class _Coded:
    """Rows of `types` picked by kind."""

    def __init__(self, types: np.ndarray, kind: np.ndarray):
        self.types, self.kind = types, kind
        self.dtype, self.shape = types.dtype, (len(kind), types.shape[1])

    def __getitem__(self, i):
        return self.types[self.kind[i]]


def _reduce(level: int, folder: str, shards: Shards):
    """Merge one level's shards into files, and send what it makes of the level below.

    Below, an n-gram without its first word has one more different word before it, and one without its last
    word, a context, has one more successor of this count: both are rows there, of count, total, and numbers
    of successors with counts 1, 2 and more. A filled n-gram passes its count on to the shorter one it stands for.
    """
    unpack = _codec(level)[1]

    def reduce(key, table):
        columns = [np.concatenate(c) for c in zip(*(unpack(b) for b in table["data"].to_pylist()), strict=True)]
        words, values = folded(columns[:level], columns[level:])
        del columns
        filled = words[0] == FILL
        _write_grams(folder, level, key[0].as_py(), *([c[~filled] for c in x] for x in (words, values)))
        n = values[0]
        full = np.flatnonzero(~filled & (n > 0))
        if level == 1:
            return pa.table({"shard": pa.array([], pa.int32()), "fine": pa.array([], pa.binary()), "data": pa.array([], pa.binary())})
        short = np.concatenate([np.flatnonzero(filled), full])
        below = [np.concatenate([a[short], b[full]]) for a, b in zip(words[1:], words[:-1], strict=True)]
        made = [np.where(filled[short], n[short], 1), *[np.zeros(len(short), np.uint8)] * 4], [np.zeros(len(full), np.uint8), n[full], *(x[full].view(np.uint8) for x in (n == 1, n == 2, n > 2))]
        del words
        return pa.Table.from_batches([_by_shard(level - 1, below, [np.concatenate(x) for x in zip(*made, strict=True)], shards)])

    return reduce


def _sums(folder: str, shards: Shards):
    """The stats of shards' files; number i is level i // shards + 1, shard i % shards."""

    def sums(batches):
        for b in batches:
            level, shard = np.divmod(b.column("id").to_numpy(), int(shards))
            found = [Sorted(folder, f"grams{k + 1}", shards, ()).shard(int(s)) for k, s in zip(level, shard, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(level + 1, pa.int32()), pa.array([[0] * STATS if x is None else x["stats"].tolist() for x in found], pa.list_(pa.int64()))], ["level", "stats"])

    return sums


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams with counts 1 to 4; plain steps where those are too few."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else -1
        out.append(d if 0 < d < i else 0.5 * i)
    return out


class Model:
    """The counted model: a folder of sorted arrays and a few totals. Probabilities are made from counts when asked for."""

    def __init__(self, folder: str, order: int, shards: Shards, train_tokens: int, train_words: int, stats: dict[int, list[int]]):
        self.folder, self.order, self.shards, self.stats = folder, order, shards, stats
        self.train_tokens, self.train_words = train_tokens, train_words
        self.tables: dict = {}

    def table(self, level: int) -> Sorted:
        if level not in self.tables:
            self.tables[level] = Grams(self.folder, level, self.shards, level < self.order) if level else Sorted(self.folder, "word", self.shards, ("number", "n"))
        return self.tables[level]

    def __getstate__(self):
        return self.__dict__ | {"tables": {}}

    def score(self, w, n_docs: int) -> tuple[np.ndarray, ...]:
        """Of each document: tokens, known tokens, base score, log10 probability."""
        seq, doc, place = sequences(w, n_docs)
        words, inverse = np.unique(seq, return_inverse=True)
        number, raw = self.table(0).get(words)
        number = np.where((raw > 0) | (words == BEGIN), number, UNSEEN)
        base = np.log10((raw + 1) / (self.train_tokens + self.train_words + 1.0))
        n = self.stats.get(1, [0] * STATS)
        d = np.array([0.0, *discounts(n)])
        found = self.table(1).get(gram_hash([number]))
        count, total = found[0], n[4]
        left = d[1] * n[0] + d[2] * n[1] + d[3] * (n[5] - n[0] - n[1])
        p = ((np.maximum(count - d[np.minimum(count, 3)], 0) + left / (n[5] + 1)) / total if total else np.full(len(words), 1.0 / (n[5] + 1)))[inverse]
        seq, at = small(number)[inverse], np.arange(len(seq))
        # Of the n-gram that ends at each place, as the context of the next one: its total and successors.
        types = found[1][inverse] if self.order > 1 and found[1].ndim == 2 else None
        for level in range(2, self.order + 1):
            d = np.array([0.0, *discounts(self.stats.get(level, [0] * STATS))])
            at = np.flatnonzero(place >= level - 1)
            found = self.table(level).get(gram_hash(_columns(seq, place, at, level)))
            if types is not None:
                context = types[at - 1] if level == 2 else types[where[at - 1]]
                sums = context[:, 0].astype(np.float64)
                rest = (context[:, 1:] @ d[1:]) / np.maximum(sums, 1)
                here = np.maximum(found[0] - d[np.minimum(found[0], 3)], 0) / np.maximum(sums, 1) + rest * p[at]
                p[at] = np.where(sums > 0, here, p[at])
            if level < self.order:
                types = found[1] if found[1].ndim == 2 else None
                where = np.zeros(len(seq), np.int64)
                where[at] = np.arange(len(at))
        own = np.flatnonzero(place > 0)
        by = np.searchsorted(doc[own], np.arange(n_docs))
        add = lambda x: np.add.reduceat(x[own], by) if n_docs else np.zeros(0)
        return add(np.ones(len(seq), np.int64)), add((raw > 0)[inverse].astype(np.int64)), add(base[inverse]), add(np.log10(p))


def train(texts: DataFrame, order: int = ORDER, text: str = "text") -> Model:
    """Count the n-grams of `text`, each text followed by an end mark, into files under the shared folder.

    Level n of the model has adjusted counts: at the highest level, and where a text begins, how often an
    n-gram occurs; below, how many different words stand before it. A first scan counts and numbers the words.
    A second sends n-grams of word numbers by shard; each level is merged in an exchange of its own and sends
    the level below its continuation counts and, of each context, how many successors have counts 1, 2 and
    more. n-grams are dealt by the hash of all their words, so no context, however frequent, is one task's.
    Only totals reach the driver. Shards follow the input's size, and all counts cover all texts. Null is empty.
    """
    spark = texts.sparkSession
    ship(spark)
    rows = texts.select(F.col(text).alias("text"))
    size = text_bytes(rows)
    shards, folder = shard_number(size, SHARD_BYTES), new_folder(spark, "lm")
    tokens, words = grouped(gathering(rows, size).mapInArrow(_words(shards), CELL), shards).applyInArrow(_number(folder, shards), "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = rows.mapInArrow(_count(order, folder, shards), CELL)
    for level in range(order, 0, -1):
        pack, unpack = _codec(level)
        df = grouped(df, shards, pack, unpack).applyInArrow(_reduce(level, folder, shards), CELL)
    df.agg(F.count("*")).first()
    sums = spark.range(order * shards).mapInArrow(_sums(folder, shards), "level int, stats array<long>").groupBy("level").agg(F.array(*[F.sum(F.element_at("stats", i + 1)) for i in range(STATS)]).alias("s")).collect()
    return Model(folder, order, shards, tokens, words, {r["level"]: list(r["s"]) for r in sums})


def _score(model: Model):
    piece = PIECE * min(PIECES, -(-int(model.shards) // VISITS))

    def score(batches):
        for b in batches:
            parts = [model.score(w, j - i) for i, j, _, _, w in batches_of_words(b.column("text"), piece)]
            n, known, base, log10 = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(4))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.train_tokens, np.int64)), pa.array(base.astype(np.float64)), pa.array(log10.astype(np.float64))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def lm_scores(documents: DataFrame, held_out, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows that the Column `held_out` does not mark, score all rows.

    doc_id, held_out, n_tokens (words and one end mark), n_known (of those seen in training), train_tokens,
    base_score (unigrams with one added), score (log10 of the model's probability). Null text is empty and
    has one token; null ids train and are scored; repeated rows count each time; without training text every
    token has probability 1 / (words + 1) = 1; empty input gives no rows; other columns are ignored.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    model = train(rows.where(~F.col("held_out")).select("text"), order)
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def crc_is(doc_id: str, modulus: int, remainder: int):
    """crc32 of an id as text leaves `remainder`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc_is("doc_id", 7, 2))
