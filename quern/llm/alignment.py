"""Alignment of two tokenizers: common cuts of their tokens' bytes, links of overlapping tokens, and how many documents link each pair of ids."""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, saved, ship
from .sharded import Shards, Sorted, runs, shard_number, shard_of, totals, write_sorted
from .text import mix, pieces
from .token_counts import USUAL

#: Bytes of text whose links are handled at a time; pairs a task holds before it folds them; salts of the first exchange of sums.
PIECE, HELD, SALTS = 400_000, 2_000_000, 16
#: Bytes of a shard of pairs: 9 for each.
SHARD_BYTES = 9 << 20
DOC = "doc_id long, a binary, b binary, n_groups long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself where it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokens of a byte-level vocabulary of the tokenizers library; strings of special tokens are plain text.

    With the same vocabulary as ranks, usual texts go through the faster tiktoken, which gives the same ids.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.exact.encode_special_tokens = True
        letters = byte_letters()
        entries = self.exact.get_vocab(with_added_tokens=True)
        self.entries = [b""] * (max(entries.values()) + 1)
        for word, i in entries.items():
            self.entries[i] = bytes(map(letters.get, word)) if all(c in letters for c in word) else word.encode()
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast, self.odd = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), re.compile(USUAL).search

    def encode(self, text: str) -> list[int]:
        text = " " + text
        return self.exact.encode(text, add_special_tokens=False).ids if not self.fast or self.odd(text) else self.fast.encode_ordinary(text)


class Pieces:
    """Tokens of a sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entries = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.entries.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", piece) else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def lengths(entries: list[bytes]) -> np.ndarray:
    return np.array([len(e) for e in entries], np.int64)


def groups_of(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens of both end, and the group of each token. Documents stand one after the other: where one ends, both end."""
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)


def links_of(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of every two tokens whose bytes overlap."""
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    first, last = np.searchsorted(end_b, end_a - len_a[a], "right"), np.searchsorted(end_b - len_b[b], end_a, "left")
    n = last - first
    i = np.repeat(np.arange(len(a)), n)
    return i, np.arange(len(i)) + np.repeat(first - (np.cumsum(n) - n), n)


def decimals(n: int) -> np.ndarray:
    """(n, width + 1) bytes: the numbers below n in decimal from the left, zeros behind; the last place is for what follows."""
    width = len(str(n))
    return np.array([str(i).encode() for i in range(n)], f"S{width + 1}").view(np.uint8).reshape(n, width + 1)


def written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as `a1,a2|b1;a3|b2,b3;`, and where the text of each group ends."""
    side = np.repeat([0, 1], [len(a), len(b)])
    group = np.concatenate([group_a, group_b])
    order = np.argsort(2 * group + side, kind="stable")
    group, side = group[order], side[order]
    out = table[np.concatenate([a, b])[order]]
    after = np.full(len(out), ord(","), np.uint8)
    last = np.append(group[1:] != group[:-1], True)[: len(group)]
    after[:-1][side[1:] != side[:-1]] = ord("|")
    after[last] = ord(";")
    out[:, -1] = after
    return out[out > 0], np.cumsum((out > 0).sum(1))[last]


def _tokens(path_a: str, ranks_path: str | None, path_b: str):
    """Ids of both tokenizers of each text, and its groups; no ids where the tokens' bytes are not the text's."""

    def scan(batches):
        tools = None
        for batch in batches:
            if tools is None:
                first, second = ByteLevel(path_a, ranks_path), Pieces(path_b)
                tools = first, second, lengths(first.entries), lengths(second.entries), decimals(max(len(first.entries), len(second.entries)))
            first, second, len_a, len_b, table = tools
            text = batch.column("text")
            size = pa.compute.binary_length(text).fill_null(0).cast(pa.int64()).to_numpy()
            for lo, hi in pieces(np.append(0, np.cumsum(size)), PIECE):
                ids: list = [[], []]
                for t in text.slice(lo, hi - lo).to_pylist():
                    own = ([], [])
                    if t:
                        own = first.encode(t), second.encode(t)
                        raw = b" " + t.encode()
                        if any(b"".join(map(tool.entries.__getitem__, x)) != raw for tool, x in zip((first, second), own, strict=True)):
                            own = ([], [])
                    for x, y in zip(ids, own, strict=True):
                        x.append(np.array(y, np.int32))
                a, b = map(np.concatenate, ids)
                cuts, group_a, group_b = groups_of(a, b, len_a, len_b)
                said, ends = written(a, b, group_a, group_b, table)
                said = said.tobytes()
                # Groups of each document: those up to its last token's.
                many = np.array([len(x) for x in ids[0]])
                upto = np.append(0, np.append(0, group_a + 1)[np.cumsum(many)])
                upto = np.maximum.accumulate(upto)
                at = np.append(0, ends)[upto]
                digest = [hashlib.sha256(said[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                kept = [pa.array([x.astype(np.uint16).tobytes() for x in own], pa.binary()) for own in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *kept, pa.array(np.diff(upto)), pa.array(digest, pa.string())], ["doc_id", "a", "b", "n_groups", "groups_sha256"])

    return scan


def _unpacked(batch: pa.RecordBatch):
    """(first row, end row, ids a, ids b, document of each a) of pieces of a batch."""
    flat, off = {}, {}
    for c in "ab":
        column = batch.column(c).cast(pa.large_binary())
        off[c] = (np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) // 2
        flat[c] = np.frombuffer(column.buffers()[2] or b"", np.uint16)
    for lo, hi in pieces(off["a"] - off["a"][0], PIECE // 2) if batch.num_rows else ():
        a, b = (flat[c][off[c][lo] : off[c][hi]].astype(np.int64) for c in "ab")
        yield lo, hi, a, b, np.repeat(np.arange(hi - lo), np.diff(off["a"][lo : hi + 1]))


def _group_texts(len_a: np.ndarray, len_b: np.ndarray):
    """The groups of each document as text, from its ids."""

    def scan(batches):
        table = decimals(max(len(len_a), len(len_b)))
        for batch in batches:
            for lo, hi, a, b, doc in _unpacked(batch):
                _, group_a, group_b = groups_of(a, b, len_a, len_b)
                said, ends = written(a, b, group_a, group_b, table)
                said = said.tobytes()
                upto = np.maximum.accumulate(np.append(0, np.append(0, group_a + 1)[np.searchsorted(doc, np.arange(hi - lo), "right")]))
                at = np.append(0, ends)[upto].tolist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([said[x : max(x, y - 1)].decode() for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())], ["doc_id", "groups"])

    return scan


def group_texts(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, groups of token_alignment's tokens: `a1,a2|b1;a3|b2,b3`, the ids of both tokenizers between common cuts; empty without tokens."""
    len_a, len_b = lengths(ByteLevel(path_a).entries), lengths(Pieces(path_b).entries)
    return tokens.mapInArrow(_group_texts(len_a, len_b), "doc_id long, groups string")


def _pairs_by_document(len_a: np.ndarray, len_b: np.ndarray):
    """pair, salt, n: documents of the task that hold each pair linked, folded before they are sent."""

    def scan(batches):
        held: list = []
        size = 0

        def folded():
            return totals(np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held]))

        for batch in batches:
            for _, _, a, b, doc in _unpacked(batch):
                i, j = links_of(a, b, len_a, len_b)
                # A document counts a pair once.
                one = np.unique((doc[i] << 32) | (a[i] << 16) | b[j]) & 0xFFFFFFFF
                held.append(np.unique(one, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [folded()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from sent(*held[0])
                        held, size = [], 0
        if held:
            yield from sent(*folded())

    def sent(pair, n):
        salt = int(pair[:1].sum() + n.sum()) % SALTS
        for at in range(0, len(pair), 1 << 16):
            p = pair[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.full(len(p), salt, np.int32)), pa.array(n[at : at + (1 << 16)])], ["pair", "salt", "n"])

    return scan


def pair_counts(tokens: DataFrame, len_a: np.ndarray, len_b: np.ndarray) -> DataFrame:
    """pair (a << 16 | b), n, best (n is the highest of its a): how many documents link each two ids.

    Tasks fold their own documents, sums are made by pair and salt, then by pair. There are at most as many highest
    counts as the first tokenizer has ids.
    """
    parts = tokens.mapInArrow(_pairs_by_document(len_a, len_b), "pair long, salt int, n long")
    sums = saved(parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    own = F.shiftright("pair", 16)
    most = sums.groupBy(own.alias("id")).agg(F.max("n").alias("most"))
    return sums.join(F.broadcast(most), own == F.col("id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _deal(shards: Shards):
    def deal(batches):
        for b in batches:
            where = shard_of(mix(b.column("pair").to_numpy().view(np.uint64)), shards)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *b.columns], ["shard", *b.schema.names])

    return deal


def _write(folder: str):
    def write(key, t):
        h = mix(t["pair"].to_numpy().view(np.uint64))
        order = np.argsort(h)
        write_sorted(folder, "pair", key[0].as_py(), key=h[order], n=t["n"].to_numpy()[order], best=t["best"].to_numpy(zero_copy_only=False)[order])
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    return write


def _score(folder: str, shards: Shards, len_a: np.ndarray, len_b: np.ndarray):
    def scan(batches):
        known = Sorted(folder, "pair", shards, ("n", "best"))
        for batch in batches:
            n = {c: np.diff(np.frombuffer((x := batch.column(c).cast(pa.large_binary())).buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]) // 2 for c in "ab"} if batch.num_rows else {"a": [], "b": []}
            many, best, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, a, b, doc in _unpacked(batch):
                i, j = links_of(a, b, len_a, len_b)
                pair, back = np.unique((a[i] << 16) | b[j], return_inverse=True)
                count, top = known.get(mix(pair.view(np.uint64)))
                own = doc[i]
                cut = runs(own)
                for out, x in ((many, np.ones(len(i), np.int64)), (best, top[back]), (total, count[back])):
                    if len(cut):
                        out[lo + own[cut]] = np.add.reduceat(x, cut)
            values = [batch.column("doc_id"), *(pa.array(np.asarray(x, np.int64)) for x in (n["a"], n["b"])), batch.column("n_groups"), *map(pa.array, (many, best, total)), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return scan


def token_alignment(documents: DataFrame, path_a: str, path_b: str, ranks_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: of every row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; pair, n, best of all id pairs; and
    of every row its ids (a, b: 16 bits each), of which group_texts() writes the groups.

    A (a byte-level vocabulary of the tokenizers library) encodes a space and the text, B (a sentencepiece model) the text,
    to which it adds a space. Places where tokens of both end cut them into groups; tokens whose bytes overlap are linked.
    A pair's count is the number of rows that hold it linked; n_best are a row's links whose count is the highest of their A
    id, count_sum adds the counts of its links. Ids are below 65,536.

    Null and empty texts, and those whose tokens' bytes are not the text's (B changes some characters), have no tokens: zeros and an
    empty digest. Rows that repeat an id are documents of their own; null ids stay; empty input gives no rows; other
    columns are ignored.

    Texts are encoded once; ids are written to the shared folder, and read for the counts and for the sums. Counts are
    sorted arrays that tasks map, so no link is shuffled.
    """
    spark = documents.sparkSession
    ship(spark)
    len_a, len_b = lengths(ByteLevel(path_a).entries), lengths(Pieces(path_b).entries)
    if max(len(len_a), len(len_b)) > 1 << 16:
        raise ValueError("ids must be below 65,536")
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = saved(rows.mapInArrow(_tokens(path_a, ranks_path, path_b), DOC), "align-tokens")
    pairs = pair_counts(tokens, len_a, len_b)
    shards, folder = shard_number(9 * pairs.count(), SHARD_BYTES), new_folder(spark, "align-counts")
    dealt = pairs.mapInArrow(_deal(shards), "shard int, pair long, n long, best boolean").repartitionById(shards, F.col("shard"))
    dealt.groupBy("shard").applyInArrow(_write(folder), "n long").agg(F.sum("n")).collect()
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return tokens.mapInArrow(_score(folder, shards, len_a, len_b), schema), pairs, tokens


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"))[0]
