"""Byte-level BPE encoding with a segment tree over the ranks of adjacent pairs.

Each pre-token has a tree whose leaves are its positions; a leaf holds the rank of the pair that begins there,
with the position below it, and a node the least of its children. The root so yields the leftmost pair of lowest
rank; a merge changes three leaves and the paths above them, and encoding ends when the root holds no pair.
Trees of like width are worked on together, as rows of a numpy array: one step merges the best pair of every
pre-token that still has one. A pre-token of more than ``LONG`` bytes has the same tree in a list of its own, so
that its time is in proportion to its merges. Workers keep the pre-tokens they have met.

Encoding and decoding are one pass over every whole text each, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, prefix, slices, span_hash, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 62)
CACHE_TOKENS = 1_000_000
LONG = 2048  # pre-tokens of more bytes are worked on one by one


@dataclass
class Bpe:
    token_bytes: np.ndarray  # all tokens, one after the other by id
    token_at: np.ndarray
    pair_keys: np.ndarray  # sorted (left << 32 | right)
    pair_ids: np.ndarray
    whole_keys: np.ndarray  # sorted hashes of whole tokens
    whole_ids: np.ndarray
    byte_ids: np.ndarray
    pattern: str = PATTERN
    digest: bytes = b""  # of all that decides an encoding

    def __post_init__(self):
        if not self.digest:
            parts = [x.tobytes() for x in (self.token_bytes, self.token_at, self.pair_keys, self.pair_ids, self.byte_ids)]
            self.digest = hashlib.sha256(b"".join([*parts, self.pattern.encode()])).digest()

    def pair_ranks(self) -> dict[int, int]:
        if "_ranks" not in self.__dict__:
            self._ranks = dict(zip(self.pair_keys.tolist(), self.pair_ids.tolist()))
        return self._ranks

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ranks"}


def bpe(ranks: dict[bytes, int], pattern: str = PATTERN) -> Bpe:
    by_id = sorted(ranks, key=ranks.get)
    assert [ranks[t] for t in by_id] == list(range(len(by_id)))
    at = np.append(0, np.cumsum([len(t) for t in by_id]))
    data = np.frombuffer(b"".join(by_id), np.uint8)
    pairs = {}
    for t, r in ranks.items():
        for k in range(1, len(t)):
            if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                pairs[a << 32 | b] = r
    keys = np.array(sorted(pairs), np.int64)
    whole = span_hash(prefix(BYTE[data]), at[:-1], at[1:])
    order = np.argsort(whole)
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return Bpe(data, at, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), whole[order], order.astype(np.int64), single, pattern)


def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Bpe:
    with open(path, "rb") as f:
        return bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _rank(model: Bpe, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merged id of each pair, which is its rank; NONE if there is no such token."""
    key = left << 32 | right
    i = np.minimum(np.searchsorted(model.pair_keys, key), len(model.pair_keys) - 1)
    return np.where((model.pair_keys[i] == key) & (right >= 0), model.pair_ids[i], NONE)


def _merge(model: Bpe, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All merges of the rows of ``ids`` (rows, power of two); the tokens in a row, and how many."""
    n, width = ids.shape
    bits = max(width.bit_length() - 1, 1)
    after = np.tile(np.arange(1, width + 1), (n, 1))
    before = np.tile(np.arange(-1, width - 1), (n, 1))
    alive = np.arange(width) < length[:, None]
    tree = np.full((n, 2 * width), NONE)
    rank = _rank(model, ids[:, :-1].reshape(-1), np.where(alive[:, 1:], ids[:, 1:], -1).reshape(-1)).reshape(n, width - 1)
    place = np.arange(width - 1)
    tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank << bits | place, NONE)
    for k in range(width.bit_length() - 2, -1, -1):
        lo = 1 << k
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    row = np.flatnonzero(tree[:, 1] < NONE)
    while len(row):
        root = tree[row, 1]
        at, merged = root & ((1 << bits) - 1), root >> bits
        gone = after[row, at]
        then, left = after[row, gone], before[row, at]
        ids[row, at] = merged
        alive[row, gone] = False
        after[row, at] = then
        has = then < width
        before[row[has], then[has]] = at[has]
        nxt = np.where(has, ids[row, np.minimum(then, width - 1)], -1)
        nxt = np.where(has & (then < length[row]), nxt, -1)
        r = _rank(model, merged, nxt)
        tree[row, width + at] = np.where(r < NONE, r << bits | at, NONE)
        tree[row, width + gone] = NONE
        p = np.maximum(left, 0)
        r = _rank(model, ids[row, p], merged)
        tree[row, width + p] = np.where(left >= 0, np.where(r < NONE, r << bits | p, NONE), tree[row, width + p])
        for leaf in (at, gone, p):
            node = (width + leaf) >> 1
            while node[0]:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node = node >> 1
        row = row[tree[row, 1] < NONE]
    return ids[alive], alive.sum(axis=1)


def _merge_long(model: Bpe, ids: list[int]) -> list[int]:
    """As ``_merge`` for one long pre-token, with the tree in a list."""
    ranks, n, none = model.pair_ranks(), len(ids), int(NONE)
    width = 1 << max(n - 1, 1).bit_length()
    bits = width.bit_length()
    place = (1 << bits) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = ranks.get(ids[i] << 32 | ids[i + 1])
        if r is not None:
            tree[width + i] = r << bits | i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(leaf: int, value: int) -> None:
        k = width + leaf
        tree[k] = value
        k >>= 1
        while k:
            new = min(tree[2 * k], tree[2 * k + 1])
            if new == tree[k]:
                break
            tree[k] = new
            k >>= 1

    def pair(i: int) -> int:
        r = ranks.get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
        return none if r is None else r << bits | i

    while tree[1] < none:
        at, ids_at = tree[1] & place, tree[1] >> bits
        gone = after[at]
        ids[at], after[at] = ids_at, after[gone]
        if after[at] < n:
            before[after[at]] = at
        ids[gone] = -1
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    return [i for i in ids if i >= 0]


def encode_tokens(model: Bpe, tokens: list[str], at_once: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens, one after the other, and how many each has."""
    data, at = utf8(pa.array(tokens, pa.large_string()))
    size = np.diff(at)
    h = span_hash(prefix(BYTE[data]), at[:-1], at[1:])
    i = np.minimum(np.searchsorted(model.whole_keys, h), len(model.whole_keys) - 1)
    whole = model.whole_keys[i] == h
    many = np.where(whole, 1, 0)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.flatnonzero(whole), model.whole_ids[i[whole]], np.ones(int(whole.sum()), np.int64))]
    width = 2 ** np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
    for k in np.flatnonzero((size > LONG) & ~whole).tolist():
        got = np.array(_merge_long(model, model.byte_ids[data[at[k] : at[k + 1]]].tolist()), np.int64)
        parts.append((np.array([k]), got, np.array([len(got)])))
        many[k] = len(got)
    whole = whole | (size > LONG)
    for w in np.unique(width[~whole]).tolist():
        mine = np.flatnonzero((width == w) & ~whole)
        for lo in range(0, len(mine), step := max(1, at_once // w)):
            k = mine[lo : lo + step]
            inside = np.arange(w) < size[k, None]
            ids = np.full((len(k), w), -1, np.int64)
            ids[inside] = model.byte_ids[data[(at[k, None] + np.arange(w))[inside]]]
            got, n = _merge(model, ids, size[k])
            parts.append((k, got, n))
            many[k] = n
    start = np.cumsum(many) - many
    out = np.empty(int(many.sum()), np.int32)
    for k, got, n in parts:
        out[np.repeat(start[k] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
    return out, many


class Encoder:
    """Encodes texts with a cache of pre-tokens."""

    def __init__(self, model: Bpe):
        import regex

        self.model, self.find = model, regex.compile(model.pattern).findall
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.many, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        found = [self.find(t) for t in texts]
        new = set().union(*found)
        if len(self.known) + len(new) > CACHE_TOKENS:
            self.clear()
        new = sorted(new.difference(self.known))
        if new:
            ids, many = encode_tokens(self.model, new)
            self.known.update(zip(new, range(len(self.many), len(self.many) + len(new))))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(many) - many])
            self.ids, self.many = np.concatenate([self.ids, ids]), np.concatenate([self.many, many])
        size = np.array([len(f) for f in found])
        k = np.fromiter((x for f in found for x in map(self.known.__getitem__, f)), np.int64, int(size.sum()))
        n = self.many[k]
        upto = np.append(0, np.cumsum(n))
        out = self.ids[np.repeat(self.start[k] - upto[:-1], n) + np.arange(upto[-1])]
        return out, np.diff(upto[np.append(0, np.cumsum(size))])


def decode_ids(model: Bpe, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the end of each."""
    n = np.diff(model.token_at)[ids]
    upto = np.append(0, np.cumsum(n))
    data = model.token_bytes[np.repeat(model.token_at[ids] - upto[:-1], n) + np.arange(upto[-1])]
    return data, upto[np.append(0, np.cumsum(many))]


_encoder: OrderedDict[bytes, Encoder] = OrderedDict()  # by model; the last two used stay
MODELS = 2


def _encoder_of(model: Bpe) -> Encoder:
    _encoder[model.digest] = _encoder.pop(model.digest, None) or Encoder(model)
    while len(_encoder) > MODELS:
        _encoder.popitem(last=False)
    return _encoder[model.digest]


def encode(docs: DataFrame, model: Bpe) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) for every row; round_trip says that decoding gives back the text.

    A null text has null in all three, an empty one no ids. Texts of any length are encoded whole; of pairs of
    equal rank the leftmost is merged first. Null doc_ids and repeated rows pass through row by row; further columns
    are not read; an empty table gives no rows.
    """

    def run(batches):
        coder = _encoder_of(model)
        for batch in batches:
            for part, data, at in slices(batch):
                text = part.column("text")
                ids, many = coder.encode([x or "" for x in text.to_pylist()])
                back, end = decode_ids(model, ids, many)
                same = np.full(len(part), len(back) == len(data)) & (end[1:] == at[1:])
                if len(back) == len(data):
                    wrong = np.flatnonzero(back != data)
                    same[np.searchsorted(at, wrong, "right") - 1] = False
                null = text.is_null().to_numpy(zero_copy_only=False)
                cuts = np.append(0, np.cumsum(many)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(many.astype(np.int64), mask=null), pa.array(same, mask=null)], ["doc_id", "token_ids", "n_tokens", "round_trip"]
                )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: Bpe) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); a null list, and one with a null or an id outside the vocabulary, gives a null text.

    Ids that don't make up UTF-8 give U+FFFD in its place. An empty list gives an empty text.
    """

    def run(batches):
        for b in batches:
            lists = b.column("token_ids")
            many = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            null = lists.is_null().to_numpy(zero_copy_only=False).copy()
            wrong = (ids < 0) | (ids >= len(model.token_at) - 1)
            null[np.repeat(np.arange(len(b)), many)[wrong]] = True
            data, end = decode_ids(model, np.where(wrong, 0, ids), many)
            text = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(end[:-1], end[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(text, object), pa.string(), mask=null)], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
