"""Token counts under a unigram vocabulary by dynamic programming over a trie of pre-tokens.

A text is split at ASCII white space; each word, behind a word mark, is segmented into the pieces of greatest
total score. The distinct words of a task are sorted, so that their trie is implicit: a node is a prefix that
the word before doesn't share. The forward score of a node (best score of any segmentation of that prefix, and
its number of pieces) is computed once for all words below it; nodes of one depth are computed together in
numpy. The count at a word's last node is kept, and a text's count is the sum over its words. Workers keep the
counts of words they have met. A word of more than ``LONG`` bytes is a trie of one path: the same forward scores
are carried along it in a plain loop, so its time is in proportion to its length.

Scores: the vocabulary is ordered by frequency, and a piece of rank r has log probability -log(r + shift)
(Zipf's law). A character that is no piece costs ``unknown`` less than the worst piece and counts as one token
per UTF-8 byte, as with byte fallback. Of equal scores the one of fewer tokens is taken.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, SPACE, mix, powers, prefix, slices, span_hash, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SHIFT, UNKNOWN = 2.7, 10.0
MARK = 0xFF  # stands for the word mark; no UTF-8 text has this byte
WIDE = 48  # words of more bytes are handled in width classes of powers of two
LONG = 512  # and words of more bytes than this one by one
CACHE_WORDS = 3_000_000


@dataclass
class Unigram:
    """Hashes of pieces in order, their scores, and the longest piece in bytes."""

    keys: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: float
    pieces: dict[bytes, float] = field(default_factory=dict, repr=False)
    digest: bytes = b""  # of all that decides a count

    def __post_init__(self):
        self.digest = self.digest or hashlib.sha256(self.keys.tobytes() + self.scores.tobytes() + repr((self.longest, self.unknown)).encode()).digest()


def unigram(pieces: list[str], shift: float = SHIFT, unknown: float = UNKNOWN) -> Unigram:
    """From pieces by descending frequency; U+2581 is the word mark."""
    table: dict[bytes, float] = {}
    for r, p in enumerate(pieces):
        raw = p.encode()
        if raw.startswith("▁".encode()):
            raw = bytes([MARK]) + raw[3:]
        if raw and "▁".encode() not in raw:
            table.setdefault(raw, -float(np.log(r + shift)))
    raw = b"".join(table)
    end = np.cumsum([len(x) for x in table])
    keys = span_hash(prefix(BYTE[np.frombuffer(raw, np.uint8)]), np.append(0, end[:-1]), end)
    order = np.argsort(keys)
    scores = np.array(list(table.values()))
    return Unigram(keys[order], scores[order], max(map(len, table)), float(scores.min()) - unknown, table)


def load(path: str = VOCABULARY) -> Unigram:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return unigram([model.id_to_piece(i) for i in ids])


def count_words(vocabulary: Unigram, texts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Tokens of each word. ``texts``: bytes (rows, width), sorted, zero-padded, each beginning with MARK."""
    n, width = texts.shape
    up, down = powers(width + 2)
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum(BYTE[texts] * up[:width], axis=1, out=sums[:, 1:])
    shared = np.zeros(n, np.int64)  # bytes shared with the word before
    if n > 1:
        differ = texts[1:] != texts[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[1:] = np.minimum(shared[1:], np.minimum(length[1:], length[:-1]))
    node = np.full((n, width + 1), -1, np.int64)  # node of each prefix, numbered by depth
    node[:, 0] = 0
    score, tokens, sizes = [np.zeros(1)], [np.zeros(1, np.int64)], texts
    out = np.zeros(n, np.int64)
    for depth in range(1, width + 1):
        has = length >= depth
        new = has & (shared < depth)
        if not has.any():
            break
        node[:, depth] = np.where(has, np.cumsum(new) - 1, -1)
        row = np.flatnonzero(new)
        best, many = np.full(len(row), -np.inf), np.zeros(len(row), np.int64)
        edge = np.ones(len(row), bool) if depth == width else (sizes[row, depth] & 0xC0) != 0x80  # ends between characters
        edge |= length[row] == depth
        for k in range(1, min(depth, vocabulary.longest) + 1):
            at = np.full(len(row), depth)
            h = span_hash_rows(sums, down, row, at - k, at)
            i = np.minimum(np.searchsorted(vocabulary.keys, h), len(vocabulary.keys) - 1)
            ok = np.flatnonzero((vocabulary.keys[i] == h) & edge)
            if len(ok):
                up_node = node[row[ok], depth - k]
                s, t = score[depth - k][up_node] + vocabulary.scores[i[ok]], tokens[depth - k][up_node] + 1
                take = (s > best[ok]) | ((s == best[ok]) & (t < many[ok]))
                best[ok[take]], many[ok[take]] = s[take], t[take]
        for k in range(1, min(depth, 4) + 1):  # a character without a piece
            lead = sizes[row, depth - k]
            size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            size = np.where(lead == MARK, 1, size)
            ok = np.flatnonzero((size == k) & ((lead & 0xC0) != 0x80) & edge)
            if len(ok):
                up_node = node[row[ok], depth - k]
                s, t = score[depth - k][up_node] + vocabulary.unknown, tokens[depth - k][up_node] + np.where(lead[ok] == MARK, 3, k)
                h = span_hash_rows(sums, down, row[ok], np.full(len(ok), depth - k), np.full(len(ok), depth))
                i = np.minimum(np.searchsorted(vocabulary.keys, h), len(vocabulary.keys) - 1)
                take = ((s > best[ok]) | ((s == best[ok]) & (t < many[ok]))) & (vocabulary.keys[i] != h)
                best[ok[take]], many[ok[take]] = s[take], t[take]
        score.append(best)
        tokens.append(many)
        done = np.flatnonzero(length == depth)
        out[done] = many[node[done, depth]]
    return out


def span_hash_rows(sums: np.ndarray, down: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[row, end] - sums[row, start]) * down[start] + (end - start).astype(np.uint64))


def count_long(vocabulary: Unigram, raw: np.ndarray) -> int:
    """Tokens of one long word: its pieces are looked up together, the scores are carried along in a plain loop."""
    text = np.append(np.uint8(MARK), raw)
    n, sums = len(text), prefix(BYTE[text])
    inner = np.append((text & 0xC0) != 0x80, True)  # places between characters
    steps: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
    lead = text.astype(np.int64)
    width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    width[0] = 1
    for k in range(1, min(vocabulary.longest, n) + 1):
        at = np.arange(n - k + 1)
        h = span_hash(sums, at, at + k)
        i = np.minimum(np.searchsorted(vocabulary.keys, h), len(vocabulary.keys) - 1)
        known = vocabulary.keys[i] == h
        for a, score in zip(at[known & inner[at + k]].tolist(), vocabulary.scores[i[known & inner[at + k]]].tolist()):
            steps[a].append((k, score, 1))
        if k <= 4:
            for a in at[~known & inner[at] & (width[at] == k) & inner[at + k]].tolist():
                steps[a].append((k, vocabulary.unknown, 3 if a == 0 else k))
    best, many = [-np.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for a in range(n):
        if best[a] > -np.inf:
            for k, score, t in steps[a]:
                s, t = best[a] + score, many[a] + t
                if s > best[a + k] or (s == best[a + k] and t < many[a + k]):
                    best[a + k], many[a + k] = s, t
    return many[n]


def _count(vocabulary: Unigram, data: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = 50_000) -> np.ndarray:
    """Tokens of words given by their place; words of like width are handled together."""
    size = end - start + 1
    out = np.zeros(len(size), np.int64)
    width = np.where(size <= WIDE, -(-size // 12) * 12, 2 ** np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = count_long(vocabulary, data[start[k] : end[k]])
    for w in np.unique(width[size <= LONG]).tolist():
        mine = np.flatnonzero((width == w) & (size <= LONG))
        for lo in range(0, len(mine), step := max(1, at_once * 12 // w)):
            k = mine[lo : lo + step]
            text = np.zeros((len(k), w), np.uint8)
            text[:, 0] = MARK
            column = np.arange(1, w)
            inside = column < size[k, None]
            text[:, 1:][inside] = data[(start[k, None] + column - 1)[inside]]
            order = np.argsort(text.view(f"S{w}").reshape(-1), kind="stable")
            out[k[order]] = count_words(vocabulary, text[order], size[k[order]])
    return out


_known: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()  # by vocabulary; the last two used stay
VOCABULARIES = 2


def counts(vocabulary: Unigram, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens of each row."""
    start, end, first = words(data, at, SPACE)
    h = span_hash(prefix(BYTE[data]), start, end)
    distinct, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
    keys, values = _known.pop(vocabulary.digest, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    i = np.searchsorted(keys, distinct)
    met = (keys[np.minimum(i, len(keys) - 1)] == distinct) if len(keys) else np.zeros(len(distinct), bool)
    n = np.zeros(len(distinct), np.int64)
    n[met] = values[i[met]]
    new = sample[~met]
    n[~met] = _count(vocabulary, data, start[new], end[new])
    if len(keys) + len(new) > CACHE_WORDS:
        keys, values, i = keys[:0], values[:0], np.zeros_like(i)
    if len(new):  # both are sorted, so the new ones are put in place without another sort
        keys, values = np.insert(keys, i[~met], distinct[~met]), np.insert(values, i[~met], n[~met])
    _known[vocabulary.digest] = keys, values
    while len(_known) > VOCABULARIES:
        _known.popitem(last=False)
    total = np.append(0, np.cumsum(n[inverse]))
    return total[first[1:]] - total[first[:-1]]


def token_counts(docs: DataFrame, vocabulary: Unigram) -> DataFrame:
    """(doc_id, n_tokens) for every row; null for a null text, 0 for one without words.

    Texts of any length are counted whole; of segmentations of equal score the one of fewer tokens counts. Null
    doc_ids and repeated rows pass through row by row; further columns are not read; an empty table gives no rows.
    """
    small = Unigram(vocabulary.keys, vocabulary.scores, vocabulary.longest, vocabulary.unknown, digest=vocabulary.digest)

    def run(batches):
        for batch in batches:
            null = batch.column("text").is_null()
            at_row = 0
            for part, data, at in slices(batch, size=1 << 23):
                n = counts(small, data, at)
                mask = null.slice(at_row, len(part)).to_numpy(zero_copy_only=False)
                at_row += len(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, mask=mask)], ["doc_id", "n_tokens"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, n_tokens long")
