"""Counts over all training texts for lm.py: of words, and of what follows a passage's context.

Rows of many small counts would cost a shuffle row each, so counts travel as arrays: a unit is about UNIT_CHARS
characters of texts; it asks for its distinct keys once, in one array per bucket of keys; a bucket sums what all units
hold and answers each unit. A key that every text holds is thus one number per unit, not one per text, and a bucket
holds as many keys as any other: their number follows spark.sql.shuffle.partitions.

Passages: a place in a text is an anchor if the hash of the CONTEXT ids before it is divisible by RATE, a power of two (and always the
first place that has so many before it). The ids from an anchor to the next one, or to the end, are a segment. Where
the same context stands elsewhere in the training texts, the segments that follow it there are known; see `mixed`.

Defined cases: a text without words asks for nothing, one shorter than a context has no segments; texts that repeat count
each, and a training text's own occurrence is left out when it is foretold; texts of any length are read whole, a unit being
closed behind the text that fills it; no texts give no rows, sums of zero and the least shares. Open: a bucket's keys of all units
meet in one task, and their number follows spark.sql.shuffle.partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_CHARS = 8_000_000
CONTEXT, RATE = 4, 32
#: Classes of contexts by how often they occur elsewhere; the last holds all that occur as often or more.
CLASSES = 5
ODD = np.random.default_rng(20250711).integers(0, 2**64, CONTEXT + 2, np.uint64) | np.uint64(1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: A random value for each byte, none for white space; a random odd factor for each place in a word.
BYTES = np.random.default_rng(20250712).integers(1, 2**64, 256, np.uint64)
BYTES[65:91] = BYTES[97:123]
BYTES[[9, 10, 11, 12, 13, 32]] = 0
PLACES = np.random.default_rng(20250713).integers(0, 2**64, 4096, np.uint64) | np.uint64(1)

#: first: the place of the row's first key among all that the piece asks for, in order.
ASKED = "unit long, piece long, bucket int, first long, keys binary, more binary, n binary"
#: own: counts of the keys; all: of their contexts. Then for the bucket as a whole, on one of its rows: distinct keys and
#: their sum, and for each class the occurrences and how many of them would be foretold.
ANSWERED = "unit long, piece long, first long, own binary, all binary, kinds long, total long, seen array<double>, told array<double>"


def ask(unit: int, piece: int, buckets: int, keys: np.ndarray, more: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """One row of ASKED for each bucket: a range of the keys, which come in order."""
    bucket = (keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
    stops = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist()
    for b, (start, stop) in enumerate(zip(stops, stops[1:], strict=False)):
        if stop > start:
            part = slice(start, stop)
            yield unit, piece, b, start, keys[part].tobytes(), more[part].tobytes() if len(more) else None, n[part].astype(np.int64).tobytes()


def answer(table: pa.Table) -> pa.Table:
    """A bucket's sums for each unit that asked."""
    keys, more, n = (np.frombuffer(b"".join(x.as_py() or b"" for x in table[c]), t) for c, t in (("keys", np.uint64), ("more", np.uint32), ("n", np.int64)))
    sizes = np.array([len(x.as_py()) // 8 for x in table["keys"]])
    _, key = np.unique(keys, return_inverse=True)
    of_key = np.bincount(key, n).astype(np.int64)
    if len(more):
        order = np.lexsort((more, key))
        new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(more[order]) != 0)])
        pair = np.empty(len(key), np.int64)
        pair[order] = np.cumsum(new) - 1
    else:
        pair = key
    of_pair = np.bincount(pair, n).astype(np.int64)
    seen, told = [], []
    if len(more):
        context = np.empty(len(of_pair), np.int64)
        context[pair] = key
        others = of_key[context] - 1  # an occurrence itself is left out
        known = (of_pair > 0) & (others > 0)
        kind = np.minimum(others, CLASSES)[known]
        seen = np.bincount(kind, of_pair[known], CLASSES + 1)[1:].tolist()
        told = np.bincount(kind, of_pair[known] * (of_pair[known] - 1) / others[known], CLASSES + 1)[1:].tolist()
    cuts = np.cumsum(sizes)[:-1]
    own, all_ = np.split(of_pair[pair], cuts), np.split(of_key[key], cuts)
    rows, head = len(sizes), [True] + [False] * (len(sizes) - 1)
    return pa.table(
        {
            "unit": table["unit"], "piece": table["piece"], "first": table["first"], "own": pa.array([x.tobytes() for x in own], pa.binary()), "all": pa.array([x.tobytes() if len(more) else None for x in all_], pa.binary()),
            "kinds": pa.array([int((of_key > 0).sum()) if h else 0 for h in head]), "total": pa.array([int(of_key.sum()) if h else 0 for h in head]),
            "seen": pa.array([seen if h else [] for h in head], pa.list_(pa.float64())), "told": pa.array([told if h else [] for h in head], pa.list_(pa.float64())),
        }
    ) if rows else table


def answered(asked: DataFrame) -> DataFrame:
    return asked.groupBy("bucket").applyInArrow(answer, ANSWERED)


def next_number() -> Callable[[], int]:
    """Numbers that no other task of the job gives."""
    context = TaskContext.get()
    base, given = (context.partitionId() if context else 0) << 32, iter(range(2**32))
    return lambda: base + next(given)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of these bytes begin, and a 64-bit hash of each, A-Z read as a-z; words stand between ASCII
    white space, and so do the bytes as a whole."""
    value = BYTES[raw]
    word = value != 0
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    value = value[starts[0] :]
    place = np.arange(len(value), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), np.diff(np.append(starts, len(raw))))
    far = int(place.max()) >= len(PLACES)
    value *= PLACES[place & (len(PLACES) - 1)]
    if far:
        value *= PLACES[::-1][(place // len(PLACES)) & (len(PLACES) - 1)]
    found = np.add.reduceat(value, starts - starts[0])
    found = (found ^ (found >> np.uint64(32))) * SPREAD
    return starts, (found ^ (found >> np.uint64(29))) * ODD[0]


class Words:
    """The words of one unit: hashed as they come, numbered in the order of their hashes at the end."""

    def __init__(self):
        self.hashes, self.lengths, self.train, self.chars, self.texts = [], [], [], 0, 0

    def add(self, texts: list[str], train: np.ndarray) -> None:
        encoded = [t.encode() for t in texts]
        sizes = np.array(list(map(len, encoded)), np.int64) + 1
        starts, hashes = word_hashes(np.frombuffer(b" " + b" ".join(encoded) + b" ", np.uint8))
        stops = np.searchsorted(starts, np.cumsum(sizes) + 1)
        self.lengths.append(np.diff(np.concatenate([[0], stops])).astype(np.uint32))
        self.hashes.append(hashes)
        self.train.append(train)
        self.chars += sum(map(len, texts))
        self.texts += len(texts)

    def rows(self, unit: int, buckets: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple]]:
        """Words of each text, their numbers, and the rows that ask for what the numbers stand for."""
        lengths, hashes, train = (np.concatenate(x) for x in (self.lengths, self.hashes, self.train))
        order = np.argsort(hashes)
        found = hashes[order]
        new = np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]
        numbers = np.empty(len(found), np.uint32)
        numbers[order] = np.cumsum(new) - 1
        n = np.bincount(numbers[np.repeat(train, lengths)], minlength=int(new.sum()))
        return lengths, numbers, ask(unit, -1, buckets, found[new], np.zeros(0, np.uint32), n)


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int, kind: type = np.uint32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(pa.decompress(raw, size * n, "zstd", asbytes=True), np.uint8).reshape(size, n).T.tobytes(), kind)


def segments(texts: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, log probability, context and continuation of every segment. values: the natural log probability of each
    id and end of the texts, one behind the other."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    ids = np.zeros(total, np.uint64)
    for t, s in zip(texts, starts, strict=True):
        ids[s : s + len(t)] = t
        ids[s + len(t)] = 2**32
    place = np.arange(total) - np.repeat(starts, lengths)
    context = np.zeros(total, np.uint64)
    for back in range(1, CONTEXT + 1):
        context[back:] += (ids[:-back] + np.uint64(1)) * ODD[back - 1]
    context = (context ^ (context >> np.uint64(29))) * ODD[CONTEXT]
    context ^= context >> np.uint64(32)
    anchor = (place == CONTEXT) | ((place > CONTEXT) & (context & np.uint64(RATE - 1) == 0))
    cuts = np.flatnonzero(anchor | (place == 0))
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros(0), context, np.zeros(0, np.uint32)
    inside = (np.arange(total) - np.repeat(cuts, np.diff(np.append(cuts, total)))).astype(np.uint64)
    x = (ids + np.uint64(1)) * ODD[CONTEXT + 1] + inside * SPREAD
    x = (x ^ (x >> np.uint64(31))) * ODD[CONTEXT]
    follow = (np.add.reduceat(x ^ (x >> np.uint64(30)), cuts) >> np.uint64(32)).astype(np.uint32)
    said = np.add.reduceat(values, cuts)
    real = anchor[cuts]
    return np.searchsorted(starts, cuts[real], side="right") - 1, said[real], context[cuts[real]], follow[real]


class Passages:
    """The segments of some texts of one unit, as distinct (context, continuation) to ask for."""

    def __init__(self):
        self.found, self.texts, self.held = [], [], 0

    def add(self, seqs: np.ndarray, train: np.ndarray, texts: list[np.ndarray], values: np.ndarray) -> None:
        text, said, context, follow = segments(texts, values)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.texts.append((seqs, np.add.reduceat(values, np.cumsum(lengths) - lengths), np.bincount(text, minlength=len(texts))))
        self.found.append((said, context, follow, train[text]))
        self.held += int(lengths.sum())

    def rows(self, unit: int, piece: int, buckets: int) -> tuple[tuple, Iterator[tuple]]:
        """(seq, log probability and number of segments of the texts; log probability and place of the segments), and
        what to ask."""
        said, context, follow, train = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((follow, context))
        new = np.concatenate([[True], (np.diff(context[order]) != 0) | (np.diff(follow[order]) != 0)])[: len(order)]
        at = np.empty(len(order), np.uint32)
        at[order] = np.cumsum(new) - 1
        heads = order[new]
        n = np.bincount(at, train, len(heads)) if len(order) else np.zeros(0)
        seqs, totals, parts = (np.concatenate(x) for x in zip(*self.texts, strict=True))
        own = (unit, piece, seqs.astype(np.uint32).tobytes(), totals.astype(np.float64).tobytes(), parts.astype(np.uint32).tobytes(), said.astype(np.float32).tobytes(), at.tobytes())
        return own, ask(unit, piece, buckets, context[heads], follow[heads], n)


def mixed(said: np.ndarray, own: np.ndarray, all_: np.ndarray, train: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log probability of segments: that of the network, and where the context occurs elsewhere, with the class's
    share, how often this continuation follows it there. A training text's own occurrence is left out, so that every
    text is foretold by the others."""
    c, n = own - train, all_ - train
    known = n > 0
    w = np.where(known, share[np.minimum(np.maximum(n, 1), CLASSES) - 1], 0.0)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(w * c / np.maximum(n, 1)), np.log1p(-w) + said)


def shares(answers: DataFrame) -> np.ndarray:
    """For each class of contexts, how often the others foretell what follows, over all training texts."""
    sums = [F.sum(F.try_element_at(c, F.lit(i + 1))).alias(f"{c}{i}") for c in ("seen", "told") for i in range(CLASSES)]
    row = answers.agg(*sums).first()
    return np.array([np.clip((row[f"told{i}"] or 0.0) / max(row[f"seen{i}"] or 0.0, 1.0), 0.01, 0.99) for i in range(CLASSES)])


def array_of(table: pd.DataFrame, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[column]), kind)
