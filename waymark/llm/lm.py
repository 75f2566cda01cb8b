"""LM scoring by a causal self-attention model trained in numpy on subword ids.

A text's ids are cut into blocks of BLOCK; each block's queries attend, causally and with learned biases by
distance, to the keys of their own block and of the block before, so windows of two blocks overlap by one and
every token is scored once, many blocks in one masked batch. The hidden layer predicts one of FAMILIES families of
units and the unit within it; a unit is one of the UNITS most frequent ids, or the rest, within which counts decide.
Families are units with like neighbours. A text ends with an end id, which is scored too.

The network learns from every token of every training text (learned_network): texts are dealt by a hash to shards, each a
task that goes through its texts once by stochastic gradients, and the shards' networks are averaged, in a few rounds of
growing size over different texts. Families come from the counts of pairs of units, and the share of these counts from
what the network says of each training text just before it learns from it. Counts of ids and of pairs (what follows a
unit is mixed into what the network says, the more the better the unit is known), and of what follows the contexts of
passages (memory.py) cover all training texts too: a text's segments are foretold, where their context stands in another
training text, by the segments that follow it there, else by the network alone; that share is measured as well.

base_score is the unigram score of words by counts from all training texts; they travel as arrays, see memory.py.

Defined cases: null text is the empty text (its end alone is scored); null doc_id belongs to no fold: not held out,
trained on; rows may repeat, each is counted and scored; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import memory
from waymark.llm.common import fresh_path, text_column, text_slices, width
from waymark.llm.subwords import shared_subwords, vocabulary_path

FOLDS, HELD_OUT = 5, 1
BLOCK = 16
SIZE, HIDDEN, UNITS, FAMILIES, COLUMNS, LARGEST_FAMILY = 16, 32, 1536, 24, 256, 48
#: No text is left out: nothing reads this number any more, only tests set it.
MOST_SAMPLED = 3000
PASSES, BATCH, RATE = 3, 128, 6e-3
#: A round of learning takes the texts whose hash modulo the last of these lies below its own number, and not the one before's.
ROUNDS = (1, 4, 16, 64)
#: Tokens in a round's shard: LEAST_SHARD with up to MANY_SHARDS shards, then more, up to MOST_SHARD.
LEAST_SHARD, MANY_SHARDS, MOST_SHARD = 1_000_000, 96, 32_000_000
#: Tokens below which a corpus is one shard, gone through up to PASSES times.
ONE_SHARD = 4_000_000
#: Tokens packed into blocks at once while learning.
LEARN_IDS = 200_000
#: Blocks in a step of a large shard, at most: a shard takes no fewer steps than one of LEAST_SHARD tokens.
MOST_STEP = 8 * BATCH
#: Steps after which the rate of learning falls.
STEADY = 200
#: Bytes of ids whose pairs are counted at once.
PAIR_BYTES = 4_000_000
#: Windows on which the share of the pairs is fitted.
MOST_MIXED = 4096
#: Words in each generation of a worker's cache.
MOST_WORDS = 500_000
#: Ids whose segments are held before they are handed on.
MOST_HELD = 4_000_000
#: Sums of exponentials within these need no shift in single precision.
TINY, HUGE = 1e-25, 1e30
#: Rows that are multiplied at once by product().
SHORT = 64
#: Blocks whose attention is computed at once.
ATTEND = 64
#: Blocks in one batch of scoring.
CHUNK = 2048


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1))


# ---------------------------------------------------------------- the network


class Network:
    """p: embeddings e, queries q, keys k, values v and the direct way t into the hidden layer, its bias, biases by
    distance, and the outputs: ws for the families of units, wu for the units within their family."""

    def __init__(self, inputs: int, family_of: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s, by: (rng.normal(0, 1, s) * by).astype(np.float32)
        d, h, units = SIZE, HIDDEN, len(family_of)
        self.family_of = family_of
        families = int(family_of.max()) + 1
        self.members = [np.flatnonzero(family_of == s) for s in range(families)]
        self.place = np.zeros(units, np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        self.p = {
            "e": draw(inputs, d, by=0.5), "q": draw(d, d, by=1 / d), "k": draw(d, d, by=d**-0.5), "v": draw(d, h, by=0.3 * d**-0.5), "t": draw(d, h, by=d**-0.5), "b1": np.zeros(h, np.float32),
            "near": np.zeros(2 * BLOCK, np.float32), "ws": draw(h, families, by=0.3 * h**-0.5), "bs": np.zeros(families, np.float32), "wu": draw(h, units, by=0.1 * h**-0.5), "bu": np.zeros(units, np.float32),
        }
        self.tables: list[np.ndarray] | None = None
        self.of_family, self.outputs = np.zeros((0, 0)), []
        self.pairs: np.ndarray | None = None
        self.own = np.ones(units, np.float32)

    def mix(self, pairs: np.ndarray, inputs: np.ndarray, first: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> None:
        """Mix in the followers of each unit, by the share that suits the given blocks."""
        said, before = [], None
        for at in range(0, len(inputs), CHUNK):
            part = slice(at, at + CHUNK)
            x, before = self.log_probability(inputs[part], first[part], targets[part], before)
            said.append(x)
        if valid.any():
            weight, ratio = foretold(pairs, inputs[valid], targets[valid], np.concatenate(said)[valid])
            self.mix_in(pairs, share_of(weight, ratio, np.ones(len(weight))))
        else:
            self.mix_in(pairs, 0.5)

    def mix_in(self, pairs: np.ndarray, share: float) -> None:
        """pairs: counts (unit, following unit) over all training texts. A unit that occurs n times before m different units
        gives its followers n / (n + m) of the share."""
        n, weight = pairs.sum(axis=1), known_by(pairs)
        self.own = (1 - share * weight).astype(np.float32)
        self.pairs = np.empty(pairs.shape, np.float32)
        for i, row in enumerate(pairs):
            self.pairs[i] = row * (share * weight[i] / max(n[i], 1))

    def start_from(self, mass: np.ndarray) -> None:
        """Output biases from the units' counts."""
        of_family = np.bincount(self.family_of, mass, len(self.members))
        self.p["bs"] = np.log(of_family / of_family.sum()).astype(np.float32)
        self.p["bu"] = np.log(mass / of_family[self.family_of]).astype(np.float32)

    def mask(self) -> np.ndarray:
        """Query i of a block, key j of the block before and the block: the bias of their distance, or none if j is later."""
        distance = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
        return np.where(distance >= 0, self.p["near"][np.clip(distance, 0, 2 * BLOCK - 1)], np.float32(-1e9))

    def log_probability(self, inputs: np.ndarray, first: np.ndarray, targets: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each target unit's probability. before: the inputs of the block ahead of these; the last block's are returned.

        Queries, keys, values and the direct way are tables by unit; the values have a column of ones, so that the
        product with the weights also gives their sum. Attention runs over few blocks at a time, in cache.
        """
        if self.tables is None:
            self.prepare()
        tq, tk, tv, tt, mask = self.tables
        z = np.empty((*inputs.shape, tt.shape[1]), np.float32)
        ahead = inputs[:1] if before is None else before
        for at in range(0, len(inputs), ATTEND):
            part = slice(at, at + ATTEND)
            x = inputs[part]
            both = np.concatenate([ahead, x])
            ahead = x[-1:]
            v = pairs_of_blocks(tv.take(both, axis=0))
            a = tq.take(x, axis=0) @ turned(tk.take(both, axis=0))
            a += mask
            a[first[part], :, :BLOCK] = -1e9
            mix = np.exp(a) @ v
            total = mix[:, :, -1:]
            if not fits(total):
                a -= a.max(axis=2, keepdims=True)
                mix = np.exp(a) @ v
                total = mix[:, :, -1:]
            np.multiply(mix, 1 / total, out=z[part])
        z = z.reshape(-1, z.shape[-1])  # its last column is one
        z += tt.take(inputs.ravel(), axis=0)
        np.maximum(z, 0, out=z)
        flat = targets.ravel()
        family = self.family_of.astype(np.uint8 if len(self.members) < 256 else np.int64)[flat]
        order = np.argsort(family, kind="stable")
        stops = np.searchsorted(family[order], np.arange(len(self.members) + 1))
        z, place = z.take(order, axis=0), self.place[flat[order]]
        said = log_share(z, self.of_family, family[order]).astype(np.float64)
        for s, w in enumerate(self.outputs):
            start, stop = stops[s], stops[s + 1]
            if stop > start and w.shape[1] > 1:
                said[start:stop] += log_share(z[start:stop], w, place[start:stop])
        out = np.empty(len(flat))
        out[order] = said
        if self.pairs is not None:
            left = inputs.ravel()
            out = np.log(self.own.take(left) * np.exp(out) + self.pairs[left, flat])
        return out.reshape(targets.shape), inputs[-1:]

    def prepare(self) -> None:
        p = self.p
        ones = np.ones((len(p["e"]), 1), np.float32)
        tables = [p["e"] @ p["q"], p["e"] @ p["k"], np.concatenate([p["e"] @ p["v"], ones], axis=1), np.concatenate([p["e"] @ p["t"] + p["b1"], 0 * ones], axis=1), self.mask()]
        self.tables = [np.ascontiguousarray(t, np.float32) for t in tables]
        self.of_family = np.concatenate([p["ws"], p["bs"][None]])
        self.outputs = [np.concatenate([p["wu"][:, m], p["bu"][None, m]]) for m in self.members]

    def gradients(self, inputs: np.ndarray, first: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the valid targets, and its gradients."""
        said, g = self.learned(inputs, first, targets, valid)
        return -float((said * valid).sum()) / max(1, int(valid.sum())), g

    def learned(self, inputs: np.ndarray, first: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Natural log of each target's probability by the network alone, and the gradients of the mean loss over the valid
        ones. The first block attends to none before it."""
        p, shape, d, h = self.p, inputs.shape, SIZE, HIDDEN
        kind = p["b1"].dtype
        x, flat = inputs.ravel(), targets.ravel()
        weight = valid.ravel() / kind.type(max(1, int(valid.sum())))
        # by unit, as in prepare(); the values have a column of ones, which gives the weights' sum; few blocks at a time, in cache
        ways = np.concatenate([p["q"], p["k"], p["v"], p["t"]], axis=1)
        by_unit = p["e"] @ ways
        column, mask = np.ones((len(by_unit), 1), kind), self.mask()
        tq, tk, tv, tt = (np.ascontiguousarray(t) for t in (by_unit[:, :d], by_unit[:, d : 2 * d], np.concatenate([by_unit[:, 2 * d : 2 * d + h], column], axis=1), np.concatenate([by_unit[:, 2 * d + h :] + p["b1"], 0 * column], axis=1)))
        parts = [slice(at, min(at + ATTEND, len(inputs))) for at in range(0, len(inputs), ATTEND)]
        kept, z = [], tt.take(x, axis=0)
        for part in parts:
            mine = inputs[part]
            both, none = np.concatenate([inputs[max(part.start - 1, 0)][None], mine]), first[part].copy()
            none[0] |= part.start == 0
            q, k, v = tq.take(mine, axis=0), turned(tk.take(both, axis=0)), tv.take(both, axis=0)

            def weights(shift: bool, q: np.ndarray, k: np.ndarray, none: np.ndarray) -> np.ndarray:
                a = q @ k
                a += mask
                a[none, :, :BLOCK] = -1e9
                if shift:
                    a -= a.max(axis=2, keepdims=True)
                return np.exp(a, out=a)

            a = weights(False, q, k, none)
            mixed = a @ pairs_of_blocks(v)
            if not fits(mixed[:, :, -1]):
                a = weights(True, q, k, none)
                mixed = a @ pairs_of_blocks(v)
            inverse = 1 / mixed[:, :, -1:]
            mixed *= inverse
            z[part.start * BLOCK : part.stop * BLOCK] += mixed.reshape(-1, h + 1)  # its last column is one
            kept.append((a, mixed, inverse))
        np.maximum(z, 0, out=z)
        # the outputs, targets sorted by family, units too
        family = self.family_of.astype(np.uint8 if len(self.members) < 256 else np.int64)[flat]
        order = np.argsort(family, kind="stable")
        stops = np.searchsorted(family[order], np.arange(len(self.members) + 1))
        zs, place, share = z.take(order, axis=0), self.place[flat[order]], weight[order]
        units, heads = np.concatenate(self.members), np.cumsum([0, *map(len, self.members)])
        own = np.concatenate([p["wu"], p["bu"][None]]).take(units, axis=1)
        of_family, turned_own, turned_of_family = np.concatenate([p["ws"], p["bs"][None]]), np.ascontiguousarray(own[:-1].T), np.ascontiguousarray(p["ws"].T)
        g_own, ones, dz, picked, totals = np.zeros_like(own), np.ones(own.shape[1], kind), np.empty((len(zs), h), kind), np.zeros((2, len(zs)), kind), np.ones((2, len(zs)), kind)

        def output(level: int, rows: slice, w: np.ndarray, turned_w: np.ndarray, at: np.ndarray, shift: bool) -> tuple[np.ndarray, np.ndarray]:
            z, mine = zs[rows], share[rows]
            y = z @ w
            if shift:
                y -= y.max(axis=1, keepdims=True)
            places = np.arange(0, y.size, y.shape[1]) + at
            picked[level, rows] = y.take(places)
            np.exp(y, out=y)
            totals[level, rows] = total = y @ ones[: y.shape[1]]
            y *= (mine / total)[:, None]
            y.ravel()[places] -= mine
            return y @ turned_w, product(z, y)

        def outputs(shift: bool) -> np.ndarray:
            dz[:], of_families = output(0, slice(None), of_family, turned_of_family, family[order], shift)
            for s, m in enumerate(self.members):
                rows, mine = slice(stops[s], stops[s + 1]), slice(heads[s], heads[s + 1])
                if rows.stop > rows.start and len(m) > 1:
                    back, g_own[:, mine] = output(1, rows, own[:, mine], turned_own[mine], place[rows], shift)
                    dz[rows] += back
            return of_families

        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            of_families = outputs(False)
        if not fits(totals):
            of_families = outputs(True)
        dz *= zs[:, :h] > 0
        out = np.empty(len(zs), kind)
        out[order] = (picked - np.log(totals)).sum(axis=0)
        g_units = g_own.take(heads[self.family_of] + self.place, axis=1)
        # back through the attention: weights are a * inverse; a block's keys and values are used by it and by the next
        back = np.empty((*shape, 2 * d + 2 * h), kind)
        dh = np.empty_like(dz)
        dh[order] = dz
        near, behind = np.zeros((BLOCK, 2 * BLOCK), kind), back[..., d : 2 * d + h]
        for part, (a, mixed, inverse) in zip(parts, kept, strict=True):
            mine = inputs[part]
            both = np.concatenate([inputs[max(part.start - 1, 0)][None], mine])
            blocks = dh.reshape(*shape, h)[part]
            scaled = np.empty_like(mixed)
            np.multiply(blocks, inverse, out=scaled[..., :h])
            scaled[..., h] = -np.einsum("nij,nij->ni", scaled[..., :h], mixed[..., :h])
            ds = scaled @ turned(tv.take(both, axis=0))
            ds *= a
            near += ds.sum(axis=0)
            back[part, :, :d], back[part, :, 2 * d + h :] = ds @ pairs_of_blocks(tk.take(both, axis=0)), blocks
            used = np.concatenate([ds.transpose(0, 2, 1) @ tq.take(mine, axis=0), a.transpose(0, 2, 1) @ scaled[..., :h]], axis=2)
            behind[part] = used[:, BLOCK:]
            skip = part.start == 0  # none from blocks that are first: their weights are 0
            behind[part.start - 1 + skip : part.stop - 1] += used[skip:, :BLOCK]
        back = back.reshape(-1, 2 * d + 2 * h)
        inner = product(p["e"].take(x, axis=0), back)
        g = {"q": inner[:, :d], "k": inner[:, d : 2 * d], "v": inner[:, 2 * d : 2 * d + h], "t": inner[:, 2 * d + h :], "b1": np.ones(len(dh), kind) @ dh}
        g |= {"ws": of_families[:-1], "bs": of_families[-1], "wu": g_units[:-1], "bu": g_units[-1]}
        distance = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
        seen = distance >= 0
        g["near"] = np.bincount(distance[seen], near[seen], 2 * BLOCK).astype(kind)
        de = back @ ways.T
        g["e"] = np.bincount((x[:, None] * d + np.arange(d)).ravel(), de.ravel(), p["e"].size).reshape(p["e"].shape).astype(kind)
        return out.reshape(shape), g

    def train(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, passes: int, seed: int = 4) -> list[float]:
        """Adam over windows of two blocks: arrays of windows x 2 x BLOCK."""
        rng, losses, adam = np.random.default_rng(seed), [], Adam(self.p)
        first = np.tile([True, False], BATCH)
        steps = max(1, passes * (-(-len(inputs) // BATCH)))
        for _ in range(passes):
            order = rng.permutation(len(inputs))
            for start in range(0, len(order), BATCH):
                at = order[start : start + BATCH]
                blocks = [x[at].reshape(-1, BLOCK) for x in (inputs, targets, valid)]
                loss, g = self.gradients(blocks[0], first[: 2 * len(at)], blocks[1], blocks[2])
                losses.append(loss)
                adam.step(g, RATE * min(1.0, (adam.t + 1) / 20) * (1 - 0.95 * (adam.t + 1) / steps))
        self.tables = None
        return losses


class Adam:
    """Steps of the arrays p along their gradients; the arrays are replaced in p."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.t = p, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, grad in g.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            root = np.sqrt(v)
            root += 1e-8 * (1 - 0.98**self.t) ** 0.5
            self.p[k] = (self.p[k] - m / root * (rate * (1 - 0.98**self.t) ** 0.5 / (1 - 0.9**self.t))).astype(np.float32)


def known_by(pairs: np.ndarray) -> np.ndarray:
    """How much each unit's followers count: n / (n + m) for n occurrences before m different units."""
    n, m = pairs.sum(axis=1), (pairs > 0).sum(axis=1)
    return n / np.maximum(n + m, 1)


def foretold(pairs: np.ndarray, left: np.ndarray, right: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair (left, right) the weight of left, and how its followers' probability of right, its own occurrence taken
    out, stands to the network's, of which said is the logarithm."""
    n = pairs.sum(axis=1)
    return known_by(pairs)[left], np.maximum(pairs[left, right] - 1, 0) / np.maximum(n[left] - 1, 1) / (np.exp(said) + 1e-30)


def share_of(weight: np.ndarray, ratio: np.ndarray, count: np.ndarray) -> float:
    """The share of the followers by EM, from foretold() pairs that occur `count` times each."""
    share = 0.5
    for _ in range(20):
        theirs, rest = share * weight * ratio, (1 - share) * weight
        total = theirs + 1 - share * weight + 1e-30
        share = float(np.clip((count * theirs / total).sum() / max((count * (theirs + rest) / total).sum(), 1e-9), 0.01, 0.99))
    return share


def pairs_of_blocks(x: np.ndarray) -> np.ndarray:
    """Each block but the first, with the block before it in front: a view."""
    n, block, d = x.shape
    return np.lib.stride_tricks.as_strided(x, (n - 1, 2 * block, d), x.strides, writeable=False)


def turned(x: np.ndarray) -> np.ndarray:
    """The same, each turned over: a view of one array, so that products with it need not turn."""
    n, block, d = x.shape
    flat = np.ascontiguousarray(x.reshape(-1, d).T)
    return np.lib.stride_tricks.as_strided(flat, (n - 1, d, 2 * block), (block * flat.itemsize, *flat.strides), writeable=False)


def fits(total: np.ndarray) -> bool:
    """Whether these sums of exponentials need no shift."""
    return not total.size or bool(total.min() > TINY and total.max() < HUGE)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y for many rows of few columns, in short pieces: several times as fast."""
    n = len(x) - len(x) % SHORT
    out = x[n:].T @ y[n:]
    if n:
        out += (x[:n].reshape(-1, SHORT, x.shape[1]).transpose(0, 2, 1) @ y[:n].reshape(-1, SHORT, y.shape[1])).sum(axis=0)
    return out


def log_share(z: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of z @ w at the given columns; shifted only where single precision would not do."""
    y = z @ w
    picked = y[np.arange(len(at)), at]
    np.exp(y, out=y)
    total = y @ np.ones(y.shape[1], np.float32)
    if not fits(total):
        y = z @ w
        y -= y.max(axis=1, keepdims=True)
        picked, total = y[np.arange(len(at)), at], np.exp(y).sum(axis=1)
    return picked - np.log(total)


# ---------------------------------------------------------------- the model of texts


def blocked(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, valid, first): the texts' ids in whole blocks, each text from a new one, the end ahead and behind; which
    places are filled, and which blocks are a text's first."""
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(-(-lengths // BLOCK))])
    total = int(starts[-1])
    source, target = np.full(total * BLOCK, end, np.int64), np.full(total * BLOCK, end, np.int64)
    valid = np.zeros(total * BLOCK, bool)
    for t, s, n in zip(texts, starts * BLOCK, lengths, strict=False):
        source[s + 1 : s + n] = t
        target[s : s + n - 1] = t
        valid[s : s + n] = True
    first = np.zeros(total, bool)
    first[starts[:-1]] = True
    return source, target, valid, first


@dataclass
class Model:
    network: Network
    unit_of: np.ndarray
    within: np.ndarray
    end: int

    def text_scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text by the network and the pairs, given its ids."""
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        return np.add.reduceat(self.id_scores(texts), np.cumsum(lengths) - lengths) / np.log(10) if texts else np.zeros(0)

    def id_scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log of the probability of each id and end of the texts, one behind the other."""
        if not texts:
            return np.zeros(0)
        source, target, valid, first = blocked(texts, self.end)
        total = len(first)
        value = self.within[target]
        inputs, units = self.unit_of[source].reshape(-1, BLOCK), self.unit_of[target].reshape(-1, BLOCK)
        before = None
        for at in range(0, total, CHUNK):
            part = slice(at, at + CHUNK)
            said, before = self.network.log_probability(inputs[part], first[part], units[part], before)
            value[at * BLOCK : (at + CHUNK) * BLOCK] += said.ravel()
        return value[valid]


def profiles(unit_of: np.ndarray, units: int, windows: np.ndarray, columns: int) -> np.ndarray:
    """How often the first `columns` units stand before, behind and in the window of each unit."""
    out = np.zeros((units, 3 * columns), np.float32)
    for ids in (windows[i : i + 1000] for i in range(0, len(windows), 1000)):
        u = np.where(ids < 0, -1, unit_of[ids])
        for left, right, base, key in ((u[:, :-1], u[:, 1:], 0, 1), (u[:, :-1], u[:, 1:], columns, 0), (u[:, 8:], u[:, :-8], 2 * columns, 0)):
            subject, other = (right, left) if key else (left, right)
            fine = (subject >= 0) & (other >= 0) & (other < columns)
            np.add.at(out, (subject[fine], base + other[fine]), 1)
    return out


def family_of_units(profile: np.ndarray, mass: np.ndarray, families: int, seed: int = 6) -> np.ndarray:
    """k-means over the roots of the profiles, weighted by mass; large families are split by mass."""
    x = np.sqrt(profile / np.maximum(profile.sum(axis=1, keepdims=True), 1))
    rng = np.random.default_rng(seed)
    k = min(families, len(x))
    weight = np.sqrt(mass)
    centres = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())]
    for _ in range(12):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x * weight[:, None])
        total = np.bincount(near, weight, k)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centres)
    order = np.lexsort((-mass, near))
    rank = np.empty(len(near), np.int64)
    rank[order] = np.arange(len(near)) - np.searchsorted(near[order], near[order])
    return np.unique(near * len(x) + rank // LARGEST_FAMILY, return_inverse=True)[1]


def units_of(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The unit of each id, and how many ids have their own."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    own = min(UNITS, len(counts) - 1)
    unit_of = np.full(len(counts), own, np.int64)
    unit_of[order[:own]] = np.arange(own)
    return unit_of, own


def fit(counts: np.ndarray, windows: np.ndarray, passes: int = PASSES, pairs: np.ndarray | None = None) -> Model:
    """counts: of every id in all training texts, the end last; windows: rows of 2 * BLOCK + 1 ids, -1 for none;
    pairs: counts of pairs of units in all training texts.

    The UNITS most frequent ids are a unit each; all other ids share one unit, split by their counts."""
    end = len(counts) - 1
    unit_of, own = units_of(counts)
    mass = np.bincount(unit_of, counts + 0.5, own + 1)
    within = np.log((counts + 0.5) / mass[unit_of])
    family_of = family_of_units(profiles(unit_of, own + 1, windows, COLUMNS), mass, FAMILIES) if len(windows) else np.arange(own + 1) // 32
    network = Network(own + 1, family_of)
    network.start_from(mass)
    if len(windows):
        known = np.where(windows < 0, end, windows)
        shape = (len(windows), 2, BLOCK)
        network.train(unit_of[known[:, :-1]].reshape(shape), unit_of[known[:, 1:]].reshape(shape), (windows[:, 1:] >= 0).reshape(shape).astype(np.float32), passes)
    if pairs is not None:
        some = windows[:: -(-len(windows) // MOST_MIXED)] if len(windows) else windows
        known = np.where(some < 0, end, some)
        blocks = [x.reshape(-1, BLOCK) for x in (unit_of[known[:, :-1]], unit_of[known[:, 1:]], some[:, 1:] >= 0)]
        network.mix(pairs, blocks[0], np.tile([True, False], len(some)), blocks[1], blocks[2])
    return Model(network, unit_of, within, end)


# ---------------------------------------------------------------- counts and windows of the corpus

#: Kinds of rows: a text; the words of a unit's texts, as numbers; what a unit asks for; counts of a unit's ids.
TEXT, WORDS, ASKED, IDS = range(4)
ENCODED = "kind int, unit long, seq int, doc_id long, h long, fold int, ids binary, lengths binary, words binary, bucket int, first long, keys binary, n binary"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Columns by name, each a list or an array; the others are null."""
    n = len(next(iter(columns.values())))
    arrays = [pa.nulls(n, f.type) if (c := columns.get(f.name)) is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def encoded(docs: DataFrame, vocabulary: str, size: int) -> DataFrame:
    """A row per text: its unit and place in it, doc_id, hash, fold, ids (unsigned 16-bit); a row with the words of a
    unit's texts, as numbers; and rows in which the unit asks for the words' counts."""
    buckets, schema = width(docs.sparkSession), arrow_schema(ENCODED)

    def unit_rows(words: memory.Words, counts: np.ndarray, unit: int) -> Iterator[pa.RecordBatch]:
        if words.texts:
            yield record({"kind": [IDS], "unit": [unit], "n": [counts.tobytes()]}, schema)
            lengths, numbers, asked = words.rows(unit, buckets)
            yield record({"kind": [WORDS], "unit": [unit], "lengths": [lengths.tobytes()], "words": [memory.packed(numbers)]}, schema)
            if asked := list(asked):
                _, _, bucket, first, keys, _, n = zip(*asked, strict=True)
                yield record({"kind": [ASKED] * len(n), "unit": [unit] * len(n), "bucket": bucket, "first": first, "keys": keys, "n": n}, schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, number, words = shared_subwords(vocabulary, MOST_WORDS), memory.next_number(), memory.Words()
        unit, counts = number(), np.zeros(size + 1, np.int64)
        for part in text_slices(batches, "text"):
            doc_ids, hashes, folds = part.columns[:3]
            texts, seq, rows = part.column(3).to_pylist(), words.texts, part.num_rows
            train = folds.to_numpy(zero_copy_only=False) != HELD_OUT
            words.add(texts, train)
            ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in subwords.ids(texts)]
            counts[:size] += np.bincount(np.frombuffer(b"".join([x for x, t in zip(ids, train, strict=True) if t]), "<u2"), minlength=size)[:size]
            counts[size] += train.sum()
            yield record({"kind": [TEXT] * rows, "unit": [unit] * rows, "seq": list(range(seq, seq + rows)), "doc_id": doc_ids, "h": hashes, "fold": folds, "ids": ids}, schema)
            if words.chars > memory.UNIT_CHARS:
                yield from unit_rows(words, counts, unit)
                unit, words, counts = number(), memory.Words(), np.zeros(size + 1, np.int64)
        yield from unit_rows(words, counts, unit)

    text = text_column()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), fold(F.col("doc_id")).cast("int").alias("fold"), text.alias("text"))
    return rows.mapInArrow(encode, ENCODED)


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids in the training texts, the end last: one row per id reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x, np.int64) for batch in batches for x in batch.column(0).to_pylist()), np.zeros(size + 1, np.int64))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    found = rows.filter(F.col("kind") == IDS).select("n").mapInArrow(add, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 1, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def pair_counts(train: DataFrame, unit_of: np.ndarray) -> np.ndarray:
    """Counts of (unit, following unit) in all training texts, the end around each: summed in each task, then by pair;
    at most a row for each pair of units reaches the driver."""
    size, end = int(unit_of.max()) + 1, len(unit_of) - 1
    spread = train.sparkSession.sparkContext.broadcast(unit_of.astype(np.int32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, stop = np.zeros(size * size, np.int64), np.array([end], "<u2").tobytes()
        for part in text_slices(batches, "ids", PAIR_BYTES):
            u = spread.value[np.frombuffer(stop + b"".join(x + stop for x in part.column(0).to_pylist()), "<u2")]
            for at in range(0, len(u) - 1, PAIR_BYTES):
                some = u[at : at + PAIR_BYTES + 1]
                total += np.bincount(some[:-1] * np.int64(size) + some[1:], minlength=size * size)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 100_000):
            some = seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    rows = train.select("ids").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


#: Bins by weight and by logarithm of the ratio of foretold().
WEIGHTS, RATIOS, LOW, STEP = 64, 400, -20.0, 0.1
PART_FLOATS = 8192
LEARNT = "part int, weight double, arr binary"


def binned(weight: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """How many foretold() pairs lie in each bin; those with a ratio of 0 in a bin of their own."""
    with np.errstate(divide="ignore"):
        return binned_logs(bin_of(weight), np.log(ratio))


def bin_of(weight: np.ndarray) -> np.ndarray:
    return np.minimum((weight * WEIGHTS).astype(np.int64), WEIGHTS - 1) * (RATIOS + 1)


def binned_logs(base: np.ndarray, log: np.ndarray) -> np.ndarray:
    """binned(), from bin_of(weight) and the logarithm of the ratio."""
    at = np.clip((log - LOW) / STEP, 0, RATIOS - 1).astype(np.int64) + 1
    return np.bincount(base + at * (log > -np.inf), minlength=WEIGHTS * (RATIOS + 1))


def share_of_bins(bins: np.ndarray) -> float:
    weight, ratio = np.divmod(np.arange(len(bins)), RATIOS + 1)
    return share_of((weight + 0.5) / WEIGHTS, np.where(ratio > 0, np.exp(LOW + (ratio - 0.5) * STEP), 0), bins) if bins.any() else 0.5


def learn(network: Network, texts: list[np.ndarray], unit_of: np.ndarray, pairs: np.ndarray, passes: int) -> tuple[int, np.ndarray]:
    """The network goes through all tokens of the texts, passes times; how many tokens they hold, and binned() of the last pass.

    The more tokens, the more of them a step takes, and the longer it is, by the root."""
    adam, tokens = Adam(network.p), sum(len(t) + 1 for t in texts)
    step = min(2 * BATCH * max(1, round(tokens / LEAST_SHARD)), MOST_STEP) if passes == 1 else 2 * BATCH
    rate = RATE * (step / (2 * BATCH)) ** 0.5
    base, n, units = bin_of(known_by(pairs)), np.maximum(pairs.sum(axis=1) - 1, 1), len(pairs)
    with np.errstate(divide="ignore"):
        others = np.log(np.maximum(pairs - 1, 0).astype(np.float32)) - np.log(n).astype(np.float32)[:, None]
    cuts, held = [0], 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held > LEARN_IDS:
            cuts, held = [*cuts, i + 1], 0
    cuts += [len(texts)] if cuts[-1] < len(texts) else []
    for _ in range(passes):
        bins = np.zeros(WEIGHTS * (RATIOS + 1), np.int64)
        for start, stop in zip(cuts, cuts[1:], strict=False):
            source, target, valid, first = blocked(texts[start:stop], len(unit_of) - 1)
            inputs, targets, valid = unit_of[source].reshape(-1, BLOCK), unit_of[target].reshape(-1, BLOCK), valid.reshape(-1, BLOCK)
            for at in range(0, len(first), step):
                part = slice(at, at + step)
                x, y, fine = inputs[part], targets[part], valid[part]
                said, g = network.learned(x, first[part], y, fine.astype(np.float32))
                left = x[fine]
                bins += binned_logs(base.take(left), others.take(left * units + y[fine]) - said[fine])
                adam.step(g, rate * min(1.0, (adam.t + 1) / 20) / (1 + adam.t / STEADY) ** 0.5)
    return tokens, bins


def flat_of(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def unflat(flat: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    stops = np.cumsum([x.size for x in p.values()])
    return {k: part.reshape(x.shape).astype(np.float32) for (k, x), part in zip(p.items(), np.split(flat, stops[:-1]), strict=True)}


def shard_learner(network: Network, spread: Broadcast, passes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a shard makes of the network: rows of LEARNT, counts in part -1."""
    p, family_of = dict(network.p), network.family_of

    def learn_shard(table: pd.DataFrame) -> pd.DataFrame:
        own = Network(len(family_of), family_of)
        own.p = dict(p)
        table, (unit_of, pairs) = table.sort_values(["key", "size", "units"]), spread.value
        texts = [memory.unpacked(x, n, np.uint16) for x, n in zip(table["units"], table["size"], strict=True)]
        n, found = learn(own, texts, np.append(np.arange(len(pairs)), unit_of[-1]), pairs, passes)
        flat = flat_of(own.p).astype(np.float64)
        parts = [flat[at : at + PART_FLOATS] for at in range(0, len(flat), PART_FLOATS)]
        return pd.DataFrame({"part": [-1, *range(len(parts))], "weight": float(n), "arr": [x.tobytes() for x in (found, *parts)]})

    return learn_shard


def learned_network(train: DataFrame, network: Network, unit_of: np.ndarray, pairs: np.ndarray, tokens: int) -> int:
    """Fit the network on all training texts, which hold so many tokens, and mix in the pairs; how many tokens it learned from.

    A round deals its texts by a hash of doc_id and text to shards, so that equal texts are spread; each shard starts from the
    network of the round before. Parts of the shards' networks are averaged by the tokens that they saw, part by part; one
    network a round reaches the driver."""
    spark = train.sparkSession
    spread = spark.sparkContext.broadcast((unit_of, pairs))  # fixed size: units by units
    texts = train.select(F.xxhash64("doc_id", "h").alias("key"), "ids")
    place, seen, bins = F.pmod("key", F.lit(ROUNDS[-1])), 0, 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The units of each text, packed, so that the exchange is small."""
        for part in text_slices(batches, "ids"):
            units = [spread.value[0][np.frombuffer(x, "<u2")].astype(np.uint16) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(u) for u in units], pa.int32()), pa.array([memory.packed(u) for u in units], pa.binary())], names=["key", "size", "units"])

    def average(table: pd.DataFrame) -> pd.DataFrame:
        """Networks by weight; counts, in part -1, are added."""
        table = table.sort_values(["weight", "arr"])
        kind = np.int64 if table["part"].iloc[0] < 0 else np.float64
        total = table["weight"].sum()
        arr = sum(np.frombuffer(x, kind) * (1 if kind is np.int64 else w / total) for x, w in zip(table["arr"], table["weight"], strict=True))
        return pd.DataFrame({"part": table["part"].iloc[:1], "weight": [total], "arr": [arr.tobytes()]})

    single = tokens <= ONE_SHARD
    passes = min(PASSES, -(-ONE_SHARD // max(1, tokens))) if single else 1
    for low, high in ((0, ROUNDS[-1]),) if single else zip((0, *ROUNDS), ROUNDS, strict=False):
        share = tokens * (high - low) // ROUNDS[-1]
        shards = 1 if single else max(1, min(-(-share // LEAST_SHARD), MANY_SHARDS), -(-share // MOST_SHARD))

        mine = texts.filter((place >= low) & (place < high)).mapInArrow(pack, "key long, size int, units binary").withColumn("shard", F.pmod(F.shiftright("key", 8), F.lit(shards)))
        learnt = mine.repartition(shards, "shard").groupBy("shard").applyInPandas(shard_learner(network, spread, passes), LEARNT)
        found = learnt.groupBy("part").applyInPandas(average, LEARNT).toPandas().sort_values("part")
        if len(found):
            arrays = found["arr"].tolist()
            bins, seen = bins + np.frombuffer(arrays[0], np.int64), seen + round(found["weight"].iloc[0])
            network.p = unflat(np.concatenate([np.frombuffer(x, np.float64) for x in arrays[1:]]), network.p)
    network.tables = None
    network.mix_in(pairs, share_of_bins(bins) if seen else 0.5)
    spread.unpersist()
    return seen


def fit_all(counts: np.ndarray, pairs: np.ndarray, train: DataFrame) -> Model:
    """The model of all training texts: counts of their ids, the end last, counts of pairs of units, and their rows."""
    unit_of, own = units_of(counts)
    mass = np.bincount(unit_of, counts + 0.5, own + 1)
    profile = np.concatenate([pairs[:COLUMNS].T, pairs[:, :COLUMNS]], axis=1).astype(np.float32)
    network = Network(own + 1, family_of_units(profile, mass, FAMILIES))
    network.start_from(mass)
    learned_network(train, network, unit_of, pairs, int(counts.sum()))
    return Model(network, unit_of, np.log((counts + 0.5) / mass[unit_of]), len(counts) - 1)


SCORED = "unit long, piece long, seqs binary, totals binary, parts binary, said binary, places binary, bucket int, first long, keys binary, more binary, n binary"


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """For pieces of units: the texts' log probabilities by the network, their segments, and rows that ask for these."""
    buckets, schema = width(rows.sparkSession), arrow_schema(SCORED)
    spread = rows.sparkSession.sparkContext.broadcast(model)  # fixed size: the vocabulary's arrays and the network

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, unit, passages = memory.next_number(), None, memory.Passages()

        def out() -> Iterator[pa.RecordBatch]:
            if passages.found:
                own, asked = passages.rows(unit, number(), buckets)
                yield record(dict(zip(("unit", "piece", "seqs", "totals", "parts", "said", "places"), ([x] for x in own), strict=True)), schema)
                if asked := list(asked):
                    yield record(dict(zip(("unit", "piece", "bucket", "first", "keys", "more", "n"), zip(*asked, strict=True), strict=True)), schema)

        for part in text_slices(batches, "ids"):
            units, seqs, folds = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            texts = [np.frombuffer(x, "<u2") for x in part.column(3).to_pylist()]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(units)) + 1, [len(units)]])
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if units[start] != unit or passages.held > MOST_HELD:
                    yield from out()
                    unit, passages = int(units[start]), memory.Passages()
                some = texts[start:stop]
                passages.add(seqs[start:stop], folds[start:stop] != HELD_OUT, some, spread.value.id_scores(some))
        yield from out()

    return rows.select("unit", "seq", "fold", "ids").mapInArrow(score_all, SCORED)


#: Further kinds of rows in a unit's group: counts of words, segments, counts of passages.
COUNTED, PIECE, PASSAGE = range(4, 7)


def gathered(rows: DataFrame, words: DataFrame, pieces: DataFrame, passages: DataFrame) -> DataFrame:
    """All that was found out about the texts of each unit."""
    plain = (("kind", "int"), ("unit", "long"), ("piece", "long"), ("seq", "int"), ("doc_id", "long"), ("fold", "int"), ("first", "long"))
    binary = ("lengths", "words", "own", "all", "seqs", "totals", "parts", "said", "places")

    def like(df: DataFrame) -> DataFrame:
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (*plain, *((c, "binary") for c in binary))))

    tables = (rows, words.withColumn("kind", F.lit(COUNTED)), pieces.withColumn("kind", F.lit(PIECE)), passages.withColumn("kind", F.lit(PASSAGE)))
    return like(tables[0]).unionByName(like(tables[1])).unionByName(like(tables[2])).unionByName(like(tables[3]))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
def finish(table: pd.DataFrame, n: int, v: int, ends: int, share: np.ndarray) -> pd.DataFrame:
    """RESULT for the texts of one unit."""
    of = {kind: part for kind, part in table.groupby("kind")}
    none = table.iloc[:0]
    docs, words = of[TEXT].sort_values("seq"), of[WORDS].iloc[0]
    lengths = np.frombuffer(words["lengths"], np.uint32).astype(np.int64)
    numbers = memory.unpacked(words["words"], int(lengths.sum()))
    count = memory.array_of(of.get(COUNTED, none).sort_values("first"), "own", np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    known = np.bincount(text, (count > 0)[numbers], len(lengths)).astype(np.int64) + (ends > 0)
    base = np.bincount(text, np.log10(count + 0.5)[numbers], len(lengths)) + np.log10(ends + 0.5) - (lengths + 1) * np.log10(n + 0.5 * (v + 1))
    train = (docs["fold"] != HELD_OUT).to_numpy()
    score, answers = np.zeros(len(docs)), dict(list(of.get(PASSAGE, none).groupby("piece")))
    for piece in of[PIECE].itertuples():
        seqs, said, at = np.frombuffer(piece.seqs, np.uint32), np.frombuffer(piece.said, np.float32).astype(np.float64), np.frombuffer(piece.places, np.uint32)
        score[seqs] = np.frombuffer(piece.totals, np.float64)
        if len(at):
            seqs, found = np.repeat(seqs, np.frombuffer(piece.parts, np.uint32)), answers[piece.piece].sort_values("first")
            c, total = (memory.array_of(found, x, np.int64)[at] for x in ("own", "all"))
            score += np.bincount(seqs, memory.mixed(said, c, total, train[seqs], share) - said, len(score))
    return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64").to_numpy(), "held_out": ~train, "n_tokens": lengths + 1, "n_known": known, "train_tokens": np.int64(n), "base_score": base, "score": score / np.log(10)})


def score(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    path = vocabulary or vocabulary_path()
    size = shared_subwords(path).tokenizer.get_vocab_size()
    rows = squeezed(encoded(docs, path, size), "encoded")
    texts = rows.filter(F.col("kind") == TEXT)
    train = texts.filter(F.col("fold") != HELD_OUT)
    words = squeezed(memory.answered(rows.filter(F.col("kind") == ASKED).select("unit", F.lit(-1).cast("long").alias("piece"), "bucket", "first", "keys", F.lit(None).cast("binary").alias("more"), "n")), "words")
    total = words.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    counts = id_counts(rows, size)
    ends = int(counts[size])
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    model = fit_all(counts, pair_counts(train, units_of(counts)[0]), train)
    pieces = squeezed(scored(texts, model), "scored")
    passages = squeezed(memory.answered(pieces.filter("bucket is not null").select("unit", "piece", "bucket", "first", "keys", "more", "n")), "passages")
    share = memory.shares(passages)
    found = gathered(rows.filter(F.col("kind").isin(TEXT, WORDS)), words, pieces.filter("bucket is null"), passages)
    return found.groupBy("unit").applyInPandas(lambda table: finish(table, n, v, ends, share), RESULT)


def squeezed(df: DataFrame, name: str) -> DataFrame:
    """Staged, with the tighter of the usual codecs: arrays of numbers are most of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
