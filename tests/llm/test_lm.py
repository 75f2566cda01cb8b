import math
import re
import zlib
from collections import Counter

import numpy as np

from waymark.llm import lm, memory


def test_gradients():
    rng = np.random.default_rng(0)
    net = lm.Network(30, np.arange(30) % 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs, targets = rng.integers(0, 30, (4, lm.BLOCK)), rng.integers(0, 30, (4, lm.BLOCK))
    first, valid = np.array([True, False, True, False]), np.ones((4, lm.BLOCK))
    valid[3, 20:] = 0
    loss, g = net.gradients(inputs, first, targets, valid)
    for name, x in net.p.items():
        at = tuple(rng.integers(0, s) for s in x.shape)
        if name == "e":
            at = (inputs[1, 3], at[1])
        old, h = x[at], 1e-5
        x[at] = old + h
        up = net.gradients(inputs, first, targets, valid)[0]
        x[at] = old - h
        down = net.gradients(inputs, first, targets, valid)[0]
        x[at] = old
        assert np.isclose((up - down) / 2 / h, g[name][at], rtol=1e-4, atol=1e-9)
    said, _ = net.log_probability(inputs, first, targets)
    assert np.isclose(-(said * valid).sum() / valid.sum(), loss)


def small_model():
    counts = np.zeros(41, np.int64)
    counts[:40] = np.arange(40, 0, -1)
    counts[40] = 5
    rng = np.random.default_rng(1)
    return lm.fit(counts, rng.integers(0, 40, (64, 2 * lm.BLOCK + 1)), passes=1)


def test_probabilities_sum_to_one_and_look_only_back():
    model = small_model()
    ids = np.random.default_rng(2).integers(0, 40, 150)
    units = [model.text_scores([np.concatenate([ids[:70], [i]])])[0] for i in range(40)]
    ends = model.text_scores([ids[:70]])[0]
    # over all ids and the end at place 70, given the first 70
    prefix = sum_before(model, ids[:70])
    after = [u - sum_end(model, np.concatenate([ids[:70], [i]])) for i, u in enumerate(units)]
    assert np.isclose(sum(10 ** (a - prefix) for a in after) + 10 ** (ends - prefix), 1, atol=1e-5)


def test_pairs_of_all_texts(spark):
    texts = [[3, 4, 5, 3, 4], [], [40, 7], [3, 4], [7] * 5]
    df = spark.createDataFrame([(np.array(t, "<u2").tobytes(),) for t in texts], "ids binary").repartition(3)
    unit_of = np.minimum(np.arange(51), 41)
    want = np.zeros((42, 42), np.int64)
    for t in texts:
        for a, b in zip([50, *t], [*t, 50], strict=True):
            want[unit_of[a], unit_of[b]] += 1
    assert (lm.pair_counts(df, unit_of) == want).all()
    assert (lm.pair_counts(df.filter("false"), unit_of) == 0).all()


def test_pairs_are_mixed_in():
    counts, rng = np.full(41, 1000), np.random.default_rng(1)
    windows = rng.integers(0, 40, (64, 2 * lm.BLOCK + 1))
    unit_of, own = lm.units_of(counts)
    pairs = np.ones((own + 1, own + 1), np.int64)
    pairs[unit_of[np.arange(40)], unit_of[(np.arange(40) + 1) % 40]] += 1000
    model = lm.fit(counts, windows, passes=1, pairs=pairs)
    units = np.arange(own + 1)
    rows = np.full((own + 1, lm.BLOCK), units[3])
    said = model.network.log_probability(rows, np.ones(own + 1, bool), np.tile(units[:, None], lm.BLOCK))[0]
    assert np.isclose(np.exp(said[:, 5]).sum(), 1, atol=1e-5)


def test_score_knows_texts_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_SAMPLED", 1)
    words = "river stone garden window summer market engine letter winter people".split()
    rng = np.random.default_rng(5)
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1][:200]
    mixed = " ".join(words[i] for i in np.concatenate([rng.permutation(10) for _ in range(6)]))
    rows = [(i, " ".join(words * 6)) for i in [*train, held[0]]] + [(held[1], mixed)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 20


def sum_before(model, ids):
    return token_scores(model, ids)[:-1].sum()


def sum_end(model, ids):
    return token_scores(model, ids)[-1]


def token_scores(model, ids):
    """Every token scored from its own two blocks alone."""
    full = np.concatenate([ids, [model.end]])
    source = np.concatenate([[model.end], ids])
    out = []
    for i, t in enumerate(full):
        block = i // lm.BLOCK
        start = max(0, block - 1) * lm.BLOCK
        rows = np.full((block + 1 - max(0, block - 1), lm.BLOCK), model.end)
        rows.ravel()[: i + 1 - start] = source[start : i + 1]
        targets = np.zeros_like(rows)
        targets.ravel()[i - start] = model.unit_of[t]
        first = np.array([True] + [False] * (len(rows) - 1))
        said = model.network.log_probability(model.unit_of[rows], first, targets)[0].ravel()[i - start]
        out.append((said + model.within[t]) / math.log(10))
    return np.array(out)


def test_batches_score_each_token_once(monkeypatch):
    model = small_model()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, n) for n in (0, 1, 15, 16, 17, 31, 32, 33, 200, 64)]
    want = [token_scores(model, t).sum() for t in texts]
    for chunk in (1, 2, 256):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        assert np.allclose(model.text_scores(texts), want, rtol=1e-4)


def base(rows):
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    out = []
    for (d, _), ws, h in zip(rows, words, held, strict=True):
        score = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[w] for w in ws), ends])
        out.append((d, h, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, score))
    return out


def test_base_scores(spark, texts, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "MOST_SAMPLED", 40)
    for df in (spark.createDataFrame(texts, "doc_id long, text string"), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = sorted(lm.score(df).collect(), key=lambda r: (str(r["doc_id"]), r["base_score"]))
        want = sorted(base(rows), key=lambda r: (str(r[0]), r[5]))
        assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
        assert np.allclose([r["base_score"] for r in got], [w[5] for w in want])
        assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)
    assert lm.score(none).collect() == []


def test_segments_cover_a_text_from_its_first_anchor():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 50, n).astype("<u2") for n in (0, 3, 4, 5, 400, 90)]
    values = rng.normal(size=sum(len(t) + 1 for t in texts))
    text, said, context, follow = memory.segments(texts, values)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    for i, t in enumerate(texts):
        mine = said[text == i]
        assert (len(mine) > 0) == (len(t) >= memory.CONTEXT)
        assert np.isclose(mine.sum(), values[at[i] + memory.CONTEXT : at[i + 1]].sum() if len(mine) else 0)
    again = memory.segments([texts[4], texts[4][:-1]], rng.normal(size=801))
    first, second = ((again[2][again[0] == i], again[3][again[0] == i]) for i in (0, 1))
    assert (first[0] == context[text == 4]).all() and (first[1] == follow[text == 4]).all()
    assert (first[1][: len(second[1]) - 1] == second[1][:-1]).all() and first[1][len(second[1]) - 1] != second[1][-1]


def test_counts_travel_as_arrays(spark):
    """Against plain counting: three units, keys in common, in four buckets."""
    rng = np.random.default_rng(6)
    pool = np.sort(rng.integers(0, 2**64, 40, np.uint64))
    units = [np.unique(rng.choice(pool, 30)) for _ in range(3)]
    counts = [rng.integers(0, 3, len(u)) for u in units]
    total = Counter()
    for u, c in zip(units, counts, strict=True):
        total.update(dict(zip(u.tolist(), c.tolist(), strict=True)))
    rows = [r for i, (u, c) in enumerate(zip(units, counts, strict=True)) for r in memory.ask(i, 7, 4, u, np.zeros(0, np.uint32), c)]
    assert len({r[2] for r in rows}) == 4
    got = memory.answered(spark.createDataFrame(rows, memory.ASKED)).collect()
    for i, u in enumerate(units):
        own = b"".join(r["own"] for r in sorted(got, key=lambda r: r["first"]) if r["unit"] == i)
        assert [total[int(k)] for k in u] == np.frombuffer(own, np.int64).tolist()
    assert sum(r["kinds"] for r in got) == sum(v > 0 for v in total.values())
    assert sum(r["total"] for r in got) == sum(total.values())


def test_shares_of_passages_against_counting(spark):
    rows = [(1 << 60, 10), (1 << 60, 10), (1 << 60, 11), (2 << 60, 20), (3 << 60, 30), (3 << 60, 30)]
    asked = []
    for unit, part in enumerate((rows[:2], rows[2:])):
        pairs = sorted(set(part))
        keys, more = (np.array(x, t) for x, t in zip(zip(*pairs, strict=True), (np.uint64, np.uint32), strict=True))
        asked += memory.ask(unit, 0, 3, keys, more, np.array([part.count(p) for p in pairs]))
    share = memory.shares(memory.answered(spark.createDataFrame(asked, memory.ASKED)))
    # two others: 10 is foretold by one of two, twice, 11 never; one other: 30, both times
    assert np.isclose(share[1], (0.5 + 0.5 + 0) / 3) and np.isclose(share[0], 0.99)


def test_texts_that_occur_twice_stand_apart(spark, texts):
    """Copies in other training texts raise a text's score, its own occurrence does not."""
    rows = [(i, t) for i, t in texts if t and len(t) > 300 and zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [r for r, n in zip(rows, (Counter(t for _, t in rows)[t] for _, t in rows), strict=True) if n == 1][:60]
    free = [i for i in range(10**6, 10**6 + 99) if zlib.crc32(str(i).encode()) % 5 != 1]
    df = spark.createDataFrame(rows + [(i, t) for i, (_, t) in zip(free, rows[:20], strict=False)], "doc_id long, text string")
    got = {r["doc_id"]: (r["score"] - r["base_score"]) / r["n_tokens"] for r in lm.score(df).collect()}
    twice, once = [got[i] for i, _ in rows[:20]], sorted(got[i] for i, _ in rows[20:])
    assert np.mean(np.array(twice) > once[int(len(once) * 0.9)]) > 0.8


def test_words_are_hashed_as_they_stand():
    texts = ["A a\tB  b", "", " \x0b", "caf\u00e9 CAF\u00c9 caf\u00c9 \U0001f600", "ab ba abc a" + "x" * 9000 + " a" + "x" * 9000 + " a" + "x" * 8999 + "y", "a\x1cb"]
    words = memory.Words()
    words.add(texts, np.array([True, False, True, True, False, True]))
    lengths, numbers, asked = words.rows(1, 2)
    flat = [w for t in texts for w in t.encode().lower().split()]
    assert lengths.tolist() == [len(t.encode().lower().split()) for t in texts]
    assert len({(w, n) for w, n in zip(flat, numbers.tolist(), strict=True)}) == len(set(flat)) == len(set(numbers.tolist()))
    n = np.concatenate([np.frombuffer(r[6], np.int64) for r in asked])
    assert n[numbers].tolist() == [sum(v.encode().lower().split().count(w) for v, k in zip(texts, (1, 0, 1, 1, 0, 1), strict=True) if k) for w in flat]
    assert (memory.unpacked(memory.packed(numbers), len(numbers)) == numbers).all()


def test_network_learns_from_every_training_text(spark, monkeypatch):
    """Every token of every training text, in rounds of shards as in one; what only the last texts say is known."""
    rng, unit_of = np.random.default_rng(7), np.arange(51)
    rows = [(i, i * 7919, rng.integers(0, 50, int(rng.integers(0, 90))).astype("<u2").tobytes()) for i in range(400)] + [(None, 5, b"")]
    df = spark.createDataFrame(rows, "doc_id long, h long, ids binary").repartition(5)
    tokens, pairs = sum(len(r[2]) // 2 + 1 for r in rows), lm.pair_counts(df, unit_of)
    for one in (lm.ONE_SHARD, 0):
        monkeypatch.setattr(lm, "ONE_SHARD", one)
        monkeypatch.setattr(lm, "LEAST_SHARD", 3000)
        network = lm.Network(51, unit_of % 7)
        network.start_from(pairs.sum(axis=1) + 0.5)
        assert lm.learned_network(df, network, unit_of, pairs, tokens) == tokens
        said = network.log_probability(np.full((51, lm.BLOCK), 3), np.ones(51, bool), np.tile(unit_of[:, None], lm.BLOCK))[0]
        assert np.isclose(np.exp(said[:, 5]).sum(), 1, atol=1e-5)
    learnt = []
    monkeypatch.setattr(lm.Network, "learned", lambda self, x, f, y, v, old=lm.Network.learned: (learnt.append(int(v.sum())), old(self, x, f, y, v))[1])
    texts = [np.frombuffer(r[2], "<u2") for r in rows]
    assert lm.learn(lm.Network(51, unit_of % 7), texts, unit_of, pairs, 2)[0] == tokens and sum(learnt) == 2 * tokens


def test_share_from_bins_is_close_to_the_exact_one():
    rng = np.random.default_rng(8)
    weight, ratio = rng.random(20000), np.where(rng.random(20000) < 0.2, 0, np.exp(rng.normal(0, 2, 20000)))
    assert np.isclose(lm.share_of_bins(lm.binned(weight, ratio)), lm.share_of(weight, ratio, np.ones(20000)), atol=0.01)


def test_gradients_in_parts_and_of_large_sums(monkeypatch):
    """Blocks are attended to a few at a time, across whose ends keys and values are shared; sums beyond single range are shifted."""
    rng = np.random.default_rng(9)
    net = lm.Network(30, np.arange(30) % 5)
    inputs, targets = rng.integers(0, 30, (7, lm.BLOCK)), rng.integers(0, 30, (7, lm.BLOCK))
    first, valid = np.array([True, False, False, False, True, False, False]), np.ones((7, lm.BLOCK))
    want, g = net.learned(inputs, first, targets, valid)
    for part in (1, 2, 3):
        monkeypatch.setattr(lm, "ATTEND", part)
        said, some = net.learned(inputs, first, targets, valid)
        assert np.allclose(said, want, atol=1e-5) and all(np.allclose(some[k], g[k], atol=1e-6) for k in g)
    for k, by in (("k", 400), ("bu", None)):
        net.p[k] = (net.p[k] + np.float32(300) if by is None else net.p[k] * np.float32(by)).astype(np.float32)
        said, some = net.learned(inputs, first, targets, valid)
        net.tables = None
        assert np.allclose(said, net.log_probability(inputs, first, targets)[0], rtol=1e-4, atol=1e-4)
        assert all(np.isfinite(x).all() for x in some.values())


def test_large_shards_take_longer_steps(monkeypatch):
    """Every token once, in no fewer steps than a shard of LEAST_SHARD tokens has, and not in one for each 2 * BATCH blocks."""
    steps, rng = [], np.random.default_rng(10)
    monkeypatch.setattr(lm, "LEAST_SHARD", 4 * 2 * lm.BATCH * lm.BLOCK)
    monkeypatch.setattr(lm.Network, "learned", lambda self, x, f, y, v, old=lm.Network.learned: (steps.append(int(v.sum())), old(self, x, f, y, v))[1])
    for shards, most in ((1, 8), (4, 8)):
        steps.clear()
        texts = [rng.integers(0, 50, 63).astype("<u2") for _ in range(shards * lm.LEAST_SHARD // 64)]
        assert lm.learn(lm.Network(51, np.arange(51) % 7), texts, np.arange(51), np.ones((51, 51), np.int64), 1)[0] == shards * lm.LEAST_SHARD
        assert sum(steps) == shards * lm.LEAST_SHARD and 4 <= len(steps) <= most


def test_packed_units_are_small():
    rng = np.random.default_rng(11)
    for units in (np.minimum(rng.zipf(1.3, 1000), lm.UNITS).astype(np.uint16), np.zeros(0, np.uint16), np.array([lm.UNITS], np.uint16)):
        raw = memory.packed(units)
        assert (memory.unpacked(raw, len(units), np.uint16) == units).all()
        assert len(units) < 1000 or len(raw) < 0.75 * units.nbytes
