import hashlib
import itertools
import zlib

import numpy as np

from waymark.llm import chat


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    chain = chat.Chain.from_counts(rng.integers(0, 30, chat.STATES + chat.STATES**2 + sum(chat.STATES * n for n in chat.SIZES)).astype(float))
    seen = np.stack([rng.integers(0, n, 5) for n in chat.SIZES], axis=1)

    def value(path):
        total = chain.start[path[0]] + sum(chain.step[a, b] for a, b in zip(path, path[1:], strict=False))
        return total + sum(e[s, row[i]] for s, row in zip(path, seen, strict=True) for i, e in enumerate(chain.emit))

    best = max(itertools.product(range(chat.STATES), repeat=5), key=value)
    assert np.isclose(value(chain.path(seen)), value(best))
    assert chain.path(seen[:0]) == []


def test_markers():
    for line, role in (("User: hi", 1), ("### Human", 1), ("[bot] yes", 2), ("<|system|>", 0), ("**Q:** what", 1), ("model > ok", 2), ("A thing", -1), ("the user: x", -1), ("", -1), ("Note: x", -1)):
        assert chat.speaker(line) == role


def test_held_out_roles(spark, sf):
    sf = sf.replace("0.001", "0.01")
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = chat.format_conversations(table).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lines_right"] for r in held) > 0.9 * sum(r["lines_known"] for r in held)
    assert len(rows) == table.select("conv_id").distinct().count() and sum(r["n_turns"] for r in rows) == table.count()
    assert all(r["rendered"].count("<|end|>") >= r["found_turns"] for r in rows)


def test_marked_turns_come_back_whole():
    turns = [(0, "user", "one\ntwo"), (1, "assistant", "three\n\nfour?")]
    for conv in range(40):
        lines, truth = chat.write_transcript(conv, turns)
        parsed = chat.turns_of(lines, truth)
        assert parsed == [("user", "one\ntwo"), ("assistant", "three\n\nfour?")]
    assert chat.render(parsed) == "<|user|>\none\ntwo\n<|end|>\n<|assistant|>\nthree\n\nfour?\n<|end|>\n"


def test_odd_conversations(spark):
    schema = "conv_id long, turn int, role string, text string, segment long, turns string, slab int, opens string, h string, uid string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, 2, "tool", "x"), (None, 0, "assistant", ""), (2, None, "system", "s"), (2, 700, "user", "later"), (3, 0, "user", "w " * 200_000)]
    df = spark.createDataFrame([(*r, 9, "t", 1, "o", "h", "u") for r in rows], schema)
    got = {(r["conv_id"], r["segment"]): r for r in chat.format_conversations(df).collect()}
    assert set(got) == {(1, 0), (None, 0), (2, 0), (3, 0)}
    assert got[1, 0]["n_turns"] == 4 and got[1, 0]["lines_known"] >= 1
    assert chat.format_conversations(spark.createDataFrame([], schema)).collect() == []


def brute(rows):
    """The whole operator without Spark and without slabs: conv_id -> turns, lines, found turns, roles, known, right, rendering."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text or ""))
    lower = lambda x: (x is not None, x if x is not None else 0)
    said = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (lower(t[0]), (t[1] is not None, t[1] or ""), hashlib.md5(t[2].encode()).hexdigest()))
        said[conv] = chat.write_transcript(conv, turns)
    learnt = [chat.count(*x) for conv, x in said.items() if conv is None or zlib.crc32(str(conv).encode()) % chat.FOLDS]
    chain = chat.Chain.from_counts(sum(learnt, np.zeros(chat.STATES + chat.STATES**2 + sum(chat.STATES * n for n in chat.SIZES))))
    out = {}
    for conv, (lines, truth) in said.items():
        states = chain.path(chat.features(lines))
        blocks = chat.blocks_of(lines, states)
        known = [(s, t) for s, t in zip(states, truth, strict=True) if t >= 0]
        out[conv] = (len(by[conv]), len(lines), len(blocks), [r for r, _ in blocks], len(known), sum(s // 2 == t // 2 for s, t in known), chat.rendered(blocks))
    return out


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r["conv_id"]), r["segment"])):
        old = out.get(r["conv_id"], (0, 0, 0, [], 0, 0, ""))
        assert r["segment"] == 0 or r["conv_id"] in out
        new = (r["n_turns"], r["n_lines"], r["found_turns"], [x for x in r["roles"].split(",") if x], r["lines_known"], r["lines_right"], r["rendered"])
        out[r["conv_id"]] = tuple(a + b for a, b in zip(old, new, strict=True))
    return out


def test_against_brute_force(spark, sf, monkeypatch):
    """All columns, on the table and on long conversations: one of repeated turns, one of null turns, and the null one."""
    table = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rng = np.random.default_rng(3)
    text = lambda: "\n".join(rng.choice(["", "is it so?", "yes", "a longer line of words in it", "User: not me", " "], rng.integers(1, 4)))
    long = [(conv, turn(i), rng.choice(["user", "assistant", "system", "tool"]).item() if i % 9 else None, text() if i % 7 else None) for conv, turn in ((10**6, lambda i: i), (10**6 + 1, lambda i: None), (None, lambda i: i % 3), (10**6 + 2, lambda i: 5)) for i in range(60)]
    for rows, slab in ((table, 512), (table + long, 5), (long, 2)):
        monkeypatch.setattr(chat, "SLAB", slab)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        assert whole(chat.format_conversations(df).collect()) == brute(rows)
