import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from waymark.llm import packing
from waymark.llm.subwords import Subwords


def reference():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_cached_ids_are_the_tokenizers(texts):
    plain = [t or "" for _, t in texts]
    odd = ["", "don't I'LL 12½ x² ªº", "a\x1cb\x85c\xa0d", "Σας ΑΣ ǅ İ", "é ä", "x" * 500, "​word next", "<|endoftext|> <|startoftext|>", "日本語 テスト 12", "!!??...'s's"]
    own, tok = Subwords(), reference()
    for batch in (plain[:50], odd, plain[50:] + odd):
        want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(batch, add_special_tokens=False)]
        assert own.ids(batch) == want


def check(rows, capacity=packing.CAPACITY):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_sequences(spark, texts, odd):
    tok = reference()
    for df in (spark.createDataFrame(texts, "doc_id long, text string"), odd):
        rows = packing.pack(df).collect()
        want = Counter()
        for r in df.collect():
            ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 2048):
                part = ids[k : k + 2048]
                want[r["doc_id"], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        least = -(-sum(r["length"] for r in rows) // 2048)
        assert check(rows) <= 1.02 * least + 2


def test_plans_place_every_piece():
    rng = np.random.default_rng(1)
    for trial in range(6):
        lengths = rng.integers(1, 2049, 3000) if trial % 2 else np.clip(rng.lognormal(6, 1.2, 3000).astype(int), 1, 2048)
        counts = Counter(lengths.tolist())
        runs = packing.plan(counts)
        fill, placed = defaultdict(list), Counter()
        for r in runs:
            for rank in range(r.lo, r.hi):
                fill[r.sequence + (rank - r.lo) // r.per_bin].append((r.offset + (rank - r.lo) % r.per_bin * r.length, r.length))
                placed[r.length, rank] += 1
        assert set(placed.values()) == {1} and len(placed) == 3000
        for spans in fill.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(fill) <= 1.03 * -(-lengths.sum() // 2048) + 1


def test_configurations_reach_the_optimum():
    found = packing.configurations(np.array([1200, 1000, 848]), np.array([10, 10, 10]), 2048)
    assert abs(sum(x for x, _ in found) - 15) < 1e-6  # 1200 + 848 ten times, 1000 + 1000 five times


def test_empty(none):
    assert packing.pack(none).collect() == []
