import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import fingerprints as fp


@settings(max_examples=60, deadline=None)
@given(st.text("abé", max_size=60), st.text("abé", max_size=60), st.integers(0, 59), st.integers(0, 59))
def test_spans_and_extensions(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = fp.PrefixHashes(fp.codes_of(a)), fp.PrefixHashes(fp.codes_of(b))
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert fp.common_extension(x, i, y, j) == n
    size = min(len(a) - i, len(b) - j)
    assert fp.same_span(x, i, y, j, size) == (a[i : i + size] == b[j : j + size])


def test_spans_across_blocks():
    text = "0123456789abcde" * 20_000
    x = fp.PrefixHashes(fp.codes_of(text))
    w = x.windows()
    assert len(np.unique(w)) == 15
    assert fp.same_span(x, 3, x, 3 + 15 * 9_000, 100_000)
    assert not fp.same_span(x, 3, x, 4 + 15 * 9_000, 100_000)
    assert w[70_000] == x.span(70_000, 70_000 + fp.SPAN)[0]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for n, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        p, e, q = (fp.fingerprint(t) for t in (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), p, e, fp.likeness(p, e), fp.likeness(p, q)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, texts, odd):
    for rows, df in ((texts, spark.createDataFrame(texts, "doc_id long, text string").repartition(5)), ([(r["doc_id"], r["text"]) for r in odd.collect()], odd)):
        got = sorted((tuple(r)[:7] for r in fp.edited_fingerprints(df).collect()), key=str)
        assert got == brute(rows)


def test_likeness_tells_edits_from_others(spark, texts):
    rows = fp.edited_fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    long = [r for r in rows if r["n_chars"] > 400]
    assert all(r["near_edited"] > 0.4 for r in long)
    assert sum(r["near_next"] < 0.2 for r in long) > 0.9 * len(long)
    assert len({r["fingerprint"] for r in rows}) == len({t or "" for _, t in texts})


def test_empty_and_single(spark, none):
    assert fp.edited_fingerprints(none).collect() == []
    r = fp.edited_fingerprints(spark.createDataFrame([(5, "abcd" * 30)], "doc_id long, text string")).first()
    assert r["n_chars"] == 120 and r["near_next"] == 1.0
