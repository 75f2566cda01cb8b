import re
from collections import Counter

import duckdb

from waymark.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The counts in their plainest form."""
    words, seen, dups = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


TEXTS = ["", " \n\t ", "x", "a a a a", "a b c a b c", "a b a b a", "é ü \x1c y\x1f z", "# | <b> ** %\n# | <b> ** %\n\n\n", "one two three. one two three. one two four", "w\r\nw\r\n w", "\U0001f600 \U0001f600 \U0001f600 \U0001f600", "p q r s p q r s q r s t"]


def test_counts_against_brute_force(texts):
    for text in [*TEXTS, *(t for _, t in texts if t is not None)]:
        m = quality_rules.measure(text)
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == plain(text)


def test_many_distinct_words_do_not_overflow():
    words = [str(i).encode() for i in range(1 << 21)] + [b"1", b"2", b"3", b"x", b"1", b"2", b"4"]
    assert quality_rules.repeated_words(words) == 6


def test_rules_of_lines():
    def rules(text):
        return {x["line"]: x["rule"] for x in quality_rules.measure(text)["lost"]}

    assert rules("A sentence ends here.\nHome | About | Contact | Imprint.\nSign up for more!\nstray heading\n\nA sentence ends here.") == {1: "navigation", 2: "boilerplate", 3: "open end", 5: "repeated"}
    assert rules("of%%% the&&& thing$$$ is ended.\n\"He said so.\"\n他来了。\nEnd (of it).") == {0: "symbols"}
    assert rules("a line of a paragraph that is wrapped at some width and\nso goes on below, ending here.") == {}
    assert rules("| |") == {0: "symbols"} or rules("| |") == {0: "open end"}


def test_cleaned_texts(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    junk = "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i} | f{i} | g{i}" for i in range(12))
    rows = [(1, prose + "\nHome | News | More\n" + "Tail.", 3, "k"), (2, prose + "\n" + junk, 3, "k"), (3, "short.", 6, "k"), (None, prose, None, None), (4, None, None, "k"), (None, prose, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _m string")
    kept = quality_rules.cleaned(docs).collect()
    clean = prose + "\nTail."
    assert sorted(map(tuple, kept), key=str) == sorted([(1, clean, len(clean), "k"), (None, prose, len(prose), None), (None, prose, len(prose), None)], key=str)
    assert quality_rules.cleaned(docs).schema == docs.schema
    lines = quality_rules.report(docs).filter("doc_id = 1").collect()
    assert [(r["line"], r["rule"]) for r in lines] == [(1, "open end")]


def test_a_text_that_loses_half_stays(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)) + ".", " ".join(f"x{i}%%" for i in range(30))
    rows = spark.createDataFrame([(1, f"{good}\n{bad}"), (2, f"{good}\n{bad} y%%")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality_rules.measured(rows).collect()} == {1: True, 2: False}


def test_odd_rows(odd, none):
    found = quality_rules.measured(odd).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(found) == odd.count()
    assert all((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(texts[r["doc_id"]]) for r in found)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in found)
    assert quality_rules.measured(none).collect() == [] and quality_rules.cleaned(none).schema == none.schema and quality_rules.cleaned(none).collect() == []


def test_query_against_sql_and_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = quality_rules.measured(docs)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({quality_rules.oracle_sql()})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    known = found.join(labels, "doc_id").filter("not base_failed").collect()
    assert known and all(r["kept"] == (r["quality"] == 1) for r in known)
