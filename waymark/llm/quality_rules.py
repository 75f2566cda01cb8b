"""Quality rules, line first: lines that fail a rule are removed, then documents that lose too much of their text.

Every \\n-split line that holds a word is held against the rules in turn; the first that it breaks is its reason:

1. "symbols" (punctuation): more than a tenth of its words hold two marks of `#*$%&|<>!` in a row.
2. "open end" (punctuation): it has fewer than WRAPPED words and does not end in a mark that ends a sentence. A longer
   line may be a wrapped line of a paragraph, and stays.
3. "navigation": two or more of its words are separators by themselves, and they make up a tenth of its words.
4. "boilerplate": it has fewer than WORDY words and holds one of PHRASES.
5. "repeated" (boilerplate): it equals an earlier line of the text. The first one is held against the rules alone.

A text is rejected if the words of its removed lines are more than MOST_LOST percent of its words, or if it fails one
of the two base rules over the whole text (fewer than LEAST_WORDS words; more than MOST_REPEATED percent of its words
stand in three-word windows that occur twice or more). A text is read once, whole, in the task that scans it: nothing is
exchanged. Words are runs of anything but ASCII white space; characters are code points.

Defined cases: a null text has no words; an empty text or one of white space alone has none either and fails the base
rule; lines without a word are neither counted nor removed; a text of any length is measured whole, a row at a time;
rows that repeat are each measured, also under null or equal doc_ids; an empty table gives an empty result; extra columns
are ignored by measured() and report(), and kept as they are by cleaned().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from waymark.llm.common import free, text_column, text_slices

LEAST_WORDS, MOST_REPEATED, MOST_LOST, WRAPPED, WORDY, SYMBOL_SHARE, SEPARATOR_SHARE = 50, 50, 50, 10, 30, 10, 10

#: The marks that n_symbols counts; those of them, and "!", that make a word odd when two stand together.
SYMBOLS, RUN = "#*$%&|<>", r"[#*$%&|<>!]{2}"
#: Marks that end a sentence, and what may close behind them.
ENDS, CLOSES = (".", "!", "?", ":", ";", "…", "。", "！", "？"), ('"', "'", ")", "]", "”", "’", "»")
#: Words that separate the entries of menus.
SEPARATORS = ("|", "||", ">", ">>", "»", "«", "<", "/", "//", "·", "•", "::", "→", "←")
#: Phrases of boilerplate, in lower case.
PHRASES = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript", "click here", "sign up", "log in", "sign in", "subscribe to", "read more", "share on", "follow us", "lorem ipsum", "powered by")
RULES = ("symbols", "open end", "navigation", "boilerplate", "repeated")

BLANKS = " \t\n\x0b\x0c\r"
_of = lambda values: "(?:" + "|".join(map(re.escape, values)) + ")"
MARKED = re.compile(RUN.encode()).search
ENDED = re.compile((_of(ENDS) + _of(CLOSES) + "*$").encode()).search
BOILED = re.compile(_of(PHRASES).encode(), re.IGNORECASE).search
BETWEEN = frozenset(s.encode() for s in SEPARATORS)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, lost array<struct<line:int,rule:string>>, clean string"
ARROW = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")] + [("lost", pa.list_(pa.struct([("line", pa.int32()), ("rule", pa.string())]))), ("clean", pa.string())])


def rule_broken(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with these words breaks by itself."""
    n = len(words)
    if MARKED(line) and 100 * sum(1 for w in words if MARKED(w)) > SYMBOL_SHARE * n:
        return RULES[0]
    if n < WRAPPED and not ENDED(words[-1]):
        return RULES[1]
    if (between := sum(map(BETWEEN.__contains__, words))) >= 2 and 100 * between >= SEPARATOR_SHARE * n:
        return RULES[2]
    if n < WORDY and BOILED(line):
        return RULES[3]
    return None


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in three-word windows that occur twice or more."""
    n, seen = len(words), {}
    if n < 4:
        return 0
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 21:  # three numbers below this fit a window's code of 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, window, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    often, covered = counts[window] > 1, np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= often
    return int(covered.sum())


def measure(text: str, clean: bool = False) -> dict:
    """Counts of a whole text, its removed lines with their rules and, if wanted, the text of the others."""
    raw = text.encode()
    lines, words, seen = raw.split(b"\n"), [], set()
    lost, kept, lost_words, n_dup = [], [], 0, 0
    for i, line in enumerate(lines):
        rule = None
        if here := line.split():
            words += here
            if again := line in seen:
                n_dup += 1
            seen.add(line)
            if rule := rule_broken(line, here) or (RULES[4] if again else None):
                lost_words += len(here)
                lost.append({"line": i, "rule": rule})
        if clean and rule is None:
            kept.append(line)
    return {
        "n_words": len(words), "word_chars": len(text) - sum(map(text.count, BLANKS)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": n_dup, "n_repeat_words": repeated_words(words),
        "lost_words": lost_words, "lost": lost, "clean": b"\n".join(kept).decode() if clean else None,
    }


def with_measures(docs: DataFrame, name: str, clean: bool) -> DataFrame:
    """docs with a struct of MEASURES under this name, a slice of texts at a time."""
    text = free(docs, f"{name}_text")
    rows = docs.withColumn(text, text_column())
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            at = part.schema.get_field_index(text)
            found = pa.array([measure(t, clean) for t in part.column(at).to_pylist()], ARROW)
            columns = [c for i, c in enumerate(part.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, found], [*(n for n in part.schema.names if n != text), name])

    return rows.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(MEASURES))]))


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < LEAST_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MOST_REPEATED * F.col(f"{m}.n_words"))


def passes(m: str) -> Column:
    return ~base_failed(m) & (100 * F.col(f"{m}.lost_words") <= MOST_LOST * F.col(f"{m}.n_words"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of every whole text, base_failed and kept: a row for each row of docs."""
    rows = with_measures(docs.select("doc_id", "text"), "m", False)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")
    return rows.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in counts), base_failed("m").alias("base_failed"), passes("m").alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0) and rule of every line that is removed."""
    return with_measures(docs.select("doc_id", "text"), "m", False).select("doc_id", F.inline("m.lost"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that stay, their texts without the removed lines; n_chars, where there is one, counts the new text."""
    name = free(docs, "_m")
    rows = with_measures(docs, name, True).filter(passes(name))
    text = F.when(F.col("text").isNotNull(), F.col(f"{name}.clean")).alias("text")
    size = lambda c: F.char_length(F.col(f"{name}.clean")).cast(docs.schema[c].dataType).alias(c)
    return rows.select(*(text if c == "text" else size(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def oracle_sql() -> str:
    """The rows of measured() over documents, lost_words included, in DuckDB's SQL."""
    quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    pattern = lambda values: "(?:" + "|".join(re.escape(v).replace("'", "''") for v in values) + ")"
    word = r"'[^\x20\x09-\x0D]+'"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS uid FROM documents),
base AS (SELECT uid, doc_id, regexp_extract_all(text, {word}) AS words, len(text) - len(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols FROM d),
w AS (SELECT uid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM base),
three AS (SELECT uid, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY uid ORDER BY i)),
often AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, a, b, c) AS n FROM three WHERE c IS NOT NULL) WHERE n > 1),
again AS (SELECT uid, count(DISTINCT i + k) AS n FROM often, range(3) AS r(k) GROUP BY uid),
ln AS (SELECT uid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM d),
parts AS (SELECT *, row_number() OVER (PARTITION BY uid, line ORDER BY nth) > 1 AS rep FROM (SELECT *, regexp_extract_all(line, {word}) AS ws FROM ln) WHERE len(ws) > 0),
bad AS (SELECT uid, rep, len(ws) AS n, rep OR (len(list_filter(ws, lambda x: regexp_matches(x, '{RUN}'))) * 100 > {SYMBOL_SHARE} * len(ws)) OR (len(ws) < {WRAPPED} AND NOT regexp_matches(ws[-1], '{pattern(ENDS)}{pattern(CLOSES)}*$'))
 OR (len(list_filter(ws, lambda x: x IN ({quoted(SEPARATORS)}))) >= 2 AND len(list_filter(ws, lambda x: x IN ({quoted(SEPARATORS)}))) * 100 >= {SEPARATOR_SHARE} * len(ws))
 OR (len(ws) < {WORDY} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern(PHRASES)}')) AS lost FROM parts),
lost AS (SELECT uid, CAST(sum(n) FILTER (lost) AS BIGINT) AS lost_words, count(*) FILTER (rep) AS n_dup_lines FROM bad GROUP BY uid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words
 FROM base LEFT JOIN again USING (uid) LEFT JOIN lost USING (uid))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_words <= {MOST_LOST} * n_words AS kept FROM m"""
