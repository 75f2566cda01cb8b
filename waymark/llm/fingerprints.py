"""Document fingerprints from prefix polynomial hashes.

PrefixHashes holds, for a text's code points c, the prefix sums of (c+1) * B**i modulo 2**31 - 1 for two bases.
Any span's 62-bit hash follows from two prefix entries, so span equality is a comparison, and the longest common
extension of two positions is a binary search over span lengths. A fingerprint is the length, the whole text's
hash and a sketch of BINS bins over the hashes of all spans of SPAN code points; two fingerprints' likeness
estimates the Dice coefficient of their spans, repeated ones counted each.

Defined cases: null text is the empty text; texts shorter than SPAN count as one span; the empty text's sketch
is empty, alike only to the empty text. Rows may repeat: the order is by doc_id (null first), then text, and each
row's next document is the next row in that order, after the last the first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import text_column, width

PRIME = np.uint64(2**31 - 1)
BITS = np.uint64(31)
BASES = (1_000_003_421, 1_540_483_477)
SPAN = 16
BINS = 128
BLOCK = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)
AGAIN = np.uint64(0xD1342543DE82EF95)
FIRST_KEY = -(2**63)


def reduce_once(x: np.ndarray) -> np.ndarray:
    """x below 2**63 modulo PRIME, without division."""
    x = (x & PRIME) + (x >> BITS)
    x = (x & PRIME) + (x >> BITS)
    x[x == PRIME] = 0
    return x


def power_table(base: int) -> np.ndarray:
    table = np.ones(BLOCK, np.uint64)
    size = 1
    while size < BLOCK:
        table[size : 2 * size] = reduce_once(table[:size] * np.uint64(pow(base, size, int(PRIME))))
        size *= 2
    return table


POWERS = [power_table(b) for b in BASES]
INVERSES = [pow(b, -1, int(PRIME)) for b in BASES]
INVERSE_POWERS = [power_table(b) for b in INVERSES]


def powers_of(which: int, at: np.ndarray | int, inverse: bool = False) -> np.ndarray:
    """base**at for any positions, from the table of one block."""
    base, table = (INVERSES[which], INVERSE_POWERS[which]) if inverse else (BASES[which] % int(PRIME), POWERS[which])
    at = np.asarray(at, np.int64)
    blocks, inside = np.divmod(at, BLOCK)
    if blocks.size and blocks.max() == 0:
        return table[inside]
    seen, back = np.unique(blocks, return_inverse=True)
    steps = np.array([pow(base, int(b) * BLOCK, int(PRIME)) for b in seen], np.uint64)
    return reduce_once(np.atleast_1d(table[inside] * steps[back.reshape(at.shape)])).reshape(at.shape)


class PrefixHashes:
    """Prefix arrays of one text, 8 bytes a code point, built block by block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.sums = [np.zeros(len(codes) + 1, np.uint32) for _ in BASES]
        for which, sums in enumerate(self.sums):
            carry = np.uint64(0)
            for start in range(0, len(codes), BLOCK):
                part = codes[start : start + BLOCK].astype(np.uint64) + np.uint64(1)
                scale = np.uint64(pow(BASES[which], start, int(PRIME)))
                weights = POWERS[which][: len(part)]
                if start:
                    weights = reduce_once(weights * scale)
                run = reduce_once(np.cumsum(reduce_once(part * weights)) + carry)
                sums[start + 1 : start + 1 + len(part)] = run
                carry = run[-1]

    def __len__(self) -> int:
        return len(self.codes)

    def span(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of [start, end); equal spans have equal hashes wherever they stand."""
        out = np.uint64(0)
        start, end = np.atleast_1d(np.asarray(start, np.int64)), np.atleast_1d(np.asarray(end, np.int64))
        for which, sums in enumerate(self.sums):
            gap = sums[end].astype(np.uint64) + PRIME - sums[start]
            out = (out << BITS) | reduce_once(reduce_once(gap) * powers_of(which, start, inverse=True))
        return out

    def windows(self, size: int = SPAN) -> np.ndarray:
        """Hashes of all spans of `size` code points, or of the whole text if it is shorter (none if empty)."""
        n = len(self.codes)
        if n < size:
            return self.span(0, n) if n else np.zeros(0, np.uint64)
        out = np.empty(n - size + 1, np.uint64)
        for start in range(0, len(out), BLOCK):
            stop = min(start + BLOCK, len(out))
            total = np.uint64(0)
            for which, sums in enumerate(self.sums):
                gap = reduce_once(sums[start + size : stop + size].astype(np.uint64) + PRIME - sums[start:stop])
                hashed = reduce_once(gap * INVERSE_POWERS[which][: stop - start])
                if start:
                    hashed = reduce_once(hashed * np.uint64(pow(INVERSES[which], start, int(PRIME))))
                total = (total << BITS) | hashed
            out[start:stop] = total
        return out

    def whole(self) -> int:
        return (int(self.sums[0][-1]) << 31) | int(self.sums[1][-1])


def codes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def same_span(a: PrefixHashes, i: int, b: PrefixHashes, j: int, size: int) -> bool:
    return bool(a.span(i, i + size)[0] == b.span(j, j + size)[0])


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """The most code points from a[i:] and b[j:] that agree, by binary search."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def counted(windows: np.ndarray) -> np.ndarray:
    """Equal hashes made different by their number, so that a repeated span counts as often as it stands there."""
    order = np.argsort(windows)
    ordered = windows[order]
    new = np.ones(len(windows), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return windows
    at = np.arange(len(windows))
    nth = np.empty(len(windows), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return windows + nth * AGAIN


def sketch(windows: np.ndarray) -> bytes:
    """One byte a bin: 0 for an empty bin, else 1 to 255 from the smallest mixed hash in it."""
    mixed = counted(windows) * MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    least = np.full(BINS, 2**32, np.uint64)
    np.minimum.at(least, (mixed >> np.uint64(57)).astype(np.intp), (mixed >> np.uint64(20)) & np.uint64(2**32 - 1))
    return np.where(least == 2**32, 0, 1 + least % np.uint64(255)).astype(np.uint8).tobytes()


def written(n: int, whole: int, windows: np.ndarray) -> str:
    return f"{n:x}-{whole:016x}-{sketch(windows).hex()}"


def fingerprint(text: str | None) -> str:
    hashes = PrefixHashes(codes_of(text))
    return written(len(hashes), hashes.whole(), hashes.windows())


def likeness(a: str, b: str) -> float:
    """From two fingerprints, the estimated Dice coefficient of their texts' spans, 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), np.uint8) for f in (a, b))
    filled = int(((x > 0) | (y > 0)).sum())
    if not filled:
        return 0.0
    chance = 1 / 255
    share = max(0.0, (float(((x == y) & (x > 0)).sum()) / filled - chance) / (1 - chance))
    return 2 * share / (1 + share)


class Document:
    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.hashes = PrefixHashes(codes_of(self.text))
        self.windows = self.hashes.windows()
        self.print = written(len(self.hashes), self.hashes.whole(), self.windows)


def edited_row(doc: Document, after: Document) -> tuple:
    """The contract's row: the text's last quarter is replaced by the head of the next document."""
    n = len(doc.hashes)
    kept = n - n // 4
    head = min(n // 4, len(after.hashes))
    text = doc.text[:kept] + after.text[:head]
    total = kept + head
    if total < SPAN:
        windows = PrefixHashes(codes_of(text)).windows()
    else:
        seam = np.concatenate([doc.hashes.codes[max(0, kept - SPAN + 1) : kept], after.hashes.codes[: min(head, SPAN - 1)]])
        across = PrefixHashes(seam).windows() if len(seam) >= SPAN else np.zeros(0, np.uint64)
        windows = np.concatenate([doc.windows[: max(0, kept - SPAN + 1)], across, after.windows[: max(0, head - SPAN + 1)]])
    whole = 0
    for which in range(len(BASES)):  # a concatenation's hash from its parts' prefix entries
        left, right = int(doc.hashes.sums[which][kept]), int(after.hashes.sums[which][head])
        whole = (whole << 31) | (left + right * pow(BASES[which], kept, int(PRIME))) % int(PRIME)
    edited = written(total, whole, windows)
    shared = common_extension(doc.hashes, 0, after.hashes, 0)
    return (doc.doc_id, n, hashlib.sha256(text.encode()).hexdigest(), doc.print, edited, likeness(doc.print, edited), likeness(doc.print, after.print), shared)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_next long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("shared_next", pa.int64())])


def edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, extra and key; each row's successor stands behind it, a bucket's last row before an extra."""
    last, bucket = None, None
    for batch in batches:
        rows = []
        for b, extra, doc_id, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "extra", "doc_id", "text")), strict=True):
            if last is None and extra.as_py():
                continue
            doc = Document(doc_id.as_py(), text.as_py())
            if last is not None:
                if bucket != b.as_py():
                    raise ValueError("a bucket's last row has no successor")
                rows.append(edited_row(last, doc))
            last, bucket = (None, None) if extra.as_py() else (doc, b.as_py())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
    if last is not None:
        raise ValueError("the last row has no successor")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For every row: its fingerprint, that of its edited text, and their likeness.

    Texts move once, by ranges of doc_id whose bounds come from the ids alone; the first row of each range is
    also sent behind the last of the range before it, so that every row meets its successor.
    """
    spark = docs.sparkSession
    n = width(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_KEY)).alias("key"))
    found = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("b")).first()["b"]
    bounds = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    keyed = rows.withColumn("bucket", bucket_of("key"))
    firsts = sorted((r["bucket"], r["key"]) for r in rows.select("key").withColumn("bucket", bucket_of("key")).groupBy("bucket").agg(F.min("key").alias("key")).collect())  # one row a range
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    heads, tails = np.array(list(before), np.int64), np.array(list(before.values()), np.int32)

    @F.pandas_udf("int")
    def also_in(key: pd.Series) -> pd.Series:
        at = np.searchsorted(heads, key.to_numpy())
        hit = heads[np.minimum(at, len(heads) - 1)] == key.to_numpy()
        return pd.Series(np.where(hit, tails[np.minimum(at, len(heads) - 1)], -1).astype(np.int32))

    place = lambda b, extra: F.struct(b.alias("bucket"), F.lit(extra).alias("extra"))
    own, other = place(F.col("bucket"), False), place(F.col("tail"), True)
    dealt = keyed.withColumn("tail", also_in("key")).select("doc_id", "text", "key", F.explode(F.when(F.col("tail") >= 0, F.array(own, other)).otherwise(F.array(own))).alias("p"))
    dealt = dealt.select("p.bucket", "p.extra", "key", "doc_id", "text").repartitionById(n, "bucket").sortWithinPartitions("bucket", "extra", "key", "text")
    return dealt.select("bucket", "extra", "doc_id", "text").mapInArrow(edited_rows, SCHEMA)
