"""Chat formatting: a hidden Markov model recovers who speaks in a raw transcript, then turns are rendered alike.

States are a role and whether the line begins or continues a turn. A line is seen as its speaker marker (none, or
one that names a role, in any of the usual spellings), its number of words, whether it asks, stands first, or
follows a blank line. Start, transition and emission probabilities are smoothed counts over all transcripts to
learn from; Viterbi's path names the state of every line; a turn is a begin line and what continues it.

For a table of conversations whose roles are known, transcripts() writes the raw text first: each conversation in
one of the STYLES of marking speakers, with some turns' markers left out, so that recovery can be measured.

Conversations are sorted by range of (conv_id, turn, role, hash of the text), which numbers their turns, and cut into
segments of SLAB turns, so none gathers in one task, whatever its length and even if all rows are of one conversation;
yet a conversation is parsed as a whole. For every segment of a long one, max-plus products of the transition and
emission scores give the best value from each state before it to each state at its end; these few numbers are chained
along the conversation, which fixes the state before and at the end of each segment as Viterbi's path over all lines
has them, and inside a segment the path between the two is the whole path's. Of equally good paths the one with the
lowest states counts, from the last line on; scores are multiples of one over GRAIN, so that sums are the same in any
order. Segments' renderings, put one behind the other, are the conversation's.

Defined cases: identical rows are turns of their own; null text is the empty text; a null role, or one other than
system, user and assistant, is written without a marker and not counted as right or wrong; null turns stand first; a
null conv_id is a conversation; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stage, text_column
from waymark.sources.graphs import ordered

ROLES = ("system", "user", "assistant")
#: Turns in a segment; two at least.
SLAB = 512
FOLDS = 5
UNMARKED = 6  # one turn in so many has no marker
#: Ways to mark a speaker; {0} is the role's name in that style.
STYLES = (
    ("{0}: ", ("System", "User", "Assistant")), ("{0}: ", ("SYSTEM", "Human", "AI")), ("[{0}] ", ("system", "user", "bot")), ("### {0}\n", ("Instructions", "Human", "Assistant")),
    ("<|{0}|>\n", ("system", "user", "assistant")), ("**{0}:** ", ("Context", "Q", "A")), ("{0} > ", ("sys", "me", "model")),
)
#: Names that say a role.
NAMES = {"system": 0, "sys": 0, "context": 0, "instructions": 0, "user": 1, "human": 1, "q": 1, "me": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "a": 2, "model": 2, "agent": 2}
MARKER = re.compile(r"^\s*(?:#{1,6}\s*(?P<a>[A-Za-z]+)\s*:?\s*$|\[(?P<b>[A-Za-z]+)\]\s*:?|<\|?(?P<c>[A-Za-z]+)\|?>|\*\*(?P<d>[A-Za-z]+):?\*\*:?|(?P<e>[A-Za-z]+)\s?[:>](?=\s|$))[ \t]*")
#: Scores are whole multiples of one over this.
GRAIN = 2**20
STATES = 2 * len(ROLES)  # role * 2 + (1 inside)
#: Numbers of values of the features: marker, words, asks, first, after a blank line.
SIZES = (4, 6, 2, 2, 2)


def features(lines: list[str], first: bool = True, blank: bool = False) -> np.ndarray:
    """first: whether the first line is the conversation's; blank: whether the line before it is blank."""
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    for i, line in enumerate(lines):
        n = line.count(" ") + 1 if line.strip() else 0
        out[i] = (1 + speaker(line) if speaker(line) >= 0 else 0, np.searchsorted((1, 4, 12, 30, 80), n, side="left") if n else 0, line.rstrip().endswith("?"), first and i == 0, blank)
        blank = not line.strip()
    return out


def speaker(line: str) -> int:
    """The role that a line's marker names, or -1."""
    m = MARKER.match(line)
    return NAMES.get((m["a"] or m["b"] or m["c"] or m["d"] or m["e"]).lower(), -1) if m else -1


def write_transcript(conv_id: object, turns: list[tuple[object, str | None, str]], first: bool = True) -> tuple[list[str], list[int]]:
    """Lines, and for each line its true state (-1 for unknown roles). A conversation's first turn has a marker."""
    pattern, names = STYLES[zlib.crc32(f"{conv_id}".encode()) % len(STYLES)]
    lines, states = [], []
    for turn, role, text in turns:
        at = ROLES.index(role) if role in ROLES else -1
        marked = at >= 0 and ((first and not lines) or zlib.crc32(f"{conv_id}:{turn}".encode()) % UNMARKED)
        body = ((pattern.format(names[at]) if marked else "") + text).split("\n")
        lines += body
        states += [2 * at + (i > 0) if at >= 0 else -1 for i in range(len(body))]
    return lines, states


@dataclass
class Chain:
    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    @staticmethod
    def from_counts(counts: np.ndarray) -> Chain:
        """Log probabilities from counts laid out as start, steps, then a table for each feature."""
        cuts = np.cumsum([STATES, STATES * STATES, *(STATES * n for n in SIZES)])
        start, step, *emit = np.split(counts + 0.5, cuts[:-1])
        logs = lambda x: np.round(np.log(x / x.sum(axis=-1, keepdims=True)) * GRAIN) / GRAIN
        return Chain(logs(start), logs(step.reshape(STATES, STATES)), [logs(e.reshape(STATES, n)) for e, n in zip(emit, SIZES, strict=True)])

    def said(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, i]] for i, e in enumerate(self.emit)).T

    def path(self, seen: np.ndarray, before: int | None = None, last: int | None = None) -> list[int]:
        """Viterbi's states for a transcript's features, behind a given state and with a given last one."""
        if not len(seen):
            return []
        best, back = self.forward(seen, self.start if before is None else self.step[before])
        out = [int(best.argmax()) if last is None else last]
        for t in range(len(seen) - 1, 0, -1):
            out.append(int(back[t, out[-1]]))
        return out[::-1]

    def forward(self, seen: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best value of each last state, and for every line and state the state before it."""
        said = self.said(seen)
        best, back = first + said[0], np.zeros((len(seen), STATES), np.int64)
        for t in range(1, len(seen)):
            ways = best[:, None] + self.step
            back[t] = ways.argmax(axis=0)
            best = ways[back[t], np.arange(STATES)] + said[t]
        return best, back

    def entries(self, seen: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """For each last state the state before these lines on the best path, given the best values there."""
        ways = ahead[:, None] + self.step
        at = np.arange(STATES)
        _, back = self.forward(seen, ways.max(axis=0))
        for t in range(len(seen) - 1, 0, -1):
            at = back[t, at]
        return ways.argmax(axis=0)[at]

    def across(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """The best value from each state before these lines to each state of the last one; all rows are alike at a
        conversation's start."""
        said = self.said(seen)
        best = (np.tile(self.start, (STATES, 1)) if first else self.step) + said[0]
        for t in range(1, len(seen)):
            best = (best[:, :, None] + self.step).max(axis=1) + said[t]
        return best


def count(lines: list[str], states: list[int], first: bool = True, before: int = -1, blank: bool = False) -> np.ndarray:
    """before: the true state of the line ahead, -1 if there is none or it is unknown."""
    start, step = np.zeros(STATES), np.zeros((STATES, STATES))
    emit = [np.zeros((STATES, n)) for n in SIZES]
    for i, (seen, state) in enumerate(zip(features(lines, first, blank), states, strict=True)):
        if state < 0:
            continue
        ahead = states[i - 1] if i else before
        if first and i == 0:
            start[state] += 1
        elif ahead >= 0:
            step[ahead, state] += 1
        for table, value in zip(emit, seen, strict=True):
            table[state, value] += 1
    return np.concatenate([start, step.ravel(), *(e.ravel() for e in emit)])


def blocks_of(lines: list[str], states: list[int], before: int | None = None) -> list[tuple[str, list[str]]]:
    """(role, lines without markers) of each turn; what goes on from the line ahead comes first, with the role "" (even
    if it is nothing), where there is a line ahead."""
    out: list[tuple[str, list[str]]] = [] if before is None else [("", [])]
    role_now = None if before is None else ROLES[before // 2]
    for line, state in zip(lines, states, strict=True):
        role, inside = divmod(state, 2)
        if inside and role_now == ROLES[role]:
            out[-1][1].append(line)
            continue
        m = MARKER.match(line) if speaker(line) >= 0 else None
        bare = line[m.end() :] if m else line
        role_now = ROLES[role]
        # a marker alone on its line has no text of its own
        out.append((role_now, [] if m and not bare else [bare]))
    return out


def turns_of(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    """(role, text) of each turn, without markers."""
    return [(role, "\n".join(body)) for role, body in blocks_of(lines, states)]


END = "<|end|>\n"


def rendered(blocks: list[tuple[str, list[str]]], closed: bool = True) -> str:
    """Turns in one form. A block of the role "" goes on with a turn that was opened before; closed: the last one ends here."""
    out = [("" if i == 0 and role == "" else (END if i else "") + f"<|{role}|>\n") + "".join(f"{x}\n" for x in body) for i, (role, body) in enumerate(blocks)]
    return "".join(out) + (END if closed and blocks else "")


def render(turns: list[tuple[str, str]]) -> str:
    return rendered([(role, text.split("\n") if text else []) for role, text in turns])


KEYS = ["conv_id", "turn", "role", "h", "uid"]


def segments(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, turns: the turns of a conversation in order, SLAB to a segment."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_column().alias("text"))
    rows = ordered(rows.withColumn("h", F.md5("text")).withColumn("uid", F.monotonically_increasing_id()), KEYS, "rank")
    firsts = rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("rank").alias("start"))
    placed = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("place", F.col("rank") - F.col("start"))
    turns = F.sort_array(F.collect_list(F.struct("place", "turn", "role", "text")))  # SLAB at most
    return placed.groupBy("conv_id", F.floor(F.col("place") / SLAB).alias("segment")).agg(turns.alias("turns"))


def tail(conv_id: object, turn: object, role: str | None, text: str) -> tuple[int, bool]:
    """True state and blankness of the last line of a turn that is not the first."""
    lines, states = write_transcript(conv_id, [(turn, role, text)], False)
    return states[-1], not lines[-1].strip()


def settled(found: DataFrame) -> DataFrame:
    """found with opens (the conversation begins with the segment), and the line ahead's true state (-1 for none or
    unknown) and blankness. A segment with one behind it holds SLAB turns, two at least, so its last is not the first."""

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ends = [tail(key(c), key(t["turn"]), t["role"], t["text"]) for c, t in zip(frame["conv_id"], frame["t"], strict=True)]
            yield pd.DataFrame({"c": whole_numbers(frame["conv_id"]), "s": frame["segment"] + 1, "before": [e[0] for e in ends], "blank": [e[1] for e in ends]})

    first = found.filter("segment = 0").withColumns({"opens": F.lit(True), "before": F.lit(-1), "blank": F.lit(False)})
    full = found.filter(F.size("turns") == SLAB).select("conv_id", "segment", F.element_at("turns", -1).alias("t"))
    ahead = full.mapInPandas(tails, "c long, s long, before int, blank boolean")
    later = found.filter("segment > 0").withColumn("opens", F.lit(False)).join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")
    return first.unionByName(later.select(*first.columns))


def lines_of(row: object) -> tuple[list[str], list[int]]:
    return write_transcript(key(row.conv_id), [(key(t["turn"]), t["role"], t["text"]) for t in row.turns], bool(row.opens))


def learn(found: DataFrame) -> Chain:
    """Counts over all conversations to learn from; a row of a few hundred numbers from each task reaches the driver's sum."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                c = count(*lines_of(row), bool(row.opens), int(row.before), bool(row.blank))
                total = c if total is None else total + c
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "n": total})

    rows = found.filter(F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(FOLDS)), F.lit(1)) != 0)
    sums = rows.mapInPandas(counted, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(STATES + STATES * STATES + sum(STATES * n for n in SIZES))
    counts[sums["at"].to_numpy(int)] = sums["n"].to_numpy()
    return Chain.from_counts(counts)


def key(conv_id: object) -> object:
    """A whole number, or None; pandas reads whole numbers beside nulls as floats."""
    return None if conv_id is None or conv_id != conv_id else int(conv_id)


def ends_of(found: DataFrame, chain: Chain) -> DataFrame:
    """c, s (conversation and segment), entry (the state before it, null at a start), last (its last line's state), final:
    for the segments of conversations that have several. A segment is 36 numbers here."""
    long = found.filter("not opens").select(F.col("conv_id").alias("c")).distinct()
    parts = found.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(row.conv_id, row.segment, chain.across(features(lines_of(row)[0], bool(row.opens), bool(row.blank)), bool(row.opens)).ravel()) for row in frame.itertuples(index=False)]
            out = pd.DataFrame(rows, columns=["c", "s", "product"])
            yield out.assign(c=whole_numbers(out["c"]))

    def forward(frame: pd.DataFrame) -> pd.DataFrame:
        frame, value, ahead = frame.sort_values("s"), None, []
        for p in frame["product"]:
            p = np.asarray(p).reshape(STATES, STATES)
            ahead.append(value)
            value = p[0] if value is None else (value[:, None] + p).max(axis=0)
            value = value - value.max()
        last = pd.array([None] * (len(frame) - 1) + [int(value.argmax())], "Int32")
        return pd.DataFrame({"c": whole_numbers(frame["c"]), "s": frame["s"].to_numpy(), "ahead": ahead, "last": last})

    def entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            states = [None if a is None else chain.entries(features(lines_of(r)[0], False, bool(r.blank)), np.asarray(a)) for r, a in zip(frame.itertuples(index=False), frame["ahead"], strict=True)]
            yield pd.DataFrame({"c": whole_numbers(frame["conv_id"]), "s": frame["segment"], "entries": states, "last": frame["last"].astype("Int32")})

    def backward(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("s")
        last, out = int(frame["last"].iloc[-1]), []
        for entries in frame["entries"].iloc[::-1]:
            entry = None if entries is None else int(entries[last])
            out.append((entry, last))
            last = entry
        entry, last = zip(*out[::-1], strict=True)
        return pd.DataFrame({"c": whole_numbers(frame["c"]), "s": frame["s"].to_numpy(), "entry": pd.array(entry, "Int32"), "last": last, "final": [False] * (len(last) - 1) + [True]})

    values = parts.mapInPandas(products, "c long, s long, product array<double>")
    ahead = values.groupBy("c").applyInPandas(lambda frame: forward(frame), "c long, s long, ahead array<double>, last int")
    met = parts.join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")
    back = met.mapInPandas(entered, "c long, s long, entries array<int>, last int")
    return back.groupBy("c").applyInPandas(lambda frame: backward(frame), "c long, s long, entry int, last int, final boolean")


def whole_numbers(column: pd.Series) -> pd.Series:
    return pd.array([key(x) for x in column], "Int64")


SCHEMA = "conv_id long, segment long, held_out boolean, n_turns long, n_lines long, found_turns long, roles string, lines_known long, lines_right long, rendered string"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """A row per segment of SLAB turns: the turns and roles recovered from its raw transcript, how many lines' roles are
    right, the rendering."""
    found = stage(settled(stage(segments(conversations), "segments")), "conversations")
    chain = learn(found)
    ends = stage(ends_of(found, chain), "ends")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                conv_id, (lines, truth) = key(row.conv_id), lines_of(row)
                entry, last = (None if pd.isna(x) else int(x) for x in (row.entry, row.last))
                states = chain.path(features(lines, bool(row.opens), bool(row.blank)), entry, last)
                blocks = blocks_of(lines, states, entry)
                known = [(s, t) for s, t in zip(states, truth, strict=True) if t >= 0]
                held = conv_id is not None and zlib.crc32(str(conv_id).encode()) % FOLDS == 0
                new = [role for role, _ in blocks if role]
                rows.append((conv_id, row.segment, held, len(row.turns), len(lines), len(new), ",".join(new), len(known), sum(s // 2 == t // 2 for s, t in known), rendered(blocks, last is None or bool(row.final))))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.assign(conv_id=out["conv_id"].astype("Int64"))

    met = found.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left").drop("c", "s")
    return met.mapInPandas(parse, SCHEMA)


def parse_transcript(chain: Chain, transcript: str) -> list[tuple[str, str]]:
    lines = transcript.split("\n")
    return turns_of(lines, chain.path(features(lines)))
