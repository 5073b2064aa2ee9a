"""Chat formatting: transcripts are parsed by a hidden Markov model, then rendered in one canonical form.

States are a role and whether a line opens a turn of it or goes on with it.
Lines emit a speaker marker and features of their form; the likeliest path of
states (Viterbi) says where turns begin and who speaks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relflow.functions.lambdas import quoted
from relflow.llm.batches import bound_batches
from relflow.sources.scratch import written

ROLES = ("system", "user", "assistant", "tool")
#: Names that speakers go by.
NAMES = {
    "system": "system", "developer": "system", "instructions": "system", "user": "user", "human": "user", "customer": "user",
    "question": "user", "q": "user", "you": "user", "prompter": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant",
    "gpt": "assistant", "chatgpt": "assistant", "model": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool",
}
_MARK = re.compile(
    r"^\s*(?:<\|(?:im_start|start_header_id)\|>\s*(?P<chatml>\w+)(?:<\|end_header_id\|>)?|\[(?P<box>\w+)\]:?|(?:#{1,6}\s*)(?P<head>\w+)\s*:?\s*$|"
    r"(?:\*\*)?(?P<name>[A-Za-z]\w{0,15})(?:\*\*)?\s*:(?:\*\*)?)\s*"
)
_END = re.compile(r"<\|(?:im_end|eot_id|end)\|>\s*$")

#: Rows of a conversation that are handed on together.
SEGMENT = 64


@dataclass(frozen=True)
class Transitions:
    """Probabilities.  ``follow[a][b]``: a turn of a is followed by one of b; ``stay``: a line goes on with its turn."""

    first: tuple[float, ...] = (0.25, 0.6, 0.1, 0.05)
    follow: tuple[tuple[float, ...], ...] = ((0.05, 0.8, 0.1, 0.05), (0.02, 0.08, 0.82, 0.08), (0.02, 0.82, 0.08, 0.08), (0.02, 0.08, 0.8, 0.1))
    stay: float = 0.6
    #: A turn shows its own role's marker, another role's, or none; a line that goes on shows a marker.
    own_mark: float = 0.9
    other_mark: float = 0.002
    inner_mark: float = 0.004
    #: The recorded break between two rows begins a turn.
    at_break: float = 0.98
    inside: float = 0.2
    #: By role: a line asks, and is long.
    asks: tuple[float, ...] = (0.05, 0.5, 0.15, 0.05)
    long: tuple[float, ...] = (0.4, 0.25, 0.5, 0.4)


@dataclass(frozen=True)
class Line:
    text: str
    mark: str | None
    at_break: bool


def read_line(raw: str, at_break: bool) -> Line:
    """A line without its speaker marker; names that aren't known are part of the text."""
    raw = _END.sub("", raw)
    m = _MARK.match(raw)
    if m and (role := NAMES.get((m["chatml"] or m["box"] or m["head"] or m["name"]).lower())):
        return Line(raw[m.end() :], role, at_break)
    return Line(raw, None, at_break)


def moves(t: Transitions) -> np.ndarray:
    """Log-probabilities from state to state; 0..n-1 open a turn of a role, n..2n-1 go on with one."""
    n, log = len(ROLES), np.log
    opens = np.log(np.array(t.follow))
    move = np.full((2 * n, 2 * n), -np.inf)
    for a in range(n):
        for s in (a, n + a):
            move[s, :n] = log(1 - t.stay) + opens[a]
            move[s, n + a] = log(t.stay)
    return move


def emits(line: Line, t: Transitions) -> np.ndarray:
    """The line's log-probability in each state."""
    n, log = len(ROLES), np.log
    emit = np.zeros(2 * n)
    for r, role in enumerate(ROLES):
        shown = t.own_mark if line.mark == role else t.other_mark if line.mark else 1 - t.own_mark - (n - 1) * t.other_mark
        inner = t.inner_mark if line.mark else 1 - n * t.inner_mark
        form = log(t.asks[r] if line.text.rstrip().endswith("?") else 1 - t.asks[r]) + log(t.long[r] if len(line.text) > 200 else 1 - t.long[r])
        emit[r] = log(shown) + log(t.at_break if line.at_break else t.inside) + form
        emit[n + r] = log(inner) + log(1 - t.at_break if line.at_break else 1 - t.inside) + form
    return emit


def firsts(t: Transitions) -> np.ndarray:
    return np.concatenate([np.log(np.array(t.first)), np.full(len(ROLES), -np.inf)])


def viterbi(lines: list[Line], t: Transitions, enter: np.ndarray | None = None, leave: int | None = None) -> list[tuple[int, bool]]:
    """(role number, opens a turn) of each line on the likeliest path; of equals the first in order of states.

    For a part of a transcript, ``enter`` holds the best score of each state at the
    line before it, and ``leave`` is the state of its last line.
    """
    n, move = len(ROLES), moves(t)
    score = firsts(t) if enter is None else enter
    back: list[np.ndarray] = []
    for k, line in enumerate(lines):
        if k or enter is not None:
            every = score[:, None] + move
            if k:
                back.append(every.argmax(0).astype(np.int8))
            score = every.max(0)
        score = score + emits(line, t)
    path = []
    if lines:
        s = int(score.argmax()) if leave is None else leave
        path.append(s)
        for b in reversed(back):
            s = int(b[s])
            path.append(s)
    return [(s % n, s < n) for s in reversed(path)]


def transfer(lines: list[Line], t: Transitions) -> np.ndarray:
    """Best scores from each state before the lines (a row each) to each state of the last; the last row is for lines that begin a transcript."""
    move = moves(t)
    out = np.concatenate([move, firsts(t)[None]])
    for k, line in enumerate(lines):
        if k:
            out = (out[:, :, None] + move).max(1)
        out = out + emits(line, t)
    return out


def chained(parts: list[np.ndarray]) -> list[tuple[np.ndarray | None, int]]:
    """For the transfers of all parts of a transcript, in order: the (enter, leave) of each on the likeliest path of the whole."""
    scores = [parts[0][-1]]
    for m in parts[1:]:
        scores.append((scores[-1][:, None] + m[:-1]).max(0))
    s, out = int(scores[-1].argmax()), []
    for i in range(len(parts) - 1, 0, -1):
        out.append((scores[i - 1], s))
        s = int((scores[i - 1] + parts[i][:-1, s]).argmax())
    return [(None, s), *reversed(out)]


def lines_of(turns: list[tuple[str | None, str | None]]) -> tuple[list[Line], list[int]]:
    """The lines of (speaker, text) rows, and the row of each."""
    lines, owner = [], []
    for i, (speaker, text) in enumerate(turns):
        role = NAMES.get((speaker or "").strip().lower())
        for k, raw in enumerate((text or "").split("\n")):
            line = read_line(raw, k == 0)
            lines.append(Line(line.text, line.mark or role, True) if k == 0 and role and line.mark in (None, role) else line)
            owner.append(i)
    return lines, owner


def parse(turns: list[tuple[str | None, str | None]], t: Transitions | None = None, enter: np.ndarray | None = None, leave: int | None = None) -> list[list[tuple[str, str]]]:
    """For each (speaker, text) row of a transcript, the (role, text) turns that are found in it.

    Known speakers stand as markers before the first line; others are unknown to
    the model and their role comes from the context.  A row whose first line goes
    on with the turn before it begins with a turn of that role.  For ``enter`` and
    ``leave`` see :func:`viterbi`.
    """
    lines, owner = lines_of(turns)
    out: list = [[] for _ in turns]
    for (r, opens), line, i in zip(viterbi(lines, t or Transitions(), enter, leave), lines, owner, strict=True):
        if opens or not out[i]:
            out[i].append((ROLES[r], line.text))
        else:
            out[i][-1] = (out[i][-1][0], out[i][-1][1] + "\n" + line.text)
    return out


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form."""
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


SCHEMA = "parsed_role string, n_turns bigint, n_lines bigint, rendered string, rendered_sha256 string"


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each different turn row, with ``copies``, the role that was recovered and the rendered form.

    Rows of a conversation are ordered by turn, then speaker and text, and parsed as
    one transcript, whatever its length.  All rows are dealt to tasks by ranges of
    this order.  Of a conversation that goes on from one range to the next, each
    range gives the best scores from state to state; the driver chains these (two
    matrices a range at the most), and each range finds its part of the likeliest
    path of the whole.  Rows without a conversation or turn number are
    transcripts of their own.  A null speaker is unknown, a null text empty.
    Equal rows are counted in their map tasks first.  Other columns are not read.
    """
    df = turns.select(F.col(quoted(conv_id)).alias("conv_id"), F.col(quoted(turn)).cast("bigint").alias("turn"), F.col(quoted(role)).cast("string").alias("role"), F.col(quoted(text)).cast("string").alias("text"))
    rows = df.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    own = F.xxhash64(F.lit("alone"), "conv_id", "turn", "role", "text")
    order = ["alone", "conv_id", "turn", "role", "text"]
    placed = rows.withColumn("alone", alone).withColumn("cell", F.when(alone, own).otherwise(F.xxhash64("conv_id"))).repartitionByRange(*order)
    placed = written(placed.withColumn("part", F.spark_partition_id()), "turns")
    dealt = placed.repartitionByRange("part").sortWithinPartitions("part", *order).select("part", "cell", *order, "copies")
    kept = ["conv_id", "turn", "role", "copies"]
    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in kept)

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, place, cell, m): the transfers of the first and the last conversation of each range."""

        def summary(part: int, place: int, cell: int, rows: pa.Table) -> pa.RecordBatch:
            m = transfer(lines_of(_turns(rows))[0], Transitions()).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([cell], pa.int64()), pa.array([m], pa.binary())], names=["part", "place", "cell", "m"])

        now, last = None, None
        for part, cell, rows in _runs(batches):
            if rows.column("alone")[0].as_py():
                continue
            if part != now:
                if last:
                    yield summary(*last)
                now, last = part, None
                yield summary(part, 0, cell, rows)
            else:
                last = (part, 1, cell, rows)
        if last:
            yield summary(*last)

    bound_batches(turns.sparkSession)
    found = dealt.mapInArrow(ends, "part int, place int, cell bigint, m binary").collect()
    chains: list[list] = []
    for r in sorted(found, key=lambda r: (r["part"], r["place"])):
        if chains and chains[-1][-1]["cell"] == r["cell"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    states = 2 * len(ROLES)
    known = {}
    for chain in chains:
        if len(chain) > 1:
            known.update(zip([(r["part"], r["cell"]) for r in chain], chained([np.frombuffer(bytes(r["m"])).reshape(states + 1, states) for r in chain]), strict=True))
    shared = turns.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cell, rows in _runs(batches):
            enter, leave = shared.value.get((part, cell), (None, None))
            yield from _parsed(rows, kept, enter, leave)

    out = dealt.mapInArrow(run, f"{kinds}, {SCHEMA}")
    return out.withColumn("agrees", F.coalesce(F.lower("role") == F.col("parsed_role"), F.lit(False)))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(part, cell, rows) of each run of equal parts and cells, the first two columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        parts, cells = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = (cells[1:] != cells[:-1]) | (parts[1:] != parts[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(cells)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            here = (int(parts[s]), int(cells[s]))
            if here != key and held:
                yield *key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(b.slice(s, e - s))
    if held:
        yield *key, pa.Table.from_batches(held)


def _turns(rows: pa.Table) -> list[tuple[str | None, str | None]]:
    return list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True))


def _parsed(rows: pa.Table, kept: list[str], enter: np.ndarray | None, leave: int | None) -> Iterator[pa.RecordBatch]:
    every = parse(_turns(rows), None, enter, leave)
    for k in range(0, len(every), SEGMENT):
        found, some = every[k : k + SEGMENT], rows.slice(k, SEGMENT)
        shown = [render(x) for x in found]
        arrays = [some.column(c).combine_chunks() for c in kept]
        arrays += [
            pa.array([x[0][0] for x in found]), pa.array([len(x) for x in found], pa.int64()), pa.array([(t or "").count("\n") + 1 for t in some.column("text").to_pylist()], pa.int64()),
            pa.array(shown), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in shown]),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "parsed_role", "n_turns", "n_lines", "rendered", "rendered_sha256"])
