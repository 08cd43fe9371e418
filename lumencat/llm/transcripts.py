"""Operator 10: chat formatting by a hidden Markov model over the lines of a transcript.

A transcript is lines of text in which some turns open with a speaker marker ("User:", "**Assistant**", "Q.") and some with
none. Hidden states are role and place: a turn's first line with its marker, a first line that has none, or a later line. A
line shows a marker class, whether a blank line or a question precedes it, whether it asks, whether it begins in lower case,
and its length class; these are independent given the state. A dash is one class in a transcript that has speaker words and
another in one that has none. Viterbi's best path gives the roles and the turns, which are rendered in one canonical form.
Only a line in a marked state loses its marker: a list item, or a text that itself begins with "A: ", stays as it is.

The model is counted, with one added to each count, over transcripts whose roles are known and whose id's crc32 mod 3 is
not 1; the others are held out. The roles are those of these transcripts. A role of which no speaker words are known is
marked by its own name. The counts of all rows go to the driver as one row for each feature value and state, whose number
the features and the roles bound.

Scale: turns are numbered by ranges of (conversation, turn), never by a window over a conversation, and laid out in parts of
PART_TURNS turns, so that a conversation of any length is many tasks' work and never one row. The path is still that of the
whole conversation: each part gives the best score from every state before it to every state at its end, these small
matrices are joined along a conversation, and each part is then decoded between the states that the whole path has at its
ends. Renderings of a conversation's parts follow each other. Transcripts of one length class are decoded in step.

Defined cases: null text is an empty turn, null roles are ``unknown`` and not learnt from; null conversation ids and turns are
kept and laid out first; turns of one number come in the order of role and text; repeated rows are turns of their own; a role
that no training row has, or that is not among the MOST_ROLES most frequent ones, is never recovered; an empty transcript has no turn and renders to the empty string; white space at a
turn's ends goes; extra columns are not read; an empty table gives an empty result. Among equally likely paths the first
state in the order of roles wins.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumencat.llm.common import stored, table

PART_TURNS = 512
#: The states are three for each role, and the steps the square of the states: a free text in the place of a role is no role.
MOST_ROLES = 64
PLACES = ("marked", "bare", "later")

#: Words that stand for a role at a line's start.
SPEAKERS = {
    "user": ("user", "human", "customer", "q", "question", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "a", "answer", "response", "gpt"),
    "system": ("system", "instruction", "instructions", "context"),
}
_DASH = re.compile(r"^\s*[-–—>•]\s+")
FEATURES = ("marker", "before", "asks", "begins", "size")
BEFORE = ("start", "blank", "question", "text")
SIZES = ("empty", "short", "middle", "long")


def kind_of(line: str | None) -> int:
    """What a line is to the next one: a number of BEFORE."""
    bare = None if line is None else line.strip()
    return 0 if bare is None else 1 if not bare else 2 if bare.endswith("?") else 3


class Speakers:
    """The roles, and the markers that stand for them. Marker classes: none, dash, dash beside speaker words, then one a role."""

    def __init__(self, roles: list[str]):
        self.roles = sorted(roles)
        self.states = [(r, p) for r in self.roles for p in PLACES]
        words = {w: r for r in self.roles for w in (*SPEAKERS.get(r, ()), r.lower())}
        self._role_of = words
        any_word = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) or r"(?!)"
        self._marker = re.compile(r"^[\s>*#\[<|_-]*(" + any_word + r")[\]>|*_ ]*(?:[:.)\]>|]|$)[\]>|*_]*[ \t]*", re.IGNORECASE)
        self.values = (3 + len(self.roles), len(BEFORE), 2, 2, len(SIZES))

    def marker(self, line: str, worded: bool) -> tuple[int, int]:
        """Marker class of a line and the length of the marker."""
        m = self._marker.match(line)
        if m:
            return 3 + self.roles.index(self._role_of[m[1].lower()]), m.end()
        m = _DASH.match(line)
        return (2 if worded else 1, m.end()) if m else (0, 0)

    def worded(self, lines: list[str]) -> bool:
        return any(self._marker.match(x) for x in lines)

    def observations(self, lines: list[str], worded: bool, before: int = 0) -> list[tuple[int, ...]]:
        """The number of each feature's value, for each line; before: what precedes the first."""
        out = []
        for line in lines:
            bare = line.strip()
            first = next((c for c in bare if c.isalpha()), "")
            n = len(bare)
            out.append((self.marker(line, worded)[0], before, int(bare.endswith("?")), int(first.islower()), 0 if n == 0 else 1 if n < 40 else 2 if n < 160 else 3))
            before = kind_of(line)
        return out


class Model:
    """Log probabilities: of the first state, from state to state, and of each feature's value in a state."""

    def __init__(self, speakers: Speakers, counts: dict[tuple[str, int, int], int]):
        self.speakers = speakers
        states, n = speakers.states, len(speakers.states)
        get = lambda kind, a, b: counts.get((kind, a, b), 0) + 1
        opens = [p != "later" for _, p in states]
        self.start = np.array([math.log(get("start", 0, s)) if opens[s] else -np.inf for s in range(n)])
        if n:
            self.start -= math.log(np.exp(self.start).sum())
        self.step = np.full((n, n), -np.inf)
        for a in range(n):
            may = [b for b in range(n) if opens[b] or states[b][0] == states[a][0]]
            total = sum(get("step", a, b) for b in may)
            for b in may:
                self.step[a, b] = math.log(get("step", a, b) / total)
        self.emit = []
        for f, size in zip(FEATURES, speakers.values, strict=True):
            e = np.array([[get(f, s, v) for v in range(size)] for s in range(n)], float).reshape(n, size)
            self.emit.append(np.log(e / e.sum(axis=1, keepdims=True)).T)

    def _scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(self.emit[f][seen[:, f]] for f in range(len(FEATURES)))

    def viterbi(self, many: list[list[tuple[int, ...]]], ends: list[tuple[int, int]] | None = None) -> list[list[int]]:
        """The likeliest states of each sequence of observations; sequences advance in step, longest first.

        ends: of each sequence the state before it (-1: none, it is the start) and its last state (-1: any).
        """
        order = sorted(range(len(many)), key=lambda i: -len(many[i]))
        longest = len(many[order[0]]) if order else 0
        if not longest or not self.speakers.states:
            return [[] for _ in many]
        lengths = np.array([len(many[i]) for i in order])
        score, back = np.empty((len(order), len(self.start))), []
        for t in range(longest):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            e = self._scores(np.array([many[i][t] for i in order[:live]]))
            if t == 0:
                before = [-1 if ends is None else ends[i][0] for i in order[:live]]
                score[:live] = np.array([self.start if b < 0 else self.step[b] for b in before]) + e
            else:
                ways = score[:live, :, None] + self.step
                best = ways.argmax(axis=1)
                back.append(best)
                score[:live] = np.take_along_axis(ways, best[:, None, :], axis=1)[:, 0] + e
        out: list[list[int]] = [[] for _ in many]
        for row, i in enumerate(order):
            n = int(lengths[row])
            if n:
                last = -1 if ends is None else ends[i][1]
                path = [int(score[row].argmax()) if last < 0 else last]
                for t in range(n - 1, 0, -1):
                    path.append(int(back[t - 1][row, path[-1]]))
                out[i] = path[::-1]
        return out

    def passage(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        """The best score from each state before a sequence (rows; the last row: from the start) to each state at its end."""
        n = len(self.start)
        now = np.full((n + 1, n), -np.inf)
        np.fill_diagonal(now, 0.0)
        for t, e in enumerate(self._scores(np.array(seen))):
            now = (np.vstack([self.step, self.start]) if t == 0 else (now[:, :, None] + self.step).max(axis=1)) + e
        return now


def turns(speakers: Speakers, lines: list[str], states: list[int], worded: bool) -> list[tuple[str, str]]:
    """(role, text) of each turn, markers taken off marked lines. A turn that goes on from lines before has the first line's role."""
    found: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states, strict=True):
        role, place = speakers.states[s]
        if place != "later" or not found:
            found.append((role, [line[speakers.marker(line, worded)[1] :] if place == "marked" else line]))
        else:
            found[-1][1].append(line)
    return [(r, "\n".join(t).strip()) for r, t in found]


def render(found: list[tuple[str, str]], goes_on: bool = False, open_: bool = False) -> str:
    """Canonical form: a header line for each turn, its text, and an end mark; control marks inside a text are escaped.

    goes_on: the first turn began before, and has no header here; open_: the last one goes on, and has no end mark here.
    """
    out = []
    for k, (role, text) in enumerate(found):
        head = "" if goes_on and k == 0 else f"<|{role}|>\n"
        out.append(f"{head}{text.replace('<|', '<\\|')}\n" + ("" if open_ and k == len(found) - 1 else "<|end|>\n"))
    return "".join(out)


STYLES = (
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "Q: ", "assistant": "A: ", "system": "Context: "},
    {"user": "**Human**: ", "assistant": "**AI**: ", "system": "**System**: "},
    {"user": "### Question:\n", "assistant": "### Answer:\n", "system": "### Instruction:\n"},
    {"user": "> ", "assistant": "- ", "system": "[system] "},
)
#: One marker in so many is missing.
MISSING = 8


def lay_out(speakers: Speakers, key: int | None, said: list[tuple[str, str]], first: int = 0, missing: int = MISSING) -> tuple[list[str], list[int]]:
    """A raw transcript of turns, numbered from first, in a style that the key picks, and its true states (-1: role unknown)."""
    style = STYLES[zlib.crc32(str(key).encode()) % len(STYLES)]
    spaced = zlib.crc32(str(key).encode()) % 2
    lines: list[str] = []
    states: list[int] = []
    for k, (role, text) in enumerate(said, first):
        gone = missing and zlib.crc32(f"{key}/{k}".encode()) % missing == 0
        own = (("" if gone else style.get(role, f"{role}: ")) + text).split("\n")
        if k and spaced:
            own.insert(0, "")
        known = role in speakers.roles
        at = speakers.states.index((role, "marked")) if known else -1
        blank = 1 if k and spaced else 0
        before = states[-1] if states else -1
        states += [before // 3 * 3 + 2 if before >= 0 else -1] * blank
        states += [-1 if not known else at + (gone and 1 or 0) if n == 0 else at + 2 for n in range(len(own) - blank)]
        lines += own
    return lines, states


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, number, single): turns with their number from 0 in the conversation's order, repeated ones too; single: all are one part."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = c.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("range", F.shiftright("place", 33)), "turns")
    # of each range and conversation the first place and how many: a few rows a conversation, however long
    sizes = ranged.groupBy("conv_id", "range").agg(F.min("place").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    single = F.sum("n").over(Window.partitionBy("conv_id")) <= PART_TURNS
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "least", before.alias("before"), single.alias("single"))
    return ranged.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).select(*order, (F.col("before") + F.col("place") - F.col("least")).alias("number"), "single")


def transcripts(conversations: DataFrame, speakers: Speakers, missing: int = MISSING) -> DataFrame:
    """(conv_id, part, transcript, states array<int>, single): raw transcripts laid out from turns whose roles are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                raw, true = [], []
                for key, part, said in zip(b.column("conv_id").to_pylist(), b.column("part").to_pylist(), b.column("said").to_pylist(), strict=True):
                    lines, states = lay_out(speakers, key, [(s["role"], s["text"]) for s in said], part * PART_TURNS, missing)
                    raw.append("\n".join(lines))
                    true.append(states)
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array(raw, pa.string()), pa.array(true, pa.list_(pa.int32())), b.column("single")], ["conv_id", "part", "transcript", "states", "single"])

    part = F.floor(F.col("number") / PART_TURNS).cast("long").alias("part")
    parts = numbered(conversations).groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("number", "role", "text"))).alias("said"), F.bool_and("single").alias("single"))
    return parts.mapInArrow(run, "conv_id long, part long, transcript string, states array<int>, single boolean")


def _lines(transcript: str | None) -> list[str]:
    return transcript.split("\n") if transcript else []


def with_context(raw: DataFrame, speakers: Speakers) -> DataFrame:
    """raw (conv_id, part, transcript, ...) with ``worded`` (of the whole conversation), ``before`` (what precedes the part) and ``single``.

    Rows that are told to be a whole conversation (single) are left as they are, with null: what reads them sees all itself.
    """
    if "single" in raw.columns:
        whole = raw.where("single").withColumns({"worded": F.lit(None).cast("boolean"), "before": F.lit(0)})
        return whole.unionByName(with_context(raw.where("not single").drop("single"), speakers))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [_lines(x.as_py()) for x in b.column("transcript")]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array([speakers.worded(x) for x in lines], pa.bool_()), pa.array([kind_of(x[-1]) if x else None for x in lines], pa.int32())], ["c", "p", "worded", "last"])

    seen = raw.select("conv_id", "part", "transcript").mapInArrow(look, "c long, p long, worded boolean, last int")
    # one small row a part
    own = Window.partitionBy("c")
    ahead = F.coalesce(F.last("last", True).over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    context = seen.select("c", "p", F.max("worded").over(own).alias("worded"), ahead.alias("before"), (F.count("*").over(own) == 1).alias("single"))
    return raw.join(context, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p"))).drop("c", "p")


def fit(labelled: DataFrame, speakers: Speakers) -> Model:
    """Counts features, first states and steps over all labelled transcripts (conv_id, part, transcript, states); -1 is an unknown state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        for b in batches:
            for raw, states, worded, first in zip(*(b.column(c).to_pylist() for c in ("transcript", "states", "worded", "before")), strict=True):
                before = None
                lines = raw.split("\n")
                for seen, s in zip(speakers.observations(lines, speakers.worded(lines) if worded is None else worded, first), states, strict=True):
                    if s >= 0:
                        for f, v in zip(FEATURES, seen, strict=True):
                            counts[f, s, v] = counts.get((f, s, v), 0) + 1
                        if before is None and first == 0:
                            counts["start", 0, s] = counts.get(("start", 0, s), 0) + 1
                        elif before is not None and before >= 0:
                            counts["step", before, s] = counts.get(("step", before, s), 0) + 1
                    before = s
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array([k[2] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["kind", "a", "b", "n"])

    rows = with_context(labelled.select("conv_id", "part", "transcript", "states", *(["single"] if "single" in labelled.columns else [])), speakers)
    sums = rows.select("transcript", "states", "worded", "before").mapInArrow(run, "kind string, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    return Model(speakers, {(r["kind"], r["a"], r["b"]): r["n"] for r in sums.collect()})


def ends_of_parts(rows: DataFrame, model: Model) -> DataFrame:
    """(c, p, enter, leave, goes_on): of parts of longer conversations the best path's state before, its last one, and whether a later line follows."""
    n = len(model.start)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for raw, worded, before in zip(*(b.column(c).to_pylist() for c in ("transcript", "worded", "before")), strict=True):
                seen = model.speakers.observations(_lines(raw), worded, before)
                found.append(model.passage(seen).reshape(-1).tolist() if seen and n else None)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.array(found, pa.list_(pa.float64()))], ["conv_id", "part", "way"])

    def join_up(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        ways = [None if w is None else np.array(w).reshape(n + 1, n) for w in group.column("way").to_pylist()]
        forward: list[np.ndarray | None] = [None]
        for w in ways:
            now = forward[-1]
            forward.append(now if w is None else w[n] if now is None else (now[:, None] + w[:n]).max(axis=0))
        enter, leave = [-1] * len(ways), [-1] * len(ways)
        state = -1 if forward[-1] is None else int(forward[-1].argmax())
        for k in range(len(ways) - 1, -1, -1):
            leave[k] = state
            if ways[k] is not None:
                state = -1 if forward[k] is None else int((forward[k] + ways[k][:n, state]).argmax())
            enter[k] = state
        return pa.table({"c": group.column("conv_id"), "p": group.column("part"), "enter": pa.array(enter, pa.int32()), "leave": pa.array(leave, pa.int32())})

    ways = rows.where("not single").select("conv_id", "part", "transcript", "worded", "before").mapInArrow(measure, "conv_id long, part long, way array<double>")
    return ways.groupBy("conv_id").applyInArrow(join_up, "c long, p long, enter int, leave int")


_PARSED = "conv_id long, part long, held_out boolean, n_lines long, n_turns long, roles string, wrong_lines long, rendered string, first_place string"


def parse(raw: DataFrame, model: Model) -> DataFrame:
    """(conv_id, part, held_out, n_lines, n_turns, roles, wrong_lines, rendered) of transcripts (conv_id, part, transcript[, states]).

    roles: the recovered role of each turn, joined by a comma; n_turns: turns that begin in the part; wrong_lines: lines
    whose role differs from the known one, null if none is known. A conversation's parts in order render to the whole.
    """
    if "states" not in raw.columns:
        raw = raw.withColumn("states", F.lit(None).cast("array<int>"))
    speakers = model.speakers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                own = {c: b.column(c).to_pylist() for c in ("conv_id", "transcript", "states", "worded", "before", "enter", "leave")}
                lines = [_lines(t) for t in own["transcript"]]
                own["worded"] = [speakers.worded(x) if w is None else w for x, w in zip(lines, own["worded"], strict=True)]
                seen = [speakers.observations(x, w, f) for x, w, f in zip(lines, own["worded"], own["before"], strict=True)]
                paths = model.viterbi(seen, [(-1 if e is None else e, -1 if v is None else v) for e, v in zip(own["enter"], own["leave"], strict=True)])
                found = [turns(speakers, x, p, w) if p else [] for x, p, w in zip(lines, paths, own["worded"], strict=True)]
                wrong = [None if true is None else sum(t >= 0 and t // 3 != s // 3 for t, s in zip(true, p, strict=False)) for true, p in zip(own["states"], paths, strict=True)]
                goes_on = [bool(p) and speakers.states[p[0]][1] == "later" for p in paths]
                columns = [
                    b.column("conv_id"),
                    b.column("part"),
                    pa.array([is_held_out(k) for k in own["conv_id"]], pa.bool_()),
                    pa.array([len(x) for x in lines], pa.int64()),
                    pa.array([len(t) - g for t, g in zip(found, goes_on, strict=True)], pa.int64()),
                    pa.array([",".join(r for r, _ in t[g:]) for t, g in zip(found, goes_on, strict=True)], pa.string()),
                    pa.array(wrong, pa.int64()),
                    pa.array([render(t, g, True) for t, g in zip(found, goes_on, strict=True)], pa.string()),
                    pa.array([speakers.states[p[0]][1] if p else None for p in paths], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _PARSED.split(", ")])

    names = [f.split()[0] for f in _PARSED.split(", ")]
    rows = with_context(raw.select("conv_id", "part", "transcript", "states", *(["single"] if "single" in raw.columns else [])), speakers)
    free = {"enter": F.lit(-1), "leave": F.lit(-1)}
    close = F.when(F.col("first_place").isNull(), F.col("rendered")).otherwise(F.concat("rendered", F.lit("<|end|>\n")))
    alone = rows.where("single").withColumns(free).drop("single").mapInArrow(run, _PARSED).withColumn("rendered", close)

    ends = ends_of_parts(rows, model)
    met = rows.where("not single").join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p"))).drop("c", "p", "single")
    places = stored(met.mapInArrow(run, _PARSED), "parsed")
    # a part's last turn is closed unless the next part's first line goes on with it
    after = F.first("first_place", True).over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    next_ = places.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), after.alias("after"))
    joined = places.join(next_, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p")))
    open_ = F.coalesce(F.col("after") == "later", F.lit(False))
    several = joined.withColumn("rendered", F.when(open_, F.col("rendered")).otherwise(close)).select(*names)
    return alone.unionByName(several).select(*names[:-1])


def is_held_out(key: int | None) -> bool:
    return zlib.crc32(str(key).encode()) % 3 == 1


def _training(df: DataFrame) -> DataFrame:
    return df.where(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("None"))) % 3 != 1)


def known_speakers(conversations: DataFrame) -> Speakers:
    """The most frequent roles of the training rows, MOST_ROLES at most, ties by name: these come to the driver."""
    rows = _training(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"))).where("role is not null")
    return Speakers([r["role"] for r in rows.groupBy("role").count().orderBy(F.desc("count"), "role").limit(MOST_ROLES).collect()])


def op10_hmm_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    speakers = known_speakers(conversations)
    raw = stored(transcripts(conversations, speakers), "transcripts")
    return parse(raw, fit(_training(raw), speakers))
