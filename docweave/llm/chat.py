"""Transcript parsing: a hidden Markov model recovers who speaks, and turns are rendered in one form.

Each line of a transcript comes from a state: the first or a later line of a turn of one of the roles. What is seen of a line is its speaker
marker (of which role, or none), whether the line before was blank, whether it ends as a question, how long it is, and whether it looks
like instructions or like code and lists. Viterbi's most probable states give the turns, also where markers are missing, misleading or quoted
within a turn.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweave.llm.common import discard, mapped, stored

ROLES = ("system", "user", "assistant")
#: Names that speakers of each role go by in transcripts.
NAMES = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "gpt", "chatbot", "response"),
}
_NAME = "|".join(sorted((n for names in NAMES.values() for n in names), key=len, reverse=True))
_MARKER = re.compile(
    rf"\s*(?:<\|(?:im_start\|>)?\s*(?P<a>{_NAME})(?:\|>)?|\[(?P<b>{_NAME})\]:?|#{{1,4}}\s*(?P<c>{_NAME})\s*:?(?=\s|$)|\*\*(?P<d>{_NAME}):?\*\*:?|>?\s*(?P<e>{_NAME})(?:\s*\(\d+\))?\s*:)\s*",
    re.IGNORECASE,
)
_ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_ENDING = re.compile(r"\s*(?:<\|(?:im_end|end|endoftext)\|>|</s>)\s*$")
_INSTRUCTS = re.compile(r"\s*(?:you are|you will|act as|your task|answer as|always|never)\b", re.IGNORECASE)
_LISTED = re.compile(r"\s*(?:[-*•]\s|\d{1,3}[.)]\s|```|    |\t)")


def marker(line: str) -> tuple[int, int]:
    """The role that a line's marker names (its place in ROLES, -1 for none) and where the line's own text begins."""
    found = _MARKER.match(line)
    if not found:
        return -1, 0
    return ROLES.index(_ROLE_OF[next(filter(None, found.groups())).lower()]), found.end()


def observed(line: str, after_blank: bool) -> tuple[int, ...]:
    """Marker + 1, after a blank line (2: blank itself), question, length class, instructs, listed."""
    role, at = marker(line)
    own = line[at:]
    blank = not line.strip()
    size = len(own)
    return (role + 1, 2 if blank else int(after_blank), int(own.rstrip().endswith("?")), (size > 60) + (size > 240), int(bool(_INSTRUCTS.match(own))), int(bool(_LISTED.match(line))))


_WIDTHS = (4, 3, 2, 3, 2, 2)


#: Log probabilities are counted in whole numbers of 1 / UNIT.
UNIT = 1 << 30
CODES = 4 * 2 * 3 * 2 * 2 * 2


def code(line: str) -> int:
    """What is seen of a line by itself, as one number; odd for blank lines."""
    role, after, asks, size, instructs, listed = observed(line, False)
    return ((((role * 2 + asks) * 3 + size) * 2 + instructs) * 2 + listed) * 2 + (after == 2)


def _features(c: int, after_blank: int) -> tuple[int, ...]:
    """What observed() gives for a line of this code."""
    c, blank = divmod(c, 2)
    c, listed = divmod(c, 2)
    c, instructs = divmod(c, 2)
    c, size = divmod(c, 3)
    return (c // 2, 2 if blank else after_blank, c % 2, size, instructs, listed)


@dataclass
class ChatModel:
    """States 2 r (first line of a turn of role r) and 2 r + 1 (a later line), as log probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]  # for each feature: states by values

    @classmethod
    def default(cls) -> ChatModel:
        """Probabilities stated by hand: the prior of fitted models, and the model where nothing is labelled."""
        first = [0.35, 0.0, 0.5, 0.0, 0.15, 0.0]
        move = np.zeros((6, 6))
        follows = [[0.02, 0.9, 0.08], [0.01, 0.09, 0.9], [0.01, 0.93, 0.06]]  # role after role
        for r in range(3):
            for state, stays in ((2 * r, 0.5), (2 * r + 1, 0.75)):
                move[state, 2 * r + 1] = stays
                for q in range(3):
                    move[state, 2 * q] += (1 - stays) * follows[r][q]
        marks, blanks, asks, sizes, instructs, lists = ([] for _ in range(6))
        for r in range(3):
            named = [0.09, 0.004, 0.004, 0.004]
            named[r + 1] = 1 - sum(named) + named[r + 1]
            marks += [named, [0.985, 0.003, 0.006, 0.006]]
            blanks += [[0.55, 0.445, 0.005], [0.7, 0.12, 0.18]]
            asks += [[1 - q, q] for q in ([0.02, 0.35, 0.06][r], [0.02, 0.2, 0.05][r])]
            sizes += [[0.3, 0.4, 0.3] if r != 1 else [0.5, 0.35, 0.15], [0.35, 0.4, 0.25]]
            instructs += [[1 - q, q] for q in ([0.4, 0.03, 0.02][r], [0.1, 0.02, 0.02][r])]
            lists += [[1 - q, q] for q in ([0.03, 0.03, 0.08][r], [0.1, 0.08, 0.25][r])]
        return cls._logs(first, move, [marks, blanks, asks, sizes, instructs, lists])

    @classmethod
    def _logs(cls, first, move, emit) -> ChatModel:
        log = lambda x: np.log(np.maximum(np.asarray(x, dtype=float), 1e-12))
        return cls(log(first), log(move), [log(e) for e in emit])

    @classmethod
    def fit(cls, transcripts: list[list[tuple[str, str]]], weight: float = 1.0) -> ChatModel:
        """From transcripts of (role, turn text with its marker): relative frequencies, with the default as prior of this weight."""
        return cls.fit_codes([[(role, bytes(map(code, text.split("\n")))) for role, text in turns] for turns in transcripts], weight)

    @classmethod
    def fit_codes(cls, transcripts: list[list[tuple[str, bytes]]], weight: float = 1.0) -> ChatModel:
        """fit, for transcripts of (role, codes of the turn's lines)."""
        base = cls.default()
        first, move, emit = weight * np.exp(base.start), weight * np.exp(base.move), [weight * np.exp(e) for e in base.emit]
        for turns in transcripts:
            before, after_blank = None, False
            for role, codes in turns:
                for k, c in enumerate(codes):
                    state = 2 * ROLES.index(role) + (k > 0)
                    for feature, value in enumerate(_features(c, int(after_blank))):
                        emit[feature][state, value] += 1
                    if before is None:
                        first[state] += 1
                    else:
                        move[before, state] += 1
                    before, after_blank = state, bool(c & 1)
        rows = lambda m: m / m.sum(axis=-1, keepdims=True)
        return cls._logs(rows(first), rows(move), [rows(e) for e in emit])

    def whole(self) -> tuple[list[int], list[list[int]], list[list[list[int]]]]:
        """start, move by the state moved to, and emit by after_blank and code, as whole numbers: their sums do not hang on where a transcript is divided."""
        fixed = lambda x: np.rint(np.asarray(x) * UNIT).astype(np.int64).tolist()
        emit = [[sum(e[:, v] for e, v in zip(self.emit, _features(c, b))) for c in range(CODES)] for b in (0, 1)]
        return fixed(self.start), fixed(self.move.T), fixed(emit)

    def viterbi(self, lines: list[str]) -> list[int]:
        """The most probable states; of equal paths the one whose states come first."""
        found = Decoder(self)
        for line in lines:
            found.step(code(line))
        return found.settled(found.best()) if lines else []

    def parse(self, lines: list[str]) -> list[tuple[str, str]]:
        """(role, content) of each turn. Markers that name the turn's role go, as do end-of-turn signs and blank lines around it."""
        turns = Turns(False)
        ended = [turns.add(line, state) for line, state in zip(lines, self.viterbi(lines))] + [(turns.role, turns.own) if lines else None]
        return [(ROLES[t[0]], content_of(t[1])) for t in ended if t]


class Decoder:
    """Viterbi, a line at a time: from the start of a transcript, or from the scores that its states have before the next line."""

    def __init__(self, model: ChatModel, score: list[int] | None = None, after_blank: bool = False):
        self.start, self.move, self.emit = model.whole()
        self.score, self.after_blank, self.back = score, after_blank, []

    def begin(self, score: list[int] | None = None, after_blank: bool = False) -> None:
        self.score, self.after_blank, self.back = score, after_blank, []

    def step(self, c: int) -> list[int]:
        """Takes a line by its code; returns the state before it on the best path to each state."""
        own = self.emit[self.after_blank][c]
        if self.score is None:
            came, self.score = [0, 1, 2, 3, 4, 5], [a + b for a, b in zip(self.start, own)]
        else:
            best = [max(zip([s + m for s, m in zip(self.score, into)], (0, -1, -2, -3, -4, -5))) for into in self.move]
            came, self.score = [-i for _, i in best], [b + o for (b, _), o in zip(best, own)]
        self.after_blank = bool(c & 1)
        self.back.append(came)
        return came

    def best(self) -> int:
        return max(range(6), key=lambda s: (self.score[s], -s))

    def settled(self, last: int | None = None) -> list[int]:
        """The states of the lines not yet given out: of all, where the last line's state is known, or else of those on which the best paths to all six states agree."""
        tips, k = [*range(6)] if last is None else [last], len(self.back) - 1
        while k >= 0 and len(set(tips)) > 1:
            tips, k = [self.back[k][t] for t in tips], k - 1
        path, state = [], tips[0]
        for came in reversed(self.back[: k + 1]):
            path.append(state)
            state = came[state]
        del self.back[: k + 1]
        return path[::-1]


def content_of(lines: list[str]) -> str:
    return _ENDING.sub("", "\n".join(lines).strip("\n")).strip()


class Turns:
    """Lines and their states gathered to turns: (role, or -1 where the turn began before, its lines)."""

    def __init__(self, inside: bool):
        self.role, self.own, self.inside = -1, [], inside

    def add(self, line: str, state: int):
        """The turn that ends before this line, if any."""
        ended = None
        if state % 2 == 0 or not self.inside:
            ended = (self.role, self.own) if self.own else None
            role, at = marker(line)
            self.role, self.own, self.inside = state // 2, [line[at:] if role == state // 2 else line], True
        else:
            self.own.append(line)
        return ended


def rendered(role: str, content: str) -> str:
    return f"<|{role}|>\n{content}\n<|end|>\n"


def format_chats(parts: DataFrame, id_col: str, order_col: str, text_col: str, model: ChatModel | None = None, most_lines: int = 5000, per_stretch: int = 1000) -> DataFrame:
    """id, stretch, turn, role, content, rendered, place: the turns of each transcript.

    A transcript is the texts of its id in order, each beginning a new line; one row an id is the plain case. place numbers its turns from
    0. A transcript of more than per_stretch rows is dealt out over tasks in stretches of so many rows; stretch is that in which a turn
    begins, and turn numbers its turns from 0. The states are those of one Viterbi over the whole transcript, wherever it is divided.
    Rows are streamed in order: after most_lines lines those are given out on whose states all best paths agree.

    Defined cases: null texts are empty lines; turns of blank content are left out, so blank transcripts give none. Null ids are one transcript, null orders come first.
    Repeated rows repeat their lines; rows of equal order come in the order of their texts. An empty table gives no rows. Other
    columns are ignored.
    """
    model = model or ChatModel.default()
    kind = parts.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = parts.select(F.col(id_col).alias("id"), F.col(order_col).alias("o"), text.alias("t"))
    long = stored(rows.groupBy(F.col("id").alias("i")).agg(F.count("*").alias("n")).where(F.col("n") > per_stretch).select("i"), "long")
    same = F.col("id").eqNullSafe(F.col("i"))
    short = rows.join(long, same, "left_anti").repartition("id").sortWithinPartitions("id", "o", "t")
    out = _turns(short.select("id", F.lit(0).cast("long").alias("stretch"), "t", *_whole()), model, most_lines, kind)
    out = out.withColumn("place", F.col("j"))
    if not long.isEmpty():
        out = out.unionByName(_long_turns(rows.join(long, same, "left_semi"), model, most_lines, per_stretch, kind))
    turn = (F.row_number().over(Window.partitionBy("id", "stretch").orderBy("place")) - 1).cast("int")
    said = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>\n"))
    return out.select("id", "stretch", turn.alias("turn"), "role", "content", said.alias("rendered"), "place")


def _whole():
    """The columns that tell how a stretch is entered and left, for stretches that are whole transcripts."""
    return [F.lit(None).cast("array<long>").alias("score"), F.lit(False).alias("after_blank"), F.lit(None).cast("int").alias("exit")]


def _grouped(rows: DataFrame, function, schema: str, *keys: str) -> DataFrame:
    """function(key, an iterator of rows) for each run of rows with equal keys (rows are sorted); it yields tuples."""

    def run(batches):
        def each():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out = []
        for key, own in itertools.groupby(each(), lambda r: r[: len(keys)]):
            for x in function(key, own):
                out.append(x)
                if len(out) >= 2000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return mapped(rows, run, schema)


def _turns(rows: DataFrame, model: ChatModel, most_lines: int, kind: str, whole: bool = True) -> DataFrame:
    """id, stretch, j, role, content: the turns of each stretch; rows have id, stretch, t and what _whole() names.

    Where stretches are not whole transcripts content is as it stands, open turns come with a null content or role, and empty ones too.
    """

    decoder = Decoder(model)

    def turns_of(key, own):
        turns, held, j = None, [], 0

        def piece(turn):
            nonlocal j
            role, lines = turn
            content = content_of(lines) if whole else "\n".join(lines)
            if content or not whole:
                yield (*key, j, ROLES[role] if role >= 0 else None, content)
                j += 1

        limit = most_lines
        for _, _, text, score, after_blank, leave in own:
            if turns is None:
                turns, last = Turns(score is not None), leave
                decoder.begin(score, after_blank)
            for line in text.split("\n"):
                held.append(line)
                decoder.step(code(line))
                if len(held) >= limit:
                    states = decoder.settled()
                    for x, state in zip(held, states):
                        if ended := turns.add(x, state):
                            yield from piece(ended)
                    del held[: len(states)]
                    limit = max(most_lines, 2 * len(held))
        for x, state in zip(held, decoder.settled(decoder.best() if last is None else last)):
            if ended := turns.add(x, state):
                yield from piece(ended)
        yield from piece((turns.role, turns.own))

    return _grouped(rows, turns_of, f"id {kind}, stretch long, j long, role string, content string", "id", "stretch")


def _long_turns(rows: DataFrame, model: ChatModel, most_lines: int, per_stretch: int, kind: str) -> DataFrame:
    """id, stretch, j, role, content, place of the turns of transcripts in several stretches.

    Rows are sorted as a whole, which gives each its rank. Of each stretch, the best scores from any state to any other are found by
    themselves; put together along a transcript they give the scores with which each stretch is entered. With these, each stretch tells from
    which state each of its last states comes, which gives, from the transcript's end, the state in which each stretch ends.
    """
    ordered = rows.repartitionByRange("id", "o", "t").sortWithinPartitions("id", "o", "t").select("id", F.spark_partition_id().alias("p"), "t")

    def numbered(key, own):
        for k, (i, p, t) in enumerate(own):
            yield i, p, k, t, np.array([code(x) for x in t.split("\n")], np.uint8).tobytes()

    placed = stored(_grouped(ordered, numbered, f"id {kind}, p int, k long, t string, codes binary", "id"), "placed")
    before = F.sum("n").over(Window.partitionBy("i").orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    shift = placed.groupBy(F.col("id").alias("i"), F.col("p").alias("q")).agg(F.count("*").alias("n")).withColumn("before", before).where("before > 0")
    # at most one row for each partition: only its first transcript began before it
    ranked = placed.join(F.broadcast(shift), F.col("id").eqNullSafe(F.col("i")) & (F.col("p") == F.col("q")), "left")
    ranked = ranked.withColumn("rank", F.col("k") + F.coalesce("before", F.lit(0)))
    ranked = ranked.withColumn("stretch", F.floor(F.col("rank") / per_stretch).cast("long"))
    dealt = lambda x, *cols: x.repartition("id", "stretch").sortWithinPartitions("id", "stretch", "rank").select("id", "stretch", *cols)
    join = lambda a, b: a.join(b.withColumnsRenamed({"id": "i2", "stretch": "s2"}), F.col("id").eqNullSafe(F.col("i2")) & (F.col("stretch") == F.col("s2"))).drop("i2", "s2")
    decoder = Decoder(model)
    start, emit, move = decoder.start, decoder.emit, np.array(decoder.move)

    def transfer(key, own):
        """The first line's own scores after a line and after a blank one, and the best scores from its states to the last line's."""
        best, blank = None, False
        for *_, codes in own:
            for c in codes:
                if best is None:
                    first, best = c, np.where(np.eye(6, dtype=bool), 0, -(1 << 60))
                else:
                    best = (best[:, None, :] + move).max(axis=2) + np.array(emit[blank][c])
                blank = bool(c & 1)
        yield (*key, emit[0][first], emit[1][first], best.ravel().tolist(), blank)

    def entered(key, own):
        score, after_blank = None, False
        for i, stretch, plain, after, best, blank in own:
            yield i, stretch, score, after_blank
            first = start if score is None else [max(s + m for s, m in zip(score, into)) for into in decoder.move]
            first = [a + b for a, b in zip(first, after if after_blank else plain)]
            score = [max(first[a] + best[6 * a + b] for a in range(6)) for b in range(6)]
            top = max(score)
            score, after_blank = [s - top for s in score], blank

    def traced(key, own):
        came = [*range(6)]
        for n, (_, _, codes, score, after_blank) in enumerate(own):
            if n == 0:
                decoder.begin(score, after_blank)
            for c in codes:
                came = [came[b] for b in decoder.step(c)]
                decoder.back.clear()
        yield (*key, came, decoder.best())

    def left(key, own):
        state = None
        for i, stretch, came, best in own:
            state = best if state is None else state
            yield i, stretch, state
            state = came[state]

    along = lambda x, down=False: x.repartition("id").sortWithinPartitions("id", F.desc("stretch") if down else "stretch")
    head = f"id {kind}, stretch long, "
    parts = _grouped(dealt(ranked, "codes"), transfer, head + "plain array<long>, after array<long>, best array<long>, blank boolean", "id", "stretch")
    entries = stored(_grouped(along(parts), entered, head + "score array<long>, after_blank boolean", "id"), "entries")
    traces = _grouped(dealt(join(ranked, entries), "codes", "score", "after_blank"), traced, head + "came array<int>, best int", "id", "stretch")
    exits = stored(_grouped(along(traces, True), left, head + "exit int", "id"), "exits")
    pieces = stored(_turns(dealt(join(join(ranked, entries), exits), "t", "score", "after_blank", "exit"), model, most_lines, kind, whole=False), "pieces")
    # a piece without a role goes on with the last turn that began in a stretch before it
    heads = pieces.groupBy("id", "stretch").agg(F.max(F.when(F.col("role").isNotNull(), F.col("j"))).alias("last"))
    w = Window.partitionBy("id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("stretch").alias("stretch"), F.col("last").alias("j"))), ignorenulls=True)
    heads = heads.select("id", "stretch", begun.over(w).alias("from"), "last")
    own = join(pieces, heads).withColumn("at", F.when(F.col("role").isNull(), F.col("from")).otherwise(F.struct("stretch", "j")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "content"))), lambda x: x["content"]), "\n")
    turns = own.groupBy("id", "at").agg(F.max("role").alias("role"), texts.alias("content"))

    def cleaned(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([content_of([x]) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())], names=b.schema.names)

    turns = turns.select("id", F.col("at.stretch").alias("stretch"), F.col("at.j").alias("j"), "role", "content")
    turns = stored(mapped(turns, cleaned, head + "j long, role string, content string").where("content != ''"), "turns")
    sums = turns.groupBy("id", "stretch").agg(F.count("*").alias("n")).select("id", "stretch", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("earlier"))
    discard(placed, entries, exits, pieces)
    within = F.row_number().over(Window.partitionBy("id", "stretch").orderBy("j")) - 1
    return join(turns, sums).withColumn("place", (F.col("earlier") + within).cast("long")).drop("earlier")


#: How the query writes the speaker of a turn, by conversation.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions:\n", "user": "### Human:\n", "assistant": "### AI:\n"},
    {"system": "<|im_start|>system\n", "user": "<|im_start|>user\n", "assistant": "<|im_start|>assistant\n"},
    {"system": "[SYSTEM] ", "user": "[USER] ", "assistant": "[BOT] "},
    {"system": "**System:** ", "user": "**Q:** ", "assistant": "**A:** "},
)


def transcripts(conversations: DataFrame, unmarked: float = 0.0) -> DataFrame:
    """conversations as raw transcripts: text gets the speaker's marker, in one of STYLES by conv_id; unknown roles get none, nor does a share of
    the turns, by a hash."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, marks in enumerate(STYLES):
        for role, text in marks.items():
            mark = F.when((style == k) & (F.col("role") == role), text).otherwise(mark)
    mark = F.when(F.pmod(F.xxhash64("conv_id", "turn", F.lit("unmarked")), F.lit(1000)) < 1000 * unmarked, "").otherwise(mark)
    return conversations.select("conv_id", "turn", "role", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))


def fitted(conversations: DataFrame, limit: int = 2000, most_turns: int = 64, most_lines: int = 200, unmarked: float = 0.05) -> ChatModel:
    """The model of labelled conversations (conv_id, turn, role, text) written as transcripts, of which a share of the turns has no marker.

    Learnt from at most `limit` ids, chosen by a hash, and of each from at most its first `most_turns` turns and their first `most_lines` lines:
    codes of lines, of a byte each, reach the driver. Null ids and turns of unknown roles are left out; without any the default stands.
    """
    ids = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(limit)
    raw = transcripts(conversations, unmarked)
    rows = raw.join(F.broadcast(ids), F.col("conv_id") == F.col("i")).where(F.col("role").isin(*ROLES))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    rows = rows.withColumn("place", place).where(F.col("place") <= most_turns).select("conv_id", "place", "role", "text")

    def coded(batches):
        for b in batches:
            codes = [bytes(map(code, t.split("\n", most_lines)[:most_lines])) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(codes, pa.binary())], names=["conv_id", "place", "role", "codes"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    found: dict = {}
    for r in sorted(mapped(rows, coded, f"conv_id {kind}, place int, role string, codes binary").collect()):
        found.setdefault(r["conv_id"], []).append((r["role"], bytes(r["codes"])))
    return ChatModel.fit_codes(list(found.values()))


def op1_chat_formatting(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = format_chats(transcripts(conversations), "conv_id", "turn", "text", fitted(conversations))
    return turns.select(F.col("id").alias("conv_id"), "stretch", F.col("place").alias("turn"), "role", "content", "rendered")
