"""Chat formatting: roles of a raw transcript's lines by a hidden Markov model, then canonical turns.

A hidden state is a role and whether the line opens a turn.  A line shows its speaker marker
(what kind of name stands before a colon, in brackets or after hashes, if any), how long it is,
whether it is blank, and whether a question mark ends it; the features are taken as independent
given the state.  Their counts come from transcripts whose turns are known.  Viterbi decoding
finds the likeliest states; lines from one opening line to the next make a turn.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2 + (0: opens a turn, 1: goes on)
SIZES = (5, 6, 2, 2)
PART_TURNS = 512

# Names that speakers go by.
NAMES = {
    "system": 1, "sys": 1, "context": 1,
    "user": 2, "human": 2, "prompt": 2, "question": 2, "q": 2,
    "assistant": 3, "ai": 3, "bot": 3, "model": 3, "response": 3, "answer": 3, "a": 3,
}
_MARKER = re.compile(r"\s*(?:#{1,6}\s*([A-Za-z]{1,12})\s*:?(?=\s|$)|\[([A-Za-z]{1,12})\]\s*:?|<\|?([A-Za-z]{1,12})\|?>|\**([A-Za-z]{1,12})\**\s*:)[ \t]*")


def marker(line: str) -> tuple[int, int]:
    """The kind of a line's speaker marker (0: none, 4: an unknown name) and where its text begins."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    kind = NAMES.get(next(x for x in m.groups() if x).lower(), 4)
    return (kind, m.end()) if kind < 4 else (4, 0)


def observe(lines: list[str]) -> np.ndarray:
    """Marker kind, length class, blank, question: one row a line."""
    out = np.zeros((len(lines), 4), np.int64)
    for i, line in enumerate(lines):
        kind, at = marker(line)
        body = line[at:].strip()
        out[i] = kind, min(5, len(body) // 60 + (len(body) > 0)), not body, body.endswith("?")
    return out


class RoleModel:
    """Log probabilities of first states, transitions and each feature, from counts with one added."""

    def __init__(self, counts: pd.DataFrame):
        """counts: kind (0 first, 1 transition, 2 + feature), state, value, times."""
        first, move = np.ones(STATES), np.ones((STATES, STATES)) * 0.1
        shows = [np.ones((STATES, n)) for n in SIZES]
        first[1::2] = 1e-6  # a transcript opens with a turn
        for row in counts.itertuples(index=False):
            if row.kind == 0:
                first[row.state] += row.times
            elif row.kind == 1:
                move[row.state, row.value] += row.times
            else:
                shows[row.kind - 2][row.state, row.value] += row.times
        self.first = np.log(first / first.sum())
        self.move = np.log(move / move.sum(1, keepdims=True))
        self.shows = [np.log(x / x.sum(1, keepdims=True)) for x in shows]

    def _fits(self, seen: np.ndarray, follows: bool) -> np.ndarray:
        fits = sum(table[:, seen[:, k]] for k, table in enumerate(self.shows)).T
        later = seen if follows else seen[1:]
        fits[len(seen) - len(later) :, 0::2][(later[:, 0] == 0) & (later[:, 2] == 1)] = -1e9  # a blank line without a marker opens no turn
        return fits

    def crossing(self, seen: np.ndarray) -> np.ndarray:
        """The best score of a part's lines for each state before them, and last for none before them, and each state of the last line."""
        fits = self._fits(seen, True)
        best = np.vstack([self.move + fits[0], self.first + self._fits(seen[:1], False)[0]])
        for fit in fits[1:]:
            best = (best[:, :, None] + self.move).max(1) + fit
        return best

    def decode(self, seen: np.ndarray, enter: int | None = None, leave: int | None = None) -> np.ndarray:
        """The likeliest state of each line; `enter` is that of the line before, `leave` that of the last, where they are known."""
        fits = self._fits(seen, enter is not None)
        best = (self.first if enter is None else self.move[enter]) + fits[0]
        back = np.zeros(fits.shape, np.int64)
        for t in range(1, len(fits)):
            way = best[:, None] + self.move
            back[t] = way.argmax(0)
            best = way.max(0) + fits[t]
        path = np.empty(len(fits), np.int64)
        path[-1] = best.argmax() if leave is None else leave
        for t in range(len(fits) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def _count(batches):
    for batch in batches:
        rows: dict[tuple[int, int, int], int] = {}
        for turns in batch.column("turns").to_pylist():
            states, lines = [], []
            for turn in turns or []:
                if turn["role"] not in ROLES:
                    continue
                own = (turn["raw"] or "").split("\n")
                lines += own
                states += [ROLES.index(turn["role"]) * 2 + (i > 0) for i in range(len(own))]
            if not lines:
                continue
            keys = [(0, states[0], 0)] + [(1, a, b) for a, b in zip(states, states[1:], strict=False)]
            keys += [(2 + k, s, int(x)) for s, seen in zip(states, observe(lines), strict=True) for k, x in enumerate(seen)]
            for key in keys:
                rows[key] = rows.get(key, 0) + 1
        if rows:
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["kind", "state", "value", "times"])


def learn(known: DataFrame) -> RoleModel:
    """From turns, array<struct<role, raw>> in order: raw is what the transcript has. Other roles are left out."""
    import pyarrow as pa

    def counted(batches):
        for frame in _count(batches):
            yield pa.RecordBatch.from_pandas(frame.astype("int64"), preserve_index=False)

    rows = known.select("turns").mapInArrow(counted, "kind long, state long, value long, times long")
    return RoleModel(rows.groupBy("kind", "state", "value").agg(F.sum("times").alias("times")).toPandas())


def _turns(text: str | None, model: RoleModel, enter: int | None = None, leave: int | None = None) -> tuple[list[dict], bool]:
    """The turns between given states (of the line before, of the last line), and whether the first goes on the one before."""
    if not text or not text.strip():
        return [], False
    lines = text.split("\n")
    path = model.decode(observe(lines), enter, leave)
    goes_on = enter is not None and path[0] % 2 == 1
    turns: list[dict] = []
    for i, (line, state) in enumerate(zip(lines, path, strict=True)):
        if i == 0 or state % 2 == 0:
            turns.append({"role": ROLES[state // 2], "lines": [line if i == 0 and goes_on else line[marker(line)[1] :]]})
        else:
            turns[-1]["lines"].append(line)
    return [{"role": t["role"], "text": "\n".join(t["lines"]).rstrip("\n")} for t in turns], goes_on


def parse_text(text: str | None, model: RoleModel) -> list[dict]:
    """The turns of one transcript; blank lines at a turn's end are dropped."""
    return _turns(text, model)[0]


def parse(transcripts: DataFrame, model: RoleModel, text: str = "text") -> DataFrame:
    """Adds turns, array<struct<role, text>>: empty for null, empty and blank texts. Other columns stay."""
    sent = transcripts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<role:string,text:string>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([parse_text(t, sent.value) for t in texts], dtype=object)

    return transcripts.withColumn("turns", parsed(F.col(text)))


def ways(crossings: list[np.ndarray | None]) -> list[tuple[int | None, int | None]]:
    """The states before and at the end of each part of a transcript on its likeliest path; a part without lines (None) changes nothing."""
    best, backs = None, []
    for m in crossings:
        if m is None:
            backs.append(None)
        elif best is None:
            best = m[STATES]
            backs.append(None)
        else:
            way = best[:, None] + m[:STATES]
            backs.append(way.argmax(0))
            best = way.max(0)
    out: list[tuple[int | None, int | None]] = [(None, None)] * len(crossings)
    state = None if best is None else int(best.argmax())
    for i in range(len(crossings) - 1, -1, -1):
        if crossings[i] is None:
            continue
        before = None if backs[i] is None else int(backs[i][state])
        out[i], state = (before, state), before
    return out


def parse_parts(parts: DataFrame, model: RoleModel, key: str, part: str = "part", text: str = "text") -> DataFrame:
    """Adds turns, as `parse`, and continues: whether the first turn goes on that of the part before.

    Parts of one key are one transcript, in the order of their numbers, which may not repeat within a key; parts
    without a key or number are transcripts of their own.  What crosses a cut is carried exactly: each part sends the 42 scores between the states before it, if any,
    and at its end, these are folded for each key of several parts, and each part is then decoded between the states that
    the fold gives.  No text leaves its part.  A turn over a cut is two turns of the same role."""
    sent = parts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def crossed(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.crossing(observe(t.split("\n"))).ravel() if t and t.strip() else None for t in texts], dtype=object)

    def folded(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__part")
        found = ways([None if c is None else np.asarray(c).reshape(-1, STATES) for c in frame["__way"]])
        return pd.DataFrame({"__key": frame["__key"].to_numpy(), "__part": frame["__part"].to_numpy(), "__enter": pd.array([a for a, _ in found], "Int32"), "__leave": pd.array([b for _, b in found], "Int32")})

    @F.pandas_udf("struct<turns:array<struct<role:string,text:string>>,continues:boolean>")
    def parsed(texts: pd.Series, enter: pd.Series, leave: pd.Series) -> pd.DataFrame:
        states = [[None if pd.isna(x) else int(x) for x in column] for column in (enter, leave)]
        return pd.DataFrame([_turns(t, sent.value, a, b) for t, a, b in zip(texts, *states, strict=True)], columns=["turns", "continues"])

    # joined by key and number throughout, as such parts are dealt by the aggregate that made them: no text moves again
    named = parts.select(F.col(key).alias("__key"), F.col(part).alias("__part"), F.col(text).alias("__text"))
    several = named.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1").select("__key")
    cut = named.join(named.select("__key", "__part").join(several, "__key"), ["__key", "__part"], "left_semi").select("__key", "__part", crossed("__text").alias("__way"))
    kinds = f"__key {parts.schema[key].dataType.simpleString()}, __part {parts.schema[part].dataType.simpleString()}, __enter int, __leave int"
    between = cut.groupBy("__key").applyInPandas(folded, kinds)
    found = parts.join(between, (F.col(key) == F.col("__key")) & (F.col(part) == F.col("__part")), "left").withColumn("__found", parsed(F.col(text), "__enter", "__leave"))
    return found.withColumns({"turns": F.col("__found.turns"), "continues": F.col("__found.continues")}).drop("__key", "__part", "__enter", "__leave", "__found")


def rendered(turns: Column) -> Column:
    """Canonical text of turns: each between its role's opening mark and an end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t.role, F.lit("|>\n"), F.coalesce(t.text, F.lit("")), F.lit("\n<|end|>\n"))), "")


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, part, text and turns (role and raw) from rows of turns.

    A conversation uses one of three ways to mark speakers, by the CRC of its id; every fourth
    turn, by the CRC of its id and number, has no mark at all.  Parts hold `PART_TURNS` numbers,
    so that no group grows without bound where numbers do not repeat; null numbers count as 0.  Null texts are empty, a null role is written unmarked."""
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(3))
    bare = F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn")), F.lit(4)) == 0
    role = F.col("role")
    names = [("System: ", "User: ", "Assistant: "), ("[sys] ", "Human: ", "AI: "), ("### System\n", "### Prompt\n", "### Response\n")]
    of_style = [F.when(role == ROLES[0], a).when(role == ROLES[1], b).when(role == ROLES[2], c).otherwise("") for a, b, c in names]
    mark = F.when(bare, "").when(style == 0, of_style[0]).when(style == 1, of_style[1]).otherwise(of_style[2])
    turn = F.struct(F.col("turn"), F.coalesce(role, F.lit("")).alias("role"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("raw"))
    part = F.floor(F.coalesce("turn", F.lit(0)) / PART_TURNS).cast("long")
    grouped = conversations.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.withColumn("text", F.array_join(F.transform("turns", lambda t: t.raw), "\n"))


def query(spark, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations, parsed by a model learned where crc32(conv_id as text) mod 5 is not 0."""
    held_out = F.crc32(F.col("conv_id").cast("string")) % 5 == 0
    made = as_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    model = learn(made.filter(F.coalesce(~held_out, F.lit(False))))
    given = made.withColumn("given", F.transform("turns", lambda t: t.role)).drop("turns")
    found = parse_parts(given, model, "conv_id").withColumn("roles", F.transform("turns", lambda t: t.role))
    right = F.size(F.filter(F.arrays_zip("roles", "given"), lambda x: x.roles == x.given))
    return found.select(
        "conv_id",
        "part",
        "continues",
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        F.size("given").cast("long").alias("n_given"),
        F.size("turns").cast("long").alias("n_turns"),
        right.cast("long").alias("n_right"),
        F.array_join("roles", ",").alias("roles"),
        F.sha2(rendered(F.col("turns")), 256).alias("rendered_sha256"),
    )
