"""Chat formatting: transcripts parsed by a hidden Markov model and rendered as canonical turns.

A transcript is a text whose turns may begin with speaker markers of any style. Its lines
are the observations of a hidden Markov model with six states, the start and the
continuation of a turn of each role. A line is seen as a few features (the kind of
speaker marker, a blank line before it, how it ends, its length, list or code marks),
independent given the state. The model is fitted by counting on a bounded sample of labelled
transcripts; Viterbi's algorithm recovers the most probable states in numpy; each start
state opens a turn, whose marker is cut off.

Defined results: null text counts as empty, and an empty transcript has no turns; blank lines
belong to the turn they stand in, outer ones are dropped; a marker that is a role name
unknown to the model counts as a marker without a role; equal paths take the first state;
"<|" in contents is rendered as "< |", so that contents cannot forge turns; transcripts
of a table are assembled in segments of at most ``segment_turns`` turns.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lattiq.llm.arrow import map_batches

ROLES = ("system", "user", "assistant")
#: Fixed vocabulary of speaker names by role.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "you", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "gpt"),
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_MARKER = re.compile(r"^\s{0,3}(?:#{1,4}\s*|\*\*|\[|<\|?|>\s*)?([A-Za-z][A-Za-z_]{0,15})\s*(?:\d{0,3})(?:\*\*|\]|\|?>)?\s*(:|\]|\|>|>|-\s|$)(?:\*\*)?\s*")
#: How the transcripts of a table are written; None leaves the turn unmarked after a blank line.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions:\n", "user": "### Human:\n", "assistant": "### Assistant:\n"},
    {"system": "[context] ", "user": "Q: ", "assistant": "A: "},
    {"system": "**System:** ", "user": "**Customer:** ", "assistant": "**Agent:** "},
    {"system": "System: ", "user": "Human: ", "assistant": None},
)
_SIZES = (6, 2, 3, 4, 2)  # values of each feature
_START, _CONTINUE = 0, 1


def marker(line: str) -> tuple[int, int]:
    """(kind, length) of a line's speaker marker: 0 none, 1 unknown speaker, 2.. a role."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    role = _ROLE_OF.get(m[1].lower())
    plain = line[: m.start(1)].strip() == ""
    if m[2] == "" and (role is None or plain):
        return 0, 0  # a lone word is no marker, unless set apart
    if role is None:
        return (1, m.end()) if m[2] == ":" and not plain else (0, 0)
    return 2 + ROLES.index(role), m.end()


def features(lines: list[str]) -> np.ndarray:
    """One row of feature values for each line that is not blank."""
    out, blank = [], 1
    for line in lines:
        text = line.strip()
        if not text:
            blank = 1
            continue
        kind, size = marker(line)
        rest = line[size:].strip()
        end = 1 if rest.endswith("?") else 2 if rest.endswith((".", "!", ":")) else 0
        length = int(np.searchsorted((1, 40, 160), len(rest), side="right"))
        listed = int(bool(re.match(r"\s*(?:[-*•]|\d+[.)]|```|\||    )", line)))
        out.append((kind, blank, end, length, listed))
        blank = 0
    return np.array(out, np.int64).reshape(-1, len(_SIZES))


@dataclass(frozen=True)
class ChatModel:
    start: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, ...]  # per feature: (states, values)

    def decode(self, seen: np.ndarray) -> np.ndarray:
        """Viterbi: the most probable states, 2 x role + (start, continue)."""
        n = len(seen)
        if not n:
            return np.empty(0, np.int64)
        score = sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T
        best, back = self.start + score[0], np.zeros((n, len(self.start)), np.int64)
        for t in range(1, n):
            way = best[:, None] + self.step
            back[t] = way.argmax(0)
            best = way.max(0) + score[t]
        path = np.empty(n, np.int64)
        path[-1] = int(best.argmax())
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def fit(labelled: list[tuple[list[str], list[int]]]) -> ChatModel:
    """Count states of the lines that are not blank.

    The feature shares of a state are mixed with those of all states, little for markers and
    more for the others, so that a rare state does not gain from its thin counts.
    """
    k = 2 * len(ROLES)
    start, step = np.full(k, 0.1), np.full((k, k), 0.05)
    start[_CONTINUE::2] = 1e-6  # a transcript begins with a turn,
    emit = [np.full((k, v), 1e-3) for v in _SIZES]
    for role in range(len(ROLES)):  # and a turn goes on in its own role
        step[2 * role : 2 * role + 2, _CONTINUE::2] = 1e-6
        step[2 * role : 2 * role + 2, 2 * role + _CONTINUE] = 0.5
    for lines, states in labelled:
        seen = features(lines)
        if not len(seen):
            continue
        start[states[0]] += 1
        np.add.at(step, (states[:-1], states[1:]), 1)
        for f, e in enumerate(emit):
            np.add.at(e, (states, seen[:, f]), 1)
    mixed = []
    for f, e in enumerate(emit):
        own, pooled, share = e / e.sum(1, keepdims=True), (e.sum(0) + 0.5) / (e.sum() + 0.5 * e.shape[1]), 0.01 if f == 0 else 0.3
        mixed.append(np.log((1 - share) * own + share * pooled))
    return ChatModel(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), tuple(mixed))


def parse(text: str | None, model: ChatModel) -> list[tuple[str, str]]:
    """(role, content) of the turns of a transcript."""
    lines = (text or "").split("\n")
    states = iter(model.decode(features(lines)).tolist())
    turns: list[tuple[str, list[str]]] = []
    for line in lines:
        if not line.strip():
            if turns:
                turns[-1][1].append("")
            continue
        role, kind = divmod(next(states), 2)
        if kind == _START or not turns:
            turns.append((ROLES[role], [line[marker(line)[1] :]]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(body).strip()) for role, body in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form: a role line, the content, an end mark."""
    return "".join(f"<|{role}|>\n{content.replace('<|', '< |')}\n<|end|>\n" for role, content in turns)


def transcripts(conversations: DataFrame, segment_turns: int = 256) -> DataFrame:
    """conv_id, segment, style, transcript, and the turns it was written from."""
    rows = conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(0)).alias("segment"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def write(rows: dict) -> dict:
        style, text = [], []
        for conv, turns in zip(rows["conv_id"], rows["turns"], strict=True):
            s = int.from_bytes(hashlib.blake2b(str(conv).encode(), digest_size=2).digest(), "big") % len(STYLES)
            style.append(s)
            text.append("\n\n".join((STYLES[s].get(t["role"]) or "") + t["text"] for t in turns))
        return {**{k: rows[k] for k in ("conv_id", "segment", "turns")}, "style": style, "transcript": text}

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return map_batches(grouped, write, f"conv_id {kind}, segment long, turns array<struct<turn:long,role:string,text:string>>, style int, transcript string")


def labelled_lines(turns: list[dict], style: int) -> tuple[list[str], list[int]]:
    """Lines of a written transcript, and the states of those that are not blank."""
    lines, states = [], []
    for t in turns:
        if t["role"] not in ROLES:
            return [], []
        first = True
        for line in ((STYLES[style][t["role"]] or "") + t["text"]).split("\n"):
            lines.append(line)
            if line.strip():
                states.append(2 * ROLES.index(t["role"]) + (_START if first else _CONTINUE))
                first = False
        lines.append("")
    return lines, states


def fit_on(written: DataFrame, max_transcripts: int = 1000) -> ChatModel:
    """Fit on at most *max_transcripts* transcripts, those with the least hashes of the id."""
    sample = written.select("turns", "style", F.xxhash64("conv_id", "segment").alias("h")).orderBy("h").limit(max_transcripts)
    return fit([labelled_lines([t.asDict() for t in r.turns], r.style) for r in sample.collect()])


def format_transcripts(written: DataFrame, model: ChatModel, text_col: str = "transcript") -> DataFrame:
    """All columns of *written*, with parsed (array of role, content) and rendered."""
    shared = written.sparkSession.sparkContext.broadcast(model)
    names = written.columns

    def apply(rows: dict) -> dict:
        parsed = [parse(t, shared.value) for t in rows[text_col]]
        return {**{c: rows[c] for c in names}, "parsed": [[{"role": r, "content": c} for r, c in p] for p in parsed], "rendered": [render(p) for p in parsed]}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in written.schema)
    return map_batches(written, apply, f"{fields}, parsed array<struct<role:string,content:string>>, rendered string")
