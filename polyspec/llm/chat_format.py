"""Chat formatting with minimum-cost role repair (operator 1).

A legal chat is a path of a small automaton over roles: it begins with system or user, system leads to user, user to
assistant, assistant to user or tool, tool to assistant, and it ends with assistant. For each message, dynamic
programming chooses to keep it, to merge it into the turn before, to relabel it, or to insert empty turns in front,
at the least total cost. The repaired sequence is rendered as one piece a message; the pieces of a conversation, in
order of ``seq``, are its text.

A step is a matrix of (min, +) costs between automaton states, and such matrices multiply. Messages are range-sorted by
conversation and turn, which also splits a conversation of any length over tasks; each task cuts its rows into chunks
of at most ``CHUNK`` messages. A conversation in one chunk is repaired there. Of the others only the chunks' matrices
(a few numbers for up to ``CHUNK`` messages) meet, to give each chunk the costs at its start and its state at its end.

Defined cases: null text: empty; null or unknown role: must be relabelled; null conv_id: one conversation; null turn:
first; equal turns are ordered by role and text; repeated rows are messages of their own; an empty table gives no
rows; texts of any length work; extra columns are not carried, and never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm.common import materialize, read, small_batches

ROLES = ("system", "user", "assistant", "tool")
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
END = "assistant"
MERGE, RELABEL, INSERT = 1, 2, 3
CHUNK, CHUNK_CHARS = 1024, 8 << 20
START, FAR = len(ROLES), 1 << 40
N = len(ROLES) + 1


STATES = (*ROLES, "")


def chain(start: str, wanted: str | None) -> tuple[str, ...] | None:
    """The fewest roles that lead from ``start`` to where ``wanted`` may come (wanted None: the end), if any do."""
    paths = [()]
    for _ in STATES:
        for path in paths:
            last = path[-1] if path else start
            if (wanted in NEXT[last]) if wanted else last == END:
                return path
        paths = [(*p, r) for p in paths for r in NEXT[p[-1] if p else start]]
    return None


CHAINS = {(s, r): chain(s, r) for s in STATES for r in (*ROLES, None)}
FINAL = [INSERT * len(CHAINS[s, None]) for s in ROLES] + [0]


def steps(role: str | None) -> tuple[np.ndarray, dict]:
    """Costs from state to state for a message of this role, and the action of each: (merged, roles inserted)."""
    cost, act = np.full((N, N), FAR, np.int64), {}
    for s, state in enumerate(STATES):
        for t, new in enumerate(ROLES):
            relabel = RELABEL * (new != role)
            inserted = CHAINS[state, new]
            if inserted is not None:
                cost[s, t], act[s, t] = relabel + INSERT * len(inserted), (False, inserted)
            if s == t and MERGE + relabel <= cost[s, t]:
                cost[s, t], act[s, t] = MERGE + relabel, (True, ())
    return cost, act


STEPS = {r: steps(r) for r in (*ROLES, None)}


def known(role) -> str | None:
    role = role.strip().lower() if isinstance(role, str) else None
    return role if role in ROLES else None


def times(f: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(min, +) product of rows of costs and a matrix."""
    return np.minimum((f[..., :, None] + m).min(-2), FAR)


def forward(roles: list[str | None], entry: np.ndarray) -> list[np.ndarray]:
    out = [entry]
    for r in roles:
        out.append(times(out[-1], STEPS[r][0]))
    return out


def backward(roles: list[str | None], costs: list[np.ndarray], end: int) -> list[int]:
    """States before each message and after the last; on equal cost the first state."""
    path = [end]
    for r, f in zip(reversed(roles), reversed(costs[:-1]), strict=True):
        path.append(int((f + STEPS[r][0][:, path[-1]]).argmin()))
    return path[::-1]


def final_state(costs: np.ndarray) -> int:
    return int((costs + np.array(FINAL)).argmin())


def escaped(text) -> str:
    """Text that can't be taken for a mark."""
    return (text or "").replace("<|", "< |")


COLUMNS = ("conv_id", "seq", "turn", "role", "new_role", "action", "inserted", "cost", "rendered")


def render(out: list[tuple], conv, seq: int, turns, roles, texts, path: list[int], last: bool) -> None:
    for i, (turn, role, text) in enumerate(zip(turns, roles, texts, strict=True)):
        s, t, r = path[i], path[i + 1], known(role)
        cost, (merged, inserted) = int(STEPS[r][0][s, t]), STEPS[r][1][s, t]
        piece = f"\n\n{escaped(text)}" if merged else "<|end|>\n" * (s != START) + "".join(f"<|start|>{x}\n<|end|>\n" for x in inserted) + f"<|start|>{ROLES[t]}\n{escaped(text)}"
        after = CHAINS[ROLES[t], None] if last and i == len(roles) - 1 else ()
        if last and i == len(roles) - 1:
            piece += "<|end|>\n" + "".join(f"<|start|>{x}\n<|end|>\n" for x in after)
            cost += FINAL[t]
        action = ("merge" if merged else "keep") if ROLES[t] == r else ("relabel_merge" if merged else "relabel")
        out.append((conv, seq + i, turn, role, ROLES[t], action, ",".join((*inserted, *after)), cost, piece))


RESULT = "conv_id long, seq long, turn long, role string, new_role string, action string, inserted string, cost long, rendered string"
CHUNK_SCHEMA = "conv long, part int, no int, closed boolean, turns array<long>, roles array<string>, texts array<string>, m array<long>"


def in_chunks(batches: Iterator[pd.DataFrame], size: int = CHUNK) -> Iterator[pd.DataFrame]:
    """Rows of one task as chunks. A chunk is closed if it surely holds its whole conversation."""
    part, no = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    conv, begun, chars = None, None, 0  # begun: None before the first row, then the chunks that this conversation has before

    def chunk(last: bool, first_conv: bool) -> tuple:
        turns, roles, texts = ([r[k] for r in rows] for k in range(3))
        whole = begun == 0 and not last and not first_conv
        m = [] if whole else forward([known(r) for r in roles], np.where(np.eye(N, dtype=bool), 0, FAR))[-1].ravel().tolist()
        return conv, part, no, whole, turns, roles, texts, m

    first = True
    for pdf in batches:
        done = []
        conv_ids = [None if pd.isna(c) else int(c) for c in pdf["conv"]]
        for c, turn, role, text in zip(conv_ids, pdf["turn"], pdf["role"], pdf["text"], strict=True):
            if begun is not None and c != conv:
                done.append(chunk(False, first))
                no, rows, begun, chars, first = no + 1, [], 0, 0, False
            elif len(rows) >= size or chars >= CHUNK_CHARS:
                done.append(chunk(True, first))
                no, rows, begun, chars = no + 1, [], (begun or 0) + 1, 0
            begun, conv = begun or 0, c
            rows.append((None if pd.isna(turn) else int(turn), role, text))
            chars += len(text or "")
        if done:
            yield pd.DataFrame(done, columns=["conv", "part", "no", "closed", "turns", "roles", "texts", "m"]).astype({"conv": "Int64"})
    if rows:
        yield pd.DataFrame([chunk(True, first)], columns=["conv", "part", "no", "closed", "turns", "roles", "texts", "m"]).astype({"conv": "Int64"})


def emit(pdfs: Iterator[pd.DataFrame], path_of) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        out: list[tuple] = []
        for row in pdf.itertuples(index=False):
            roles = [known(r) for r in row.roles]
            seq, last, path = path_of(row, roles)
            render(out, None if pd.isna(row.conv) else int(row.conv), seq, row.turns, row.roles, row.texts, path, last)
        yield pd.DataFrame(out, columns=COLUMNS).astype({"conv_id": "Int64", "turn": "Int64"})


@lru_cache(10_000)
def best_path(roles: tuple) -> list[int]:
    costs = forward(roles, np.where(np.arange(N) == START, 0, FAR))
    return backward(roles, costs, final_state(costs[-1]))


def whole_path(row, roles: list) -> tuple[int, bool, list[int]]:
    """Short conversations share few sequences of roles; their paths are kept."""
    path = best_path(tuple(roles)) if len(roles) <= 64 else best_path.__wrapped__(tuple(roles))
    return 0, True, path


def part_path(row, roles: list) -> tuple[int, bool, list[int]]:
    return int(row.seq), bool(row.last), backward(roles, forward(roles, np.array(row.entry)), int(row.end))


def entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs at the start of each chunk of a conversation, messages before it, and whether it is the last."""
    pdf = pdf.sort_values(["part", "no"])
    f, rows = np.where(np.arange(N) == START, 0, FAR), []
    for m in pdf["m"]:
        rows.append(f.tolist())
        f = times(f, np.asarray(m).reshape(N, N))
    out = pdf.drop(columns=["m", "size"]).assign(entry=rows, seq=np.cumsum(pdf["size"]) - pdf["size"], last=np.arange(len(pdf)) == len(pdf) - 1, end=final_state(f))
    return out.astype({"conv": "Int64"})


def ways_back(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each state at the end of a chunk, the state at its start."""
    for pdf in pdfs:
        back = []
        for row in pdf.itertuples(index=False):
            roles = [known(r) for r in row.roles]
            costs = forward(roles, np.array(row.entry))
            back.append([backward(roles, costs, t)[0] for t in range(N)])
        yield pdf[["conv", "part", "no", "end"]].assign(back=back).astype({"conv": "Int64"})


def ends(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["part", "no"])
    state, out = int(pdf["end"].iloc[-1]), []
    for back in reversed(pdf["back"].tolist()):
        out.append(state)
        state = int(back[state])
    return pdf.drop(columns=["back", "end"]).assign(end=out[::-1]).astype({"conv": "Int64"})


def repair(df: DataFrame, partitions: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """A row per message: conv_id, seq (from 0), turn, role, new_role, action (keep, merge, relabel, relabel_merge),
    inserted (roles of the empty turns before it and, for the last, after it), cost, rendered."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("role", "text"), "copy": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role", "tie", "copy"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    with small_batches(spark):
        chunks = materialize(dealt.mapInPandas(lambda b: in_chunks(b, chunk), CHUNK_SCHEMA), "chunks")
    done = chunks.where("closed").mapInPandas(lambda p: emit(p, whole_path), RESULT)
    open_ = chunks.where("NOT closed")
    sums = open_.select("conv", "part", "no", "m", F.size("roles").alias("size"))
    starts = materialize(sums.groupBy("conv").applyInPandas(entries, "conv long, part int, no int, entry array<long>, seq long, last boolean, end int"), "starts")
    with_start = open_.select("part", "no", "roles").join(starts, ["part", "no"])
    back = with_start.select("conv", "part", "no", "roles", "entry", "end").mapInPandas(ways_back, "conv long, part int, no int, end int, back array<int>")
    ended = materialize(back.groupBy("conv").applyInPandas(ends, "conv long, part int, no int, end int").select("part", "no", "end"), "ends")
    rest = open_.join(starts.select("part", "no", "entry", "seq", "last"), ["part", "no"]).join(ended, ["part", "no"])
    return done.unionByName(rest.mapInPandas(lambda p: emit(p, part_path), RESULT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"))
