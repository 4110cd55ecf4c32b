"""Chat formatting with budgeted windows.

The turns of a conversation stand in line, each as long as its tokens, and prefix sums of the tokens give every turn its
place. A window is a span of whole turns. It repeats the conversation's first turn if it is the system's, and as history
the turns that start within `history` tokens before it; then it takes as many turns of its own as fit. Template and
repeated turns count, so a window holds `budget` tokens at most, unless the system turn and one turn alone exceed them:
history gives way first, and a window always has one turn of its own. What is repeated is context: in later windows
nothing of it is under the loss mask, so each assistant text is learnt once.

Prefix sums have two levels (runs of RUN turns, then the turns of a run), so a conversation with a third of all rows is
spread over many tasks. Its line is cut into stretches of STRETCH budgets; a turn belongs to the stretch that it starts
in, and is handed to the next one too if it may be history there. Windows are packed within a stretch, one task reading
its turns in order, so what a task holds is bounded by the stretch and its last turn.

Template: a turn is `### `, the role, `: `, the text, ` </turn>` and a line feed. Inside texts and roles, backslashes are
doubled, and a `#` or `<` that begins `###` or `</turn>` gets a backslash before it; roles lose colons and line feeds in
the same way. So no text can look like the end of a turn, and the output is read back without loss.

Defined results: null texts and roles count as empty ones; turns are ordered by turn (null first), role and text; equal
rows are turns of their own; rows with a null conversation form one conversation; other columns never matter;
an empty table gives an empty result; texts of any length go through whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

BUDGET, HISTORY = 1024, 256
#: Budgets of a stretch.
STRETCH = 64
#: Turns whose tokens are summed together before the sums are.
RUN = 64
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
LEARNT = "assistant"


def tokens(text: Column) -> Column:
    """An estimate that needs no vocabulary: words, and a token for each six further characters of long ones."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{1,6}")) + 4


def escape(text: str) -> str:
    return re.sub(r"\\|#(?=##)|<(?=/turn>)", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """Roles have no colon or line feed left."""
    return escape(role).replace(":", "\\c").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"c": ":", "n": "\n"}.get(m[1], m[1]), role, flags=re.S)


def write(turns: list[tuple[str, str, bool]]) -> tuple[str, list[int]]:
    """turns: (role, text, repeated). (formatted text, flat list of the [start, end) code points under the loss mask)."""
    out, mask, at = [], [], 0
    for role, text, repeated in turns:
        head, body = OPEN + escape_role(role) + MIDDLE, escape(text)
        if role == LEARNT and not repeated:
            mask += (at + len(head), at + len(head) + len(body))
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), mask


def read(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    out, at = [], 0
    while at < len(formatted):
        colon = formatted.index(MIDDLE, at)
        end = formatted.index(CLOSE, colon + len(MIDDLE))  # texts hold none, theirs are escaped
        out.append((unescape_role(formatted[at + len(OPEN) : colon]), unescape(formatted[colon + len(MIDDLE) : end])))
        at = end + len(CLOSE)
    return out


def lined(turns: DataFrame) -> DataFrame:
    """Per turn: conv, seq (its place in the conversation), start (tokens before it), cost, role, text."""
    clean = turns.select(
        F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("cost", tokens(F.col("text")).cast("long"))
    # two levels: runs of turns by their number, then the turns of a run; turns without a number come first
    clean = clean.withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-1 << 62)))
    runs = clean.groupBy("conv", "run").agg(F.sum("cost").alias("run_cost"), F.count(F.lit(1)).alias("run_turns"))
    before = W.partitionBy("conv").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        F.col("conv").alias("r_conv"), F.col("run").alias("r_run"),
        F.coalesce(F.sum("run_cost").over(before), F.lit(0)).alias("cost_before"), F.coalesce(F.sum("run_turns").over(before), F.lit(0)).alias("turns_before"),
    )
    inside = W.partitionBy("conv", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    line = clean.withColumn("nth", F.row_number().over(inside)).withColumn("end_in", F.sum("cost").over(upto))
    line = line.join(runs, line["conv"].eqNullSafe(runs["r_conv"]) & (line["run"] == runs["r_run"]))
    return line.select(
        "conv", (F.col("turns_before") + F.col("nth") - 1).alias("seq"), (F.col("cost_before") + F.col("end_in") - F.col("cost")).alias("start"), "cost", "role", "text"
    )


def pack(starts: list[int], costs: list[int], first: int, head: int, *, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """Windows as (first turn of history, first own turn, end), over the turns of a stretch; own turns begin at `first`.

    starts: tokens before each turn. head: tokens of the system turn, which doesn't repeat in a window that holds it.
    """
    at, n = first, len(starts)
    while at < n:
        room = budget - head
        past = bisect_left(starts, starts[at] - history, 0, at)
        # history gives way to the first own turn
        past = bisect_left(starts, starts[at] + costs[at] - room, past, at)
        end = at + 1
        while end < n and starts[end] + costs[end] - starts[past] <= room:
            end += 1
        yield past, at, end
        at = end


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """turns: conv_id, turn, role, text. A row for each window: conv_id, win (its first own turn), formatted, mask (flat code points), context (turns that are repeated), n_tokens."""
    home, stretch = common.shared_dir(turns.sparkSession), STRETCH * budget
    line = common.keep(lined(turns), f"{home}/line")
    heads = line.filter("seq = 0 AND role = 'system'").select(F.col("conv").alias("h_conv"), F.struct("cost", "role", "text").alias("head"))
    own, reach = F.floor(F.col("start") / stretch), F.floor((F.col("start") + history) / stretch)
    dealt = line.withColumn("own", own).withColumn("stretch", F.explode(F.sequence("own", reach)))
    turn = F.struct("seq", "start", "cost", "role", "text", (F.col("stretch") > F.col("own")).alias("past"))
    gathered = dealt.groupBy("conv", "stretch").agg(F.sort_array(F.collect_list(turn)).alias("turns")).filter(F.exists("turns", lambda t: ~t["past"]))
    # a conversation has one head at most, and a table stands between, so Spark can split a long conversation's stretches
    gathered = common.keep(gathered, f"{home}/stretches")
    gathered = gathered.join(heads, gathered["conv"].eqNullSafe(heads["h_conv"]), "left").select("conv", "turns", "head")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        for batch in batches:
            for i in range(batch.num_rows):
                held, head, made = batch.column("turns")[i].as_py(), batch.column("head")[i].as_py(), []
                starts, costs = [t["start"] for t in held], [t["cost"] for t in held]
                first = sum(t["past"] for t in held)
                # the stretch that the system turn starts in has it in the line; later windows repeat it
                lead = 1 if head and held[0]["seq"] == 0 else 0
                spans = [*pack(starts, costs, first, 0, budget=budget, history=history)][:1] if lead and not first else []
                rest = spans[0][2] if spans else first
                for past, at, end in [*spans, *pack(starts, costs, rest, head["cost"] if head else 0, budget=budget, history=history)]:
                    past = max(past, lead) if at else past
                    repeated = [(t["role"], t["text"], True) for t in held[past:at]]
                    if head and held[at]["seq"]:
                        repeated = [(head["role"], head["text"], True), *repeated]
                    text, mask = write([*repeated, *((t["role"], t["text"], False) for t in held[at:end])])
                    total = sum(costs[past:end]) + (head["cost"] if head and held[at]["seq"] else 0)
                    made.append((held[at]["seq"], text, mask, len(repeated), total))
                columns = [pa.array([m[k] for m in made], t) for k, t in enumerate(shape)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("conv")[i].as_py()] * len(made), batch.column("conv").type), *columns], ["conv_id", "win", "formatted", "mask", "context", "n_tokens"])

    kind = gathered.schema["conv"].dataType.simpleString()
    return gathered.mapInArrow(work, f"conv_id {kind}, win long, formatted string, mask array<bigint>, context bigint, n_tokens bigint")


def digests(made: DataFrame) -> DataFrame:
    """What the windows hold, read back from them, per conversation: windows stream in order, one at a time."""
    kind = made.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, last, state = None, None, None

        def close() -> pa.RecordBatch:
            n, turns, chars, loss, total = state
            values = [last[0], n, turns.hexdigest(), chars, loss.hexdigest(), total]
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            key_type = batch.column("conv_id").type
            for conv, text, mask, context in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask", "context")), strict=True):
                if last is None or last[0] != conv:
                    if state:
                        yield close()
                    last, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read(text)[context:]
                state[0] += len(turns)
                for role, said in turns:
                    state[1].update(f"{role}\n{said}\n".encode())
                for s, e in zip(mask[::2], mask[1::2], strict=True):
                    learnt = unescape(text[s:e])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
        if state:
            yield close()

    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "win")
    return ordered.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
