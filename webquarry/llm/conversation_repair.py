"""Repair of conversations' structure by a time-major tensor DP over their turns.

A conversation is legal when its roles are an optional system turn and then pairs of user and assistant. The
cheapest edits that make it so are found over four states (nothing yet, after system, after user, after
assistant): keep a turn, give it the role that is due, delete it, or insert an empty turn that is due.

1. Rows are gathered by conversation once, in Spark, and folded into chunks of bounded rows and bytes; a row's
   role and fault make one letter, so a chunk's letters need no text.
2. Letters alone go to the DP. Runs of at most SEGMENT turns, bucketed by length, form time-major tensors
   (turn, run, state). One vectorised step for each turn, from last to first, gives the cost of what follows for
   all runs and states; the costs are stored, and edits are traced forward, again one vectorised step for each
   turn. A conversation of several runs gets the costs at its borders from the runs' min-plus matrices, and the
   states from traces out of every state, so its runs are worked at once like those of others.
3. Edits meet the chunks of their conversation in order and texts stream by: no task holds a conversation's text.

Among cheapest edits the ASCII-least string of initials wins, letter by letter, which also fixes all roles.

What a conversation has as one value stays in one task: its letters and its edits (a byte a turn, as long as the
audit itself), and the running hash of its repaired text, which streams.

Defined results: a null role or text is one space, in the damage's key a null id or turn too; rows of one turn
go by role, then text, in code point order; null turns first; rows that repeat conversation, turn, role and text
count one by one (the later is a duplicate); null ids form one conversation; a role counts by its first
character, so an empty role is foreign; a very long conversation or text is repaired whole; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webquarry.llm.common import columns, cut

BLANKS = " \t\n\x0b\x0c\r"
#: Rows and bytes of a chunk of a conversation, turns of a run of the DP, letters that a task solves at once.
CHUNK_ROWS, CHUNK_BYTES, SEGMENT, HELD = 256, 256 << 10, 256, 1_000_000
#: A row's letter is A plus 4 times its role's place here (else 3) plus its fault's place.
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")

# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; DUE: the state after a user or assistant turn that is due
DUE = np.array([2, 2, 3, 2])
INSERT, RETAG, DELETE, FAR = 2, 2, 3, 1 << 28
#: Cost of ending in each state, by insertions.
END = np.array([0, 4, 2, 0], np.int32)
PAD = 16
#: KEEP[letter, state]: cost, and INTO: the state after; RETAGGED[letter]: cost.
KEEP, INTO, RETAGGED = np.full((17, 4), FAR, np.int32), np.zeros((17, 4), np.int64), np.full(17, FAR, np.int32)
for _role, _from in enumerate(((0,), (0, 1, 3), (2,), ())):
    for _fault, _more in ((0, 0), (3, 1)):
        KEEP[4 * _role + _fault, list(_from)] = _more
        INTO[4 * _role + _fault, :] = _role + 1 if _from else 0
        RETAGGED[4 * _role + _fault] = RETAG + _more


# ---------------------------------------------------------------- rows


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    c = columns(conversations, "conv_id", "turn", "role", "text")
    return c.select("conv_id", "turn", *[F.coalesce(x, F.lit(" ")).alias(x) for x in ("role", "text")])


def hazard() -> Column:
    """Which damage befalls a row, 0 to 19."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return F.crc32(key.cast("binary")) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """turns() with rows dropped, emptied, unpunctuated, repeated or turned to user's."""
    d = rows.withColumn("hazard", hazard()).where("hazard <> 0")
    text = F.when(F.col("hazard") == 1, "").when(F.col("hazard") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hazard") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("hazard") == 3, 2).otherwise(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def chunks(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, rows (n, role, text, letter): each conversation in order, by chunks. One shuffle, by conversation."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    later = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("n")) > 1
    fault = F.when(last == "", 1).when(F.col("later"), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    kind = F.when((F.col("role") == "") | (place < 0), 3).otherwise(place)
    numbered = rows.withColumn("n", F.row_number().over(own)).withColumn("bytes", F.sum(F.octet_length("text") + F.octet_length("role")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    seen = numbered.withColumn("later", later).withColumn("letter", F.char(65 + 4 * kind + fault))
    chunk = F.floor((F.col("n") - 1) / CHUNK_ROWS) + F.floor(F.col("bytes") / CHUNK_BYTES)
    return seen.withColumn("chunk", chunk).groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "letter"))).alias("rows"))


def gaps(rows: DataFrame) -> Column:
    return F.coalesce((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("bigint"), F.lit(0).cast("bigint"))


# ---------------------------------------------------------------- the DP


def _insertions(cost: np.ndarray) -> np.ndarray:
    """Costs when turns that are due may come in first: two at most help."""
    return np.minimum(cost, np.minimum(INSERT + cost[:, DUE], 2 * INSERT + cost[:, DUE[DUE]]))


def backward(letters: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(turns + 1, runs, 4): what all from each turn on costs, given the costs after the run. letters: (turns, runs)."""
    out = np.empty((len(letters) + 1, letters.shape[1], 4), np.int32)
    out[-1] = after
    for t in range(len(letters) - 1, -1, -1):
        c, then = letters[t], out[t + 1]
        kept = KEEP[c] + np.take_along_axis(then, INTO[c], 1)
        best = np.minimum(DELETE + then, np.minimum(kept, RETAGGED[c][:, None] + then[:, DUE]))
        out[t] = np.minimum(np.where((c == PAD)[:, None], then, _insertions(best)), FAR)
    return out


def forward(letters: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(turns, runs) of 3 * insertions before the turn + 0 delete, 1 keep, 2 retag; and the states at the end."""
    edits, state = np.zeros(letters.shape, np.uint8), state.copy()
    for t in range(len(letters)):
        c, now, then = letters[t], costs[t], costs[t + 1]
        deletes = now == DELETE + then
        inserts = ~deletes & (now == INSERT + now[:, DUE])
        keeps = now == KEEP[c] + np.take_along_axis(then, INTO[c], 1)
        pick = lambda table: np.take_along_axis(table, state[:, None], 1)[:, 0]  # noqa: E731, B023
        before = np.zeros(len(state), np.uint8)
        for _ in range(2):
            more = pick(inserts) & (c != PAD)
            before += more
            state = np.where(more, DUE[state], state)
        gone, kept = pick(deletes), pick(keeps)
        edits[t] = 3 * before + np.where(gone, 0, np.where(kept, 1, 2))
        state = np.where((c == PAD) | gone, state, np.where(kept, INTO[c, state], DUE[state]))
    return edits, state


def solve(letters: np.ndarray, sizes: np.ndarray, segment: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For conversations end to end: edits of each turn (as forward()), the state at each end, and each cost.

    sizes: turns of each conversation, 1 at least.
    """
    segment = segment or SEGMENT
    runs = -(-sizes // segment)
    owner = np.repeat(np.arange(len(sizes)), runs)
    first = np.cumsum(runs) - runs
    number = np.arange(len(owner)) - first[owner]
    start = (np.cumsum(sizes) - sizes)[owner] + number * segment
    size = np.minimum(segment, sizes[owner] - number * segment)
    final = number == runs[owner] - 1
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    after = np.repeat(END[None], len(owner), 0)
    tensors = {}
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        t = np.arange(int(size[at].max()))[:, None]
        tensors[b] = at, np.where(t < size[at], letters[np.minimum(start[at] + t, len(letters) - 1)], PAD)
    several = runs[owner] > 1
    if several.any():
        # min-plus matrices of runs, then the costs at borders from last to first
        matrix = np.full((len(owner), 4, 4), FAR, np.int32)
        for at, tensor in tensors.values():
            mine = several[at]
            for k in range(4):
                ends = np.full((int(mine.sum()), 4), FAR, np.int32)
                ends[:, k] = 0
                matrix[at[mine], :, k] = backward(tensor[:, mine], ends)[0]
        for back in range(1, int(runs.max())):
            here = first[runs > back] + runs[runs > back] - 1 - back
            after[here] = np.minimum((matrix[here + 1] + after[here + 1][:, None, :]).min(2), FAR)
    costs = {b: backward(tensor, after[at]) for b, (at, tensor) in tensors.items()}
    entry = np.zeros(len(owner), np.int64)
    if several.any():
        leaves = np.zeros((len(owner), 4), np.int64)
        for b, (at, tensor) in tensors.items():
            mine = several[at]
            for k in range(4):
                leaves[at[mine], k] = forward(tensor[:, mine], costs[b][:, mine], np.full(int(mine.sum()), k))[1]
        for n in range(1, int(runs.max())):
            here = first[runs > n] + n
            entry[here] = leaves[here - 1, entry[here - 1]]
    edits, ends, cost = np.zeros(len(letters), np.uint8), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, (at, tensor) in tensors.items():
        found, state = forward(tensor, costs[b], entry[at])
        real = tensor != PAD
        edits[(start[at] + np.arange(len(tensor))[:, None])[real]] = found[real]
        ends[owner[at[final[at]]]] = state[final[at]]
        opening = number[at] == 0
        cost[owner[at[opening]]] = costs[b][0, opening, 0]
    return edits, ends, cost


def initials(edits: np.ndarray) -> bytes:
    """Edits as letters: I for each insertion, then D, K or R."""
    upto = np.cumsum(edits // 3 + 1)
    out = np.full(int(upto[-1]) if len(upto) else 0, ord("I"), np.uint8)
    out[upto - 1] = np.frombuffer(b"DKR", np.uint8)[edits % 3]
    return out.tobytes()


def illegal_pairs(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Neighbours whose roles don't follow each other, for each conversation."""
    role, owner = letters // 4, np.repeat(np.arange(len(sizes)), sizes)
    a, b = role[:-1], role[1:]
    fine = ((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2))
    return np.bincount(owner[1:][~fine & (owner[1:] == owner[:-1])], minlength=len(sizes))


def _audits(kind: pa.DataType):
    """Letters of chunks, sorted by conversation and chunk, to the chunks' edits; a conversation's figures stand at its first chunk."""
    names = ["conv_id", "chunk", "audit", "cost", "illegal", *FAULTS[1:]]
    types = [kind, pa.int64(), pa.string(), *[pa.int64()] * 5]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (conversation's number, id, chunk, letters)
        size = number = 0

        def flush(part: list[tuple]) -> pa.RecordBatch:
            letters = np.frombuffer("".join(x[3] for x in part).encode(), np.uint8).astype(np.int64) - 65
            own = np.array([x[0] for x in part])
            opens = np.concatenate([[True], own[1:] != own[:-1]])
            each = np.array([len(x[3]) for x in part])
            sizes = np.add.reduceat(each, np.flatnonzero(opens))
            edits, ends, cost = solve(letters, sizes)
            closes = np.concatenate([opens[1:], [True]])
            owner = np.cumsum(opens) - 1
            upto = np.cumsum(each)
            faults = [np.bincount(np.repeat(np.arange(len(sizes)), sizes)[letters % 4 == f], minlength=len(sizes)) for f in (1, 2, 3)]
            figures = [cost, illegal_pairs(letters, sizes), *faults]
            audit = [initials(edits[upto[k] - each[k] : upto[k]]).decode() + "I" * int(closes[k] and END[ends[owner[k]]] // INSERT) for k in range(len(part))]
            cols = [[x[1] for x in part], [x[2] for x in part], audit, *[np.where(opens, f[owner], 0) for f in figures]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            for conv, chunk, letters in zip(*[b[c].to_pylist() for c in ("conv_id", "chunk", "letters")], strict=True):
                if held and held[-1][1] != conv:
                    number += 1
                    if size >= HELD:
                        yield flush(held)
                        held, size = [], 0
                held.append((number, conv, chunk, letters))
                size += len(letters)
        if held:
            yield flush(held)

    return run


# ---------------------------------------------------------------- edits meet texts


def _replayed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, figures or None, lines) for each chunk: (role, text, edit) of every turn that stands, in order. A chunk's edits come before its rows."""
    conv, state, audit, figures, fresh = None, 0, "", None, True
    for b in batches:
        for r in b.to_pylist():
            if r["rows"] is None:
                if r["chunk_first"]:
                    conv, state, fresh = r["conv_id"], 0, True
                audit, figures = r["audit"], r
                continue
            rows, lines = iter(r["rows"]), []
            for x in audit:
                if x == "I":
                    state = int(DUE[state])
                    lines.append((("user", "assistant")[state - 2], "", x))
                    continue
                row = next(rows)
                if x == "K":
                    state = INITIALS.index(row["role"][0]) + 1
                    lines.append((row["role"], row["text"], x))
                elif x == "R":
                    state = int(DUE[state])
                    lines.append((("user", "assistant")[state - 2], row["text"], x))
            yield conv, figures if fresh else None, audit, lines
            fresh = False


def _summaries(kind: pa.DataType):
    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    figures = names[1:6]
    types = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        now, digest, some = None, None, False

        def closed() -> list:
            return [now["conv_id"], *[now[f] for f in figures], "".join(now["parts"]), digest.hexdigest()]

        for conv, own, audit, lines in _replayed(batches):
            if own is not None:
                if now is not None:
                    done.append(closed())
                now, digest, some = {"conv_id": conv, "parts": []} | {f: own[f] for f in figures}, hashlib.sha256(), False
                if len(done) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                    done = []
            now["parts"].append(audit)
            if lines:
                digest.update((("\n" if some else "") + "\n".join(f"{role}:{text}" for role, text, _ in lines)).encode())
                some = True
        if now is not None:
            done.append(closed())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    return run


def _repaired(kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for conv, own, _, lines in _replayed(batches):
            at = 0 if own is not None else at
            cols = [[conv] * len(lines), range(at, at + len(lines)), *(zip(*lines, strict=True) if lines else ([], [], []))]
            at += len(lines)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (kind, pa.int64(), *[pa.string()] * 3), strict=True)], ["conv_id", "position", "role", "text", "edit"])

    return run


def _streamed(rows: DataFrame, task, schema: str) -> DataFrame:
    """rows (turns() or damaged()) by way of the DP to what task makes of chunks and their edits."""
    conv = dict(rows.dtypes)["conv_id"]
    kind = rows.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    table = cut(chunks(rows), "chunks")
    letters = table.select("conv_id", "chunk", F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("letters"))
    figures = ", ".join(f"{f} bigint" for f in ("cost", "illegal", *FAULTS[1:]))
    audits = letters.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_audits(kind), f"conv_id {conv}, chunk bigint, audit string, {figures}")
    audits = cut(audits, "audits")
    opening = F.row_number().over(Window.partitionBy("conv_id").orderBy("chunk")) == 1
    both = audits.withColumn("chunk_first", opening).unionByName(table, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", F.col("rows").isNotNull())
    return dealt.mapInArrow(task(kind), schema.format(conv=conv))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit (K, R or I) of the turns that stand after the cheapest repair."""
    return _streamed(turns(rows), _repaired, "conv_id {conv}, position bigint, role string, text string, edit string")


def audited(rows: DataFrame) -> DataFrame:
    """For each conversation that has rows: its faults, illegal neighbours, cost, edits and the repaired text's SHA-256."""
    return _streamed(turns(rows), _summaries, "conv_id {conv}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """audited() of damaged(), and gaps, for every conversation there was."""
    own = turns(conversations)
    left = damaged(own)
    every = own.select("conv_id", F.when(hazard() != 0, F.col("turn")).alias("turn")).groupBy("conv_id").agg(gaps(own).alias("gaps"))
    found = audited(left).withColumnRenamed("conv_id", "found_id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    joined = every.join(found, every["conv_id"].eqNullSafe(found["found_id"]), "left")
    return joined.select("conv_id", "gaps", *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
