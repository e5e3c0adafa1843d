"""Repair of conversation structure by rank-convergence parallel Viterbi.

A repaired conversation's role initials are `(s?(ua)+)?`. The cheapest edits to get there are a
shortest path over four states (0 nothing yet, 1 after system, 2 after user, 3 after assistant)
whose steps are the rows of the conversation, so backward costs are vectors of four numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize, stored
from docmill.sources.shared import new_folder

SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 40
DELETE, INSERT, KEEP, REROLE = b"DIKR"
#: Rows of a chunk, within which costs are worked out one after the other.
CHUNK = 4
#: Where a user's or an assistant's turn leads from each state.
TURN = np.array([2, 2, 3, 2])
#: Costs left after the last row, insertions included, and how many insertions that takes.
END = np.array([0, 10, 5, 0])
END_INSERTS = np.array([0, 2, 1, 0])


def _keeps() -> np.ndarray:
    """Where keeping a row leads, by its initial (0 system, 1 user, 2 assistant, 3 other) and state; -1 is nowhere."""
    return np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])


def _steps() -> np.ndarray:
    """Costs of a row from state to state, insertions before it included. Row codes are initial + 4 * truncated, 8 for rows that must go."""
    out = np.full((9, 4, 4), FAR)
    for code in range(9):
        for s in range(4):
            out[code, s, s] = 2
            if code < 8:
                extra, kept = 5 * (code // 4), _keeps()[code % 4, s]
                out[code, s, TURN[s]] = min(out[code, s, TURN[s]], 1 + extra)
                if kept >= 0:
                    out[code, s, kept] = min(out[code, s, kept], extra)
    for _ in range(2):  # an insertion costs 5 and leads to a turn's state; more than two are never cheapest
        for s in range(4):
            out[:, s] = np.minimum(out[:, s], out[:, TURN[s]] + 5)
    return out


STEPS = _steps()


def parallel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether vectors differ only by constants."""
    gap = a - b
    return (gap == gap[:, :1]).all(axis=1)


def backward_costs(codes: np.ndarray, ends: np.ndarray, last: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, int]:
    """Costs from each row on, for each state, of many pieces of rows at once.

    codes: of all rows; ends: for each piece the place after its last row, ascending; last: for each piece the cost
    vector after its last row. Returns the vector at each row, the one after each row, and the number of passes.

    All chunks of all pieces start together, from speculative vectors (that of a conversation's
    end) but for each piece's last chunk, and step backward side by side. A fix-up pass reruns
    the chunks whose end vector turned out not to be parallel to the one they started from; a
    chunk's rerun stops at the first row where its vector is parallel to what stands there, as
    all before it then differ by a constant too. Passes end when no chunk is left. Constants are
    added up from the back at the end.
    """
    n = len(codes)
    here, after = np.zeros((n, 4), np.int64), np.zeros((n, 4), np.int64)
    if not n:
        return here, after, 0
    begins = np.concatenate([[0], ends[:-1]])
    lengths = ends - begins
    each = -(-lengths // chunk)
    piece = np.repeat(np.arange(len(ends)), each)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(each) - each, each)
    first = begins[piece] + within * chunk
    beyond = np.minimum(first + chunk, ends[piece])
    is_last = within == each[piece] - 1
    start = np.where(is_last[:, None], last[piece], END)  # the vector that a chunk goes back from
    todo, passes = np.arange(len(piece)), 0
    while len(todo):
        vector, alive = start[todo], todo
        for back in range(chunk):
            at = beyond[alive] - 1 - back
            inside = at >= first[alive]
            alive, vector, at = alive[inside], vector[inside], at[inside]
            if not len(alive):
                break
            after[at] = vector
            vector = (STEPS[codes[at]] + vector[:, None, :]).min(axis=2)
            if passes:
                met = parallel(vector, here[at])
                shift = vector[:, 0] - here[at, 0]
                for c, place, by in zip(alive[met], at[met], shift[met], strict=True):
                    here[first[c] : place + 1] += by
                    after[first[c] : place] += by
                here[at[~met]] = vector[~met]
                alive, vector = alive[~met], vector[~met]
            else:
                here[at] = vector
        passes += 1
        inner = np.flatnonzero(~is_last)
        true = here[beyond[inner]]
        wrong = ~parallel(true, start[inner])
        todo = inner[wrong]
        start[todo] = true[wrong]
    # Each inner chunk lies below the true costs by a constant of its own and those of all after it.
    gap = np.zeros(len(piece), np.int64)
    inner = np.flatnonzero(~is_last)
    gap[inner] = here[beyond[inner], 0] - start[inner, 0]
    total = gap[::-1].cumsum()[::-1]
    past = np.append(total, 0)[np.cumsum(each)]
    shift = np.repeat(total - past[piece], beyond - first)[:, None]
    return here + shift, after + shift, passes


def decisions(codes: np.ndarray, here: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row and state the insertions before it, its letter and the state after it, along the least audit of all cheapest ones."""
    n = len(codes)
    free, extra = codes < 8, np.where(codes < 8, 5 * (codes // 4), 0)
    inserts, letter, then = (np.zeros((n, 4), np.int64) for _ in range(3))
    kept = np.vstack([np.repeat(_keeps()[None], 2, axis=0).reshape(8, 4), np.full((1, 4), -1)])[codes]
    for s in range(4):
        state, open_ = np.full(n, s), np.ones(n, bool)
        for _ in range(3):
            rows, now = np.arange(n), here[np.arange(n), state]
            goes = after[rows, state] + 2 == now
            adds = here[rows, TURN[state]] + 5 == now
            to = kept[rows, state]
            keeps = free & (to >= 0) & (after[rows, np.maximum(to, 0)] + extra == now)
            # D < I < K < R
            pick = np.where(goes, DELETE, np.where(adds, INSERT, np.where(keeps, KEEP, REROLE)))
            ends = open_ & (pick != INSERT)
            letter[ends, s] = pick[ends]
            then[ends, s] = np.where(pick == DELETE, state, np.where(pick == KEEP, to, TURN[state]))[ends]
            more = open_ & (pick == INSERT)
            inserts[more, s] += 1
            state = np.where(more, TURN[state], state)
            open_ = more
    return inserts, letter, then


def states_before(then: np.ndarray, begins: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """The state before each row: maps of states are composed by doubling, from each piece's first row on."""
    n = len(then)
    if not n:
        return np.zeros(0, np.int64)
    maps, heads = then.astype(np.int8), begins[begins < n]
    maps[heads] = then[heads, initial[begins < n]][:, None]  # a constant: nothing before it matters
    step = 1
    while step < n:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    out = np.empty(n, np.int64)
    out[1:] = maps[:-1, 0]
    out[heads] = initial[begins < n]
    return out


def whole_map(then: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each piece, where each state before its first row leads after its last one."""
    return np.stack([then[ends - 1, states_before(then, begins, np.full(len(begins), s))[ends - 1]] for s in range(4)], axis=1)


# --- Damage, order and faults --------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with the damage that crc32(`conv_id:turn`) % 20 says: 0 drops the row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it the user's. Nulls of role and text, and in the key, are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.where("kind != 0").select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def ordered(rows: DataFrame, pieces: int) -> DataFrame:
    """Rows with `part` and `pos`: conversations by turn (nulls first), then role and text, cut into ranges, and the place in a range."""
    even = F.xxhash64(F.monotonically_increasing_id())  # equal rows are alike, whatever their order; this lets a range end among them
    sort = ["conv_id", "turn", "role", "text", "even"]
    ranged = rows.withColumn("even", even).repartitionByRange(pieces, *sort).sortWithinPartitions(*sort)
    return ranged.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos"))


def with_faults(turns: DataFrame) -> DataFrame:
    """turns (with part, pos), without texts: conv_id, part, pos, turn, initial, fault (blank, duplicate, truncated or null) and code."""
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = turns.select(
        "conv_id", "part", "pos", "turn", "role", F.sha2("text", 256).alias("same"), F.substring("role", 1, 1).alias("initial"), (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    place = F.struct("part", "pos")
    firsts = rows.groupBy("conv_id", "role", "same").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("role").alias("of_role"), F.col("same").alias("of_same"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("of_role")) & (F.col("same") == F.col("of_same"))
    later = F.col("first").isNotNull() & (F.col("first") != place)
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated")
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.when(F.col("fault").isin("blank", "duplicate"), 8).otherwise(initial + F.when(F.col("fault") == "truncated", 4).otherwise(0))
    return rows.join(firsts, same, "left").withColumn("fault", fault).select("conv_id", "part", "pos", "turn", "initial", "fault", code.cast("int").alias("code"))


# --- Pieces: the rows of one conversation in one range --------------------------------------


def _whole_pieces(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Runs of whole pieces, of about `least` rows, from batches sorted by part, conv_id and pos."""
    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) < least:
            continue
        t = pa.concat_tables(held).combine_chunks()
        edge = _begins(t)[-1]
        if edge:
            yield t.slice(0, edge)
        held = [t.slice(edge)]
    if held and sum(t.num_rows for t in held):
        yield pa.concat_tables(held).combine_chunks()


def _begins(t: pa.Table) -> np.ndarray:
    """Places of the first rows of pieces."""
    ids, part = t.column("conv_id"), t.column("part").to_numpy()
    null, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
    new = np.ones(t.num_rows, bool)
    new[1:] = (part[1:] != part[:-1]) | (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def _pieces(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begins = _begins(t)
    return begins, np.append(begins[1:], t.num_rows), t.column("code").to_numpy()


def _vectors(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    return np.array(column.take(pa.array(at)).to_pylist(), np.int64).reshape(len(at), 4)


def _costed(chunk: int) -> Callable:
    """Each piece's cost vector at its first row and map of states, from the vector `last` after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pieces(batches):
            begins, ends, codes = _pieces(t)
            last = _vectors(t.column("last"), begins)
            here, after, _ = backward_costs(codes, ends, last, chunk)
            leads = whole_map(decisions(codes, here, after)[2], begins, ends)
            four = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [t.column("conv_id").take(pa.array(begins)).combine_chunks(), t.column("part").take(pa.array(begins)).combine_chunks(), pa.array(last.tolist(), four), pa.array(here[begins].tolist(), four), pa.array(leads.tolist(), four)],
                names=["conv_id", "part", "last", "costs", "leads"],
            )

    return run


PIECE = "conv_id long, part int, last array<long>, costs array<long>, leads array<long>"


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "conv_id", "pos")


def _of_piece(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows with the columns of their pieces."""
    named = pieces.withColumnRenamed("conv_id", "of").withColumnRenamed("part", "of_part")
    return rows.join(named, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).drop("of", "of_part")


def _numbers(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def solve_pieces(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, part, last (costs after the piece), state (before it), final (whether no piece follows), for each piece.

    Pieces of one conversation are worked out in tasks of their own, all from the cost vector of
    a conversation's end. Then pieces whose vector isn't parallel to what the next piece begins
    with run again, until none is left. States before pieces follow from the pieces' maps.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "repair-pieces")
    pieces = stored(_sorted(rows).withColumn("last", _numbers(END)).mapInArrow(_costed(chunk), PIECE), f"{folder}/0")
    several = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"))
    # Only pieces that end at the edge of a range go on in another one, so these are two for each range at most.
    cut = stored(pieces.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi"), f"{folder}/cut")
    round_ = 0
    while True:
        nexts = F.lead("costs").over(_in_order())
        seen = cut.withColumn("next", nexts)
        gap = lambda k: F.element_at("next", k) - F.element_at("last", k)
        wrong = seen.where(F.col("next").isNotNull() & ((gap(1) != gap(2)) | (gap(1) != gap(3)) | (gap(1) != gap(4))))
        wrong = stored(wrong.select("conv_id", "part", F.col("next").alias("last")), f"{folder}/wrong-{round_}")
        if wrong.isEmpty():
            break
        redone = _sorted(_of_piece(rows, wrong)).mapInArrow(_costed(chunk), PIECE)
        others = cut.join(wrong.select(F.col("conv_id").alias("of"), F.col("part").alias("of_part")), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")), "left_anti")
        cut, round_ = stored(others.unionByName(redone), f"{folder}/cut-{round_}"), round_ + 1

    def follow(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        state, out = 0, []
        for leads in t.column("leads").to_pylist():
            out.append(state)
            state = leads[state]
        return pa.table({"conv_id": t.column("conv_id"), "part": t.column("part"), "last": t.column("last"), "state": pa.array(out, pa.int32()), "final": pa.array([i == len(out) - 1 for i in range(len(out))])})

    followed = cut.groupBy("conv_id").applyInArrow(follow, "conv_id long, part int, last array<long>, state int, final boolean")
    alone = pieces.join(several, F.col("conv_id").eqNullSafe(F.col("of")), "left_anti")
    return stored(alone.select("conv_id", "part", "last", F.lit(0).alias("state"), F.lit(True).alias("final")).unionByName(followed), f"{folder}/solved")


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("part")


def edits(rows: DataFrame, solved: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Each row's edits: conv_id, part, pos, letter, role (after them, null if deleted), before (roles put in before it), behind (roles put in after the last row) and cost."""
    names = np.array(["", "", "user", "assistant"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pieces(batches):
            begins, ends, codes = _pieces(t)
            here, after, _ = backward_costs(codes, ends, _vectors(t.column("last"), begins), chunk)
            inserts, letter, then = decisions(codes, here, after)
            state = states_before(then, begins, t.column("state").to_numpy()[begins])
            row = np.arange(len(codes))
            added, did, now = inserts[row, state], letter[row, state], then[row, state]
            final = np.zeros(len(codes), np.int64)
            closing = t.column("final").to_numpy(zero_copy_only=False)[ends - 1]
            final[ends - 1] = np.where(closing, END_INSERTS[now[ends - 1]], 0)
            turns = lambda s, k: [[names[TURN[s]], names[TURN[TURN[s]]]][:k] if k else [] for s, k in zip(s, k, strict=True)]
            cost = 5 * (added + final) + np.where(did == DELETE, 2, (did == REROLE) + np.where(codes < 8, 5 * (codes // 4), 0))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    *[t.column(c).combine_chunks() for c in ("conv_id", "part", "pos")],
                    pa.array([chr(c) for c in did]),
                    pa.array([None if d == DELETE else names[s] if d == REROLE else "" for d, s in zip(did, now, strict=True)], pa.string()),
                    pa.array(turns(state, added), strings),
                    pa.array(turns(now, final), strings),
                    pa.array(cost),
                ],
                names=["conv_id", "part", "pos", "letter", "role", "before", "behind", "cost"],
            )

    schema = "conv_id long, part int, pos long, letter string, role string, before array<string>, behind array<string>, cost long"
    return _sorted(_of_piece(rows, solved)).mapInArrow(run, schema)


def repair(conversations: DataFrame, rows_per_piece: int = 1 << 17, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The damaged rows of conversations (conv_id, turn, role, text), in order, with their faults and the edits that repair them; see `repair_conversations` for both.

    Returns (rows, edits): rows with conv_id, turn, role, text, part, pos (order is by part and
    pos), and edits for each of them, with its initial and fault.
    """
    spark = conversations.sparkSession
    damaged = damage(conversations)
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // rows_per_piece))
    turns = materialize(ordered(damaged, pieces), "repair-turns")
    rows = materialize(with_faults(turns), "repair-rows")
    made = edits(rows, solve_pieces(rows, chunk), chunk)
    kept = rows.select(F.col("part").alias("of_part"), F.col("pos").alias("of_pos"), "turn", "initial", "fault")
    return turns, materialize(made.join(kept, (F.col("part") == F.col("of_part")) & (F.col("pos") == F.col("of_pos"))).drop("of_part", "of_pos"), "repair-edits")


def repaired_turns(turns: DataFrame, made: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, part, pos, the row's initial, letter, before and behind, and texts, the (role, text) that stand at its place in order."""
    own = made.select(F.col("part").alias("of_part"), F.col("pos").alias("of_pos"), F.col("role").alias("new_role"), "before", "behind", "letter", "initial")
    both = turns.join(own, (F.col("part") == F.col("of_part")) & (F.col("pos") == F.col("of_pos")))
    empty = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    kept = F.struct(F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")).alias("role"), "text")
    texts = F.concat(empty("before"), F.when(F.col("new_role").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(kept)), empty("behind"))
    return both.select("conv_id", "part", "pos", "initial", "letter", "before", "behind", texts.alias("texts"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired lines, audits and counts of illegal neighbours, from rows sorted by conversation, part and pos."""
    names = ["conv_id", "audit", "illegal", "repaired_sha256"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
    state: dict = {}
    done: list[tuple] = []

    def close() -> None:
        if state:
            done.append((state["id"], "".join(state["audit"]), state["illegal"], state["sha"].hexdigest()))

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
        done.clear()
        return out

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", "letter", "before", "behind", "initial", "texts")]
        for conv, letter, before, behind, initial, texts in zip(*columns, strict=True):
            if not state or state["id"] != conv:
                close()
                state = {"id": conv, "audit": [], "illegal": 0, "sha": hashlib.sha256(), "any": False, "was": None}
            state["audit"].append("I" * len(before) + letter + "I" * len(behind))
            if len(state["audit"]) > 4096:
                state["audit"] = ["".join(state["audit"])]
            state["illegal"] += state["was"] is not None and state["was"] + initial not in ("su", "ua", "au")
            state["was"] = initial
            for x in texts:
                state["sha"].update(("\n" if state["any"] else "").encode() + x["role"].encode() + b":" + x["text"].encode())
                state["any"] = True
        if len(done) >= 1024:
            yield batch()
    close()
    yield batch()


def repair_conversations(conversations: DataFrame, rows_per_piece: int = 1 << 17, chunk: int = CHUNK) -> DataFrame:
    """Faults and cheapest repair of each conversation of conversations (conv_id, turn, role, text) after `damage`.

    A row's first fault counts: blank (no character but ASCII white space), duplicate (role and
    text seen earlier in the conversation), truncated (last such character is not . ! or ?).
    Keeping a row costs 0, giving it the role user or assistant 1, deleting it 2, inserting an
    empty turn of user or assistant 5; blank and duplicate rows must go, truncated ones that
    stay cost 5 more. Of the cheapest edits after which the role initials are `(s?(ua)+)?`
    those with the least audit (initials D, I, K, R in order, by ASCII) are taken.

    Returns for each conv_id: gaps, blank, duplicate, truncated, illegal (neighbours whose
    initials aren't su, ua or au), cost, audit, repaired_sha256 (of `role:text` lines).

    Method: rank-convergence parallel Viterbi. All rows are range-partitioned by conversation
    and turn; a conversation's rows in a range are a piece, a piece's rows are cut into chunks
    of 4. Chunks work out backward costs side by side from speculative vectors, and fix-up
    passes rerun those whose end vectors are not parallel to what they started from, until
    vectors differ only by constants: first chunks within a task (`backward_costs`), then
    pieces across tasks (`solve_pieces`). Decisions follow from the stitched costs for every
    state of every row, and states from composed maps.

    Edge cases: rows of equal turn go by role, then text; a null conv_id is a conversation,
    null turns come first and don't count in gaps; a role is compared by its first character,
    an empty one fits nowhere; equal rows are duplicates; a conversation without rows after
    damage has zeros, an empty audit and the hash of nothing; a text of any length is hashed
    whole; gaps beyond a long stop at its end; an empty table gives an empty result.

    Scale: a conversation of any length is cut into pieces of about rows_per_piece rows, equal
    rows included, and texts stay out of all steps but the order, the repaired text and the
    hash. A hash is sequential: the digests stream a conversation's rows through one task, in
    the memory of a batch and its audit (one letter a row). `repaired_turns` has no such step.
    """
    spark = conversations.sparkSession
    turns, made = repair(conversations, rows_per_piece, chunk)
    stream = repaired_turns(turns, made).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "part", "pos")
    digests = stream.mapInArrow(_digests, "conv_id long, audit string, illegal long, repaired_sha256 string")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1
    per_turn = made.groupBy("conv_id", "turn").agg(*[F.sum(F.when(F.col("fault") == k, 1).otherwise(0)).alias(k) for k in ("blank", "duplicate", "truncated")], F.sum("cost").alias("cost"))
    counts = per_turn.groupBy("conv_id").agg(F.least(F.coalesce(span - F.count("turn"), F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "cost")])
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for side in (digests, counts):
        side = side.withColumnRenamed("conv_id", "of")
        ids = ids.join(side, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ids.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
