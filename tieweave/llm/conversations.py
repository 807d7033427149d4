"""Conversation structure repair: cheapest edits by a Viterbi whose chunks run at the same time."""

from __future__ import annotations

import hashlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieweave.llm.common import shuffle_partitions
from tieweave.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
KEYS = ("conv_id", "turn", "role", "text")
#: Rows of a chunk at most, as a power of two: places of one chunk agree above these bits.
CHUNK_BITS = 12
#: Each pass of corrections lets runs of so many times more chunks pass their costs on.
WIDER = 4

# The initials so far: none, s, ending in u, ending in a.  An inserted or reroled turn is the only one of
# user and assistant that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = (USER, USER, ASSISTANT, USER)
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
RIGHT, LATE, GONE = range(3)  # a row in order, a truncated one, one that has to go
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Cost from each state after the last row: what is still to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
GUESS = (0, 0, 0, 0)

Vector = tuple[int, int, int, int]
_steps: dict[tuple[Vector, int], tuple[Vector, int]] = {}


def text_or_blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults, by crc32(``conv_id:turn``) modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 sets its role to
    user.  Nulls of role and text, and of id and turn in the key, are one space.
    """
    h = F.pmod(F.crc32(F.concat(text_or_blank("conv_id"), F.lit(":"), text_or_blank("turn"))), F.lit(20))
    marked = rows.select("conv_id", "turn", text_or_blank("role").alias("role"), text_or_blank("text").alias("text"), h.alias("h"))
    return marked.where("h <> 0").select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("h"),
    ).drop("h")


def placed(rows: DataFrame) -> DataFrame:
    """Distinct rows with the number of their copies, in order: ``place`` grows with conversation and turn.

    Rows of one turn are ordered by role, then text; nulls come first.  Copies of a row stand beside each other,
    so one row with their number stands for them, however many they are.
    """
    once = rows.select("conv_id", "turn", text_or_blank("role").alias("role"), text_or_blank("text").alias("text"))
    once = once.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    # Beginnings of texts are ordered as texts are, and bounds of partitions stay small.
    ranged = once.repartitionByRange(shuffle_partitions(rows.sparkSession), *order, F.substring("text", 1, 64).asc())
    ranged = ranged.sortWithinPartitions(*order, F.col("text").asc())
    # One text for each conversation, as its nulls meet no others in a join.
    conv = F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("n"))
    return materialize(ranged.select("*", conv.alias("conv"), F.monotonically_increasing_id().alias("place")), "placed")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``placed`` (without texts) with ``fault``: blank, duplicate, truncated or null, the first that holds.

    A role and text seen before are found by the first place of each, so a turn that is repeated all the
    time is counted in each task, not gathered.
    """
    kept = F.rtrim("text", F.lit(BLANKS))
    print_ = F.sha2(F.concat_ws(":", "conv", F.length("role"), "role", "text"), 256)
    marked = rows.select(
        "conv_id", "conv", "turn", "role", "copies", "place", (kept == "").alias("blank"),
        F.instr(F.lit(".!?"), F.substring(kept, -1, 1)).alias("ended"), print_.alias("print"),
    )
    again = marked.groupBy("print").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = marked.join(again.select("print", "first"), "print", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate")
    return found.select(
        "conv_id", "conv", "turn", "role", "copies", "place", fault.when(F.col("ended") == 0, "truncated").alias("fault")
    )


def chunks(rows: DataFrame) -> DataFrame:
    """Chunks of neighbouring rows of one conversation: (conv_id, conv, number, last, first_place, symbols, copies).

    ``number`` counts a conversation's chunks from 0.  A symbol is three times the initial (s, u, a, other)
    plus what is to be done with the row; copies of a row that stand for further ones are to be deleted.
    """
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    todo = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", LATE).otherwise(RIGHT)
    part = F.shiftright("place", CHUNK_BITS)
    cut = rows.groupBy("conv_id", "conv", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("place", (3 * initial + todo).alias("symbol"), "copies"))).alias("rows")
    )
    cut = materialize(
        cut.select("conv_id", "conv", "part", F.get("rows", F.lit(0))["place"].alias("first_place"),
                   F.col("rows.symbol").alias("symbols"), F.col("rows.copies").alias("copies")), "chunks"
    )
    # Numbers are given to light rows; there is one for thousands of turns.
    order = Window.partitionBy("conv").orderBy("part")
    numbers = cut.select(
        "conv", "part", (F.row_number().over(order) - 1).cast("long").alias("number"),
        F.lead("part").over(order).isNull().alias("last"),
    )
    return cut.join(numbers, ["conv", "part"]).drop("part")


def step(after: Vector, symbol: int) -> tuple[Vector, int]:
    """Costs from each state before a row, given those after it: least one taken off, and that one."""
    known = _steps.get((after, symbol))
    if known is None:
        initial, todo = divmod(symbol, 3)
        extra = TRUNCATED if todo == LATE else 0
        costs = []
        for state in range(4):
            ways = [DELETE + after[state]]
            if todo != GONE:
                ways.append(REROLE + extra + after[FOLLOWS[state]])
                if state in KEPT[initial]:
                    ways.append(extra + after[KEPT[initial][state]])
            costs.append(min(ways))
        for _ in range(2):  # further turns inserted before the row would lead nowhere else
            costs = [min(costs[state], INSERT + costs[FOLLOWS[state]]) for state in range(4)]
        least = min(costs)
        known = _steps[(after, symbol)] = tuple(c - least for c in costs), least
    return known


def costs_before(symbols: list[int], after: Vector) -> tuple[Vector, int]:
    """Costs before a chunk from those after it, and the constant taken off."""
    taken = 0
    for symbol in reversed(symbols):
        after, more = step(after, symbol)
        taken += more
    return after, taken


def corrected(symbols: list[int], was: Vector, now: Vector, found: Vector, taken: int) -> tuple[Vector, int]:
    """``costs_before`` from ``now``, given its result from ``was``.

    Both runs go side by side until their costs differ by a constant only; from there on they agree.
    """
    before = then = 0
    for symbol in reversed(symbols):
        if was == now:
            return found, taken - before + then
        (was, less), (now, more) = step(was, symbol), step(now, symbol)
        before, then = before + less, then + more
    return now, taken - before + then


def illegal_inside(symbols: list[int], copies: list[int]) -> int:
    found = 0
    for n, symbol in enumerate(symbols):
        found += copies[n] - 1
        found += n > 0 and (symbols[n - 1] // 3, symbol // 3) not in LEGAL
    return found


def rows_out(batch: pa.RecordBatch, schema: pa.Schema, more: dict[str, list]) -> pa.RecordBatch:
    """The batch's own columns and those of ``more``, by the names of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [pa.array(more[f.name], f.type) if f.name in more else batch.column(f.name).cast(f.type) for f in schema], schema=schema
    )


def speculated(cut: DataFrame) -> DataFrame:
    """Adds to chunks: ``given`` costs after them, ``found`` costs before, ``taken`` constant, ``illegal`` neighbours.

    The last chunk of a conversation knows the costs after it, each other one starts from equal ones.
    """
    kept = ("conv_id", "conv", "number", "last", "first_place", "symbols", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = {"given": [], "found": [], "taken": [], "illegal": []}
            for symbols, copies, last in zip(*[batch.column(c).to_pylist() for c in ("symbols", "copies", "last")]):
                given = END if last else GUESS
                found, taken = costs_before(symbols, given)
                more["given"].append(given)
                more["found"].append(found)
                more["taken"].append(taken + DELETE * (sum(copies) - len(copies)))
                more["illegal"].append(illegal_inside(symbols, copies))
            types = [("given", pa.list_(pa.int32())), ("found", pa.list_(pa.int32())), ("taken", pa.int64()), ("illegal", pa.int64())]
            fields = [batch.schema.field(c) for c in kept] + [pa.field(*t) for t in types]
            yield rows_out(batch, pa.schema(fields), more)

    kinds = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in kept)
    return cut.select(*kept).mapInArrow(run, f"{kinds}, given array<int>, found array<int>, taken long, illegal long")


def settled(long: DataFrame) -> DataFrame:
    """Chunks of ``speculated`` whose given costs are those found before the chunk that follows.

    In each pass chunks whose follower found other costs run again, until both runs differ by a constant.
    Most runs end after some rows; where costs never meet, the runs of chunks that pass theirs on in
    one task grow with each pass, so passes grow with the logarithm of a conversation's chunks.
    """
    wide, names = 1, long.columns
    while True:
        follower = long.select("conv", (F.col("number") - 1).alias("number"), F.col("found").alias("right"))
        known = long.join(follower, ["conv", "number"], "left").withColumn("right", F.coalesce("right", "given"))
        if known.where("given <> right").isEmpty():
            return long

        def run(batches: Iterator[pa.RecordBatch], wide: int = wide) -> Iterator[pa.RecordBatch]:
            before, passed = None, GUESS
            for batch in batches:
                more = {"given": [], "found": [], "taken": []}
                for conv, number, *row in zip(*[batch.column(c).to_pylist() for c in columns]):
                    symbols, given, found, taken, right = row
                    now = passed if before == (conv, number + 1) and (number + 1) % wide else tuple(right)
                    if tuple(given) != now:
                        found, taken = corrected(symbols, tuple(given), now, tuple(found), taken)
                    before, passed = (conv, number), tuple(found)
                    for name, value in (("given", now), ("found", found), ("taken", taken)):
                        more[name].append(value)
                yield rows_out(batch, pa.schema([batch.schema.field(c) for c in names]), more)

        columns = ("conv", "number", "symbols", "given", "found", "taken", "right")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.schema)
        dealt = known.withColumn("run", F.floor(F.col("number") / wide)).repartition("conv", "run")
        long = materialize(
            dealt.sortWithinPartitions("conv", F.desc("number")).drop("run").mapInArrow(run, kinds), "settled"
        )
        wide *= WIDER


def traced(symbols: list[int], copies: list[int], after: Vector, last: bool, state: int) -> tuple[list[str], int]:
    """Least letters of the cheapest edits for each row of a chunk, entered in ``state``, and the state it is left in.

    Letters of turns inserted before a row stand with it; those inserted after the conversation with its last.
    """
    costs = [after]
    for symbol in reversed(symbols):
        costs.append(step(costs[-1], symbol)[0])
    costs.reverse()
    marks = []
    for n, symbol in enumerate(symbols):
        initial, todo = divmod(symbol, 3)
        extra = TRUNCATED if todo == LATE else 0
        then, least = costs[n + 1], step(costs[n + 1], symbol)[1]
        mark = ""
        while True:
            left = costs[n][state] + least
            if DELETE + then[state] == left:
                mark += "D"
                break
            if INSERT + costs[n][FOLLOWS[state]] + least == left:
                mark += "I"
                state = FOLLOWS[state]
                continue
            if todo != GONE and state in KEPT[initial] and extra + then[KEPT[initial][state]] == left:
                mark += "K"
                state = KEPT[initial][state]
            else:
                mark += "R"
                state = FOLLOWS[state]
            break
        marks.append(mark + "D" * (copies[n] - 1))
    while last and END[state]:
        marks[-1] += "I"
        state = FOLLOWS[state]
    return marks, state


def entered(long: DataFrame) -> DataFrame:
    """(conv, number, entry, seam) of settled chunks: the state each is entered in, and whether it meets the one
    before with illegal initials.

    A task traces its chunks from every state; a stream of one small row for each chunk, in order, joins them.
    """

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits, ends = [], []
            for symbols, copies, given, last in zip(*[batch.column(c).to_pylist() for c in ("symbols", "copies", "given", "last")]):
                exits.append([traced(symbols, copies, tuple(given), last, state)[1] for state in range(4)])
                ends.append([symbols[0] // 3, symbols[-1] // 3])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("number"), pa.array(exits, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                names=["conv", "number", "exits", "ends"],
            )

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = initial = conv = None
        for batch in batches:
            entries, seams = [], []
            for this, exits, ends in zip(*[batch.column(c).to_pylist() for c in ("conv", "exits", "ends")]):
                if this != conv:
                    conv, state, initial = this, START, None
                entries.append(state)
                seams.append(int(initial is not None and (initial, ends[0]) not in LEGAL))
                state, initial = exits[state], ends[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("number"), pa.array(entries, pa.int32()), pa.array(seams, pa.int64())],
                names=["conv", "number", "entry", "seam"],
            )

    light = long.select("conv", "number", "symbols", "copies", "given", "last")
    light = light.mapInArrow(leave, "conv string, number long, exits array<int>, ends array<int>")
    sorted_ = light.repartition("conv").sortWithinPartitions("conv", "number")
    return materialize(sorted_.mapInArrow(enter, "conv string, number long, entry int, seam long"), "entered")


def edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits and costs of conversations, from ``faults``.

    The first has (conv_id, conv, first_place, marks): letters of each row of a chunk.  The second has
    (conv_id, cost, illegal) in parts, to be summed.
    """
    spans = materialize(speculated(chunks(rows)), "spans")
    whole = spans.where("last AND number = 0").withColumn("entry", F.lit(START)).withColumn("seam", F.lit(0).cast("long"))
    long = spans.where("NOT (last AND number = 0)")
    if not long.isEmpty():
        long = settled(long)
        whole = whole.unionByName(long.join(entered(long), ["conv", "number"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for symbols, copies, given, last, entry in zip(
                *[batch.column(c).to_pylist() for c in ("symbols", "copies", "given", "last", "entry")]
            ):
                marks.append(traced(symbols, copies, tuple(given), last, entry)[0])
            kept = [batch.column(c) for c in ("conv_id", "conv", "first_place")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(marks, pa.list_(pa.string()))], names=["conv_id", "conv", "first_place", "marks"]
            )

    kind = whole.schema["conv_id"].dataType.simpleString()
    letters = whole.select("conv_id", "conv", "first_place", "symbols", "copies", "given", "last", "entry").mapInArrow(
        run, f"conv_id {kind}, conv string, first_place long, marks array<string>"
    )
    # Costs from the start of a conversation: what its chunks took off, and what its first one found.
    begun = F.when(F.col("number") == 0, F.get("found", F.lit(START))).otherwise(0)
    costs = whole.select("conv_id", (F.col("taken") + begun).alias("cost"), (F.col("illegal") + F.col("seam")).alias("illegal"))
    return letters, costs


class Play:
    """Replays a conversation's letters over its rows, one after another."""

    def __init__(self) -> None:
        self.state, self.audit, self.digest, self.said = START, [], hashlib.sha256(), 0

    def turns(self, marks: str, role: str, text: str) -> list[tuple[str, str, str]]:
        """(letter, role, text) of the turns that stay; a row's own letter is the first that is not an insertion."""
        self.audit.append(marks)
        out = []
        for letter in marks:
            if letter == "D":
                continue
            if letter == "K":
                self.state = KEPT["sua".index(role[0])][self.state]
                out.append((letter, role, text))
            else:
                self.state = FOLLOWS[self.state]
                out.append((letter, NAMES[self.state], "" if letter == "I" else text))
        for _, role, text in out:
            self.digest.update(f"{chr(10) * (self.said > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.said += 1
        return out


def played(rows: DataFrame, letters: DataFrame, digest: bool) -> DataFrame:
    """What the edits make of ``rows`` (of ``placed``): with ``digest`` (conv_id, audit, repaired_sha256), else
    the repaired turns (conv_id, position, role, text, edit).

    A conversation's rows pass through one task in order, as a digest of all its text wants; the task
    holds one row, the letters of one chunk and the audit.
    """
    texts = rows.select("conv_id", "conv", "place", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("array<string>").alias("marks"))
    heads = letters.select(
        "conv_id", "conv", F.col("first_place").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), "marks",
    )
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        play, now, id_, marks, first = Play(), None, None, [], 0

        def ended(schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([id_], schema.field("conv_id").type), pa.array(["".join(play.audit)]), pa.array([play.digest.hexdigest()])],
                names=["conv_id", "audit", "repaired_sha256"],
            )

        schema = None
        for batch in batches:
            schema, out = batch.schema, []
            for conv_id, conv, place, kind, role, text, some in zip(*[batch.column(c).to_pylist() for c in columns]):
                if conv != now:
                    if now is not None and digest:
                        yield ended(schema)
                    play, now, id_ = Play(), conv, conv_id
                if kind == 0:
                    marks, first = some, place
                    continue
                begin = play.said
                for n, (letter, role, text) in enumerate(play.turns(marks[place - first], role, text)):
                    out.append((conv_id, begin + n, role, text, letter))
                if digest:
                    out.clear()
            if out:
                types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "position", "role", "text", "edit"]
                )
        if now is not None and digest:
            yield ended(schema)

    columns = ("conv_id", "conv", "place", "kind", "role", "text", "marks")
    dealt = texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "place", "kind")
    made = "audit string, repaired_sha256 string" if digest else "position long, role string, text string, edit string"
    return dealt.mapInArrow(run, f"conv_id {id_type}, {made}")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns of ``rows`` (conv_id, turn, role, text): (conv_id, position, role, text, edit).

    Positions count from 0; ``edit`` is K for a kept turn, R for one that changed its role, I for an inserted one.
    """
    rows = placed(rows)
    return played(rows, edits(materialize(faults(rows), "faults"))[0], digest=False)


def audited(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: faults of its ``rows`` and their cheapest repair.

    Each row's first fault counts: blank (no word in it), duplicate (role and text seen earlier), truncated
    (its last letter not one of ``.!?``).  Keeping a row costs 0, another role 3, deleting 4 (a must for blank
    and duplicate rows), inserting an empty turn 3, and 3 more for a truncated row that stays, so that the
    initials of roles are ``(s?(ua)+)?``.  ``audit`` has the letters of the cheapest edits in order, of equally
    cheap ones the least in ASCII order.  Rows of a null conv_id are one conversation; null roles and texts
    are one space; a role of another initial than s, u and a, or of none, can't be kept.  Conversations
    without rows have zeros, an empty audit and the hash of nothing.  Other columns are not read.
    """
    rows = placed(rows)
    marked = materialize(faults(rows), "faults")
    letters, costs = edits(marked)
    told = played(rows, letters, digest=True)
    of = lambda name: F.sum(F.when(F.col("fault") == name, F.col("copies")).otherwise(0))
    # Further copies of a row repeat it, or are as blank.
    more = F.sum(F.when(F.col("fault").isNull() | (F.col("fault") == "truncated"), F.col("copies") - 1).otherwise(0))
    first = F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0))
    counts = marked.groupBy("conv_id").agg(
        of("blank").alias("blank"), (of("duplicate") + more).alias("duplicate"), first.alias("truncated"),
        (F.max("turn") - F.min("turn") + 1).cast("long").alias("range"),
    )
    turns = marked.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    parts = conversations.select("conv_id").distinct()
    for part in (counts, turns, costs, told):
        parts = parts.unionByName(part, allowMissingColumns=True)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)
    return parts.groupBy("conv_id").agg(
        (F.coalesce(F.sum("range"), F.lit(0)) - F.coalesce(F.sum("turns"), F.lit(0))).cast("long").alias("gaps"),
        *[total(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
