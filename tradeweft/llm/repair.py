"""Cheapest repair of conversations, by a parallel Viterbi that relies on rank convergence.

The rows of a conversation, in order, have to become ``(s?(ua)+)?`` by their role initials (system,
user, assistant). A row is kept (0), given another role (1) or deleted (2; blank rows and repeats
have to be), rows may be inserted (5), and a truncated row that stays costs 5. The four states of that
pattern have costs-to-go before each row, a vector that a step backward over a row turns into the next.
Only differences within a vector decide, and there are few vectors that differ by more than a
constant; they are numbered once, with the step of every kind of row, so a run over rows is a walk
through a table.

Rows are range-partitioned by conversation and order and cut into blocks of ``BLOCK`` rows, so a
conversation with a third of all rows lies in a third of the blocks. What a block holds of one
conversation is a chunk. All chunks run backward at once, the last of a conversation from the true
vector, the others from a speculative one. Fix-up passes then rerun each chunk from the vector that
its successor has come to, side by side with its former run, until both differ only by a constant.
Pass p hands vectors on through ``REACH ** p`` chunks in turn, so chains that never converge (rows
that all have to go) need no pass per chunk. Then each chunk traces the edits forward from every state,
the states at the borders are stitched together, and the audits and texts are joined in order.

Defined results: rows go by turn (nulls first), role and text; a null conv_id is a conversation of
its own; null role or text is one space, and so is a null in the key of the damage; repeated rows are
duplicates; a conversation without rows after the damage has zeros, an empty audit and the hash of
nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweft.session import written_table

BLOCK_BITS, REACH = 12, 64
BLOCK = 1 << BLOCK_BITS
_WHITE = " \t\n\x0b\x0c\r"
#: Faults and role initials; a row's code is the letter A + 4 * fault + initial.
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"  # anything else is 3
DELETE, INSERT, REROLE, STUMP = 2, 5, 1, 5
#: States: nothing yet, after system, after user, after assistant; where a user or assistant row leads.
NEXT = (2, 2, 3, 2)
ROLE_INTO = {2: "user", 3: "assistant"}
END = (0, 10, 5, 0)
SPECULATIVE = (0, 0, 0, 0)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the hash of ``conv_id:turn`` asks for, without nulls but in turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"),
                       F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _before_row(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs before a row, from those after it."""
    out = [min(cost + after[to] for _, cost, to in edits(code, s)) for s in range(4)]
    for _ in range(2):  # a second insertion before the first
        out = [min(out[s], INSERT + out[NEXT[s]]) for s in range(4)]
    return tuple(out)


def edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row in a state: letter, cost, next state; in order of the letters."""
    fault, initial = divmod(code, 4)
    found = [("D", DELETE, state)]
    if fault in (GOOD, TRUNCATED):
        stump = STUMP if fault == TRUNCATED else 0
        if (state, initial) in ((0, 0), (0, 1), (1, 1), (3, 1), (2, 2)):
            found.append(("K", stump, 1 if initial == 0 else NEXT[state]))
        found.append(("R", stump + REROLE, NEXT[state]))
    return found


class Steps:
    """All vectors up to a constant, numbered, and the steps between them."""

    def __init__(self):
        self.vectors, self.number = [], {}
        for v in (END, SPECULATIVE):
            self._add(v)
        self.back: list[list[int]] = []
        self.ahead: list[list[list[tuple[str, int, int]]]] = []
        while len(self.back) < len(self.vectors):
            after = self.vectors[len(self.back)]
            raw = [_before_row(after, code) for code in range(16)]
            self.back.append([self._add(v) for v in raw])
            self.ahead.append([[self._least(after, v, code, s) for s in range(4)] for code, v in enumerate(raw)])

    def _add(self, vector: tuple[int, ...]) -> int:
        low = min(vector)
        vector = tuple(x - low for x in vector)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    @staticmethod
    def _least(after, before, code: int, state: int) -> tuple[str, int, int]:
        """The ASCII-least of the cheapest edits up to and with a row: letters, cost, next state."""
        letters, total = "", 0
        while True:
            for letter, cost, to in edits(code, state):
                if letter != "D" and INSERT + before[NEXT[state]] == before[state]:
                    break  # an insertion comes first: I is below K and R
                if cost + after[to] == before[state]:
                    return letters + letter, total + cost, to
            letters, total, state = letters + "I", total + INSERT, NEXT[state]

    def run(self, codes: str, start: int) -> int:
        v, back = start, self.back
        for c in reversed(codes):
            v = back[v][ord(c) - 65]
        return v

    def rerun(self, codes: str, old: int, new: int, old_end: int) -> int:
        """The end of a run from ``new``; ``old`` led to ``old_end``. Stops where both differ by a constant."""
        back = self.back
        for c in reversed(codes):
            if old == new:
                return old_end
            code = ord(c) - 65
            old, new = back[old][code], back[new][code]
        return new

    def trace(self, codes: str, end: int, state: int) -> tuple[list[str], int, int]:
        """Letters of each row, cost and last state of a chunk that begins in ``state``."""
        vectors = [end]
        for c in reversed(codes[1:]):
            vectors.append(self.back[vectors[-1]][ord(c) - 65])
        made, total = [], 0
        for c, v in zip(codes, reversed(vectors)):
            letters, cost, state = self.ahead[v][ord(c) - 65][state]
            made.append(letters)
            total += cost
        return made, total, state


@lru_cache(maxsize=1)
def steps() -> Steps:
    return Steps()


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, their place in the order, and what can be said of each alone."""
    order = ["conv_id", "turn", "role", "text", "salt"]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows may part
    placed = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    placed = written_table(placed.withColumn("pos", F.monotonically_increasing_id()), "turns")
    trimmed = F.rtrim(F.col("text"), F.lit(_WHITE))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    return placed.withColumns({
        "blank": trimmed == "", "whole": F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
        "initial": F.when((F.length("role") == 0) | (initial == 0), 3).otherwise(initial - 1)})


def _chunks(placed: DataFrame) -> DataFrame:
    """One row per conversation and block: codes of its rows in order, its number and how many there are."""
    firsts = placed.filter(~F.col("blank")).groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(
        F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("fresh").isNull(), DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(GOOD)
    coded = placed.select("conv_id", "pos", "blank", "whole", "initial").join(firsts, "pos", "left").select(
        "conv_id", "pos", F.shiftright("pos", BLOCK_BITS).alias("block"), F.char(65 + fault * 4 + F.col("initial")).alias("code"))
    rows = coded.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    by_conv = Window.partitionBy("conv_id")
    return rows.select(
        "conv_id", "block", F.col("rows")[0]["pos"].alias("first"), F.array_join(F.col("rows.code"), "").alias("codes"),
        F.row_number().over(by_conv.orderBy("block")).alias("i"), F.count(F.lit(1)).over(by_conv).alias("n"))


_CHUNK = "conv_id {0}, block long, first long, codes string, i int, n long, start int, end int"


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over rows as dicts, yielding tuples of the schema, in bounded batches."""
    names = [part.split()[0] for part in schema.split(", ")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in run(row for batch in source for row in batch.to_pylist()):
            held.append(row)
            size += 100 + sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if size > 4 << 20:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held))), arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held))), arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(batches, schema)


def backward(chunks: DataFrame) -> DataFrame:
    """Chunks with the vector at their end (``start`` of the backward run) and the one at their front."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    schema = _CHUNK.format(kind)

    def first(rows):
        table = steps()
        true, guess = table.number[END], table.number[SPECULATIVE]
        for r in rows:
            start = true if r["i"] == r["n"] else guess
            yield r["conv_id"], r["block"], r["first"], r["codes"], r["i"], r["n"], start, table.run(r["codes"], start)

    def fix(rows):
        table, key, v = steps(), None, None
        for r in rows:
            own = r["conv_id"], r["lot"]
            if own != key:
                key, v = own, r["behind"]
            end = table.rerun(r["codes"], r["start"], v, r["end"])
            yield r["conv_id"], r["block"], r["first"], r["codes"], r["i"], r["n"], v, end
            v = end

    done = written_table(_mapped(chunks, first, schema), "backward")
    singles, chained, reach = done.filter("n = 1"), done.filter("n > 1"), 1
    while True:
        behind = F.lead("end").over(Window.partitionBy("conv_id").orderBy("i"))
        linked = chained.withColumn("behind", F.coalesce(behind, F.col("start")))
        if linked.filter(F.col("behind") != F.col("start")).isEmpty():
            return singles.unionByName(chained)
        lots = linked.withColumn("lot", F.floor((F.col("i") - 1) / reach)).repartition("conv_id", "lot").sortWithinPartitions(
            "conv_id", "lot", F.desc("i"))
        chained = written_table(_mapped(lots, fix, schema), "fix-up")
        reach *= REACH


def traced(chunks: DataFrame) -> DataFrame:
    """Chunks with the state they begin in."""
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def leads(rows):
        table = steps()
        for r in rows:
            ends = "".join(str(table.trace(r["codes"], r["start"], s)[2]) for s in range(4))
            yield r["conv_id"], r["block"], r["i"], ends

    def stitch(rows):
        key, state = object(), 0
        for r in rows:
            if r["i"] == 1:
                state = 0
            yield r["conv_id"], r["block"], state
            state = int(r["ends"][state])

    many = _mapped(chunks.filter("n > 1"), leads, f"conv_id {kind}, block long, i int, ends string")
    states = _mapped(many.repartition("conv_id").sortWithinPartitions("conv_id", "i"), stitch, f"owner {kind}, chunk long, state int")
    first = chunks.filter("n = 1").withColumn("state", F.lit(0))
    rest = chunks.filter("n > 1").join(states, F.col("conv_id").eqNullSafe(F.col("owner")) & (F.col("block") == F.col("chunk"))).drop("owner", "chunk")
    return first.unionByName(rest)


def _edited(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is done with each row (pos, letters and the role it ends with, after inserted ones), and sums per chunk."""
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def run(rows):
        table = steps()
        for r in rows:
            codes, state = r["codes"], r["state"]
            made, cost, last = table.trace(codes, r["start"], state)
            tail = "" if r["i"] < r["n"] else "I" * {0: 0, 1: 2, 2: 1, 3: 0}[last]
            faults = [(ord(c) - 65) // 4 for c in codes]
            initials = "".join((INITIALS + "x")[(ord(c) - 65) % 4] for c in codes)
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            lines = []
            for letters in [*made, tail]:
                line = []
                for letter in letters:
                    if letter in "IR":
                        state = NEXT[state]
                        line.append((ROLE_INTO[state] + ":") if letter == "I" else ROLE_INTO[state])
                    elif letter == "K":
                        state = 1 if state == 0 and initials[len(lines)] == "s" else NEXT[state]
                        line.append("")
                lines.append(line)
            yield (r["conv_id"], r["block"], r["first"], "".join(made) + tail, cost + INSERT * len(tail), faults.count(BLANK),
                   faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, initials[0] + initials[-1],
                   [letters[-1:] for letters in made], ["\n".join(line[:-1] if letters[-1:] in "KR" else line) for letters, line in zip(made, lines)],
                   [line[-1] if letters[-1:] == "R" else None for letters, line in zip(made, lines)], "\n".join(lines[-1]))

    rows = _mapped(chunks, run, f"conv_id {kind}, block long, first long, audit string, cost long, blank long, duplicate long, truncated long, "
                   "illegal long, sides string, letters array<string>, led array<string>, roles array<string>, tail string")
    rows = written_table(rows, "edits")
    each = rows.select("first", F.posexplode(F.arrays_zip("letters", "led", "roles"))).select(
        (F.col("first") + F.col("pos")).alias("pos"), "col.letters", "col.led", "col.roles")
    return each, rows.drop("letters", "led", "roles", "first")


def _texts(placed: DataFrame, each: DataFrame) -> DataFrame:
    """The repaired text of each chunk; null without a line."""
    own = F.when(F.col("letters").isin("K", "R"), F.concat(F.coalesce("roles", "role"), F.lit(":"), "text"))
    line = F.concat_ws("\n", F.when(F.col("led") != "", F.col("led")), own)
    rows = placed.select("conv_id", "pos", "role", "text").join(each, "pos").filter((F.col("led") != "") | own.isNotNull())
    lines = rows.select("conv_id", "pos", F.shiftright("pos", BLOCK_BITS).alias("block"), line.alias("line"))
    sorted_lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("conv_id", "block").agg(F.array_join(F.transform(sorted_lines, lambda x: x["line"]), "\n").alias("lines"))


def repair(rows: DataFrame) -> DataFrame:
    """Gaps and faults of each damaged conversation, and its cheapest repair (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = _placed(damage(rows))
    chunks = written_table(traced(backward(_chunks(placed))), "chunks")
    each, sums = _edited(chunks)
    texts = _texts(placed, each).select(F.col("conv_id").alias("owner"), F.col("block").alias("chunk"), "lines")
    joined = sums.join(texts, F.col("conv_id").eqNullSafe(F.col("owner")) & (F.col("block") == F.col("chunk")), "left").drop("owner", "chunk")

    def assembled(rows):
        key, state = None, None
        for r in rows:
            if state is None or r["conv_id"] != key:
                if state:
                    yield done(key, state)
                key = r["conv_id"]
                state = {"sums": [0] * 5, "audit": [], "hash": hashlib.sha256(), "any": False, "last": ""}
            for i, name in enumerate(("cost", "blank", "duplicate", "truncated", "illegal")):
                state["sums"][i] += r[name]
            border = state["last"] + r["sides"][0]
            state["sums"][4] += len(border) == 2 and border not in ("su", "ua", "au")
            state["last"] = r["sides"][1]
            state["audit"].append(r["audit"])
            for text in (r["lines"], r["tail"] or None):
                if text is not None:
                    state["hash"].update((b"\n" if state["any"] else b"") + text.encode())
                    state["any"] = True
        if state:
            yield done(key, state)

    def done(key, state):
        return key, *state["sums"], "".join(state["audit"]), state["hash"].hexdigest()

    made = _mapped(joined.repartition("conv_id").sortWithinPartitions("conv_id", "block"), assembled,
                   f"owner {kind}, cost long, blank long, duplicate long, truncated long, illegal long, audit string, repaired_sha256 string")
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("of")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = rows.select("conv_id").distinct().join(made, F.col("conv_id").eqNullSafe(F.col("owner")), "left").join(
        turns, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
