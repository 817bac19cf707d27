"""Repair of conversations: faults of their rows, and the cheapest edits to legal turns.

A row is blank, a duplicate (its role and text stand earlier in the conversation) or
truncated (its last character but white space ends no sentence); its first fault counts.
The edits of a conversation, one letter each in order, are its audit: K keeps a row (0),
R gives it the role of a user or assistant (1), D deletes it (2; blank rows and duplicates
have to go), I inserts an empty row of a user or assistant (5); a truncated row that stays
costs 5 more. They leave nothing, or a system row at most and then users and assistants
in turn, an assistant last. Of the cheapest audits the least in ASCII is taken.

Audits are found by dynamic programming over four states. They share their beginnings: an
audit is a linked node with its parent, the ancestors at distances of powers of two and a
rolling hash of its letters. Of two audits of one cost, the longest common beginning is
searched over the ancestors by hash, and the next letters decide; equal hashes are trusted
only if the nodes are the same or their letters are.

No task holds a conversation: all rows are sorted over ranges and numbered, BLOCK numbers
are a block, and a conversation that goes over an edge of a block is cut there. The costs
from state to state of such cuts, four by four, are carried back through the conversation
as a stream, so each cut knows what its ends cost later; it then has an audit for each
state that it can begin in, and the states are carried forward. Equal rows of one turn are
one row with its number of copies.

Defined results: a null conversation, turn, role or text counts as one space where text is
needed; rows with a null conversation are one conversation; turns go in order, nulls first, and
within a turn by role and text; a row's role is known by its first letter; a conversation
without rows has an empty audit; no rows give no rows; other columns fall away.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, stored, table

BLOCK = 1 << 10
SORTED_BY = 64
#: Fixed costs of edits.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after a system row, after a user's, after an assistant's. What ends the conversation there, and its cost.
ENDS = ("", "II", "I", "")
END_COSTS = [INSERT * len(x) for x in ENDS]
NEVER = 1 << 60
_MOD, _BASE = (1 << 61) - 1, 0x2545F4914F6CDD1D


def moves(initial: str, truncated: bool) -> list[tuple[int, int, int, str]]:
    """What a row that needn't go can do: (state before, state after, cost, letters)."""
    late = TRUNCATED * truncated
    out = [(q, q, DELETE, "D") for q in range(4)]
    if initial == "s":
        out.append((0, 1, late, "K"))
    for role, to, direct in (("u", 2, (0, 1, 3)), ("a", 3, (2,))):
        letter, cost = ("K", late) if initial == role else ("R", late + REROLE)
        out += [(p, to, cost, letter) if p in direct else (p, to, cost + INSERT, f"I{letter}") for p in range(4)]
    return out


_MOVES = {(i, t): moves(i, t) for i in ("s", "u", "a", "") for t in (False, True)}


def row_moves(initial: str, truncated: bool) -> list[tuple[int, int, int, str]]:
    return _MOVES[initial if initial in ("s", "u", "a") else "", truncated]


class Audits:
    """Audits as nodes that share their beginnings; node 0 is empty."""

    def __init__(self):
        self.letters, self.depths, self.hashes, self.ups = [""], [0], [0], [()]

    def grown(self, node: int, letters: str) -> int:
        for letter in letters:
            ups, k = [node], 0
            while k < len(self.ups[ups[k]]):
                ups.append(self.ups[ups[k]][k])
                k += 1
            self.letters.append(letter)
            self.depths.append(self.depths[node] + 1)
            self.hashes.append((self.hashes[node] * _BASE + ord(letter)) % _MOD)
            self.ups.append(tuple(ups))
            node = len(self.letters) - 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.ups[node][0]
        return "".join(reversed(out))

    def cut(self, node: int, depth: int) -> int:
        """The ancestor of that depth."""
        more, k = self.depths[node] - depth, 0
        while more >> k:
            if more >> k & 1:
                node = self.ups[node][k]
            k += 1
        return node

    def alike(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth hold the same letters, hashes aside."""
        while x != y:
            if self.letters[x] != self.letters[y]:
                return False
            x, y = self.ups[x][0], self.ups[y][0]
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether the audit of x is before that of y."""
        depth = min(self.depths[x], self.depths[y])
        a, b = self.cut(x, depth), self.cut(y, depth)
        if self.hashes[a] == self.hashes[b]:
            return self.depths[x] < self.depths[y] if self.alike(a, b) else self.text(x) < self.text(y)
        k = len(self.ups[a]) - 1
        while k >= 0:
            if k < len(self.ups[a]) and self.hashes[self.ups[a][k]] != self.hashes[self.ups[b][k]]:
                a, b = self.ups[a][k], self.ups[b][k]
            k -= 1
        same = self.alike(self.ups[a][0], self.ups[b][0])
        return self.letters[a] < self.letters[b] if same else self.text(x) < self.text(y)


def cheapest(rows: list[tuple[str, bool]], state: int, later: list[int]) -> tuple[list[tuple[str, int]], int]:
    """rows: (initial, truncated) of rows that needn't go. The letters of each with the state after it, and the last state, that cost least with what comes later."""
    audits = Audits()
    now = {state: (0, 0)}
    for row in rows:
        new: dict[int, list[tuple[int, int, str]]] = {}
        for p, q, cost, letters in row_moves(*row):
            if p in now:
                total = now[p][0] + cost
                if q not in new or total < new[q][0][0]:
                    new[q] = [(total, now[p][1], letters)]
                elif total == new[q][0][0]:
                    new[q].append((total, now[p][1], letters))
        now = {}
        for q, found in new.items():
            best = None
            for total, node, letters in found:
                node = audits.grown(node, letters)
                if best is None or audits.less(node, best[1]):
                    best = total, node
            now[q] = best
    least = min(cost + later[q] for q, (cost, _) in now.items())
    end = None
    for q, (cost, x) in now.items():
        if cost + later[q] == least and (end is None or audits.less(x, now[end][1])):
            end = q
    out, held = [], ""
    for letter in audits.text(now[end][1]):
        held += letter
        if letter != "I":
            state = next(q for p, q, _, letters in row_moves(*rows[len(out)]) if p == state and letters == held)
            out.append((held, state))
            held = ""
    return out, end


def costs(rows: list[tuple[str, bool]]) -> list[int]:
    """The least cost from each state to each, four by four."""
    out = []
    for state in range(4):
        now = [NEVER] * 4
        now[state] = 0
        for row in rows:
            new = [NEVER] * 4
            for p, q, cost, _ in row_moves(*row):
                new[q] = min(new[q], now[p] + cost)
            now = new
        out += now
    return out


def _runs(rows: pa.Table):
    """rows of a block in order. (conversation, first row, row after) of each."""
    convs = rows.column("conv").to_pylist()
    start = 0
    for at in range(1, len(convs) + 1):
        if at == len(convs) or convs[at] != convs[start]:
            yield convs[start], start, at
            start = at


def _cuts(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    firm, initials, late = (rows.column(c).to_pylist() for c in ("firm", "initial", "truncated"))
    runs = list(_runs(rows))
    edges = [r for i, r in enumerate(runs) if i in (0, len(runs) - 1)]  # only these can go on in another block
    found = [costs([(initials[i], late[i]) for i in range(a, b) if firm[i]]) for _, a, b in edges]
    convs = pa.array([c for c, _, _ in edges], rows.schema.field("conv").type)
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()] * len(edges), pa.int64()), "conv": convs, "m": pa.array(found, pa.list_(pa.int64()))})


def _streamed(rows: DataFrame, first, each, schema: str, back: bool = False) -> DataFrame:
    """rows: (block, conv, x). Goes through each conversation's blocks in order, or back: each(value, x) gives the value after the block; the value before goes out."""
    order = F.col("block").desc() if back else F.col("block")

    def carried(batches):
        conv, value, began = None, None, False
        for batch in batches:
            out = []
            for c, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fresh = not began or c != conv
                conv, began = c, True
                value = first if fresh else value
                out.append((value, fresh))
                value = each(value, x)
            kind = pa.list_(pa.int64()) if isinstance(first, list) else pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v for v, _ in out], kind), pa.array([f for _, f in out])], names=["block", "conv", "value", "edge"])

    return rows.repartition("conv").sortWithinPartitions("conv", order).mapInArrow(carried, schema)


def _back(value: list[int], m: list[int]) -> list[int]:
    return [min(m[4 * p + q] + value[q] for q in range(4)) for p in range(4)]


def _settled(rows: pa.Table, later: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    known = {c: (v, e) for c, v, e in zip(*(later.column(c).to_pylist() for c in ("conv", "value", "edge")), strict=True)}
    firm, initials, late = (rows.column(c).to_pylist() for c in ("firm", "initial", "truncated"))
    options: list[list[str]] = [["D0"] for _ in firm]  # letters and the state after them, for each state before the cut
    endings: list[list[str] | None] = [None] * len(firm)
    exits: list[list[int] | None] = [None] * len(firm)
    for conv, a, b in _runs(rows):
        after, last = known.get(conv, (END_COSTS, True))
        at = [i for i in range(a, b) if firm[i]]
        of = [(initials[i], late[i]) for i in at]
        found = [cheapest(of, state, after) for state in (range(4) if conv in known else (0,))]
        options[a:b] = [["D0"] * len(found) for _ in range(a, b)]
        for k, i in enumerate(at):
            options[i] = [f"{x[k][0]}{x[k][1]}" for x, _ in found]
        if conv in known:
            exits[b - 1] = [q for _, q in found]
        if last:
            endings[b - 1] = [ENDS[q] for _, q in found]
    for name, values, kind in (("options", options, pa.string()), ("endings", endings, pa.string()), ("exits", exits, pa.int64())):
        rows = rows.append_column(name, pa.array(values, pa.list_(kind)))
    return rows


def ordered(rows: DataFrame) -> DataFrame:
    """rows: (conv, turn, role, text, copies). Different rows with their faults, numbered in order, written to the shared folder."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    body = F.btrim("text", F.lit(SPACE_CHARS))
    same = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    rows = rows.withColumns({"blank": body == "", "truncated": ~F.right(body, F.lit(1)).isin(".", "!", "?"), "same": same, "place": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))})
    firsts = rows.where("not blank").groupBy(F.col("conv").alias("c"), F.col("same").alias("s")).agg(F.min("place").alias("least"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    rows = rows.withColumn("firm", ~F.col("blank") & (F.col("least").isNull() | (F.col("place") == F.col("least"))))
    rows = rows.select("conv", "turn", "role", "text", "copies", "blank", "truncated", "firm", F.substring("role", 1, 1).alias("initial"))
    rows = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, SORTED_BY)).sortWithinPartitions("conv", "turn", "role", "text")
    return stored(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")


def edits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows: (conv, turn, role, text, copies). Rows (conv, pos, turn, role, text, copies, initial, blank, truncated, firm, before, edit, after, role_after).

    edit is K, R or D, for the first of the copies (the others go); before and after hold a letter I for
    each row that is inserted there. firm: neither blank nor a duplicate.
    """
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = ordered(rows).withColumn("block", F.expr(f"pos div {block}"))
    key = f"block long, conv {of['conv']}"
    narrow = rows.select("block", "conv", "pos", "firm", "initial", "truncated")
    cuts = stored(narrow.groupBy("block").applyInArrow(_cuts, f"{key}, m array<long>"), "cuts")
    later = stored(_streamed(cuts, END_COSTS, _back, f"{key}, value array<long>, edge boolean", back=True), "later")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "options array<string>, endings array<string>, exits array<long>"])
    out = stored(rows.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(_settled, schema), "edits")
    ends = out.where("exits is not null").select("block", "conv", "exits")
    states = _streamed(ends, 0, lambda state, exits: exits[state], f"{key}, value long, edge boolean")
    states = stored(states.select(F.col("block").alias("b"), F.col("conv").alias("c"), "value"), "states")
    out = out.join(states, (F.col("block") == F.col("b")) & F.col("conv").eqNullSafe(F.col("c")), "left")
    which = F.coalesce("value", F.lit(0)).cast("int")
    letters = F.get("options", which)
    edit, state = F.substring(letters, -2, 1), F.right(letters, F.lit(1))
    role = F.when(edit == "K", F.col("role")).when(edit == "R", F.when(state == "2", "user").otherwise("assistant"))
    return out.select("conv", "pos", "turn", "role", "text", "copies", "initial", "blank", "truncated", "firm", F.when(F.length(letters) == 3, "I").otherwise("").alias("before"), edit.alias("edit"), F.coalesce(F.get("endings", which), F.lit("")).alias("after"), role.alias("role_after"))


def with_lines(rows: DataFrame) -> DataFrame:
    """rows of edits, with the repaired rows (role, text) that each leaves as lines."""
    empty = lambda role: F.struct(F.lit(role).alias("role"), F.lit("").alias("text"))
    none = F.array().cast("array<struct<role: string, text: string>>")
    user_next = F.substring("role_after", 1, 1) == "u"
    before = F.when(F.col("before") == "", none).when(user_next, F.array(empty("assistant"))).otherwise(F.array(empty("user")))
    own = F.when(F.col("edit") == "D", none).otherwise(F.array(F.struct(F.col("role_after").alias("role"), F.col("text"))))
    after = F.when(F.col("after") == "II", F.array(empty("user"), empty("assistant"))).when(F.col("after") == "I", F.array(empty("assistant"))).otherwise(none)
    return rows.withColumn("lines", F.concat(before, own, after))


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows: (conv, turn, role, text, copies). Rows (conv, pos, nth, role, text): the repaired conversations, in order of pos and nth."""
    out = with_lines(edits(rows, block)).select("conv", "pos", F.posexplode("lines").alias("nth", "line"))
    return out.select("conv", "pos", "nth", "line.role", "line.text")


def digests(rows: DataFrame) -> DataFrame:
    """rows of edits. A row for each conversation that has any: its faults, cost, audit and the hash of its repaired rows.

    A conversation's rows go through a task as a stream, in order; of it, only the audit is held.
    """
    conv = rows.schema["conv"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def fresh(c):
        return {"conv": c, **dict.fromkeys(names, 0), "audit": [], "sha": hashlib.sha256(), "empty": True, "turn": None, "last": None}

    def add(x, turn, copies, initial, blank, late, firm, before, edit, after, lines):
        if turn is not None and turn != x["turn"]:
            x["gaps"] += turn - x["turn"] - 1 if x["turn"] is not None else 0
            x["turn"] = turn
        x["blank"] += copies * blank
        x["duplicate"] += (copies - firm) * (not blank)
        x["truncated"] += firm and late
        x["illegal"] += copies - 1 + (x["last"] is not None and x["last"] + initial not in ("su", "ua", "au"))
        x["last"] = initial
        inserted = len(before) + len(after)
        x["cost"] += INSERT * inserted + DELETE * (copies - 1 + (edit == "D")) + REROLE * (edit == "R") + TRUNCATED * (edit != "D" and late)
        x["audit"].append(f"{before}{edit}{'D' * (copies - 1)}{after}")
        for line in lines:
            x["sha"].update((("" if x["empty"] else "\n") + f"{line['role']}:{line['text']}").encode())
            x["empty"] = False

    def out(done):
        columns = [pa.array([x["conv"] for x in done], arrow_conv[0]), *(pa.array([x[c] for x in done], pa.int64()) for c in names)]
        texts = [["".join(x["audit"]) for x in done], [x["sha"].hexdigest() for x in done]]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(t, pa.string()) for t in texts)], names=["conv", *names, "audit", "repaired_sha256"])

    arrow_conv: list = []

    def digested(batches):
        now = None
        for batch in batches:
            arrow_conv[:] = [batch.schema.field(0).type]
            done = []
            for c, *values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or now["conv"] != c:
                    done += [now] if now else []
                    now = fresh(c)
                add(now, *values)
            if done:
                yield out(done)
        if now:
            yield out([now])

    held = with_lines(rows).select("conv", "pos", F.col("turn").cast("long"), "copies", "initial", "blank", "truncated", "firm", "before", "edit", "after", "lines")
    held = held.repartition("conv").sortWithinPartitions("conv", "pos").drop("pos")
    return held.mapInArrow(digested, f"conv {conv}, {', '.join(f'{c} long' for c in names)}, audit string, repaired_sha256 string")


def spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, copies) of conversations (conv_id, turn, role, text), damaged by the hash of conversation and turn."""
    kind = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn")))) % 20
    role, text = spaced(F.col("role")), spaced(F.col("text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.where(kind != 0)
    return rows.select(F.col("conv_id").alias("conv"), "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = digests(edits(damaged(rows)))
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
