"""Repair of conversation structure at the least cost, with an audit of the edits.

A conversation is right if its roles' initials read `(s?(ua)+)?`. Rows may be kept (K, 0), given the role user or assistant (R, 3), or deleted
(D, 4; blank rows and duplicates must be), and rows without text inserted (I, 3); a truncated row that stays costs 3 more.

The edits are a weighted automaton with four states (nothing yet, after s, u, a). It is determinised as needed: the costs of the four states, less the
smallest and without those that cannot win, are a state of the deterministic automaton, and a table keeps where each such state goes
on each kind of row. So one look-up per row gives the cost. A trace backwards keeps the states that tight arcs (arcs whose cost
explains the difference) join to the end; forwards through these the least letter is taken, which is the cheapest audit that is least in ASCII.

Rows are sorted by conversation and turn over all tasks, so a conversation of any length is spread. Conversations inside one task are solved
there. Others are cut into blocks of at most BLOCK rows or BLOCK_BYTES of text: a block is a matrix of costs from state to state; costs run forwards over the
matrices, tight states backwards, and the chosen state forwards again, over one narrow row per block; then every block
is edited on its own. Duplicates of earlier turns are marked by narrow rows that sort in front of them.

Defined cases: rows of one turn stand by role, the first 64 characters of the text, and its SHA-256; equal rows are duplicates of the
first; null turns come first and count in no gap; turns are whole numbers; a null role or text is one space; a role whose first letter is
not s, u or a (or that is empty) fits nowhere as it is; a null identifier is a conversation; further columns do not matter; an empty table
gives an empty result; turns and texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import sha256_hex

BLOCK, BLOCK_BYTES = 1024, 1 << 20
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_INITIALS = "sua"
#: Kinds of rows in a symbol (kind * 4 + initial).
_FINE, _CUT_OFF, _BLANK, _COPY = range(4)
_START, _S, _U, _A = range(4)
_NEVER = 1 << 20
_SPACE = " \t\n\x0b\x0c\r"
#: State after a row of an initial: nothing for what the pattern does not allow there.
_NEXT = {(_START, 0): _S, (_START, 1): _U, (_S, 1): _U, (_A, 1): _U, (_U, 2): _A}
_LEGAL = {(0, 1), (1, 2), (2, 1)}

Vector = tuple[int, int, int, int]


def _follows(q: int) -> int:
    """The one state that a row of a free role leads to."""
    return _A if q == _U else _U


class Automaton:
    """The deterministic automaton, made state by state as rows ask for it."""

    def __init__(self):
        self.steps: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self.backs: dict[tuple[Vector, int, int], int] = {}
        self.choices: dict[tuple[Vector, int, int, int, int], tuple[str, int]] = {}

    @staticmethod
    def closed(costs: list[int]) -> tuple[Vector, int]:
        """(state, smallest cost): insertions worked in, what cannot win left out, the smallest cost taken off."""
        none, s, u, a = costs
        u = min(u, none + INSERT, s + INSERT, a + INSERT)
        a = min(a, u + INSERT)
        if none > a + DELETE:  # whatever begins from nothing can begin after a, for at most one deleted s more
            none = _NEVER
        if s > a:
            s = _NEVER
        least = min(none, s, u, a)
        return tuple(x - least if x < _NEVER else _NEVER for x in (none, s, u, a)), least  # type: ignore[return-value]

    @staticmethod
    def arcs(q: int, symbol: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, next state) of a row, in the order of the letters."""
        kind, initial = divmod(symbol, 4)
        yield "D", DELETE, q
        if kind in (_FINE, _CUT_OFF):
            more = TRUNCATED if kind == _CUT_OFF else 0
            if (q, initial) in _NEXT:
                yield "K", KEEP + more, _NEXT[q, initial]
            yield "R", RENAME + more, _follows(q)

    def step(self, v: Vector, symbol: int) -> tuple[Vector, int]:
        got = self.steps.get((v, symbol))
        if got is None:
            costs = [_NEVER] * 4
            for q in range(4):
                if v[q] < _NEVER:
                    for _, w, to in self.arcs(q, symbol):
                        costs[to] = min(costs[to], v[q] + w)
            got = self.steps[v, symbol] = self.closed(costs)
        return got

    @staticmethod
    def _insertable(v: Vector, q: int, mask: int) -> bool:
        to = _follows(q)
        return bool(mask >> to & 1) and v[q] + INSERT == v[to]

    def _with_inserts(self, v: Vector, mask: int) -> int:
        for _ in range(2):
            for q in range(4):
                if v[q] < _NEVER and self._insertable(v, q, mask):
                    mask |= 1 << q
        return mask

    def end(self, v: Vector) -> tuple[int, int]:
        """(cost of ending here, the states of cheapest ends)."""
        cost = min(v[_START], v[_A])
        return cost, self._with_inserts(v, sum(1 << q for q in (_START, _A) if v[q] == cost))

    def back(self, v: Vector, symbol: int, mask: int) -> int:
        """The states before a row from which tight arcs lead into mask."""
        got = self.backs.get((v, symbol, mask))
        if got is None:
            after, least = self.step(v, symbol)
            own = sum(1 << q for q in range(4) if v[q] < _NEVER and any(mask >> to & 1 and v[q] + w == after[to] + least for _, w, to in self.arcs(q, symbol)))
            got = self.backs[v, symbol, mask] = self._with_inserts(v, own)
        return got

    def choose(self, v: Vector, symbol: int, before: int, mask: int, q: int) -> tuple[str, int]:
        """(letters up to the row's own, state after it): the least among tight arcs."""
        got = self.choices.get((v, symbol, before, mask, q))
        if got is None:
            after, least = self.step(v, symbol)
            letters, now = "", q
            while True:
                tight = {e: to for e, w, to in self.arcs(now, symbol) if mask >> to & 1 and v[now] + w == after[to] + least}
                if self._insertable(v, now, before):
                    tight["I"] = _follows(now)
                if not tight:
                    got = "", -1  # q is not on a cheapest way; nobody asks for it in the end
                    break
                letter = min(tight)
                letters, now = letters + letter, tight[letter]
                if letter != "I":
                    got = letters, now
                    break
            self.choices[v, symbol, before, mask, q] = got
        return got

    def tail(self, v: Vector, q: int) -> str:
        """Insertions after the last row."""
        cost, mask = self.end(v)
        letters = ""
        while not (q in (_START, _A) and v[q] == cost):
            if not self._insertable(v, q, mask):
                raise ValueError("not a cheapest way")
            letters, q = letters + "I", _follows(q)
        return letters

    # ------------------------------------------------------------ whole blocks

    def scan(self, v: Vector, symbols: bytes) -> tuple[list[Vector], int]:
        """The states before each row and after the last, and what the rows cost."""
        states, spent = [v], 0
        for x in symbols:
            v, w = self.step(v, x)
            states.append(v)
            spent += w
        return states, spent

    def masks(self, states: list[Vector], symbols: bytes, mask: int) -> list[int]:
        out = [mask]
        for v, x in zip(states[-2::-1], reversed(symbols)):
            out.append(mask := self.back(v, x, mask))
        return out[::-1]

    def letters(self, states: list[Vector], symbols: bytes, masks: list[int], q: int) -> tuple[list[str], int]:
        out = []
        for v, x, before, mask in zip(states, symbols, masks, masks[1:]):
            if q < 0:
                return out, q
            one, q = self.choose(v, x, before, mask, q)
            out.append(one)
        return out, q


FIRST, _ = Automaton.closed([0, _NEVER, _NEVER, _NEVER])


def edited(letters: list[str], roles: list[str], texts: list[str], q: int) -> Iterator[dict]:
    """The rows that edits make of rows; letters may go on behind the last row."""
    for k, own in enumerate(letters):
        for letter in own:
            if letter == "D":
                continue
            free = "assistant" if q == _U else "user"
            if letter == "I":
                yield {"role": free, "text": ""}
            else:
                yield {"role": free if letter == "R" else roles[k], "text": texts[k]}
            q = _NEXT[q, _INITIALS.index(roles[k][:1])] if letter == "K" else _follows(q)


def _audited(machine: Automaton, symbols: bytes, roles: list[str], texts: list[str], v: Vector, q: int, mask: int | None) -> tuple[str, list[dict], int]:
    """(audit, repaired rows, cost of the rows) of a block; with no mask it is the last one."""
    states, spent = machine.scan(v, symbols)
    if mask is None:
        cost, end = machine.end(states[-1])
        letters, to = machine.letters(states, symbols, machine.masks(states, symbols, end), q)
        letters, spent = [*letters, machine.tail(states[-1], to)], spent + cost
    else:
        letters, _ = machine.letters(states, symbols, machine.masks(states, symbols, mask), q)
    return "".join(letters), list(edited(letters, roles, texts, q)), spent


# ---------------------------------------------------------------- blocks

_ROWS = "array<struct<role:string,text:string>>"
_STATS = "n_turns long, first_turn long, last_turn long, illegal long"
_PIECE = f"part int, block int, alone boolean, symbols binary, roles array<string>, texts array<string>, {_STATS}, first_key binary, last_key binary, cost long, audit string, rows {_ROWS}"


class _Block:
    """Rows of one conversation while a task reads them."""

    def __init__(self, conv, alone: bool):
        self.conv, self.alone = conv, alone
        self.symbols, self.roles, self.texts, self.bytes = bytearray(), [], [], 0
        self.n_turns, self.first_turn, self.last_turn, self.illegal = 0, None, None, 0
        self.first_key = self.last_key = None

    def add(self, turn, role: str, text: str, symbol: int) -> None:
        if self.symbols and (self.symbols[-1] & 3, symbol & 3) not in _LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.symbols.append(symbol)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(role) + len(text)

    def row(self, machine: Automaton, part: int, number: int, alone: bool) -> dict:
        out = {"conv": self.conv, "part": part, "block": number, "alone": alone, "symbols": bytes(self.symbols), "first_key": self.first_key, "last_key": self.last_key}
        out |= {k: getattr(self, k) for k in ("n_turns", "first_turn", "last_turn", "illegal")}
        if alone:
            audit, rows, cost = _audited(machine, bytes(self.symbols), self.roles, self.texts, FIRST, _START, None)
            return out | {"roles": None, "texts": None, "cost": cost, "audit": audit, "rows": rows}
        return out | {"roles": self.roles, "texts": self.texts, "cost": None, "audit": None, "rows": None}


def _packed(schema: pa.Schema, block_rows: int, block_bytes: int):
    """Sorted rows to blocks; conversations that begin and end inside the task and fit one block are solved at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, machine, number = TaskContext.get().partitionId(), Automaton(), 0
        block: _Block | None = None
        before = marked = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "symbol", "key")]
            for conv, turn, role, text, symbol, key in zip(*columns):
                fresh = block is None or conv != block.conv
                full = not fresh and len(block.symbols) > 0 and (len(block.symbols) >= block_rows or block.bytes >= block_bytes)
                if fresh or full:
                    if block is not None:
                        out.append(block.row(machine, part, number, block.alone and not full))
                        number += 1
                    block = _Block(conv, fresh and block is not None)
                    before, marked = (before, marked) if full else (None, None)
                    block.first_key = key
                block.last_key = key
                if symbol < 0:  # what follows with this key repeats an earlier turn
                    marked = before = key
                    continue
                if symbol >> 2 != _BLANK and key in (before, marked):
                    symbol = _COPY << 2 | symbol & 3
                before = key
                block.add(turn, role, text, symbol)
            yield pa.RecordBatch.from_pylist(out, schema)
        if block is not None:
            yield pa.RecordBatch.from_pylist([block.row(machine, part, number, False)], schema)

    return run


def _rows_to_rows(function: Callable, schema: pa.Schema):
    """An Arrow function from one on dicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = function()
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for x in batch.to_pylist() for r in each(x)], schema)
        if hasattr(each, "last"):
            yield pa.RecordBatch.from_pylist(list(each.last()), schema)

    return run


class _Matrix:
    """Costs of a block from each state to each state."""

    def __init__(self):
        self.machine = Automaton()

    def __call__(self, x: dict):
        ends = []
        for q in range(4):
            v, least = Automaton.closed([0 if k == q else _NEVER for k in range(4)])
            states, spent = self.machine.scan(v, x["symbols"])
            ends += [c + least + spent if c < _NEVER else _NEVER for c in states[-1]]
        yield x | {"ends": ends}


class _Costs:
    """Forwards over the blocks of a conversation: the state that each is entered in, and the cost at the end."""

    def __init__(self):
        self.conv, self.begun = None, False

    def __call__(self, x: dict):
        if not self.begun or x["conv"] != self.conv:
            self.conv, self.begun, self.v, self.spent = x["conv"], True, FIRST, 0
        enter = list(self.v)
        costs = [min(self.v[q] + x["ends"][4 * q + to] for q in range(4)) for to in range(4)]
        self.v, least = Automaton.closed([min(c, _NEVER) for c in costs])
        self.spent += least
        yield {k: x[k] for k in ("conv", "part", "block", "symbols")} | {"enter": enter, "leave": list(self.v), "total": self.spent + self.machine_end(self.v)}

    @staticmethod
    def machine_end(v: Vector) -> int:
        return min(v[_START], v[_A])


class _Ways:
    """For every set of states behind a block: the set before it, and where each state goes."""

    def __init__(self):
        self.machine = Automaton()

    def __call__(self, x: dict):
        v, symbols = tuple(x["enter"]), x["symbols"]
        states, _ = self.machine.scan(v, symbols)
        begins, goes = [], []
        for mask in range(16):
            masks = self.machine.masks(states, symbols, mask)
            begins.append(masks[0])
            goes += [self.machine.letters(states, symbols, masks, q)[1] if masks[0] >> q & 1 else -1 for q in range(4)]
        yield {k: x[k] for k in ("conv", "part", "block", "enter", "leave", "total")} | {"begins": begins, "goes": goes}


class _Tight:
    """Backwards over the blocks: the tight states behind each."""

    def __init__(self):
        self.conv, self.begun = None, False

    def __call__(self, x: dict):
        last = not self.begun or x["conv"] != self.conv
        if last:
            self.conv, self.begun, self.mask = x["conv"], True, Automaton().end(tuple(x["leave"]))[1]
        yield {k: x[k] for k in ("conv", "part", "block", "enter", "total", "goes")} | {"mask": self.mask, "last": last}
        self.mask = x["begins"][self.mask]


class _Chosen:
    """Forwards again: the state in which the chosen edits enter each block."""

    def __init__(self):
        self.conv, self.begun = None, False

    def __call__(self, x: dict):
        if not self.begun or x["conv"] != self.conv:
            self.conv, self.begun, self.q = x["conv"], True, _START
        yield {k: x[k] for k in ("part", "block", "enter", "total", "mask", "last")} | {"q": self.q}
        self.q = x["goes"][4 * x["mask"] + self.q]


class _Edited:
    """The audit and rows of a block whose entrance and tight states are known."""

    def __init__(self):
        self.machine = Automaton()

    def __call__(self, x: dict):
        audit, rows, _ = _audited(self.machine, x["symbols"], x["roles"], x["texts"], tuple(x["enter"]), x["q"], None if x["last"] else x["mask"])
        keep = ("conv", "part", "block", "symbols", "n_turns", "first_turn", "last_turn", "illegal")
        yield {k: x[k] for k in keep} | {"cost": x["total"] if x["last"] else 0, "audit": audit, "rows": rows}


def _schema(spark: SparkSession, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind))


def _each(df: DataFrame, function: Callable, kind: str) -> DataFrame:
    return df.mapInArrow(_rows_to_rows(function, _schema(df.sparkSession, kind)), kind)


def _over_blocks(df: DataFrame, function: Callable, kind: str, forwards: bool = True) -> DataFrame:
    """Along the blocks of each conversation, one narrow row at a time."""
    order = [F.col(c).asc() if forwards else F.col(c).desc() for c in ("part", "block")]
    return _each(df.repartition("conv").sortWithinPartitions("conv", *order), function, kind)


# ---------------------------------------------------------------- conversations


def _symbol(role: Column, bare: Column) -> Column:
    """Kind and initial of a row from its role and its text without white space at the end."""
    kind = F.when(bare == "", _BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), _FINE).otherwise(_CUT_OFF)
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return (kind * 4 + initial).cast("int")


def _in_order(turns: DataFrame) -> DataFrame:
    """Rows with symbols and the marks of repeated turns, sorted over all tasks."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    keyed = turns.withColumns({"start": F.substring("text", 1, 64), "digest": F.unhex(sha256_hex(F.col("text")))})
    narrow = keyed.select("conv", "turn", "role", "start", "digest").distinct()
    when = F.struct(F.col("turn").isNotNull(), "turn")
    several = narrow.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = narrow.join(several, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))).filter(when > F.col("first"))
    marks = again.select("conv", "turn", "role", "start", "digest", F.lit("").alias("text"), F.lit(-1).alias("symbol"), F.lit(-1).alias("salt"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int")  # rows that are equal may lie in several tasks
    rows = keyed.select("conv", "turn", "role", "start", "digest", "text", _symbol(F.col("role"), bare).alias("symbol"), salt.alias("salt"))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit("|"), F.hex("digest"), F.lit("|"), "role"), 256))
    return rows.unionByName(marks).orderBy("conv", "turn", "role", "start", "digest", "salt").select("conv", "turn", "role", "text", "symbol", key.alias("key"))


def _repeated_at_edges(edges: DataFrame) -> list[int]:
    """Tasks whose first row equals what the task before ended with; two rows per task reach the driver."""
    out, last = [], None
    for r in sorted(edges.select("part", "block", F.struct("conv", "first_key").alias("begin"), F.struct("conv", "last_key").alias("end")).collect(), key=lambda r: (r.part, r.block)):
        if r.block == 0 and last is not None and r.begin == last:
            out.append(r.part)
        last = r.end
    return out


def _first_again(again: list[int]):
    """Symbols of blocks: the first row of the named tasks' first blocks is a duplicate."""

    def each():
        def one(x: dict):
            s = x["symbols"]
            if x["block"] == 0 and x["part"] in again and s and s[0] >> 2 != _BLANK:
                x = x | {"symbols": bytes([_COPY << 2 | s[0] & 3]) + s[1:]}
            yield x

        return one

    return each


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pieces of repaired conversations: conv, part, block (their order), alone (the only piece), symbols (kind and initial of each row that came in),
    n_turns, first_turn, last_turn, illegal, cost (of the conversation, with its last piece), audit, rows (role and text of those that stay or are new)."""
    spark = turns.sparkSession
    scratch = Scratch(spark, "repair")
    own = turns.select(F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    conv = f"conv {own.schema['conv'].dataType.simpleString()}"
    packed = _in_order(own).mapInArrow(_packed(_schema(spark, f"{conv}, {_PIECE}"), block_rows, block_bytes), f"{conv}, {_PIECE}")
    pieces = scratch.write(packed, "pieces")
    cut = pieces.filter("not alone")
    window = F.col("block") == 0
    ends = cut.groupBy("part").agg(F.max("block").alias("block"))
    edges = cut.join(ends, ["part", "block"], "left_semi").unionByName(cut.filter(window)).select("part", "block", "conv", "first_key", "last_key").distinct()
    again = _repeated_at_edges(edges)
    blocks = cut.select("conv", "part", "block", "symbols")
    if again:
        blocks = _each(blocks, _first_again(again), f"{conv}, part int, block int, symbols binary")
    blocks = scratch.write(blocks, "blocks")
    head, numbers = f"{conv}, part int, block int", "array<int>"
    matrices = _each(blocks, _Matrix, f"{head}, symbols binary, ends {numbers}")
    entered = _over_blocks(matrices, _Costs, f"{head}, symbols binary, enter {numbers}, leave {numbers}, total long")
    ways = _each(entered.repartition("part", "block"), _Ways, f"{head}, enter {numbers}, leave {numbers}, total long, begins {numbers}, goes {numbers}")
    tight = _over_blocks(ways, _Tight, f"{head}, enter {numbers}, total long, goes {numbers}, mask int, last boolean", forwards=False)
    chosen = _over_blocks(tight, _Chosen, f"part int, block int, enter {numbers}, total long, mask int, last boolean, q int")
    met = cut.drop("symbols", "cost", "audit", "rows").join(blocks.drop("conv"), ["part", "block"]).join(chosen, ["part", "block"])
    columns = f"{head}, symbols binary, {_STATS}, cost long, audit string, rows {_ROWS}"
    solved = _each(met, _Edited, columns)
    names = ["conv", "part", "block", "alone", "symbols", "n_turns", "first_turn", "last_turn", "illegal", "cost", "audit", "rows"]
    return pieces.filter("alone").select(*names).unionByName(solved.withColumn("alone", F.lit(False)).select(*names)).withColumnRenamed("conv", id_col)


class _Summed:
    """One row per conversation from its pieces in order; the digest runs on, so no conversation is held."""

    def __init__(self):
        self.begun = False

    def __call__(self, x: dict):
        if not self.begun or x["conv"] != self.conv:
            yield from self.last()
            self.begun, self.conv, self.digest, self.sep = True, x["conv"], hashlib.sha256(), ""
            self.sums, self.audit, self.turns, self.least, self.most, self.before = [0] * 5, [], 0, None, None, None
        kinds = [s >> 2 for s in x["symbols"]]
        adds = [kinds.count(_BLANK), kinds.count(_COPY), kinds.count(_CUT_OFF), x["illegal"], x["cost"]]
        self.sums = [a + b for a, b in zip(self.sums, adds)]
        if x["symbols"]:
            if self.before is not None and (self.before, x["symbols"][0] & 3) not in _LEGAL:
                self.sums[3] += 1
            self.before = x["symbols"][-1] & 3
        if x["n_turns"]:
            self.turns += x["n_turns"] - (x["first_turn"] == self.most)
            self.least = x["first_turn"] if self.least is None else self.least
            self.most = x["last_turn"]
        self.audit.append(x["audit"])
        for r in x["rows"]:
            self.digest.update(f"{self.sep}{r['role']}:{r['text']}".encode())
            self.sep = "\n"

    def last(self):
        if self.begun:
            gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
            yield dict(zip(("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), (self.conv, gaps, *self.sums, "".join(self.audit), self.digest.hexdigest())))


def report(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation of repair()."""
    pieces = pieces.withColumnRenamed(id_col, "conv")
    conv = f"conv {pieces.schema['conv'].dataType.simpleString()}"
    kind = f"{conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    whole = _each(pieces.filter("alone"), _Summed, kind)
    return whole.unionByName(_over_blocks(pieces.filter("not alone"), _Summed, kind)).withColumnRenamed("conv", id_col)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults drawn by identifier and turn: dropped, emptied, without stops, repeated, of role user."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = turns.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(role).alias("role"), F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), draw.alias("draw"))
    return rows.filter("draw <> 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = report(repair(damage(turns)))
    every = turns.select(F.col("conv_id").alias("c")).distinct()
    counts = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _sql() -> str:
    """Recursion along each conversation with the best (cost, audit, lines) of each state; CRC-32 bit by bit."""

    def best(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def then(state: str, cost: str, letter: str, line: str | None = None) -> str:
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"{{c: {state}.c + {cost}, a: {state}.a || '{letter}', t: {lines}}}"

    def when(test: str, option: str) -> str:
        return f"CASE WHEN {test} THEN {option} ELSE {never} END"

    never = "{c: 1000000000::BIGINT, a: '', t: []::VARCHAR[]}"
    user, assistant, own = "'user:'", "'assistant:'", "r.role || ':' || r.text"
    put = lambda state, line: then(state, "3", "I", line)
    closed = f"(SELECT conv, i, n0, s0, {best('u1', put('a1', user))} AS u0, a1 AS a0 FROM (SELECT *, {best('a', put('u1', assistant))} AS a1 FROM (SELECT conv, i, n AS n0, s AS s0, a, {best('u', put('n', user), put('s', user), put('a', user))} AS u1 FROM walk)))"
    stays, more = "r.kind < 2", "(CASE WHEN r.kind = 1 THEN 3 ELSE 0 END)"

    def moved(state: str, free: str, sources: list[str], initial: str | None) -> str:
        options = [then(state, "4", "D")]
        for q in sources:
            if initial:
                options.append(when(f"{stays} AND r.initial = '{initial}'", then(q, more, "K", own)))
            if free:
                options.append(when(stays, then(q, f"3 + {more}", "R", f"'{free}:' || r.text")))
        return best(*options)

    return f"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
drawn AS (SELECT *, xor(list_reduce(list_transform(range(8 * length(name)), lambda k: ((ascii(name[k // 8 + 1]) >> (k % 8)) & 1)::BIGINT), lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b)), 4294967295::BIGINT), 4294967295) % 20 AS draw FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
kinds AS (SELECT conv_id AS conv, i, turn, role, text, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 1 END AS kind,
  coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
walk AS (SELECT conv_id AS conv, 0::BIGINT AS i, {{c: 0::BIGINT, a: '', t: []::VARCHAR[]}} AS n, {never} AS s, {never} AS u, {never} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv, r.i, {moved('n0', '', [], None)}, {moved('s0', '', ['n0'], 's')}, {moved('u0', 'user', ['n0', 's0', 'a0'], 'u')}, {moved('a0', 'assistant', ['u0'], 'a')}
  FROM {closed} AS w JOIN kinds AS r USING (conv) WHERE r.i = w.i + 1),
done AS (SELECT conv, {best('n0', 'a0')} AS e FROM {closed} QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1),
counted AS (SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE kind = 2) AS blank, count(*) FILTER (WHERE kind = 3) AS duplicate, count(*) FILTER (WHERE kind = 1) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM kinds GROUP BY conv)
SELECT d.conv AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.c AS cost, e.a AS audit, sha256(array_to_string(e.t, chr(10))) AS repaired_sha256
FROM done d LEFT JOIN counted k USING (conv)"""


SQL = _sql()
