"""Conversation structure repair by weighted CYK interval parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its repair grammar is in Chomsky normal
form: a nonterminal is a pair of states (p, q) and derives what leads the automaton of well-formed conversations
from p to q; binary rules are (p, r) -> (p, q) (q, r), terminal rules are the edits of one row (keep, rerole,
delete). A cell of the chart is an interval of rows and holds, for each nonterminal, the least (cost, audit)
of its derivations; audits spell the edits. Cells are closed under insertions on both sides. Equal cost means equally many
inserted turns, so no audit of a cell is a prefix of another and the least one of a concatenation is that of least parts.

Spans of up to ``BLOCK`` rows fill a whole chart, bottom-up by span length over all splits. Longer spans are
put together from those, doubling the length level by level: every derivation of (p, r) over a span visits some
state q at any given split, so one split of a span has its minimum. A long conversation is thus parsed in
pieces of bounded size in many tasks, and the pieces' cells meet in rounds.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_side, join_hot, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a span whose chart is filled with all splits, and cells of spans that a worker remembers.
BLOCK = 8
CACHE_CELLS = 200_000
#: Rows of a conversation parsed in one piece, and pieces whose cells meet in a task of a round.
PIECE_ROWS = 4096
FAN_IN = 64
#: Counted repeated rows up to which they are broadcast (about 40 bytes each).
REPEATS_BROADCAST = 400_000
#: Rows of a repeated turn from which on they are joined where they lie.
HOT_REPEATS = 10_000
_BLANK = r"[^\x20\x09-\x0D]"
_ENDS_WELL = r"[.!?][\x20\x09-\x0D]*\z"

# states: nothing yet, a system turn, after a user's turn, after an assistant's
_START, _SYSTEM, _USER, _DONE = range(4)
_MOVES = {"s": ((_START, _SYSTEM),), "u": ((_START, _USER), (_SYSTEM, _USER), (_DONE, _USER)), "a": ((_USER, _DONE),)}
_REACH = {_START: (_START, _SYSTEM, _USER, _DONE), _SYSTEM: (_SYSTEM, _USER, _DONE), _USER: (_USER, _DONE), _DONE: (_DONE, _USER)}
NONTERMINALS = [(p, q) for p in _REACH for q in _REACH[p]]
_NUMBER = {pair: k for k, pair in enumerate(NONTERMINALS)}
#: For each nonterminal (p, r), the pairs of nonterminals (p, q), (q, r) it derives.
RULES = [[(_NUMBER[p, q], _NUMBER[q, r]) for q in _REACH[p] if (q, r) in _NUMBER] for p, r in NONTERMINALS]
_ACCEPT = (_NUMBER[_START, _START], _NUMBER[_START, _DONE])

INITIALS = "sua"
#: A row's kind is one letter: four for each initial (s, u, a, another), of which these faults are the first to fourth.
FAULTS = ("none", "blank", "duplicate", "truncated")
Cell = tuple[tuple[int, str], ...]


def _combine(left: Cell, right: Cell) -> Cell:
    out = []
    for rules in RULES:
        least, same = None, []
        for i, j in rules:
            cost = left[i][0] + right[j][0]
            if least is None or cost < least:
                least, same = cost, [(i, j)]
            elif cost == least:
                same.append((i, j))
        out.append((least, min([left[i][1] + right[j][1] for i, j in same])))
    return tuple(out)


def _empty() -> Cell:
    """Cells of an interval without rows: inserted turns only, as few as lead from one state to the other."""
    never = (1 << 40, "")
    cell = [(0, "") if p == q else (INSERT, "I") if any((p, q) in _MOVES[x] for x in "ua") else never for p, q in NONTERMINALS]
    return tuple(min(cell[k], *[(cell[i][0] + cell[j][0], cell[i][1] + cell[j][1]) for i, j in RULES[k]]) for k in range(len(cell)))


_NOTHING = _empty()


def _terminal(kind: str) -> Cell:
    """Cells of one row, closed under insertions before and after it."""
    initial, fault = divmod(ord(kind) - 65, len(FAULTS))
    never = (1 << 40, "")
    cell = [(DELETE, "D") if p == q else never for p, q in NONTERMINALS]
    if FAULTS[fault] not in ("blank", "duplicate"):
        price = TRUNCATED if FAULTS[fault] == "truncated" else 0
        for role in INITIALS:
            if initial < len(INITIALS) and role == INITIALS[initial]:
                edit = (KEEP + price, "K")
            elif role in "ua":
                edit = (REROLE + price, "R")
            else:
                continue
            for move in _MOVES[role]:
                cell[_NUMBER[move]] = min(cell[_NUMBER[move]], edit)
    return _combine(_combine(_NOTHING, tuple(cell)), _NOTHING)


class Chart:
    """Cells by the kinds of the rows that they span; equal intervals, of any conversation, are parsed once."""

    def __init__(self):
        self.cells: dict[str, Cell] = {}

    def span(self, kinds: str) -> Cell:
        """The cell of up to BLOCK rows: all its intervals by growing length, each the minimum over all its splits."""
        cells = self.cells
        if kinds in cells:
            return cells[kinds]
        if len(cells) > CACHE_CELLS:
            cells.clear()
        for n in range(1, len(kinds) + 1):
            for start in range(len(kinds) - n + 1):
                part = kinds[start : start + n]
                if part not in cells:
                    split = [_combine(cells[part[:k]], cells[part[k:]]) for k in range(1, n)] if n > 1 else [_terminal(part)]
                    cells[part] = split[0] if len(split) == 1 else tuple(map(min, *split))
        return cells[kinds]

    def piece(self, kinds: str) -> Cell:
        return together([self.span(kinds[at : at + BLOCK]) for at in range(0, len(kinds), BLOCK)])


def together(cells: list[Cell]) -> Cell:
    """The cell of the whole of adjacent intervals, level by level of double length."""
    while len(cells) > 1:
        cells = [_combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else _NOTHING


def accepted(cell: Cell) -> tuple[int, str]:
    return min(cell[k] for k in _ACCEPT)


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


_CELLS = "conv_id long, seg long, ends string, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
_CELL_SCHEMA = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("ends", pa.string()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")], ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _parse_pieces(batches):
    chart = Chart()
    for batch in batches:
        rows = []
        for conv, seg, kinds in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            initials = "".join("suao"[(ord(k) - 65) // len(FAULTS)] for k in kinds)
            faults = [(ord(k) - 65) % len(FAULTS) for k in kinds]
            costs, audits = zip(*chart.piece(kinds), strict=True)
            rows.append((conv, seg, initials[0] + initials[-1], *(faults.count(f) for f in (1, 2, 3)), _illegal(initials), list(costs), list(audits)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _CELL_SCHEMA, strict=True)] if rows else [pa.array([], f.type) for f in _CELL_SCHEMA], schema=_CELL_SCHEMA)


def _meet(part: pa.Table) -> pa.Table:
    rows = sorted(part.to_pylist(), key=lambda r: r["seg"])
    cell = together([tuple(zip(r["costs"], r["audits"], strict=True)) for r in rows])
    seams = sum(_illegal(a["ends"][1] + b["ends"][0]) for a, b in zip(rows, rows[1:], strict=False))
    whole = {n: sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal")}
    whole["illegal"] += seams
    one = {"conv_id": rows[0]["conv_id"], "seg": rows[0]["seg"] // FAN_IN, "ends": rows[0]["ends"][0] + rows[-1]["ends"][1], **whole, "costs": [c for c, _ in cell], "audits": [a for _, a in cell]}
    return pa.Table.from_pylist([one], schema=_CELL_SCHEMA)


def _results(batches):
    schema = pa.schema([*list(_CELL_SCHEMA)[:1], *list(_CELL_SCHEMA)[3:7], ("cost", pa.int64()), ("audit", pa.string())])
    for batch in batches:
        found = [accepted(tuple(zip(c, a, strict=True))) for c, a in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(c) for c in range(3, 7)], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], schema=schema)


def parse_turns(turns: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost and audit of each conversation.

    ``turns`` has conv_id, turn, role and text, without nulls but in conv_id and turn. Rows are in order of turn
    (nulls first), ties by role, then by a digest of conversation, role and text. The rows
    are dealt by ranges, so a conversation may lie in many partitions; equal rows are spread by a salt.
    """
    role_class = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in INITIALS]), F.substring("role", 1, 1)) - 1, F.lit(-1))
    fault = F.when(~F.col("text").rlike(_BLANK), 1).when(~F.col("text").rlike(_ENDS_WELL), 3).otherwise(0)
    light = turns.select("conv_id", "turn", "role", same_turn().alias("same"), F.when(role_class < 0, 3).otherwise(role_class).cast("int").alias("initial"), fault.alias("fault"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("same")]
    light = light.withColumn("salt", F.rand(11)).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
    light = materialize(light.select("conv_id", "same", "initial", "fault", F.monotonically_increasing_id().alias("at")), "repair-turns")
    firsts = light.groupBy("same").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n_same")).where("n_same > 1")
    firsts = materialize(firsts, "repair-repeats")
    n_firsts = firsts.count()
    marked = light.join(checked_side(firsts, n_firsts, REPEATS_BROADCAST), "same", "left") if n_firsts <= REPEATS_BROADCAST else join_hot(light, firsts, "same", f"n_same > {HOT_REPEATS}", "left")
    fault = F.when((F.col("fault") != 1) & (F.col("at") > F.col("first_at")), 2).otherwise(F.col("fault"))
    kind = F.char((65 + len(FAULTS) * F.col("initial") + fault).cast("long"))
    pieces = marked.groupBy("conv_id", F.expr(f"at div {PIECE_ROWS}").alias("seg")).agg(F.array_sort(F.collect_list(F.struct("at", kind.alias("kind")))).alias("rows"))
    cells = pieces.select("conv_id", "seg", F.array_join(F.col("rows.kind"), "").alias("kinds")).mapInArrow(_parse_pieces, _CELLS)
    cells = materialize(cells, "repair-cells")
    done = []
    while True:
        # by a flag, not a join: a conversation in one piece is done
        many = cells.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pieces")).where("n_pieces > 1")
        many = materialize(many.select(F.col("conv_id").alias("of_conv")), "repair-long")
        n_many = many.count()
        if not n_many:
            done.append(cells)
            break
        of = cells["conv_id"].eqNullSafe(F.col("of_conv"))
        side = checked_side(many, n_many, REPEATS_BROADCAST)
        done.append(cells.join(side, of, "left_anti"))
        more = cells.join(side, of, "left_semi")
        cells = materialize(more.groupBy("conv_id", F.expr(f"seg div {FAN_IN}")).applyInArrow(_meet, _CELLS), "repair-cells")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.mapInArrow(_results, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def same_turn() -> Column:
    """Equal for turns of one conversation with equal role and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text").cast("binary")))


class Editing:
    """Applies an audit to the rows of a conversation, one at a time; gives (edit, role, text) of the turns that result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.odd = audit, 0, 0, (len(audit) - audit.count("D")) % 2

    def _turn(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.place += 1
        if edit != "K":  # roles alternate; an odd number of turns begins with the system's
            role = "user" if (self.place - self.odd) % 2 else "assistant"
        return edit, role, text

    def inserted(self):
        """Turns inserted before the next row, or at the end."""
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield self._turn("I", "", "")

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(edit, role, text)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPAIRED = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _edited(batches):
    """Rows sorted by conversation, each led by its header, to (header, turns); a header comes again, with None, at the end."""
    head, editing = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", *_COUNTS, "audit", "is_row", "role", "text")]
        for *values, is_row, role, text in zip(*columns, strict=True):
            if is_row:
                yield head, editing.row(role, text)
                continue
            if head is not None:
                yield head, editing.inserted()
                yield head, None
            head, editing = values, Editing(values[-1])
    if head is not None:
        yield head, editing.inserted()
        yield head, None


def _batches(rows, schema: pa.Schema):
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[-1] or "")
        if len(held) >= 4096 or chars > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _turn_rows(batches):
    def rows():
        place = 0
        for head, turns in _edited(batches):
            for edit, role, text in turns or ():
                place += 1
                yield head[0], place, edit, role, text
            if turns is None:
                place = 0

    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    yield from _batches(rows(), schema)


def _digest_rows(batches):
    def rows():
        digest, first = hashlib.sha256(), True
        for head, turns in _edited(batches):
            for _, role, text in turns or ():
                digest.update((("" if first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                first = False
            if turns is None:
                yield (*head, digest.hexdigest())
                digest, first = hashlib.sha256(), True

    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    yield from _batches(rows(), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n_rows, how many rows a row becomes (0: dropped, 2: repeated); by a checksum of its key."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return source.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("n_rows"))


def _with_audits(turns: DataFrame) -> DataFrame:
    """The rows of each conversation in order and before them a header with its counts and audit, in one partition."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n_rows")
    present = F.when(F.col("n_rows") > 0, F.col("turn"))
    stats = turns.groupBy("conv_id").agg(F.coalesce(F.max(present) - F.min(present) + 1 - F.countDistinct(present), F.lit(0)).cast("long").alias("gaps"))
    rows = turns.where("n_rows = 1").unionByName(turns.where("n_rows > 1").withColumn("n_rows", F.explode(F.sequence(F.lit(1), "n_rows"))))
    parsed = materialize(parse_turns(rows).select(F.col("conv_id").alias("of_conv"), *_COUNTS[1:], "audit"), "repair-parsed")
    heads = stats.join(parsed.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of_conv")), "left")
    heads = heads.select("conv_id", "gaps", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS[1:]], F.coalesce("audit", F.lit("")).alias("audit"), F.lit(False).alias("is_row"))
    stream = heads.unionByName(rows.select("conv_id", "turn", "role", "text", same_turn().alias("same"), F.lit(True).alias("is_row")), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "is_row", F.col("turn").asc_nulls_first(), "role", "same")
    return stream.select("conv_id", *_COUNTS, "audit", "is_row", "role", "text")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 1), edit (K, R or I), role and text; see ``repair``."""
    return _with_audits(turns).mapInArrow(_turn_rows, "conv_id long, place long, edit string, role string, text string")


def repair(turns: DataFrame) -> DataFrame:
    """Faults, cheapest repair and the digest of its text for each conversation.

    ``turns`` has conv_id, turn, role, text and n_rows, how often a row is there (0: the conversation is listed,
    the row is not). Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.
    Rows are in order of turn, nulls first; ties by role, then by a digest of conversation, role and text, so repeated rows
    are neighbours. Null roles and texts count as one space, a null conv_id is a conversation of its own. A conversation
    without rows has zeros, an empty audit and the digest of the empty string. Initials other than s, u, a are never legal
    and never kept. Other columns are ignored; an empty table gives an empty result.

    Texts are shuffled once, to be edited and hashed in order. Parsing never holds more than ``PIECE_ROWS`` rows in a
    group, however long a conversation; its digest, which only exists over the whole, is fed row by row by one task for
    each conversation, and the audit, one value of the result, has a letter a row.
    """
    return _with_audits(turns).mapInArrow(_digest_rows, _REPAIRED)
