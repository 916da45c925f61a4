"""Repair of damaged conversations at the least cost, by shortest paths over big integers.

A path through a conversation says of each row whether it is kept, given another role or
deleted, and where an empty row is inserted. The weight of a path is one integer: the high
digits are its cost, the low ones its audit letters, first letter highest, zeros after the
last. So the smaller of two integers is the cheaper path or, at equal cost, the one whose
audit is ASCII-least, and nothing but the minimum of integers decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

# The edits, their costs, and what a truncated row adds unless it is deleted.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
# Audit letters as digits in the order of the letters; zero is the padding.
DIGIT_BITS = 3
DIGITS = {letter: i for i, letter in enumerate("DIKR", 1)}
LETTERS = {i: letter for letter, i in DIGITS.items()}

# States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
ENDS = (START, AFTER_A)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U,
        (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")

# Rows of a block, and bytes of its texts; one longer text is a block of its own.
BLOCK_ROWS = 256
BLOCK_TEXT = 1 << 20


def written(state: int) -> str:
    """The role, as an initial, that an inserted row or a new role has in a state."""
    return "a" if state == AFTER_U else "u"


def inserts(state: int) -> list[tuple[str, int]]:
    """None, one or two inserted rows; a third would only lead back to a state seen."""
    out = [("", state)]
    for _ in range(2):
        letters, at = out[-1]
        out.append((letters + "I", NEXT[at, written(at)]))
    return out


def cost_of(letters: str) -> int:
    return sum(COSTS[letter] for letter in letters)


@lru_cache(None)
def edges(role: str, fault: str, state: int) -> list[tuple[int, str, int]]:
    """``(cost, letters, next state)``: what may become of a row, with rows inserted before.

    Of edges to one state only the cheapest are kept, as all go on alike from there.
    """
    found = []
    for before, at in inserts(state):
        found.append((before + "D", 0, at))
        if fault not in "bd":
            extra = TRUNCATED_COST if fault == "t" else 0
            found.append((before + "R", extra, NEXT[at, written(at)]))
            if (at, role) in NEXT:
                found.append((before + "K", extra, NEXT[at, role]))
    priced = [(cost_of(letters) + extra, letters, to) for letters, extra, to in found]
    least = {to: min(c for c, _, t in priced if t == to) for _, _, to in priced}
    return [e for e in priced if e[0] == least[e[2]]]


@lru_cache(None)
def closings(state: int) -> list[tuple[int, str, int]]:
    """What may be inserted after the last row to end well."""
    return [(cost_of(letters), letters, at) for letters, at in inserts(state) if at in ENDS]


def number(letters: str) -> int:
    value = 0
    for letter in letters:
        value = value << DIGIT_BITS | DIGITS[letter]
    return value


def cut_points(steps: list[list[list]], rest: list[list[int]]) -> list[tuple[int, int]]:
    """Gaps that all cheapest paths reach in one state and with equally many letters.

    What stands on the two sides of such a gap is decided apart: letters before it keep
    their places whatever follows. ``rest`` is the least cost from each gap and state on.
    """
    here, points = {START: (0, 0)}, [(0, START)]
    for i, step in enumerate(steps):
        there: dict[int, tuple[int, int]] = {}
        for state, (low, high) in here.items():
            for cost, letters, to in step[state]:
                if cost + rest[i + 1][to] == rest[i][state]:
                    least, most = there.get(to, (low + len(letters), high + len(letters)))
                    there[to] = min(least, low + len(letters)), max(most, high + len(letters))
        here = there
        if len(here) == 1:
            (state, (low, high)), = here.items()
            if low == high and i + 1 < len(steps):
                points.append((i + 1, state))
    return points


def least_path(steps: list[list[list]], start: int, end: int | None) -> tuple[int, str]:
    """Cost and audit of the path of least weight from a state to one, or to a good end.

    Suffix by suffix: a letter written before a suffix moves its digits one place down, and
    as both of two suffixes move alike, their order stays.
    """
    # No suffix of least cost has more letters: each insert is paid by a row not deleted.
    width = DIGIT_BITS * (len(steps) + 3 * len(steps) // 2 + 6)
    digits = (1 << width) - 1
    far = (5 * len(steps) + 100) << width

    def before(edge: tuple[int, str, int], suffix: int) -> int:
        cost, letters, _ = edge
        places = DIGIT_BITS * len(letters)
        return ((((suffix >> width) + cost) << width)
                | (number(letters) << (width - places)) | ((suffix & digits) >> places))

    if end is None:
        weights = [min((before(e, 0) for e in closings(s)), default=far) for s in STATES]
    else:
        weights = [0 if s == end else far for s in STATES]
    for step in reversed(steps):
        weights = [min(before(e, weights[e[2]]) for e in step[s]) for s in STATES]
    weight, audit = weights[start], []
    for place in range(width - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = (weight >> place) & ((1 << DIGIT_BITS) - 1)
        if not digit:
            break
        audit.append(LETTERS[digit])
    return weight >> width, "".join(audit)


@lru_cache(1 << 14)
def cheapest_edits(roles: str, faults: str) -> tuple[int, str]:
    """Cost and audit of a conversation given as initials and faults, a character a row.

    ``roles`` holds s, u, a or - (any other); ``faults`` b (blank), d (duplicate), t
    (truncated) or a point. A long conversation is cut where that changes nothing, so the
    integers stay short and the time grows with the rows.
    """
    steps = [[edges(r, f, s) for s in STATES] for r, f in zip(roles, faults)]
    never = 5 * len(steps) + 100
    rest = [[min((c for c, _, _ in closings(s)), default=never) for s in STATES]]
    for step in reversed(steps):
        rest.append([min(c + rest[-1][to] for c, _, to in step[s]) for s in STATES])
    rest.reverse()
    cost, audit = 0, []
    points = cut_points(steps, rest)
    for (i, state), (j, to) in zip(points, [*points[1:], (len(steps), None)]):
        part_cost, part_audit = least_path(steps[i:j], state, to)
        cost, audit = cost + part_cost, [*audit, part_audit]
    return cost, "".join(audit)


class Repair:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def insert(self) -> Iterator[tuple[str, str]]:
        """The inserted rows that stand here."""
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self.write(), ""

    def write(self) -> str:
        initial = written(self.state)
        self.state = NEXT[self.state, initial]
        return ROLES[initial]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[self.state, role[:1]]
            yield role, text
        elif letter == "R":
            yield self.write(), text


def filled(name: str) -> Column:
    """A column with one space for null, in hashed keys as in fields."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """The planted faults: ``conv_id, turn, role, text, times``, where ``times`` is how often
    the row stands in the damaged conversation: 0, 1 or 2.
    """
    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))), F.lit(20))
    return rows.select("conv_id", "turn", filled("role").alias("role"),
                       filled("text").alias("text"), kind.alias("_kind")).select(
        "conv_id", "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("times"))


BLOCK_DDL = ("conv string, conv_id long, part int, seq int, first_turn long, last_turn long, "
             "turns long, initials string, faults string, digests array<binary>, "
             "roles array<string>, texts array<string>")


class Block:
    """Rows of one conversation that stand together."""

    def __init__(self, conv, conv_id):
        self.conv, self.conv_id, self.turns, self.bytes = conv, conv_id, [], 0
        self.initials, self.faults = [], []
        self.digests, self.roles, self.texts = [], [], []

    def add(self, turn, role, text, fault, digest) -> None:
        self.initials.append(role[:1] if role[:1] in ("s", "u", "a") else "-")
        self.faults.append(fault)
        gone = fault in "bd"
        self.digests.append(None if gone else digest)
        self.roles.append(role)
        self.texts.append(None if gone else text)
        self.bytes += 0 if gone else len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def full(self) -> bool:
        return len(self.faults) >= BLOCK_ROWS or self.bytes >= BLOCK_TEXT

    def fields(self, part: int, seq: int) -> tuple:
        turns = self.turns or [None]
        return (self.conv, self.conv_id, part, seq, turns[0], turns[-1], len(self.turns),
                "".join(self.initials), "".join(self.faults), self.digests, self.roles,
                self.texts)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


BLOCK_SCHEMA = pa.schema([
    ("conv", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
    ("initials", pa.string()), ("faults", pa.string()), ("digests", pa.list_(pa.binary())),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def cut_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks. A row seen before in this partition is a duplicate."""
    part, seq, block, seen = TaskContext.get().partitionId(), 0, None, set()
    for batch in batches:
        done, held = [], 0
        for conv, conv_id, turn, role, text, times, fault, digest in zip(
                *(batch.column(c).to_pylist() for c in (
                    "conv", "conv_id", "turn", "role", "text", "times", "fault", "digest"))):
            if block is not None and (block.conv != conv or block.full()):
                done.append(block.fields(part, seq))
                seq, held = seq + 1, held + block.bytes
                if block.conv != conv:
                    seen.clear()
                block = None
            if block is None:
                block = Block(conv, conv_id)
            for _ in range(times):
                again = fault != "b" and digest in seen
                block.add(turn, role, text, "d" if again else fault, digest)
                seen.add(digest)
            if held > 8 * BLOCK_TEXT:
                yield to_batch(done, BLOCK_SCHEMA)
                done, held = [], 0
        yield to_batch(done, BLOCK_SCHEMA)
    if block is not None:
        yield to_batch([block.fields(part, seq)], BLOCK_SCHEMA)


def conversation_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of each conversation's rows in order.

    ``rows`` has ``conv_id, turn, role, text, times``. Ranges of (conversation, turn) make the
    partitions, so a conversation with most of the rows lies in many, and so do equal rows.
    """
    rows = rows.withColumns({"role": filled("role"), "text": filled("text")})
    blank = ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    cut_off = ~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*+\z"))
    keyed = rows.select(
        filled("conv_id").alias("conv"),
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "times",
        F.when(blank, "b").when(cut_off, "t").otherwise(".").alias("fault"),
        F.unhex(F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256)).alias("digest"),
        F.substring("text", 1, 64).alias("opening"),
        F.monotonically_increasing_id().alias("row"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "opening", "digest", "row"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop(
        "opening", "row").mapInArrow(cut_blocks, BLOCK_DDL)


def later_copies(blocks: DataFrame) -> DataFrame:
    """``(conv, part, seq, again)``: places of rows that an earlier partition has already.

    Only conversations that go on in the next partition have such rows; there are fewer of
    them than partitions, which bounds what is broadcast. A digest stands once in a
    partition, so no key has more rows than there are partitions.
    """
    spanning = (
        blocks.groupBy("conv").agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .filter("low < high").select("conv"))
    rows = (
        blocks.join(F.broadcast(spanning), "conv")
        .select("conv", "part", "seq", F.posexplode("digests").alias("place", "digest"))
        .filter(F.col("digest").isNotNull()))
    first = rows.groupBy("conv", "digest").agg(F.min("part").alias("first"))
    return (
        rows.join(first, ["conv", "digest"]).filter("part > first")
        .groupBy("conv", "part", "seq").agg(F.collect_list("place").alias("again")))


AUDIT_DDL = ("conv string, conv_id long, gaps long, blank long, duplicate long, "
             "truncated long, illegal long, cost long, audit string")


def audits(blocks: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation.

    A row is two characters here, so the row of the largest conversation is about as long as
    its audit.
    """
    slim = blocks.select("conv", "conv_id", "part", "seq", "first_turn", "last_turn", "turns",
                         "initials", "faults")
    parts = F.array_sort(F.collect_list(F.struct(
        "part", "seq", "first_turn", "last_turn", "turns", "initials", "faults", "again")))
    grouped = slim.join(later_copies(blocks), ["conv", "part", "seq"], "left").groupBy(
        "conv").agg(F.max("conv_id").alias("conv_id"), parts.alias("parts"))
    schema = pa.schema([("conv", pa.string()), ("conv_id", pa.int64()),
                        *((c, pa.int64()) for c in (
                            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        ("audit", pa.string())])

    def one(conv, conv_id, held) -> tuple:
        roles, faults, low, high, turns = "", [], None, None, 0
        for part in held:
            letters = list(part["faults"])
            for place in part["again"] or ():
                letters[place] = "d"
            roles, faults = roles + part["initials"], faults + letters
            if part["turns"]:
                # A turn may go on in the next block.
                turns += part["turns"] - (high == part["first_turn"])
                low, high = part["first_turn"] if low is None else low, part["last_turn"]
        faults = "".join(faults)
        cost, audit = cheapest_edits(roles, faults)
        return (conv, conv_id, 0 if low is None else high - low + 1 - turns,
                faults.count("b"), faults.count("d"), faults.count("t"),
                sum(a + b not in LEGAL_PAIRS for a, b in zip(roles, roles[1:])), cost, audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield to_batch([one(*row) for row in zip(
                *(batch.column(c).to_pylist() for c in ("conv", "conv_id", "parts")))], schema)

    return grouped.mapInArrow(run, AUDIT_DDL)


def with_blocks(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """The audit of each conversation followed by its blocks, in order, in one partition."""
    heads = found.select("conv", F.lit(-1).alias("part"), F.lit(-1).alias("seq"), "audit",
                         F.lit(None).cast("array<string>").alias("roles"),
                         F.lit(None).cast("array<string>").alias("texts"))
    bodies = blocks.select("conv", "part", "seq", F.lit(None).cast("string").alias("audit"),
                           "roles", "texts")
    return heads.unionByName(bodies).repartition("conv").sortWithinPartitions(
        "conv", "part", "seq")


def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[str, str]]]]:
    """Each conversation's repaired rows, as they stream by; one block is held at a time."""
    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(batch.column(c)[i].as_py() for c in (
                    "conv", "audit", "roles", "texts"))

    def repaired(held):
        repair = Repair(next(held)[1])
        for _, _, roles, texts in held:
            for role, text in zip(roles, texts):
                yield from repair.row(role, text)
        yield from repair.insert()

    for conv, held in groupby(rows(), key=lambda r: r[0]):
        yield conv, repaired(held)


def repaired_rows(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(conv, place, role, text)``: the repaired conversations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in walk(batches):
            held, size = [], 0
            for place, (role, text) in enumerate(rows):
                held.append((conv, place, role, text))
                size += len(text) + 64
                if size > 8 * BLOCK_TEXT:
                    yield to_batch(held, schema)
                    held, size = [], 0
            yield to_batch(held, schema)

    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()),
                        ("text", pa.string())])
    return with_blocks(found, blocks).mapInArrow(
        run, "conv string, place long, role string, text string")


def repaired_digests(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)``: digest of the repaired rows as ``role:text``, one a line."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for conv, rows in walk(batches):
            digest = sha256()
            for place, (role, text) in enumerate(rows):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            done.append((conv, digest.hexdigest()))
            if len(done) >= 4096:
                yield to_batch(done, schema)
                done = []
        yield to_batch(done, schema)

    return with_blocks(found, blocks).mapInArrow(run, "conv string, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the repair finds, and the blocks it works on; both are written tables.

    ``rows`` has ``conv_id, turn, role, text, times`` (``damage`` gives them); other columns
    are not read. Rows are taken by turn, null turns first; rows of one turn by role, then by
    the first 64 characters of the text, then by digest. Of rows with equal role and text all
    but the first are duplicates, repeated rows too. A null ``conv_id`` is one conversation.
    A conversation without rows has zeros and an empty audit. An empty table gives no rows.

    ``repaired_rows`` and ``repaired_digests`` take both tables.
    """
    blocks = settle(conversation_blocks(rows), "conversation-blocks")
    return settle(audits(blocks), "conversation-audits"), blocks


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, counts of faults and of illegal neighbours,
    cost, audit and the digest of the repaired rows."""
    found, blocks = repair_conversations(rows)
    return found.join(repaired_digests(found, blocks), "conv").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256")
