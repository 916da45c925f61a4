"""Conversation repair against exhaustive search, and on odd tables."""

import random
from hashlib import sha256
from itertools import product

import pytest
from pyspark.sql import functions as F

from mailveil.llm import conversation_repair as repair

DDL = "conv_id long, turn long, role string, text string, cost string, part int"
EMPTY = sha256(b"").hexdigest()


def good(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) > 0 and rest == "ua" * (len(rest) // 2))


def exhaustive(roles, faults, most_inserts):
    """The least (cost, audit) over all edits, with up to ``most_inserts`` rows at a place."""
    choices = []
    for role, fault in zip(roles, faults):
        extra = 1 if fault == "t" else 0
        here = [("D", 3, "")]
        if fault not in "bd":
            here += [("R", 2 + extra, "u"), ("R", 2 + extra, "a")]
            here += [("K", extra, role)]
        choices.append(here)
    added = [("I" * n, 2 * n, "".join(w)) for n in range(most_inserts + 1)
             for w in product("ua", repeat=n)]
    found = []

    def go(i, cost, audit, initials):
        for letters, price, wrote in added:
            if i == len(choices):
                if good(initials + wrote):
                    found.append((cost + price, audit + letters))
                continue
            for letter, paid, kept in choices[i]:
                go(i + 1, cost + price + paid, audit + letters + letter, initials + wrote + kept)

    go(0, 0, "", "")
    return min(found)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_least_edits_of_short_conversations(n):
    for roles in product("sua-", repeat=n):
        for faults in product("bdt.", repeat=n) if n < 3 else [
                random.Random(str(roles) + str(k)).choices("bdt.", k=n) for k in range(2)]:
            roles_, faults_ = "".join(roles), "".join(faults)
            assert repair.cheapest_edits(roles_, faults_) == exhaustive(roles_, faults_, 2)


def by_strings(roles, faults):
    """The same by comparing (cost, audit) as pairs, from the end."""
    best = {s: min(((c, a) for c, a, _ in repair.closings(s)), default=None)
            for s in repair.STATES}
    for role, fault in reversed(list(zip(roles, faults))):
        best = {s: min(((c + best[to][0], a + best[to][1])
                        for c, a, to in repair.edges(role, fault, s) if best[to]), default=None)
                for s in repair.STATES}
    return best[repair.START]


@pytest.mark.parametrize("letters", ["sua-", "u", "ua", "uuu a".replace(" ", ""), "-", "sa"])
def test_long_conversations_are_cut_without_a_change(letters):
    dice = random.Random(letters)
    for n in (5, 40, 300):
        roles = "".join(dice.choices(letters, k=n))
        for marks in ("." * 8 + "tbd", ".", "t", ".t"):
            faults = "".join(dice.choices(marks, k=n))
            assert repair.cheapest_edits(roles, faults) == by_strings(roles, faults)


def test_time_grows_with_the_rows():
    # 60,000 rows as one integer would have 450,000 bits.
    cost, audit = repair.cheapest_edits("uau" * 20_000, "." * 60_000)
    assert len(audit) >= 60_000 and cost > 0


def repaired(spark, rows, damaged=True):
    df = spark.createDataFrame(rows, DDL).repartition(3)
    df = repair.damage(df) if damaged else df.withColumn("times", F.lit(1))
    return {r.conv_id: r for r in repair.repair_report(df).collect()}


def plain(rows):
    return [(*r, "x", 1) for r in rows]


def test_rows_of_one_conversation(spark):
    out = repaired(spark, plain([
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi there."), (1, 3, "assistant", "cut off"),
        (1, 4, "user", " \t\n"), (1, 5, "user", "Hi there."), (1, None, "tool", "Early!"),
        (2, 7, "assistant", "Alone."),
    ]), damaged=False)
    one = out[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (1, 1, 1, 1, 2)
    assert (one.cost, one.audit) == (10, "DKKKDD")
    assert one.repaired_sha256 == sha256(
        b"system:Be kind.\nuser:Hi there.\nassistant:cut off").hexdigest()
    assert (out[2].cost, out[2].audit) == (2, "IK") and out[2].gaps == 0


def test_odd_rows(spark):
    long = "word " * 200_000 + "end."
    rows = plain([
        (None, None, None, None), (None, 3, "user", "Ünï 日本語 🙂."), (5, 1, "", "x."),
        (5, 2, "user", None), (6, 1, "user", long), (6, 2, "assistant", long),
        *[(7, 1, "user", "Same.")] * 50, (8, 2, "user", "tie b."), (8, 2, "user", "tie a."),
    ])
    out = repaired(spark, rows, damaged=False)
    assert set(out) == {None, 5, 6, 7, 8}
    assert out[7].duplicate == 49 and out[7].audit == "K" + "D" * 49 + "I"
    assert out[6].cost == 0 and out[6].audit == "KK"
    assert out[6].repaired_sha256 == sha256(
        f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert out[8].audit in ("KR", "KD")
    assert set(repaired(spark, rows)) == set(out)


def test_no_rows(spark):
    assert repaired(spark, []) == {}
    # crc32("0:8") % 20 is 0, so the only row is dropped and the conversation stays.
    from zlib import crc32
    turn = next(t for t in range(1000) if crc32(f"0:{t}".encode()) % 20 == 0)
    gone = repaired(spark, plain([(0, turn, "user", "Hello.")]))[0]
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY)


def test_one_conversation_over_many_partitions(spark):
    """Duplicates are found across partitions, and blocks join in order."""
    dice = random.Random(1)
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {dice.randrange(900)}.")
            for t in range(1500)] + [(2, t, "user", "other.") for t in range(5)]
    out = repaired(spark, plain(rows), damaged=False)[1]
    seen, faults = set(), ""
    for _, _, role, text in rows[:1500]:
        faults += "d" if (role, text) in seen else "."
        seen.add((role, text))
    cost, audit = repair.cheapest_edits("ua" * 750, faults)
    assert (out.cost, out.audit, out.duplicate) == (cost, audit, faults.count("d"))
    walk, held = repair.Repair(audit), []
    for _, _, role, text in rows[:1500]:
        held += walk.row(role, text)
    held += walk.insert()
    joined = "\n".join(f"{r}:{t}" for r, t in held)
    assert out.repaired_sha256 == sha256(joined.encode()).hexdigest()


def test_repaired_rows(spark):
    rows = spark.createDataFrame(plain([
        (1, 0, "user", "Hi."), (1, 1, "user", "Who?"), (2, 0, "bot", "")]), DDL)
    found, blocks = repair.repair_conversations(rows.withColumn("times", F.lit(1)))
    out = [tuple(r) for r in repair.repaired_rows(found, blocks).orderBy("conv", "place").collect()]
    assert out == [("1", 0, "user", "Hi."), ("1", 1, "assistant", "Who?")]
