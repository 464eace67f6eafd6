"""Conversation repair against every edit script, by a plain search over the grammar's states."""

import hashlib
import random
import re
import zlib

import pytest

from glossaline.llm import queries, turn_repair

FOLDER = "/root/testdata/sf0.001"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def visible(text):
    return re.findall(r"[^\x20\x09-\x0D]", text)


def brute(rows):
    """Report and repaired lines of one conversation's (turn, role, text) rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, flags = set(), []
    for _, role, text in rows:
        marks = visible(text)
        flags.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    # best[state] = (cost, audit, lines) after i rows: insert any number of turns, then edit the row.
    best = {0: (0, "", ())}

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    to = STEPS.get((state, letter))
                    way = (cost + 2, audit + "I", lines + (f"{role}:",))
                    if to is not None and (to not in best or way[:2] < best[to][:2]):
                        best[to] = way
        return best

    for (turn, role, text), flag, initial in zip(rows, flags, initials):
        after = {}

        def offer(state, way):
            if state is not None and (state not in after or way[:2] < after[state][:2]):
                after[state] = way

        extra = 1 if flag == "truncated" else 0
        for state, (cost, audit, lines) in inserted(best).items():
            offer(state, (cost + 3, audit + "D", lines))
            if flag in ("blank", "duplicate"):
                continue
            offer(STEPS.get((state, initial)), (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
            for name in ("user", "assistant"):
                offer(STEPS.get((state, name[0])), (cost + 2 + extra, audit + "R", lines + (f"{name}:{text}",)))
        best = after
    final = {s: w for s, w in inserted(best).items() if s in (0, 3)}
    cost, audit, lines = min(final.values())
    return {
        "gaps": min(max(numbers) - min(numbers) + 1 - len(numbers), 2**63 - 1) if numbers else 0,
        "blank": flags.count("blank"), "duplicate": flags.count("duplicate"), "truncated": flags.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def expected(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, *row in damaged(rows):
        groups[conv].append(tuple(row))
    return {conv: brute(g) if g else brute([]) for conv, g in groups.items()}


def run(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got}


def some_rows(conv, n, r, roles):
    return [(conv, None if r.random() < 0.05 else r.randrange(n), r.choice(roles), r.choice(["Yes.", "No!", "so", "Then", "", None, "\t ", "a. b", "Long é" * 9]) if r.random() < 0.6 else f"t{r.random()}.") for _ in range(n)]


@pytest.mark.parametrize("block", [64, 5])
def test_repairs_equal_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    r = random.Random(block)
    rows = []
    for conv in range(120):
        roles = [["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "system", "tool", None, "", "s"]][conv % 3]
        rows += some_rows(conv, r.randrange(1, 14), r, roles)
    rows += some_rows(None, 150, r, ["user", "assistant", "system"])
    rows += [(900, k, ("system", "user", "assistant")[min(k, 1) + (k > 1) * (k % 2 == 0)], f"All well {k}.") for k in range(131)]
    rows += [(901, 0, "system", "Only rules.")] + [(902, 3, "user", "Same."), (902, 3, "user", "Same.")] * 40
    rows += [(903, -(2**63), "user", "Far."), (903, 2**62, "assistant", "Very. " * 200_000)]
    assert run(spark, rows, tmp_path) == expected(rows)


def test_repair_of_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_turn_repair"](spark, FOLDER).collect()
    assert {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got} == expected(rows)


def test_alignment_tables_against_search():
    r = random.Random(3)
    for _ in range(400):
        kinds = "".join(r.choice("suax") for _ in range(r.randrange(1, 9)))
        faults = [r.choice([0, 0, 0, 1, 3]) for _ in kinds]
        codes = "".join(chr(65 + ("x" + "sua").index(k) * 4 + f) for k, f in zip(kinds, faults))
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[k], "" if f == 1 else f"{i} so" if f == 3 else f"{i}.") for i, (k, f) in enumerate(zip(kinds, faults))]
        want = brute(rows)
        cost, audits = turn_repair.chain([[dict(zip(("begin", "end", "last", "cost", "audit"), a)) for a in turn_repair.align(codes, True, True)]])
        assert (cost, "".join(audits)) == (want["cost"], want["audit"]), codes


def test_repair_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op11_turn_repair"](spark, str(tmp_path)).count() == 0
    report, repaired = turn_repair.repair(empty)
    assert report.count() == 0 and repaired.count() == 0


def test_repaired_turns_are_given_back(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Ask."), (1, 1, "user", "More."), (1, 2, "tool", "Answer.")], "conv_id long, turn int, role string, text string")
    report, repaired = turn_repair.repair(turns)
    assert [tuple(r) for r in report.select("cost", "audit", "illegal").collect()] == [(4, "KIKR", 2)]
    got = [tuple(r) for r in repaired.orderBy("block", "place").select("edit", "role", "text", "turn").collect()]
    assert got == [("K", "user", "Ask.", 0), ("I", "assistant", "", None), ("K", "user", "More.", 1), ("R", "assistant", "Answer.", 2)]
