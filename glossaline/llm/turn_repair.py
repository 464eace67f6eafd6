"""Conversation structure repair: the cheapest edits that make a conversation alternate.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.  Faults first: a row is
blank (no visible character), else a duplicate (role and text stood earlier in its conversation), else
truncated (its last visible character ends no sentence).  Then each conversation is aligned to the
grammar's strings by the Wagner-Fischer table: keep a row (0), give it the role user or assistant (2),
delete it (3; blank and duplicate rows must go), insert an empty turn of user or assistant (2); a
truncated row that stays adds 1.  The strings of one first letter are prefixes of each other, so one
table holds the last cell of every feasible length; Ukkonen's bands leave out the cells that cannot beat
the cost found so far.  Of each length of least cost the audit (the edits' initials) is traced back,
and the least audit by ASCII wins.

Rows are numbered by a range sort, so a conversation may hold any share of all rows.  Those of up to
``BLOCK`` rows are aligned whole.  Longer ones are aligned in blocks, each from every state of the
grammar that it can begin in, to every state it can end in; the blocks' answers are chained by state.
That loses nothing: an edit script cut behind the last edit of a block's rows is one script per block,
and no such part is the beginning of another, so the least parts make the least whole.

Defined results: rows count by turn (null first), then role, then text; a null role or text is one
space (so a null text is blank); equal rows are duplicates; an empty role, and any role of another
initial than s, u and a, fits nowhere and is given a role or deleted; a null conversation id is a
conversation of its own; columns other than the four named ones are not read; an empty table gives
empty results; gaps beyond a long are the largest long.  What meets in one row is a block, or one letter and one state for each row of a
conversation, which is less than the audit asked for.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..plans import ordered
from ..session import materialize

BLOCK = 64
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAULTS = ["", "blank", "duplicate", "truncated"]
KINDS = "sua"  # initials with a place in the grammar; others are "x"
FRESH, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired conversation ends in so far
NEXT = {FRESH: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
OF_LETTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ANSWER = "array<struct<begin:int,end:int,last:boolean,cost:bigint,audit:string>>"


def code(kind: Column, fault: Column) -> Column:
    """One letter for what the alignment needs of a row: its initial and its fault."""
    return F.char(F.lit(65) + (F.instr(F.lit(KINDS), kind) * 4 + fault).cast("int"))


def row_of(letter: str) -> tuple[str, int]:
    kind, fault = divmod(ord(letter) - 65, 4)
    return ("x" + KINDS)[kind], fault


def target(begin: int, system: bool, length: int) -> str:
    """The grammar's string of a length, from a state on."""
    first = "s" if system else ""
    pair = "ua" if NEXT[begin] == "u" else "au"
    return (first + pair * (length // 2 + 1))[:length]


def table(rows: list[tuple[str, int]], goal: str, bound: int) -> list[dict[int, tuple[int, int]]]:
    """Wagner-Fischer rows within the band: goal letters used -> (cost, cost when the last edit is a row's)."""
    far = 1 << 60
    n, forced = len(rows), sum(1 for _, f in rows if f in (1, 2))
    # A cell j letters for i rows: the path so far and the path to any final cell cost at least this.
    low = -(bound // DELETE) - 1
    high = bound // INSERT + 1
    cells: list[dict[int, tuple[int, int]]] = [{}]
    value = 0
    for j in range(0, min(high, len(goal)) + 1):
        if j and goal[j - 1] == "s":
            break
        cells[0][j] = (value, far if j else 0)
        value += INSERT
    gone = 0
    for i in range(1, n + 1):
        kind, fault = rows[i - 1]
        must, extra = fault in (1, 2), TRUNCATED if fault == 3 else 0
        gone += must
        rest = DELETE * (forced - gone)
        above, here = cells[-1], {}
        before = far
        for j in range(max(0, i + low), min(len(goal), i + high) + 1):
            best = above[j][0] + DELETE if j in above else far
            if j and not must and j - 1 in above:
                letter = goal[j - 1]
                step = KEEP if kind == letter else RENAME if letter != "s" else far
                best = min(best, above[j - 1][0] + step + extra)
            whole = best
            if j and before < far and goal[j - 1] != "s":
                whole = min(whole, before + INSERT)
            before = whole
            if whole + rest <= bound:
                here[j] = (whole, best)
        cells.append(here)
    return cells


def trace(rows: list[tuple[str, int]], goal: str, cells: list[dict[int, tuple[int, int]]], length: int, last: bool) -> str:
    """The least audit of all cheapest paths to the final cell of a length."""
    n = len(rows)
    good: dict[tuple[int, int], list[tuple[str, int, int]]] = {}
    todo = [(n, length, last)]
    seen = {(n, length)}
    while todo:
        i, j, free = todo.pop()
        cost = cells[i][j][0] if free else cells[i][j][1]
        steps = []
        if free and j and goal[j - 1] != "s" and j - 1 in cells[i] and cells[i][j - 1][0] + INSERT == cost:
            steps.append(("I", i, j - 1))
        if i:
            kind, fault = rows[i - 1]
            if j in cells[i - 1] and cells[i - 1][j][0] + DELETE == cost:
                steps.append(("D", i - 1, j))
            if j and fault not in (1, 2) and j - 1 in cells[i - 1]:
                same = kind == goal[j - 1]
                price = (KEEP if same else RENAME) + (TRUNCATED if fault == 3 else 0)
                if (same or goal[j - 1] != "s") and cells[i - 1][j - 1][0] + price == cost:
                    steps.append(("K" if same else "R", i - 1, j - 1))
        for letter, a, b in steps:
            good.setdefault((a, b), []).append((letter, i, j))
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b, True))
    at, out = (0, 0), []
    while at != (n, length):
        letter, i, j = min(good[at])
        out.append(letter)
        at = (i, j)
    return "".join(out)


def align(codes: str, first: bool, closed: bool) -> list[tuple[int, int, bool, int, str]]:
    """Cheapest (begin, end, last, cost, audit) of a block for each pair of states.

    ``first``: the block begins its conversation.  ``closed``: it cannot be followed by another, so
    only scripts of a last block (which may end in inserted turns, and must end legally) are asked for.
    """
    rows = [row_of(c) for c in codes]
    n, stay = len(rows), sum(1 for _, f in rows if f not in (1, 2))
    found: dict[tuple[int, int, bool], tuple[int, list[tuple[str, list, int]]]] = {}
    # Deleting all rows and inserting two turns ends behind any turn; so does giving every row that stays
    # the role of its place, and one turn more or less.  Whoever ends elsewhere for more than that can
    # be replaced by such a script, for what follows differs by at most one turn inserted and one deleted.
    named = DELETE * (n - stay) + sum(RENAME + (TRUNCATED if f == 3 else 0) for _, f in rows if f not in (1, 2))
    limit = min(DELETE * n + 2 * INSERT, named + DELETE) + DELETE + INSERT
    for begin in [FRESH] if first else range(4):
        for system in (False, True) if begin == FRESH and any(k == "s" for k, _ in rows) else (False,):
            goal = target(begin, system, stay + limit // INSERT + 2)
            cells = table(rows, goal, limit)
            for length, (whole, row_last) in sorted(cells[n].items(), key=lambda c: c[1][0]):
                end = OF_LETTER[goal[length - 1]] if length else begin
                asked = [] if closed else [(False, row_last)]
                if end in (FRESH, ASSISTANT):
                    asked.append((True, whole))
                for last, cost in asked:
                    key = (begin, end, last)
                    best = found.get(key)
                    if cost <= limit and (best is None or cost < best[0]):
                        found[key] = (cost, [(goal, cells, length)])
                    elif best is not None and cost == best[0]:
                        best[1].append((goal, cells, length))
    return [
        (begin, end, last, cost, min(trace(rows, goal, cells, length, last) for goal, cells, length in ways))
        for (begin, end, last), (cost, ways) in found.items()
    ]


def chain(blocks: list[list[dict]]) -> tuple[int, list[str]]:
    """Cheapest audits of consecutive blocks: the least whole among all chains of states."""
    # Per state: cost so far and the rank of its audit; parts never begin each other, so ranks carry on.
    here: dict[int, tuple[int, int]] = {FRESH: (0, 0)}
    back: list[dict[int, tuple[int, str]]] = []
    for at, answers in enumerate(blocks):
        final = at == len(blocks) - 1
        best: dict[int, tuple[int, int, str, int]] = {}
        for a in answers:
            if a["last"] == final and a["begin"] in here:
                cost, rank = here[a["begin"]]
                way = (cost + a["cost"], rank, a["audit"], a["begin"])
                if a["end"] not in best or way < best[a["end"]]:
                    best[a["end"]] = way
        ranks = {pair: k for k, pair in enumerate(sorted({w[1:3] for w in best.values()}))}
        here = {end: (w[0], ranks[w[1:3]]) for end, w in best.items()}
        back.append({end: (w[3], w[2]) for end, w in best.items()})
    state = min(here, key=lambda s: here[s])
    cost, audits = here[state][0], []
    for step in reversed(back):
        state, audit = step[state]
        audits.append(audit)
    return cost, audits[::-1]


def _align_udf():
    @pandas_udf(ANSWER)
    def run(codes: pd.Series, first: pd.Series) -> pd.Series:
        # Many blocks of a batch have the same letters.
        known: dict[tuple[str, bool], list[dict]] = {}
        for key in zip(codes, first):
            if key not in known:
                known[key] = [dict(zip(("begin", "end", "last", "cost", "audit"), a)) for a in align(key[0], bool(key[1]), len(key[0]) < BLOCK)]
        return pd.Series([known[key] for key in zip(codes, first)])

    return run


def _chain_udf():
    @pandas_udf("struct<cost:bigint,audits:array<string>>")
    def run(blocks: pd.Series) -> pd.DataFrame:
        chained = [chain([list(b["answers"]) for b in row]) for row in blocks]
        return pd.DataFrame({"cost": [c for c, _ in chained], "audits": [a for _, a in chained]})

    return run


def _edits_udf():
    @pandas_udf("array<struct<edit:string,at:int,role:string>>")
    def run(audit: pd.Series, begin: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for letters, state, kinds in zip(audit, begin, codes):
            at, edits = 0, []
            for letter in letters:
                put = NEXT[state] if letter in "IR" else None
                if letter == "K":
                    state = OF_LETTER[row_of(kinds[at])[0]]
                elif put:
                    state = OF_LETTER[put]
                edits.append({"edit": letter, "at": None if letter == "I" else at, "role": {"u": "user", "a": "assistant", None: None}[put]})
                at += letter != "I"
            out.append(edits)
        return pd.Series(out)

    return run


def _state_after_udf():
    @pandas_udf("array<int>")
    def run(audits: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for parts, blocks in zip(audits, codes):
            state, states = FRESH, []
            for letters, kinds in zip(parts, blocks):
                states.append(state)
                at = 0
                for letter in letters:
                    state = OF_LETTER[row_of(kinds[at])[0]] if letter == "K" else OF_LETTER[NEXT[state]] if letter in "IR" else state
                    at += letter != "I"
            out.append(states)
        return pd.Series(out)

    return run


def faults(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows in order with their fault: (conv_id, turn, role, text, row, number, fault).

    ``row`` is unique and rises in order; ``number`` counts a conversation's rows from 1; ``fault`` is
    0 (none), 1 (blank), 2 (duplicate) or 3 (truncated).
    """
    space = F.lit(" ")
    plain = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
    )
    frozen = ordered.freeze_order(plain, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()])
    seen = F.rtrim("text", F.lit(SPACE))
    # The first row of each (role, text) of a conversation: told by its row number, which no other row has.
    first = frozen.filter(seen != "").groupBy("conv_id", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("of")).agg(F.min(ordered.POS).alias("first_row"))
    fault = F.when(seen == "", 1).when(F.col("first_row").isNull(), 2).when(~F.substring(seen, -1, 1).isin(*ENDS), 3).otherwise(0)
    numbered = ordered.with_row_number(frozen, ["conv_id"], "number")
    met = numbered.join(first.select("first_row"), F.col(ordered.POS) == F.col("first_row"), "left")
    return met.select("conv_id", "turn", "role", "text", F.col(ordered.POS).alias("row"), "number", fault.alias("fault"))


def plan(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audits, codes, firsts) of each conversation from :func:`faults`, blocks in order."""
    slim = rows.select(
        "conv_id", ((F.col("number") - 1) / BLOCK).cast("bigint").alias("block"), "row", F.substring("role", 1, 1).alias("kind"), "fault"
    ).withColumn("code", code(F.when(F.col("kind") == "", "x").otherwise(F.col("kind")), F.col("fault")))
    blocks = slim.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("row", "code"))).alias("rows")).select(
        "conv_id", "block", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"), F.transform("rows", lambda r: r["row"]).alias("of"),
    )
    answers = blocks.withColumn("answers", _align_udf()("codes", F.col("block") == 0))
    together = answers.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "codes", "of"))).alias("blocks"), F.collect_list(F.struct("block", "answers")).alias("answers"))
    # Only the block decides the order of answers.
    together = together.withColumn("answers", F.array_sort("answers", lambda a, b: (a["block"] - b["block"]).cast("int")))
    chained = together.withColumn("chained", _chain_udf()("answers"))
    return chained.select("conv_id", F.col("chained.cost").alias("cost"), F.col("chained.audits").alias("audits"), F.transform("blocks", lambda b: b["codes"]).alias("codes"), F.transform("blocks", lambda b: b["of"]).alias("of"))


def illegal(codes: Column) -> Column:
    """Neighbours whose initials no legal conversation has side by side."""
    whole = F.translate(F.array_join(codes, ""), "".join(chr(65 + k * 4 + f) for k in range(4) for f in range(4)), "".join(c * 4 for c in "x" + KINDS))
    # Pairs overlap, so legal ones are looked for ahead of each letter.
    return F.greatest(F.length(whole) - 1, F.lit(0)).cast("bigint") - F.regexp_count(whole, F.lit("(?=su|ua|au)")).cast("bigint")


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns).

    The report has a row per conversation: conv_id, rows, gaps (numbers missing between its first and
    last turn), blank, duplicate, truncated, illegal, cost, audit.  The repaired turns are conv_id, block,
    place (order within a conversation: block, then place), edit (K, R or I), role, text, and the turn
    of the row (null for inserted ones).
    """
    rows = materialize(faults(turns, conversation, turn, role, text), "turn-faults")
    plans = materialize(plan(rows), "turn-plans")
    number = F.col("turn").cast("decimal(20,0)")
    facts = rows.groupBy("conv_id").agg(
        F.count("*").alias("rows"),
        F.when(F.max(number).isNull(), 0).otherwise(F.least(F.max(number) - F.min(number) + 1 - F.countDistinct("turn"), F.lit((1 << 63) - 1)).cast("bigint")).alias("gaps"),
        *[F.count_if(F.col("fault") == k).alias(FAULTS[k]) for k in (1, 2, 3)],
    )
    known = plans.select(F.col("conv_id").alias("of_id"), illegal(F.col("codes")).alias("illegal"), "cost", F.array_join("audits", "").alias("audit"))
    report = facts.join(known, F.col("conv_id").eqNullSafe(F.col("of_id"))).drop("of_id")

    steps = plans.withColumn("begins", _state_after_udf()("audits", "codes")).select(
        "conv_id", F.posexplode(F.arrays_zip("audits", "codes", "of", "begins")).alias("block", "b")
    )
    edits = steps.withColumn("edits", _edits_udf()("b.audits", "b.begins", "b.codes")).select(
        "conv_id", "block", F.col("b.of").alias("of"), F.posexplode("edits").alias("place", "e")
    ).filter("e.edit != 'D'").select("conv_id", "block", "place", "e.edit", F.col("e.role").alias("new_role"), F.get("of", F.col("e.at")).alias("of_row"))
    # Every row has a number of its own, so no conversation makes this join uneven.
    held = rows.select("row", "turn", "role", "text")
    stays = edits.filter("of_row is not null").join(held, F.col("of_row") == F.col("row")).select(
        "conv_id", "block", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text", "turn"
    )
    added = edits.filter("of_row is null").select("conv_id", "block", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"), F.lit(None).cast(turns.schema[turn].dataType).alias("turn"))
    return report, stays.unionByName(added)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines ``role:text`` of each repaired conversation, joined by newlines.

    A hash reads its text in order, so each conversation is streamed through one task in sorted order;
    the task holds one batch of rows and one hash, whatever the conversation's length.
    """
    lines = repaired.select("conv_id", "block", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    start = lines.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("int").alias("block"), F.lit(-1).cast("int").alias("place"), F.lit(None).cast("string").alias("line"))
    both = start.unionByName(lines.withColumn("block", F.col("block").cast("int")))
    by_conversation = both.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "block", "place")
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = None
        current, state, lines_seen = None, None, 0
        for batch in batches:
            names = batch.schema
            ids, sums = [], []
            column = batch.column("conv_id").to_pylist()
            for who, place, line in zip(column, batch.column("place").to_pylist(), batch.column("line").to_pylist()):
                if place == -1:
                    if state is not None:
                        ids.append(current)
                        sums.append(state.hexdigest())
                    current, state, lines_seen = who, hashlib.sha256(), 0
                    continue
                state.update((("\n" if lines_seen else "") + line).encode("utf-8", "surrogatepass"))
                lines_seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, names.field("conv_id").type), pa.array(sums, pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], names.field("conv_id").type), pa.array([state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    return by_conversation.mapInArrow(run, f"conv_id {kind}, sha256 string")


def damage(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with known faults, by crc32 of ``conversation:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conversation).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    said = F.coalesce(F.col(text), space)
    kind = F.crc32(key) % 20
    return turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(said, ENDS, "")).otherwise(said).alias("text"),
    ).filter("kind != 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")
