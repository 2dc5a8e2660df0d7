import heapq
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from creditloom.llm import conversation_repair as R
from creditloom.llm import role_parser

SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def by_sql(rows):
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("given", table)
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM given")
    cur = con.execute(R.SQL)
    names = [d[0] for d in cur.description]
    return sorted((dict(zip(names, r)) for r in cur.fetchall()), key=str)


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def some_rows(seed, conversations=60):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "What is it?", "a b c", " ", "", None, "It is so!\n", "é ü.", "one\ntwo."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            rows.append((None if conv == 7 else conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1]), role, rng.choice(texts)))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", range(3))
def test_against_sql(spark, seed):
    rows = some_rows(seed)
    assert rows_of(R.repaired_conversations(frame(spark, rows))) == by_sql(rows)


def test_one_conversation_holds_most_rows(spark):
    """It is cut into chunks over all tasks; equal rows, a third of it, are counted once."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"text {rng.randint(0, 300)}{rng.choice('.!?x')}") for t in range(400)]
    rows += [(1, 77, "user", "again and again.")] * 200 + some_rows(9, 12)
    got = R.repaired_conversations(frame(spark, rows).repartition(7)).collect()
    assert sorted((r.asDict() for r in got), key=str) == by_sql(rows)


def test_held_rows_do_not_matter(spark):
    rows = [(c % 40, t, r, x) for c, t, r, x in some_rows(3, 80) if c is not None]
    rows = frame(spark, rows)
    few, many = R.repair(rows, most_held=2, with_turns=True), R.repair(rows, with_turns=True)
    assert rows_of(few.conversations) == rows_of(many.conversations)

    def texts(turns):
        found = {}
        for r in turns.orderBy("conv", "part", "at").collect():
            found.setdefault(r.conv, []).append((r.edit, r.role, r.text))
        return found

    assert texts(few.turns) == texts(many.turns)
    digests = {r.conv: r.digest for r in many.conversations.collect()}
    made = texts(many.turns)
    assert all(R.digest_of((role, text) for _, role, text in made.get(c, [])) == d for c, d in digests.items())


def test_empty_and_very_long(spark):
    assert R.repaired_conversations(frame(spark, [])).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    plain = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    long = "word " * 400_000 + "end."
    rows = [(lost, 0, "user", "gone"), (plain, 0, "user", long), (plain, 1, "assistant", "yes.")]
    got = {r.conv_id: r for r in R.repaired_conversations(frame(spark, rows)).collect()}
    assert got[lost].audit == "" and got[lost].repaired_sha256 == R.EMPTY_SHA256 and got[lost].cost == 0
    assert got[plain].audit == "KK" and got[plain].cost == 0
    assert got[plain].repaired_sha256 == R.digest_of([("user", long), ("assistant", "yes.")])


def cheapest(rows):
    """Uniform-cost search over edits, without merging anything but equal audits."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, last = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        if (audit, at, last) in done:
            continue
        done.add((audit, at, last))
        for role in "ua":
            if (last, role) in step:
                heapq.heappush(queue, (cost + 3, audit + "I", at, step[last, role]))
        if at < len(rows):
            role, must_delete, cut = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, last))
            if not must_delete:
                if (last, role) in step:
                    heapq.heappush(queue, (cost + 3 * cut, audit + "K", at + 1, step[last, role]))
                for other in "ua":
                    if (last, other) in step:
                        heapq.heappush(queue, (cost + 3 + 3 * cut, audit + "R", at + 1, step[last, other]))


@pytest.mark.parametrize("every", [1, 2, 64])
def test_parser_finds_the_cheapest_edits(every, monkeypatch):
    monkeypatch.setattr(role_parser, "RANK_EVERY", every)
    automaton, rng = role_parser.Automaton(), random.Random(every)
    for _ in range(200):
        rows = [(rng.choice("suaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
        parse = role_parser.Repair(automaton)
        for row in rows:
            parse.row(*row)
        cost, audit = parse.best()
        assert (cost, audit) == cheapest(rows)
        made = role_parser.replay(automaton, automaton.start, audit, [({"s": "system", "u": "user", "a": "assistant"}.get(r, "x"), "") for r, *_ in rows])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in made if role))


def test_nested_grammars_are_refused():
    with pytest.raises(ValueError):
        role_parser.Automaton([("d", ("u", "d", "a")), ("d", ())])
