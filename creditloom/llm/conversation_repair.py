"""Repair of conversation structure by generalised LR parsing (see ``role_parser``).

Rows are ordered by conversation and turn over all tasks. A conversation
that lies within one task is repaired there. The first and the last one
of each task may go on elsewhere, however long they are: their rows are counted
once per distinct row, cut into chunks, and each chunk is parsed from every
stack it could begin with. The cheapest chain of chunks is found on these
summaries, and only then are the edits carried out, chunk after chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.role_parser import ROLE_GRAMMAR, Automaton, Costs, Repair, replay
from creditloom.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
# Rows of a conversation that a task holds; a longer one is cut into chunks.
MOST_HELD = 20_000
EMIT_ROWS = 1_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
FOUND = "kind string, conv {id}, turn long, at long, role string, text string, edit string, " + ", ".join(
    f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, digest string"


@dataclass
class Repaired:
    """``conversations``: one row per conversation with rows: its counts, cost, audit and digest of the repaired text.

    ``turns``: one row per edit of an undeleted or inserted turn: ``conv, part, at, edit, role, text``, ordered by
    ``part`` and ``at`` within a conversation; None unless asked for.
    """

    conversations: DataFrame
    turns: DataFrame | None


class Counts:
    """Faults and turns of consecutive rows of one conversation."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first: str | None = None
        self.last: str | None = None
        self.low: int | None = None
        self.high: int | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool, copies: int = 1) -> tuple[bool, bool]:
        """Count a row and its adjacent copies; gives whether it must be deleted and whether it is truncated."""
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (copies - 1) * (2 * initial not in LEGAL)
        self.last = initial
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        words = text.strip(WHITE)
        if not words:
            self.blank += copies
            return True, False
        self.duplicate += copies - (not seen)
        cut = not seen and words[-1] not in ".!?"
        self.truncated += cut
        return seen, cut

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def values(self) -> tuple[int, ...]:
        return self.gaps, self.blank, self.duplicate, self.truncated, self.illegal


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, EMIT_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, EMIT_ROWS).columns))


def emitted(rows: Iterable[dict], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of rows given as dictionaries; what a row leaves out is null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + len(row.get("audit") or "")
        if len(held) >= EMIT_ROWS or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, kinds)


def digest_of(lines: Iterable[tuple[str, str]]) -> str:
    done, first = hashlib.sha256(), True
    for role, text in lines:
        done.update((("" if first else "\n") + f"{role}:{text}").encode())
        first = False
    return done.hexdigest()


def _whole(automaton: Automaton, costs: Costs, conv, rows: list[tuple], with_turns: bool) -> Iterator[dict]:
    """Repair of a conversation given as ``(turn, role, text)`` rows in order."""
    counts, parse, seen = Counts(), Repair(automaton, costs), set()
    for turn, role, text in rows:
        must_delete, cut = counts.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
        parse.row(role[:1], must_delete, cut)
    cost, audit = parse.best()
    made = [m for m in replay(automaton, automaton.start, audit, ((r, t) for _, r, t in rows)) if m[1] is not None]
    yield {"kind": "conversation", "conv": conv, "cost": cost, "audit": audit,
           "digest": digest_of((role, text) for _, role, text in made), **dict(zip(COUNTS, counts.values()))}
    if with_turns:
        for at, (edit, role, text) in enumerate(made):
            yield {"kind": "turn", "conv": conv, "at": at, "edit": edit, "role": role, "text": text}


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *,
           grammar=ROLE_GRAMMAR, costs: Costs = Costs(), with_turns: bool = False, most_held: int = MOST_HELD) -> Repaired:
    """Find each conversation's faults and its cheapest edits to a sequence of the grammar, ties by least audit.

    Rows of a conversation go by turn (nulls first), then role and text. A
    row without a character other than white space is blank, one whose
    role and text an earlier row has is a duplicate, and one that ends in none
    of ``.!?`` is truncated; the first of these counts. Blank and duplicate
    rows must be deleted. Null roles and texts count as one space; a null
    conversation is one of its own, null turns are no gaps. Roles that no
    terminal begins can be rerolled or deleted only. Rows that repeat are
    duplicates; an empty table gives empty results. Texts are taken whole, and
    other columns are ignored.
    """
    def text_of(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    id_type = rows.schema["conv"].dataType
    schema = T._parse_datatype_string(FOUND.format(id=id_type.simpleString()))
    order = ["conv", "turn", "role", "text"]
    # Equal rows may be many, so a number of each row spreads them over tasks; no result depends on it.
    placed = rows.withColumn("_spread", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*order, "_spread").sortWithinPartitions(*order)

    def whole(batches):
        automaton = Automaton(grammar)

        def found():
            held, current, inside = [], None, False
            for conv, *row in rows_of(batches):
                if (conv,) != current:
                    if inside:
                        yield from _whole(automaton, costs, current[0], held, with_turns)
                    # The first conversation may have begun in an earlier task.
                    held, inside, current = [], current is not None, (conv,)
                if inside and len(held) < most_held:
                    held.append(row)
                    continue
                if inside:
                    yield from (loose(conv, r) for r in held)
                    held, inside = [], False
                yield loose(conv, row)
            # The last one may go on in a later task.
            if inside:
                yield from (loose(current[0], r) for r in held)

        def loose(conv, row):
            return {"kind": "loose", "conv": conv, "turn": row[0], "role": row[1], "text": row[2]}

        yield from emitted(found(), schema)

    first = cut_lineage(placed.select(*order).mapInArrow(whole, schema), "repair-whole")
    names = ["conv", *COUNTS, "cost", "audit", "digest"]
    rest = _chunked(first.where("kind = 'loose'").select(*order), id_type, grammar, costs, with_turns)
    conversations = first.where("kind = 'conversation'").select(*names).union(rest.conversations.select(*names))
    turns = None
    if with_turns:
        columns = ["conv", "part", "at", "edit", "role", "text"]
        turns = first.where("kind = 'turn'").withColumn("part", F.lit(0)).select(*columns).union(rest.turns.select(*columns))
    return Repaired(conversations, turns)


# --- conversations that tasks share ---------------------------------------------------------

CHUNK = ("kind string, conv {id}, part int, at long, role string, text string, copies long, entry int, exit int, cost long, rank int, "
         "audit string, first string, last string, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long")


def _chunked(rows: DataFrame, id_type: T.DataType, grammar, costs: Costs, with_turns: bool) -> Repaired:
    """Repair of conversations of any length; equal rows of one turn are one row with a number of copies."""
    order = ["conv", "turn", "role", "text"]
    counted = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.sha2("text", 256))
    counted = cut_lineage(counted, "repair-rows")
    place = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("_first")
    earliest = counted.groupBy("conv", "role", "digest").agg(place).select(
        F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.col("_first.turn").alias("_turn"),
        F.lit(False).alias("seen"))
    on = F.col("conv").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn"))
    on = on & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    # Turns are part of the key, so that no key has more than one row on either side.
    flagged = counted.join(earliest, on, "left").select(*order, "copies", F.coalesce("seen", F.lit(True)).alias("seen"))
    placed = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    chunk_schema = T._parse_datatype_string(CHUNK.format(id=id_type.simpleString()))

    def parse(batches):
        from pyspark import TaskContext

        automaton, part = Automaton(grammar), TaskContext.get().partitionId()

        def found():
            current, at = None, 0
            for conv, turn, role, text, copies, seen in rows_of(batches):
                if (conv,) != current:
                    if current is not None:
                        yield from summary(current[0], counts, parses)
                    current, at, counts = (conv,), 0, Counts()
                    parses = {s: Repair(automaton, costs, s) for s in automaton.stacks}
                must_delete, cut = counts.add(turn, role, text, seen, copies)
                for one in parses.values():
                    one.row(role[:1], must_delete, cut, copies)
                yield {"kind": "row", "conv": conv, "part": part, "at": at, "role": role, "text": text, "copies": copies}
                at += 1
            if current is not None:
                yield from summary(current[0], counts, parses)

        def summary(conv, counts, parses):
            yield {"kind": "counts", "conv": conv, "part": part, "first": counts.first, "last": counts.last, "low": counts.low,
                   "high": counts.high, "distinct": counts.distinct, "blank": counts.blank, "duplicate": counts.duplicate,
                   "truncated": counts.truncated, "illegal": counts.illegal}
            for entry, one in parses.items():
                for leave, (cost, rank, audit) in one.exits().items():
                    yield {"kind": "path", "conv": conv, "part": part, "at": -1, "entry": entry, "exit": leave,
                           "cost": cost, "rank": rank, "audit": audit}

        yield from emitted(found(), chunk_schema)

    chunks = cut_lineage(placed.mapInArrow(parse, chunk_schema), "repair-chunks")
    chosen_schema = T._parse_datatype_string(
        f"conv {id_type.simpleString()}, part int, entry int, exit int, tail string, last boolean, cost long, " + ", ".join(f"{c} long" for c in COUNTS))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """Cheapest chain of one conversation's chunks: a few numbers per task that the conversation spans."""
        automaton = Automaton(grammar)
        table = {k: list(v.itertuples(index=False)) for k, v in pdf[pdf["kind"] == "path"].groupby("part")}
        parts = sorted(table)
        best: dict[int, tuple[int, str]] = {}
        for s in automaton.stacks:
            end = Repair(automaton, costs, s)
            best[s] = end.best()
        steps, tails = [], {s: edits for s, (_, edits) in best.items()}
        total = {s: cost for s, (cost, _) in best.items()}
        for part in reversed(parts):
            options: dict[int, tuple[int, int, int]] = {}
            for row in table[part]:
                if int(row.exit) in total:
                    # Audits of one entry are ranked, and none begins with another.
                    option = (int(row.cost) + total[int(row.exit)], int(row.rank), int(row.exit))
                    entry = int(row.entry)
                    options[entry] = min(option, options.get(entry, option))
            steps.append((part, options))
            total = {s: o[0] for s, o in options.items()}
        stats = pdf[pdf["kind"] == "counts"].sort_values("part").astype(object).where(lambda x: x.notna(), None)
        sums = {c: int(stats[c].sum()) for c in COUNTS[1:]}
        distinct, low, high, last = 0, None, None, None
        for row in stats.itertuples(index=False):
            sums["illegal"] += last is not None and last + row.first not in LEGAL
            last = row.last
            if row.low is not None:
                distinct += int(row.distinct) - (row.low == high)
                low, high = row.low if low is None else low, row.high
        sums["gaps"] = 0 if low is None else int(high) - int(low) + 1 - distinct
        entry, out = automaton.start, []
        cost = total[entry]
        for k, (part, options) in enumerate(reversed(steps)):
            leave, last_one = options[entry][2], k == len(steps) - 1
            out.append((pdf["conv"].iloc[0], part, entry, leave, tails[leave] if last_one else "", last_one, cost, *(sums[c] for c in COUNTS)))
            entry = leave
        return pd.DataFrame(out, columns=chosen_schema.fieldNames())

    summaries = chunks.where("kind <> 'row'").select(
        "conv", "kind", "part", "entry", "exit", "cost", "rank", "first", "last", "low", "high", "distinct", *COUNTS[1:])
    chosen = cut_lineage(summaries.groupBy("conv").applyInPandas(solve, chosen_schema), "repair-chosen")
    ways = chosen.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), F.col("entry").alias("_entry"), F.col("exit").alias("_exit"), "tail")
    on = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    edits = chunks.where("kind = 'path'").join(ways, on & (F.col("entry") == F.col("_entry")) & (F.col("exit") == F.col("_exit")))
    columns = ["conv", "part", "at", "role", "text", "copies", "entry", "audit"]
    edits = edits.withColumn("audit", F.concat("audit", "tail")).select(*columns)
    # What a conversation's edits say comes before the rows of its chunk.
    both = edits.union(chunks.where("kind = 'row'").select(*columns)).repartition("conv").sortWithinPartitions("conv", "part", "at")
    out_schema = T._parse_datatype_string(
        f"kind string, conv {id_type.simpleString()}, part int, at long, edit string, role string, text string, audit string, digest string")

    def carry_out(batches):
        automaton = Automaton(grammar)

        def found():
            source = iter(rows_of(batches))
            row = next(source, None)
            while row is not None:
                conv, audit, digest, lines = row[0], [], hashlib.sha256(), 0
                while row is not None and row[0] == conv:
                    part, entry, edits, at = row[1], row[6], row[7], 0
                    copies: list[int] = []

                    def own():
                        nonlocal row
                        row = next(source, None)
                        while row is not None and row[0] == conv and row[1] == part:
                            copies.append(row[5])
                            yield row[3], row[4]
                            row = next(source, None)

                    for edit, role, text in replay(automaton, entry, edits, own()):
                        audit.append(edit)
                        if edit != "I":
                            audit.append("D" * (copies.pop() - 1))
                        if role is None:
                            continue
                        digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                        lines += 1
                        if with_turns:
                            yield {"kind": "turn", "conv": conv, "part": part, "at": at, "edit": edit, "role": role, "text": text}
                            at += 1
                    # The last row of a chunk leaves its generator at the next chunk's first row.
                    if row is not None and row[0] == conv and row[1] == part:
                        row = next(source, None)
                yield {"kind": "conversation", "conv": conv, "audit": "".join(audit), "digest": digest.hexdigest()}

        yield from emitted(found(), out_schema)

    done = cut_lineage(both.mapInArrow(carry_out, out_schema), "repair-edits")
    last = chosen.where("last").drop("part", "entry", "exit", "tail", "last").withColumnRenamed("conv", "_conv")
    whole = done.where("kind = 'conversation'").select("conv", "audit", "digest")
    return Repaired(whole.join(last, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv"), done.where("kind = 'turn'"))


# --- query ------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to ``conv_id, turn, role, text``, by a checksum of conversation and turn."""
    def text_of(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    known = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("_fault"))
    changed = known.where("_fault <> 0").select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_fault") == 3, 2).otherwise(1).alias("_copies"),
    )
    return changed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The contract's columns for every conversation of ``rows``, which are damaged first."""
    rows = rows.select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows)).conversations
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return joined.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda c: CAST(ord(c) AS BIGINT)),
      lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 20 AS f
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE f <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS occurrence FROM placed),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN occurrence > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM counted),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY conv_id),
inserts(q, p, cost, edits, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
moves(q, role, name, next) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
edits AS (
  SELECT q, next, 'K' AS edit, 0 AS cost, role, NULL AS name FROM moves UNION ALL SELECT q, next, 'R', 3, NULL, name FROM moves WHERE name IS NOT NULL
  UNION ALL SELECT range, range, 'D', 4, NULL, NULL FROM range(4)),
parse AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT p.conv_id, f.i, CAST(e.next AS BIGINT) AS q,
      CAST(p.cost + n.cost + e.cost + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS BIGINT) AS cost,
      p.audit || n.edits || e.edit AS audit,
      list_concat(list_concat(p.lines, n.lines), CASE e.edit WHEN 'D' THEN [] ELSE [coalesce(e.name, f.role) || ':' || f.text] END) AS lines
    FROM parse p JOIN inserts n ON n.q = p.q JOIN edits e ON e.q = n.p
    JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    WHERE e.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR e.role = f.r)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ended AS (
  SELECT p.conv_id, p.cost + n.cost AS cost, p.audit || n.edits AS audit, list_concat(p.lines, n.lines) AS lines
  FROM parse p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n JOIN inserts n ON n.q = p.q AND n.p IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + n.cost, p.audit || n.edits) = 1)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit,
  sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
