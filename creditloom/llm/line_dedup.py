"""Line dedup by a segment-partition edit join.

Two lines within ``edits`` edits share one of the first line's ``edits + 1``
segments unchanged. Segments are indexed with line length and segment number,
each line probes the few substrings of every shorter or equal length that can
hold a segment, and candidates are verified by a banded bit-parallel edit distance.
Equal lines are found by digest at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import arrow_map, components, semi_join_keys
from creditloom.session import cut_lineage

EDITS = 2
# Shorter lines are linked if equal only: a few edits make other lines of them.
MIN_CHARS = 30
# What a line without a word consists of.
BLANK = " \t\n\v\f\r"
# A segment's lines are compared in blocks of about this many by this many.
BLOCK = 512
# Cells (pairs x characters) verified at a time.
CELLS = 1_000_000
REMEMBERED_LINES = 100_000

INDEX, PROBE, BOTH = 0, 1, 2


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and width of ``edits + 1`` even segments; longer ones last."""
    count = edits + 1
    width, extra = divmod(length, count)
    found, at = [], 0
    for k in range(count):
        own = width + (k >= count - extra)
        found.append((at, own))
        at += own
    return found


def probe_plan(length: int, edits: int) -> list[tuple[int, int, int, int, int]]:
    """``(indexed length, segment, start, width, role)`` of all substrings of a line to index or look up.

    A segment that matches unchanged stands where the edits to its left and to
    its right allow: that leaves a few starts for each segment and length.
    """
    plan = []
    for other in range(max(edits + 1, length - edits), length + 1):
        shift = length - other
        for k, (at, width) in enumerate(segments(other, edits)):
            low = max(0, at - k, at + shift - (edits - k))
            high = min(length - width, at + k, at + shift + (edits - k))
            for start in range(low, high + 1):
                own = other == length and start == at
                plan.append((other, k, start, width, BOTH if own else PROBE))
    return plan


def code_points(line: str) -> np.ndarray:
    """Code points plus one, so that 0 can stand for no character."""
    return np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32) + np.uint32(1)


def within_edits(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """For pairs of lines as ``code_points``, whether their edit distance is at most ``edits``; all pairs at once.

    A banded bit-parallel recurrence: each pair is one 64-bit word that holds the
    vertical differences in a band of ``2 * edits + 1`` cells around the diagonal,
    one step per character. Equal ends are left out, and a pair is given up when
    all of its band exceeds ``edits``. Lines must have ``edits`` characters or more.
    """
    if not left:
        return np.zeros(0, dtype=bool)
    swap = [len(x) < len(y) for x, y in zip(left, right, strict=True)]
    a = [y if s else x for x, y, s in zip(left, right, swap, strict=True)]
    b = [x if s else y for x, y, s in zip(left, right, swap, strict=True)]
    rows, columns = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    result = np.zeros(len(a), dtype=bool)
    chosen = np.flatnonzero(rows - columns <= edits)
    if not len(chosen):
        return result
    start, end = differing(a, b, rows, columns, chosen, edits)
    # What equal ends leave of each pair, with ``edits`` places before the first row.
    rows, columns = end - start, end - start - (rows[chosen] - columns[chosen])
    padded_a = np.zeros((len(chosen), int(rows.max()) + 2 * edits + 1), dtype=np.uint32)
    padded_b = np.full((len(chosen), int(rows.max()) + 1), 0xFFFFFFFF, dtype=np.uint32)
    for k, which in enumerate(chosen):
        padded_a[k, edits : edits + rows[k]] = a[which][start[k] : start[k] + rows[k]]
        padded_b[k, : columns[k]] = b[which][start[k] : start[k] + columns[k]]
    # Columns first: each step reads one line of memory.
    padded_a, padded_b = np.ascontiguousarray(padded_a.T), np.ascontiguousarray(padded_b.T)
    one, top, band = np.uint64(1), 63, 2 * edits + 1
    alive = np.arange(len(chosen))
    vp = np.full(len(chosen), ((1 << (edits + 1)) - 1) << (top - edits), dtype=np.uint64)
    vn = np.zeros(len(chosen), dtype=np.uint64)
    distance = np.full(len(chosen), edits, dtype=np.int64)
    corner = rows - edits  # columns that move down the band's lower edge
    for column in range(int(columns.max())):
        symbol = padded_b[column]
        match = np.zeros(len(alive), dtype=np.uint64)
        for r in range(band):  # row column - edits + r, at bit top - 2 * edits + r
            match |= (padded_a[column + r] == symbol).astype(np.uint64) << np.uint64(top - 2 * edits + r)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        down = column < corner
        step_down = 1 - (d0 >> np.uint64(top)).astype(np.int64)
        bit = np.maximum(0, top - 1 - np.maximum(0, column - corner)).astype(np.uint64)
        step_right = ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64)
        distance += np.where(down, step_down, step_right)
        shifted = d0 >> one
        vp = hn | ~(shifted | hp)
        vn = shifted & hp
        ended = columns == column + 1
        keep = ~ended
        if ended.any():
            result[chosen[alive[ended]]] = distance[ended] <= edits
        if column % 4 == 3:
            # The least value in the band cannot fall any more; walk up from its lower edge.
            least, value = distance.copy(), distance.copy()
            for step in range(2 * edits):
                at = np.uint64(top - 1 - step)
                value -= ((vp >> at) & one).astype(np.int64) - ((vn >> at) & one).astype(np.int64)
                least = np.minimum(least, value)
            keep &= ~down | (least <= edits)
        if not keep.all():
            alive, vp, vn, distance = alive[keep], vp[keep], vn[keep], distance[keep]
            rows, columns, corner = rows[keep], columns[keep], corner[keep]
            padded_a, padded_b = padded_a[:, keep], padded_b[:, keep]
            if not len(alive):
                break
    return result


def differing(a: list, b: list, rows: np.ndarray, columns: np.ndarray, chosen: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs start and end to differ, in the longer line, with ``edits`` equal places kept at both ends."""
    start, end = np.zeros(len(chosen), np.int64), rows[chosen].astype(np.int64)
    for k, which in enumerate(chosen):
        x, y = a[which], b[which]
        size = len(y)
        unequal = np.flatnonzero(x[:size] != y)
        front = int(unequal[0]) if len(unequal) else size
        unequal = np.flatnonzero(x[len(x) - size :] != y)
        back = size - 1 - int(unequal[-1]) if len(unequal) else size
        front = max(0, min(front, size) - edits)
        back = max(0, min(back, size - front) - edits)
        start[k] = front
        end[k] -= back
    return start, end


def spanning_links(index: list[tuple[bytes, np.ndarray]], probe: list[tuple[bytes, np.ndarray]], edits: int) -> list[tuple[bytes, bytes]]:
    """Links between two lists of distinct lines, without those that other links imply."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, chunk = [], []

    def settle() -> None:
        open_pairs = [(x, y) for x, y in chunk if root(x[0]) != root(y[0])]
        found = within_edits([x[1] for x, _ in open_pairs], [y[1] for _, y in open_pairs], edits)
        for (x, y), near in zip(open_pairs, found, strict=True):
            if near and root(x[0]) != root(y[0]):
                parent[root(x[0])] = root(y[0])
                links.append((min(x[0], y[0]), max(x[0], y[0])))
        chunk.clear()

    cells = 0
    for x in index:
        for y in probe:
            if x[0] != y[0] and len(y[1]) >= len(x[1]):
                chunk.append((x, y))
                cells += len(y[1])
                if cells >= CELLS:
                    settle()
                    cells = 0
    settle()
    return links


def verified(rows: DataFrame, edits: int) -> DataFrame:
    """Links ``(a, b)`` from rows ``key, block_i, block_p, role, digest, line`` that lie sorted by key and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, probe = None, [], []
        out: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for key, i, p, role, digest, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, p) != current:
                    out += spanning_links(index, probe, edits)
                    current, index, probe = (key, i, p), [], []
                entry = (digest, code_points(line))
                if role != PROBE:
                    index.append(entry)
                if role != INDEX:
                    probe.append(entry)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"]
            )
            out = []
        out = spanning_links(index, probe, edits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"]
        )

    return rows.mapInArrow(run, "a binary, b binary")


def line_digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8"))


def occurrences(source: DataFrame) -> DataFrame:
    """Per document of ``source(row, id, text)``: ``row, id, n_lines`` and number and digest of each line with a word."""

    def run(batch):
        counts, numbers, digests = [], [], []
        for text in batch.column(2).to_pylist():
            lines = [] if text is None else text.split("\n")
            chosen = [(n, line_digest(x)) for n, x in enumerate(lines) if x.strip(BLANK)]
            counts.append(len(lines))
            numbers.append([n for n, _ in chosen])
            digests.append([d for _, d in chosen])
        return [batch.column(0), batch.column(1), counts, numbers, digests]

    return arrow_map(source, run, "row long, id long, n_lines long, numbers array<int>, digests array<binary>")


def near_lines(source: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Links between different lines of ``min_chars`` characters or more within ``edits`` edits; enough of them to connect all."""

    # Lines and plans that a task has met; empty here, and emptied when large, which only repeats rows.
    seen, plans = set(), {}

    def entries(batch):
        keys, roles, lines = [], [], []
        if len(seen) > REMEMBERED_LINES:
            seen.clear()
        for text in batch.column(0).to_pylist():
            for line in (text or "").split("\n"):
                size = len(line)
                if size < min_chars or not line.strip(BLANK):
                    continue
                number = xxhash.xxh3_64_intdigest(line.encode("utf-8"))
                if number in seen:
                    continue
                seen.add(number)
                plan = plans.get(size)
                if plan is None:
                    plan = plans[size] = [(start, start + width, other * 8 + k, role) for other, k, start, width, role in probe_plan(size, edits)]
                for start, end, seed, role in plan:
                    keys.append(xxhash.xxh3_64_intdigest(line[start:end].encode("utf-8"), seed))
                    roles.append(role)
                lines += [number] * len(plan)
        return [
            pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(np.array(roles, dtype=np.int8)),
            pa.array(np.array(lines, dtype=np.uint64).view(np.int64)),
        ]

    found = arrow_map(source.select("text"), entries, "key long, role byte, number long").repartition("key")
    group = Window.partitionBy("key")
    # A key is of use if different lines hold it and one of them is indexed under it.
    shared = found.select(
        "*", F.min("number").over(group).alias("low"), F.max("number").over(group).alias("high"),
        F.max(F.when(F.col("role") != PROBE, 1).otherwise(0)).over(group).alias("indexed"),
    ).where("low < high AND indexed = 1").select("key", "role", "number").distinct()
    shared = cut_lineage(shared, "lines-shared")

    met = set()

    def texts(batch):
        numbers, digests, lines = [], [], []
        if len(met) > REMEMBERED_LINES:
            met.clear()
        for text in batch.column(0).to_pylist():
            for line in (text or "").split("\n"):
                if len(line) < min_chars or not line.strip(BLANK):
                    continue
                number = xxhash.xxh3_64_intdigest(line.encode("utf-8"))
                if number not in met:
                    met.add(number)
                    numbers.append(number)
                    digests.append(line_digest(line))
                    lines.append(line)
        return [pa.array(np.array(numbers, dtype=np.uint64).view(np.int64)), digests, lines]

    lines = semi_join_keys(
        arrow_map(source.select("text"), texts, "number long, digest binary, line string"),
        cut_lineage(shared.select("number").distinct(), "lines-wanted"), "number",
    ).distinct()
    # A key held by many lines is cut into blocks of index lines by blocks of probing lines.
    counts = shared.groupBy("key").agg(
        F.ceil(F.sum(F.when(F.col("role") != PROBE, 1).otherwise(0)) / BLOCK).cast("int").alias("of_i"),
        F.ceil(F.sum(F.when(F.col("role") != INDEX, 1).otherwise(0)) / BLOCK).cast("int").alias("of_p"),
    )
    sized = shared.join(counts, "key")
    own_i, own_p = F.pmod(F.xxhash64("number"), "of_i"), F.pmod(F.xxhash64("number", F.lit(1)), "of_p")
    all_i, all_p = F.sequence(F.lit(0), F.col("of_i") - 1), F.sequence(F.lit(0), F.col("of_p") - 1)
    as_index = sized.where(F.col("role") != PROBE).select(
        "key", "number", own_i.cast("int").alias("block_i"), F.explode(all_p).alias("block_p"), F.lit(INDEX).alias("role")
    )
    as_probe = sized.where(F.col("role") != INDEX).select(
        "key", "number", F.explode(all_i).alias("block_i"), own_p.cast("int").alias("block_p"), F.lit(PROBE).alias("role")
    )
    placed = as_index.union(as_probe).join(lines, "number").select("key", "block_i", "block_p", "role", "digest", "line")
    # Few bytes but much work: as many tasks as the session's shuffles have, not fewer.
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = placed.repartition(tasks, "key", "block_i", "block_p").sortWithinPartitions("key", "block_i", "block_p")
    return cut_lineage(verified(sorted_rows, edits).distinct(), "lines-links")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edits: int = EDITS, min_chars: int = MIN_CHARS, row_col: str | None = None) -> DataFrame:
    """One row per document: ``id, row, n_lines, n_removed, repeats``.

    ``repeats`` lists the lines that go, each as ``(line_no, first_id,
    first_line)``: its number in the text and the first line of its class, in
    order of id (null last), row and line. A class holds equal lines of any
    length and all that links of at most ``edits`` edits (in code points) between
    lines of ``min_chars`` characters or more connect; its first line stays.
    Lines end at ``\\n``; those without a word always stay. A null text has no lines. Rows that repeat an
    id are documents of their own, told apart by ``row``; ``row_col`` names a
    caller's row key, which must be unique. An empty table gives an empty result.
    """
    if min_chars < edits + 1:
        raise ValueError("min_chars must exceed edits")
    row = F.col(row_col) if row_col else F.lit(None)
    source = docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = occurrences(source)
    # Row keys are given once, as the table is written: another scan of the texts might be split otherwise.
    table = cut_lineage(table if row_col else table.withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = table.select("row", "id", F.explode(F.arrays_zip("numbers", "digests")).alias("line")).select(
        "row", "id", F.col("line.numbers").alias("line_no"), F.col("line.digests").alias("digest")
    )
    spot = F.struct(F.col("id").isNull().alias("last"), "id", "row", "line_no")
    groups = lines.groupBy("digest").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("size"))
    labels = components(near_lines(source, edits, min_chars), "lines-classes")
    named = groups.join(labels.withColumnRenamed("node", "digest"), "digest", "left").where("size > 1 OR label IS NOT NULL")
    named = cut_lineage(named.withColumn("label", F.coalesce("label", "digest")), "lines-named")
    firsts = named.groupBy("label").agg(F.min("first").alias("first"))
    class_of = named.select("digest", "label").join(firsts, "label").select("digest", "first")
    gone = (
        lines.join(class_of, "digest")
        .where((F.col("row") != F.col("first.row")) | (F.col("line_no") != F.col("first.line_no")))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
            "line_no", F.col("first.id").alias("first_id"), F.col("first.line_no").alias("first_line")
        ))).alias("repeats"))
    )
    return table.select("row", "id", "n_lines").join(gone, "row", "left").select(
        "id", "row", "n_lines", F.coalesce(F.size("repeats"), F.lit(0)).cast("long").alias("n_removed"), "repeats",
    )


def without_lines(text: Column, numbers: Column) -> Column:
    """``text`` without the lines of these numbers; unchanged where ``numbers`` is null or empty.

    Numbers become one flag per line first, so the work is linear in lines and numbers.
    """
    at = F.array_sort(F.array_distinct(numbers))
    before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1))
    flags = F.array_join(F.zip_with(at, before, lambda n, last: F.concat(F.repeat(F.lit("k"), n - last - 1), F.lit("-"))), "")
    # Bound by an outer lambda: both arrays are made once a text.
    pair = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), F.split(flags, "").alias("flags")))
    left = F.transform(pair, lambda p: F.filter(p["lines"], lambda _, k: F.coalesce(F.get(p["flags"], k), F.lit("k")) != "-"))[0]
    return F.when(numbers.isNull() | (F.size(numbers) == 0), text).otherwise(F.array_join(left, "\n"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    none = F.array().cast("array<struct<line_no:int,first_id:bigint,first_line:int>>")
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.coalesce("repeats", none).alias("repeats"))
