"""Archives bounded by bytes, and removal of lines in linear time."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from creditloom.llm import line_dedup, warc


def test_long_pages_close_files_by_bytes(spark, tmp_path):
    # 120 pages of 2 MB, one of 17 MB that has a file of its own, and small ones.
    pages = spark.range(140).select(
        F.col("id").alias("page_id"), F.format_string("http://h/%d", "id").alias("url"),
        F.when(F.col("id") < 120, F.expr("repeat(concat('<p>', id, '</p>'), 2097152 div (length(cast(id as string)) + 7))"))
        .when(F.col("id") == 120, F.expr("repeat('17 MB of it ', 1500000)")).when(F.col("id") % 2 == 0, "short").alias("html"))
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    records = {p.parent.name: len(list(p.parent.glob("*.gz"))) for p in (tmp_path / "w").rglob("*.gz")}
    assert records["size-2"] >= 30 and records["size-3"] == 1 and records["size-0"] == 1
    assert warc.captures(warc.read_records(spark, str(tmp_path / "w")).drop("payload")).count() == 140
    got = {r.page_id: r for r in warc.round_trip(spark, pages).collect()}
    assert len(got) == 140 and all(r.record_type == "response" for r in got.values())
    want = hashlib.sha1(b"17 MB of it " * 1_500_000).hexdigest()
    assert got[120].payload_bytes == 18_000_000 and got[120].payload_digest == want and got[121].payload_bytes == 0


def test_without_lines_equals_brute_force(spark):
    dice = random.Random(4)
    rows = [(None, [0]), ("", []), ("a", [0]), ("a\nb", None), ("\n\n", [0, 2]), ("a\nb", [7, 1, 1])]
    for _ in range(60):
        lines = [dice.choice(["", "x", "line é", "two words"]) for _ in range(dice.randint(1, 30))]
        rows.append(("\n".join(lines), sorted(dice.sample(range(len(lines)), dice.randint(0, len(lines))))))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, numbers array<int>")
    got = {r.k: r.left for r in df.select("k", line_dedup.without_lines(F.col("text"), F.col("numbers")).alias("left")).collect()}
    for k, (text, numbers) in enumerate(rows):
        gone = set(numbers or [])
        assert got[k] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone) if gone else text), k


def test_without_lines_of_a_very_long_text(spark):
    df = spark.createDataFrame([("\n".join(map(str, range(200_000))), list(range(0, 200_000, 2)))], "text string, numbers array<int>").cache()
    df.count()
    start = time.time()
    left = df.select(line_dedup.without_lines(F.col("text"), F.col("numbers")).alias("left")).first()[0].split("\n")
    assert left == [str(n) for n in range(1, 200_000, 2)] and time.time() - start < 30
