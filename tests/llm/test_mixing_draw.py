"""The draw within a source: probabilities in proportion to size, certain documents, frequencies over many draws."""

from pyspark.sql import functions as F

from creditloom.llm import mixing

SIZES = [*range(1, 15), 52]


def expected(sizes, room):
    """Probabilities by trying each number of certain documents."""
    ordered = sorted(sizes, reverse=True)
    for k in range(len(ordered)):
        rate = (room - sum(ordered[:k])) / sum(s * s for s in ordered[k:])
        if rate * ordered[k] <= 1:
            return {s: min(1.0, rate * s) for s in sizes}


def test_inclusion_frequencies_over_a_thousand_draws(spark):
    # 3,000 sources of equal documents with ids of their own: every third has half of its words as target.
    sources = spark.range(3000).select(F.format_string("s%04d", "id").alias("source"), "id")
    docs = sources.select(
        "source", F.posexplode(F.array(*map(F.lit, SIZES))).alias("k", "size"), (F.col("id") * 100).alias("base")
    ).select((F.col("base") + F.col("k")).alias("doc_id"), F.expr("repeat('w ', size)").alias("text"), "source")
    total = sum(SIZES)
    half = mixing.mix(docs).where(F.abs(F.col("target") - total / 2) < 1e-6)
    rows = half.groupBy("size").agg(
        F.count("*").alias("n"), F.avg((F.col("taken") > 0).cast("double")).alias("rate"),
        F.min("probability").alias("low"), F.max("probability").alias("high"),
    ).collect()
    want = expected(SIZES, total / 2)
    assert len(rows) == len(SIZES) and want[52] == 1.0 and sum(p < 1 for p in want.values()) == 14
    for r in rows:
        assert r.n == 1000 and abs(r.low - want[r.size]) < 1e-9 and abs(r.high - want[r.size]) < 1e-9
        # A draw by words is no draw by number; with so few documents its frequencies differ from the probabilities a little.
        assert abs(r.rate - want[r.size]) < 0.08, (r, want[r.size])
    by_source = half.groupBy("source").agg(F.sum("taken").alias("taken")).agg(F.avg("taken"), F.max(F.abs(F.col("taken") - total / 2))).first()
    assert abs(by_source[0] - total / 2) < 2 and by_source[1] <= max(SIZES) / 2


def test_draw_with_nulls_ties_and_empty_texts(spark):
    docs = spark.createDataFrame(
        [(None, "a b c", None), (1, "a b c", None), (1, "a b c", None), (2, None, None), (3, "", "x"), (4, "w " * 9000, "x"), (5, "w", "x")],
        "doc_id long, text string, source string",
    )
    rows = mixing.mix(docs).collect()
    assert len(rows) == 7 and all(0 <= r.probability <= 1 and r.taken <= 3 * r.size for r in rows)
    assert all(r.probability == 0 for r in rows if r.size == 0)
