"""Text features from Spark's own string and array functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import constants as K
from creditloom.functions import scalars as S
from creditloom.session import cut_lineage, frequent_join, lookup_join, unnest

# Letters, digits, apostrophes and hyphens make up a word; the rest separates words.
WORD_BREAK = r"[^\p{L}\p{N}'-]+"
SENTENCE_END = r"[.!?]+"


def text_present(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def sentence_count(text: Column | str) -> Column:
    """Pieces between sentence marks; NULL for NULL."""
    text = S.col_of(text)
    return F.when(text.isNotNull(), F.size(F.split(text, SENTENCE_END)))


def strip_markup(text: Column | str) -> Column:
    """Without tags and boiler-plate, lower-case.

    A tag has a ``<`` and the boiler-plate a date with slashes: a text without them is not searched.
    """
    text = S.col_of(text)
    no_tags = F.when(text.contains("<"), F.regexp_replace(text, K.HTML_TAG, " ")).otherwise(text)
    return F.lower(F.when(text.contains("/"), F.regexp_replace(no_tags, K.BOILERPLATE, "")).otherwise(no_tags))


def words(text: Column) -> Column:
    """All words of an already lower-case text, in order."""
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def clean_tokens(text: Column | str,
                 stop_words: Sequence[str] = (*K.ENGLISH_STOP_WORDS, *K.ENGLISH_CONTRACTIONS, *K.DOMAIN_STOP_WORDS)) -> Column:
    """Tokens of a description: no stop words or contractions of them, no short words, no plain numbers.

    NULL or blank text gives an empty array. The stop list is an optimised
    ``IN`` set, so the cost per token does not grow with its length. A word has letters, digits,
    apostrophes and hyphens only, so trimming its start shows what it lacks without a pattern.
    """
    stops = [w for w in dict.fromkeys(stop_words) if len(w) > 2]

    def wanted(w: Column) -> Column:
        return (
            (F.length(w) > 2) & ~w.startswith("'") & (F.ltrim(w, F.lit("0123456789")) != "")
            & (F.ltrim(w, F.lit("'-")) != "") & ~w.isin(stops)
        )

    tokens = F.filter(F.split(strip_markup(text), WORD_BREAK), wanted)
    return F.coalesce(tokens, F.array().cast("array<string>"))


def with_lemmas(df: DataFrame, tokens: str, lemmas: DataFrame, key: str = "id") -> DataFrame:
    """Replace tokens by the lemma in ``lemmas(token, lemma)``; keep the others.

    Token rows are salted by row key when the dictionary is too large to
    broadcast. The order of the tokens is kept.
    """
    exploded = unnest(df, [key], tokens, "pos", "token")
    joined = lookup_join(exploded, lemmas.select("token", "lemma"), "token", salt_by=key)
    rebuilt = (
        joined.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("lemma", "token").alias("w")))).alias("_w"))
        .select(key, F.transform("_w", lambda s: s["w"]).alias("_lemmas"))
    )
    empty = F.array().cast("array<string>")
    return df.join(rebuilt, key, "left").withColumn(tokens, F.coalesce("_lemmas", empty)).drop("_lemmas")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; equal counts by value."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(column)).limit(k)
    )


def token_counts(df: DataFrame, tokens: str, k: int | None = None) -> DataFrame:
    """Token frequency over the corpus, optionally the top ``k``."""
    exploded = unnest(df, [], tokens, "token")
    if k is not None:
        return top_values(exploded, "token", k)
    return exploded.groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def term_statistics(df: DataFrame, tokens: str, label: str | None = None) -> DataFrame:
    """Per token: document frequency and summed term frequency (per class).

    Each row gives its tokens, and its distinct tokens once more as document
    marks. Both are summed in one aggregate, so the shuffle carries one partly
    summed row per token and task; (document, token) pairs are never shuffled,
    and a word that is in every document is no hot key.
    """
    def marks(words_: Column, tf: int, df_: int) -> Column:
        return F.transform(words_, lambda t: F.struct(t.alias("token"), F.lit(tf).alias("tf"), F.lit(df_).alias("df")))

    keep = [label] if label else []
    marked = df.select(*keep, tokens).select(
        *keep, F.concat(marks(F.col(tokens), 1, 0), marks(F.array_distinct(tokens), 0, 1)).alias("_m"))
    rows = unnest(marked, keep, "_m", "m").select(*keep, "m.token", "m.tf", "m.df")
    measures = [F.sum("df").alias("df"), F.sum("tf").alias("tf")]
    if label:
        for side, value in (("bad", 0), ("good", 1)):
            part = F.sum(F.when(F.col(label) == value, F.col("tf")).otherwise(0))
            measures.append(part.alias(f"tf_{side}"))
    return rows.groupBy("token").agg(*measures)


def idf(document_frequency: Column, documents: Column, min_doc_freq: int = 0) -> Column:
    """``ln((N+1)/(df+1))``, zero below ``min_doc_freq``."""
    weight = F.ln((documents + 1) / (document_frequency + 1))
    return F.when(document_frequency >= min_doc_freq, weight).otherwise(F.lit(0.0))


def mean_tfidf(df: DataFrame, tokens: str, *, min_doc_freq: int = 0) -> DataFrame:
    """Mean TF-IDF weight per token over all documents.

    The mean needs sums only, so the weights are never joined back to documents.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    stats = term_statistics(df, tokens)
    weight = idf(F.col("df"), n, min_doc_freq)
    return stats.select("token", "df", "tf", weight.alias("idf"), (F.col("tf") * weight / n).alias("mean_tfidf"))


def tfidf_contrast(df: DataFrame, tokens: str, label: str = "good_bad", *,
                   min_doc_freq: int = 0) -> DataFrame:
    """Mean TF-IDF in defaults minus mean in the others, per token."""
    sizes = df.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("bad"),
        F.count_if(F.col(label) == 1).alias("good"))).scalar()
    weight = idf(F.col("df"), sizes["n"], min_doc_freq)
    bad = F.col("tf_bad") * weight / F.greatest(sizes["bad"], F.lit(1))
    good = F.col("tf_good") * weight / F.greatest(sizes["good"], F.lit(1))
    return (
        term_statistics(df, tokens, label)
        .select("token", "df", bad.alias("mean_bad"), good.alias("mean_good"))
        .withColumn("difference", F.col("mean_bad") - F.col("mean_good"))
    )


def top_terms(table: DataFrame, weight: str, k: int = 20) -> DataFrame:
    """Top ``k`` tokens by absolute weight, ties (to nine digits) by token."""
    return table.orderBy(F.desc(F.round(F.abs(F.col(weight)), 9)), "token").limit(k)


# --- sentence extraction -------------------------------------------------------------

def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty sentences of the cleaned text, in order."""
    parts = F.transform(F.split(strip_markup(text), SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: s != "")


def long_words(sentence: Column) -> Column:
    return F.filter(F.split(sentence, WORD_BREAK), lambda w: F.length(w) > 2)


def extract_by_match(text: Column | str, knowledge_base: Sequence[str], keep: int = 2) -> Column:
    """The ``keep`` sentences that share most words with the knowledge base.

    Works inside each row, without a shuffle. Equal scores keep text order;
    NULL or blank text gives an empty text.
    """
    base = F.array(*[F.lit(w) for w in sorted(set(knowledge_base))])
    scored = F.transform(
        sentences(text),
        lambda s, i: F.struct((-F.size(F.array_intersect(long_words(s), base))).alias("rank"),
                              i.alias("pos"), s.alias("sentence")),
    )
    best = F.slice(F.array_sort(scored), 1, keep)
    joined = F.array_join(F.transform(best, lambda b: b["sentence"]), " ")
    return F.coalesce(joined, F.lit(""))


def sentence_scores(df: DataFrame, text: str, knowledge_base: Sequence[str], key: str = "id") -> DataFrame:
    """``(key, pos, sentence, score)``: one row per sentence."""
    base = F.array(*[F.lit(w) for w in sorted(set(knowledge_base))])
    return unnest(df, [key], sentences(text), "pos", "sentence").withColumn(
        "score", F.size(F.array_intersect(long_words(F.col("sentence")), base))
    )


def extract_by_distance(df: DataFrame, text: str, vectors: DataFrame, knowledge_base: Sequence[str],
                        *, key: str = "id", keep: int = 2, out: str = "extracted") -> DataFrame:
    """Like :func:`extract_by_match`, ranked by cosine to the knowledge-base centroid.

    ``vectors(word, vector)`` holds ML vectors. The words of a sentence are summed
    in the task that read it, with the vectors that can be broadcast: all, or
    those of the most frequent words; rare words are joined to the rest. A sentence with fewer
    than two known words goes last.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    # One vector of a fixed, small width.
    found = vectors.where(F.col("word").isin(list(knowledge_base))).agg(
        Summarizer.mean(F.col("vector")).alias("c")).first()["c"]
    if found is None:
        raise ValueError("no word of the knowledge base has a vector")
    centre = [float(x) for x in found]
    dims = range(len(centre))
    lines = unnest(df, [key], sentences(text), "pos", "sentence")
    written = cut_lineage(lines.select(key, "pos", long_words(F.col("sentence")).alias("words")), "sentence-words")
    tokens = unnest(written, [key, "pos"], "words", "word")
    # One number column per dimension: sums then stay in Spark's own hash
    # aggregate instead of one object per sentence.
    array = vectors.select("word", vector_to_array("vector").alias("_v"))
    table = cut_lineage(array.select("word", *[F.col("_v")[i].alias(f"_v{i}") for i in dims]), "word-vectors")
    known = frequent_join(tokens, table, "word", salt_by=key)
    summed = known.groupBy(key, "pos").agg(
        F.count(F.lit(1)).alias("n_known"), *[F.sum(f"_v{i}").alias(f"_s{i}") for i in dims])
    length = F.sqrt(sum(F.col(f"_s{i}") * F.col(f"_s{i}") for i in dims))
    along = sum(F.col(f"_s{i}") * F.lit(c) for i, c in zip(dims, centre))
    size = math.sqrt(sum(c * c for c in centre))
    score = F.when((length > 0) & F.lit(size > 0), along / (length * F.lit(size or 1.0))).otherwise(F.lit(0.0))
    scores = summed.where("n_known >= 2").select(key, "pos", score.alias("score"))
    # Scores go back to their text as one small map per row, so sentences are
    # ranked inside the row and never shuffled themselves.
    by_row = scores.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "score"))).alias("_scores"))
    ranked = F.transform(sentences(text), lambda s, i: F.struct(
        F.coalesce(-F.col("_scores")[i], F.lit(float("inf"))).alias("rank"), i.alias("pos"), s.alias("sentence")))
    best = F.slice(F.array_sort(ranked), 1, keep)
    chosen = F.array_join(F.transform(best, lambda b: b["sentence"]), " ")
    return df.join(by_row, key, "left").withColumn(out, F.coalesce(chosen, F.lit(""))).drop("_scores")


# --- vectors -------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(vector: Column | str) -> Column:
    """The vector divided by its length; NULL when it has none.

    The length is bound by an outer lambda, so it is computed once a vector.
    """
    vector = S.col_of(vector)
    pair = F.struct(vector.alias("v"), F.sqrt(dot(vector, vector)).alias("n"))
    return F.transform(F.array(pair), lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when either has no length."""
    return unit_cosine(unit(a), unit(b))


def unit_cosine(a: Column, b: Column) -> Column:
    return F.coalesce(dot(a, b), F.lit(0.0))


# Query vectors that one row of a block holds.
QUERY_BLOCK = 256


def cosines(vectors: DataFrame, queries: DataFrame, word: str, vector: str) -> DataFrame:
    """``(query, word, cosine)`` of all ``vectors`` against a stated set of query vectors, in blocks.

    The queries, any number of them, become rows of ``QUERY_BLOCK`` unit vectors each; a vector
    meets a block in one row and all its cosines are computed there, from one
    unit vector, before they become rows.
    """
    count = queries.count()
    block = F.pmod(F.xxhash64(F.col(word)), F.lit(max(1, -(-count // QUERY_BLOCK))))
    blocks = queries.groupBy(block.alias("_block")).agg(
        F.collect_list(F.struct(F.col(word).alias("w"), unit(vector).alias("v"))).alias("_queries")
    ).select("_queries")
    pair = F.struct(unit(vector).alias("v"), F.col("_queries").alias("q"))
    found = F.transform(F.array(pair), lambda p: F.transform(
        p["q"], lambda s: F.struct(s["w"].alias("query"), unit_cosine(p["v"], s["v"]).alias("cosine"))))[0]
    return vectors.select(word, vector).crossJoin(blocks).select(
        F.col(word).alias("word"), F.explode(found).alias("_f")
    ).select("_f.query", "word", "_f.cosine")


def cosine_matrix(vectors: DataFrame, words_: Sequence[str] | None = None,
                  word: str = "word", vector: str = "vector") -> DataFrame:
    """``(word_a, word_b, cosine)`` over chosen words; the matrix is the result.

    Words without a vector give no rows.
    """
    chosen = vectors if words_ is None else vectors.where(F.col(word).isin(list(words_)))
    return cosines(chosen, chosen, word, vector).select(
        F.col("word").alias("word_a"), F.col("query").alias("word_b"), "cosine")


def nearest(vectors: DataFrame, seeds: DataFrame, k: int = 5, *, word: str = "word",
            vector: str = "vector") -> DataFrame:
    """``(seed, word, cosine, rank)``: the ``k`` nearest words of each seed, itself left out.

    The vector table is read once and never shuffled whole: each task keeps its
    own ``k`` best per seed before the exchange.
    """
    scored = cosines(vectors, seeds, word, vector).where(F.col("query") != F.col("word"))
    scored = scored.withColumnRenamed("query", "seed")
    order = Window.partitionBy("seed").orderBy(F.desc(F.round("cosine", 9)), "word")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_lookup(vocabulary: DataFrame, vectors: DataFrame, size: int, word: str = "word",
                  vector: str = "vector") -> DataFrame:
    """Vector of each vocabulary word; a word without one gets zeros."""
    joined = lookup_join(vocabulary, vectors.select(word, vector), word)
    return joined.withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0), size)))


def mean_vectors(vectors: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """Mean array per group; vectors are summed inside each task first."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vectors.groupBy(by).agg(
        Summarizer.mean(array_to_vector(vector)).alias("_m")
    ).select(by, vector_to_array("_m").alias(vector))


# --- vocabulary and sequences -----------------------------------------------------------

def vocabulary(df: DataFrame, tokens: str, size: int = K.SEQUENCE_VOCABULARY) -> DataFrame:
    """``(token, code)``: frequency rank, 2 for the most frequent; 1 means unknown.

    Codes stay below ``size``, so ``size - 2`` tokens get one. Only those few
    rows are ranked.
    """
    ranked = Window.orderBy(F.desc("count"), "token")
    top = token_counts(df, tokens, size - 2)
    return top.select("token", (F.row_number().over(ranked) + 1).cast("int").alias("code"))


def encode_sequences(df: DataFrame, tokens: str, vocab: DataFrame, *, key: str = "id",
                     length: int = K.SEQUENCE_LENGTH, out: str = "sequence") -> DataFrame:
    """Fixed-length code arrays: cut after ``length`` tokens, padded with 0 at the end.

    Gives ``(key, out)``. The vocabulary has a fixed size and is broadcast; the
    codes of a row are gathered in the task that read it, then sent once. An
    empty row stays through the outer explode, so nothing is joined back.
    """
    cut = df.select(key, F.posexplode_outer(F.slice(tokens, 1, length)).alias("pos", "token"))
    coded = cut.join(F.broadcast(vocab), "token", "left")
    code = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("code", F.lit(1)).alias("code")))
    lists = coded.groupBy(key).agg(F.sort_array(F.collect_list(code)).alias("_c"))
    codes = F.transform("_c", lambda c: c["code"])
    padded = F.slice(F.concat(codes, F.array_repeat(F.lit(0), length)), 1, length)
    return lists.select(key, padded.alias(out))


# --- value buckets and clusters ----------------------------------------------------------

def top_bucket(df: DataFrame, column: str, out: str, top: Sequence[str], other: str = "other") -> DataFrame:
    """Values outside ``top`` (and NULL) become ``other``."""
    return df.withColumn(out, F.coalesce(S.known_or(F.col(column), list(top), other), F.lit(other)))


def bucket_coverage(df: DataFrame, bucket: str) -> DataFrame:
    """Rows per bucket with the running share, largest first.

    The window sees one row per bucket.
    """
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    order = Window.orderBy(F.desc("count"), bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(bucket, "count", (F.sum("count").over(order) / total * 100).alias("cum_pct"))


def cluster_profile(df: DataFrame, cluster: str, title: str, target: str = "good_bad",
                    keep: int = 3) -> DataFrame:
    """Size, most frequent titles and default rate of each cluster.

    Rows are counted per cluster and title first; a cluster with most of the
    rows then weighs no more than its number of distinct titles.
    """
    counts = df.groupBy(cluster, title).agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col(target)).alias("bad"))
    sizes = counts.groupBy(cluster).agg(F.sum("n").alias("size"), F.sum("bad").alias("bad"))
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), F.asc(title))
    best = (
        counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)
        .groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("_r", title))).alias("_t"))
        .select(cluster, F.array_join(F.transform("_t", lambda t: t[title]), " / ").alias("top_titles"))
    )
    return sizes.join(best, cluster).select(
        cluster, "size", "top_titles", (F.col("bad") / F.col("size")).alias("default_rate"))
