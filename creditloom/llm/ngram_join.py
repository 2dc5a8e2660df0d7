"""N-gram Jaccard join by vertical partitioning.

All shingles have one global order, rare ones first, which is cut into
fragments. Documents that share a shingle among their first ones are candidate
pairs; the overlap of a pair is counted in each fragment separately and summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import arrow_map, arrow_sums, components, semi_join_keys, text_bytes
from creditloom.llm.words import WordNumbers, shingle_set
from creditloom.session import cut_lineage

WORDS = 3
PERCENT = 90
FRAGMENTS = 4
SKETCH = 65_536
# Shingles that a pair must share among its first ones to be compared.
SHARED_FIRST = 3
# Groups before its own that a row of the group join names.
EARLIER = 16


def sets_of(batch_column: pa.Array, words: int, store: WordNumbers) -> list[np.ndarray]:
    return [shingle_set(store.of(t.lower().split()), words) for t in text_bytes(batch_column)]


def places(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(48)).astype(np.int64)


def shingle_sketch(texts: DataFrame, words: int) -> np.ndarray:
    """Documents per shingle, summed over ``SKETCH`` hash classes of all documents' shingles.

    A shingle that many documents share lifts its class above the others, and
    comes late in the global order.
    """

    store = WordNumbers()  # empty here; each task fills its own copy

    def add(batch, totals):
        for own in sets_of(batch.column(0), words, store):
            np.add.at(totals[0], places(own), 1)

    return arrow_sums(texts, add, SKETCH, 1)[0]


def fragment_of_class(sketch: np.ndarray, fragments: int) -> np.ndarray:
    """Cut the global order into fragments with about as many shingles each."""
    order = np.argsort(sketch, kind="stable")
    upto = np.cumsum(sketch[order])
    cut = np.empty(SKETCH, np.int8)
    cut[order] = np.minimum(fragments - 1, (upto - sketch[order]) * fragments // max(1, upto[-1]))
    return cut


def linked(overlap: str, a: str, b: str, percent: int) -> str:
    return f"100 * {overlap} >= {percent} * ({a} + {b} - {overlap})"


def overlaps(source: DataFrame, pairs: DataFrame, sets: DataFrame, sketch: np.ndarray, words: int, fragments: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` among ``pairs(a, b, n_a, n_b)`` of ``sets(node, key, id)`` by the sum of their overlaps per fragment."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut_lineage(wanted.join(sets.select("node", "key", "id"), "node"), "join-wanted")
    shipped = source.sparkSession.sparkContext.broadcast(fragment_of_class(sketch, fragments))

    store = WordNumbers()

    def split(batch):
        keys, parts, items = [], [], []
        for own in sets_of(batch.column(1), words, store):
            if len(own) == 0:
                continue
            key = xxhash.xxh3_128_digest(own.tobytes())
            part = shipped.value[places(own)]
            for fragment in range(fragments):
                chosen = own[part == fragment]
                if len(chosen):
                    keys.append(key)
                    parts.append(fragment)
                    items.append(chosen.view(np.int64))
        return [keys, parts, items]

    texts = semi_join_keys(source, wanted.select("id").distinct(), "id")
    pieces = arrow_map(texts, split, "key binary, fragment int, items array<long>")
    # Documents with equal sets give equal pieces; any one of them serves.
    pieces = cut_lineage(pieces.groupBy("key", "fragment").agg(F.first("items").alias("items")), "join-fragments")
    keyed = pairs.join(wanted.select(F.col("node").alias("a"), F.col("key").alias("key_a")), "a").join(
        wanted.select(F.col("node").alias("b"), F.col("key").alias("key_b")), "b"
    )
    left = keyed.join(pieces.select(F.col("key").alias("key_a"), "fragment", F.col("items").alias("items_a")), "key_a").drop("key_a")
    both = left.join(pieces.select(F.col("key").alias("key_b"), "fragment", F.col("items").alias("items_b")), ["key_b", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("items_a", "items_b")).alias("shared"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return summed.where(linked("shared", "n_a", "n_b", percent)).select("a", "b")


def often(pairs: DataFrame, times: int, weight: Column | None = None) -> DataFrame:
    """Pairs that occur at least ``times`` times (a row counts ``weight`` times), once each; summed in each task before the shuffle."""
    weight = F.lit(1) if weight is None else weight
    return pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum(weight).alias("count")).where(F.col("count") >= times).drop("count")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id``.

    The set of a text is its distinct ``words``-word shingles (A-Z in lower
    case); a shorter text is one shingle; null and empty texts have none and
    link with nothing. Two documents link at ``percent`` per cent Jaccard
    similarity; ``component_id`` is the smallest id that links reach. A null
    id never names a component unless all of its documents have null ids. Rows
    that repeat an id are documents of their own, and an empty table gives an
    empty result.

    Equal sets are one node. Every node of a shingle's group is first compared
    with one hub of the group only, which joins a tight group of any size by
    as many pairs as it has nodes. Then all pairs of one group are compared that
    are still in different components and can reach the threshold by their sizes, by
    the places of the shared shingles, and by their number: linked sets of size
    ``n`` share ``k`` of their first ``n - ceil(percent * n / 100) + k`` shingles. No
    link between components is lost.
    """
    # Different sets that link share at least percent / (100 - percent) shingles.
    shared_first = SHARED_FIRST
    while shared_first > 1 and shared_first * (100 - percent) > percent:
        shared_first -= 1
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = shingle_sketch(source.select("text"), words)
    shipped = source.sparkSession.sparkContext.broadcast(sketch)

    store = WordNumbers()

    def prefix(batch):
        sizes, keys, firsts = [], [], []
        for own in sets_of(batch.column(1), words, store):
            n = len(own)
            sizes.append(n)
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if n else None)
            first = n - (percent * n + 99) // 100 + shared_first if n else 0
            order = np.lexsort((own, shipped.value[places(own)]))[:first]
            firsts.append(own[order].view(np.int64))
        return [batch.column(0), sizes, keys, firsts]

    table = cut_lineage(
        arrow_map(source, prefix, "id long, n long, key binary, firsts array<long>").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "join-prefixes",
    )
    # A set is named by the smallest row that has it.
    sets = table.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.min("row").alias("node"))
    sets = cut_lineage(sets, "join-sets")
    nodes = table.select(F.col("row").alias("node"), F.col("n").cast("int").alias("n"), "firsts").join(sets.select("node"), "node")
    nodes = nodes.select("node", "n", F.posexplode("firsts").alias("place", "shingle"))
    # A node stays in a shingle's group if its neighbours by size can reach the threshold with it.
    by_size = Window.partitionBy("shingle").orderBy("n")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The node with the fewest rarer shingles of its own is the likely origin of a group of copies.
    member = F.struct("place", "node", "n")
    shared = cut_lineage(
        nodes.repartition("shingle").select(
            "*", F.lag("n").over(by_size).alias("smaller"), F.lead("n").over(by_size).alias("larger"), F.min(member).over(whole).alias("hub")
        ).where(f"100 * smaller >= {percent} * n OR 100 * n >= {percent} * larger").drop("smaller", "larger"),
        "join-groups",
    )
    near_size = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    # The first shingle that two sets share leaves them at most as many as stand from it on, the next ones one less each.
    reach = (
        f"{100 + percent} * (least(n_a - place_a, n_b - place_b) + {shared_first - 1}) >= {percent} * (n_a + n_b)"
    )
    spokes = shared.where("node <> hub.node").selectExpr(
        "least(node, hub.node) AS a", "greatest(node, hub.node) AS b",
        "IF(node < hub.node, n, hub.n) AS n_a", "IF(node < hub.node, hub.n, n) AS n_b",
        "IF(node < hub.node, place, hub.place) AS place_a", "IF(node < hub.node, hub.place, place) AS place_b",
    ).where(f"{near_size} AND {reach}")
    spokes = cut_lineage(often(spokes, shared_first), "join-spokes")
    links = cut_lineage(overlaps(source, spokes, sets, sketch, words, fragments, percent), "join-links")
    labels = components(links, "join-first")
    named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    group = Window.partitionBy("shingle")
    differs = (F.min("label").over(group) != F.max("label").over(group)).alias("open")
    still = named.select("shingle", "node", "n", "place", "label", differs).where("open").drop("open")
    # A node that is in fewer groups than a linked pair shares has no partner left.
    groups_of_node = F.count(F.lit(1)).over(Window.partitionBy("node"))
    still = still.withColumn("groups", groups_of_node).where(F.col("groups") >= shared_first).drop("groups")
    # Groups with the same nodes are one group. Nodes name them by two hashes, in no order.
    same = [F.bit_xor(F.xxhash64("node", F.lit(salt))).over(group).alias(f"nodes_{salt}") for salt in (0, 1)]
    # Nodes that can link have sizes in the same band or in neighbouring ones.
    width = float(np.log(100 / percent) * 1.0001) if percent < 100 else 1.0
    band = F.floor(F.log(F.col("n")) / F.lit(width)).cast("int").alias("band")
    merged = still.select("*", differs, *same).where("open").repartition("node").groupBy("node", "nodes_0", "nodes_1", "n", "label").agg(
        F.min("place").alias("place"), F.least(F.count(F.lit(1)), F.lit(shared_first)).cast("int").alias("weight"))
    # All nodes follow one order of shingles, so the groups that two nodes share come in one order. Each row names the
    # groups that its node comes from, as often as they count.
    marks = F.expr("transform(sequence(0, weight - 1), k -> nodes_0 ^ CAST(k AS BIGINT))")
    of_node = Window.partitionBy("node").orderBy("place")
    open_groups = cut_lineage(
        merged.select(
            "*", band, F.flatten(F.collect_list(marks).over(of_node.rowsBetween(-EARLIER, -1))).alias("before"),
            (F.count(F.lit(1)).over(Window.partitionBy("node")) <= EARLIER + 1).alias("all"),
        ),
        "join-open",
    )
    a = open_groups.selectExpr(
        "nodes_0", "nodes_1", "node AS node_x", "n AS n_a", "place AS place_a", "label AS label_a", "band AS band_a",
        "weight", "before AS before_a", "all AS all_a", "explode(array(band, band + 1)) AS band",
    )
    b = open_groups.selectExpr(
        "nodes_0 AS same_0", "nodes_1 AS same_1", "node AS node_y", "n AS n_b", "place AS place_b", "label AS label_b", "band AS band_b",
        "before AS before_b", "all AS all_b",
    )
    # Where rows name all groups before their own, a pair is made by the one row at which it shares enough; else by
    # its first rows up to there, which are summed.
    common = "size(array_intersect(before_a, before_b))"
    needed = f"{common} < {shared_first} AND (NOT (all_a AND all_b) OR {common} + weight >= {shared_first})"
    rest = a.join(
        b,
        F.expr(
            "nodes_0 = same_0 AND nodes_1 = same_1 AND band = band_b AND label_a <> label_b AND (band_a < band_b OR node_x < node_y)"
            f" AND {near_size} AND {reach} AND {needed}"
        ),
    ).selectExpr(
        "least(node_x, node_y) AS a", "greatest(node_x, node_y) AS b",
        "IF(node_x < node_y, n_a, n_b) AS n_a", "IF(node_x < node_y, n_b, n_a) AS n_b",
        f"IF(all_a AND all_b, {shared_first}, weight) AS shared",
    )
    rest = cut_lineage(often(rest, shared_first, F.col("shared")).join(spokes.select("a", "b"), ["a", "b"], "left_anti"), "join-rest")
    more = overlaps(source, rest, sets, sketch, words, fragments, percent)
    labels = components(links.union(more), "join-last")
    ids = sets.join(labels, "node").groupBy("label").agg(F.min("id").alias("component"))
    found = labels.join(ids, "label").select("node", "component")
    own = sets.join(found, "node", "left").select("key", F.coalesce("component", "id").alias("component"))
    return table.select("id", "n", "key").join(own, "key", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, g, len(g) AS n_shingles FROM s),
r AS (SELECT min(doc_id) AS rep, list_sort(g) AS g, any_value(n_shingles) AS k FROM n WHERE n_shingles > 0 GROUP BY list_sort(g)),
e AS (SELECT rep, k, unnest(g) AS x FROM r),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS o, any_value(a.k) AS ka, any_value(b.k) AS kb
  FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.k, b.k) >= 90 * greatest(a.k, b.k) GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM c WHERE 100 * o >= 90 * (ka + kb - o)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT a AS node, a AS seen FROM u UNION SELECT t.node, u.b FROM t JOIN u ON t.seen = u.a),
m AS (SELECT node, min(seen) AS comp FROM t GROUP BY node),
p AS (SELECT r.g, coalesce(m.comp, r.rep) AS comp FROM r LEFT JOIN m ON r.rep = m.node)
SELECT n.doc_id, n.n_shingles, coalesce(p.comp, n.doc_id) AS component_id
FROM n LEFT JOIN p ON n.n_shingles > 0 AND list_sort(n.g) = p.g"""
