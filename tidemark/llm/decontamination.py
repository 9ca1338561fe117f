"""Benchmark decontamination: size-partitioned MinHash containment search (operator 6).

All of it is DataFrame functions.  A test item is short and a document may be
long, so the sketch is taken of the item alone: the smallest hashes of its
5-word shingles, as many as its size class and the threshold need.  A document holds at least
the share c of an item's shingles only if it holds about that share of the
item's sketch, whatever the document's length.  Candidates are then verified
by exact containment on the shingles themselves.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, lower_ascii, stage, words_of

#: Items of up to so many shingles have a sketch that cannot miss; larger ones miss with odds below ODDS.
EXACT_UP_TO, ODDS = 256, 1e-9
#: Sketch hits asked of a candidate, where the item has so many.
LEAST_HITS = 4


def sketch_of_large(threshold: float, size: int = 64) -> tuple[int, int]:
    """(sketch size, hits asked) for items above ``EXACT_UP_TO`` shingles.

    A document that holds the share ``threshold`` of an item's shingles has
    fewer than the hits asked with odds below ``ODDS``: the binomial tail, which
    is above that of drawing without replacement.  The sketch is doubled until
    ``LEAST_HITS`` can be asked.
    """
    while True:
        tail, hits = 0.0, 0
        while hits < size and (tail := tail + comb(size, hits) * threshold**hits * (1 - threshold) ** (size - hits)) < ODDS:
            hits += 1
        if hits >= LEAST_HITS or size >= 1 << 14:
            return size, max(1, hits)
        size *= 2


def shingles(words: Column, size: int) -> Column:
    """Shingle strings of a word array column; fewer words than ``size`` make one shingle, none make none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat_ws(" ", F.slice(words, i + 1, size)))
    return F.when(n >= size, many).when(n > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of the same shingles, from the words in place."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(*[F.get(words, F.lit(k)) for k in range(size)])))


def _sketches(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(item_key, need, h): the sketch of every item, one row per hash.

    At least ``least`` of an item's n shingles must be in the document, so at
    most n - least are not, and any n - least + k of them hold k that are.
    """
    d = items.select("item_key", F.array_sort(F.array_distinct(shingle_hashes(F.col("_w"), size))).alias("_h"))
    n = F.size("_h")
    least = F.greatest(F.lit(1), F.ceil(n * F.lit(threshold) - 1e-9)).cast("int")
    few = F.least(least, F.lit(LEAST_HITS))
    large_size, large_hits = sketch_of_large(threshold)
    keep = F.when(n <= EXACT_UP_TO, n - least + few).otherwise(F.lit(large_size))
    need = F.when(n <= EXACT_UP_TO, few).otherwise(F.lit(large_hits))
    return d.select("item_key", need.alias("need"), F.explode_outer(F.slice(F.col("_h"), F.lit(1), keep)).alias("h"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5, max_broadcast: int = 200_000, filter_cells: int = 1 << 21) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document that holds an item.

    Words are lower-cased (A-Z) runs of non-space characters.  Containment is
    the share of the item's distinct ``size``-word shingles found in the
    document.  A text of fewer words is one shingle of all its words, so such
    an item matches only a document of the same few words; an item without
    words (null, empty) matches nothing.  Repeated rows of either table give
    their own result rows; a null id stays null in the result.

    Sketches of more than ``max_broadcast`` hashes are joined by shuffle, after
    a filter that drops the document shingles in none of their at most
    ``filter_cells`` hash cells.
    """
    words = lambda d: words_of(lower_ascii(F.coalesce(F.col("text"), F.lit(""))))
    items = stage(benchmark.select(F.col("item_id"), words(benchmark).alias("_w")).where(F.size("_w") > 0).withColumn("item_key", F.monotonically_increasing_id()), "items")
    sketch = stage(_sketches(items, size, threshold), "item-sketches")
    base = docs.select(F.col("doc_id"), F.col("text"))
    # explode_outer, as explode's implied filter would be pushed below the arrays and build them again per element
    probes = base.select("doc_id", words(base).alias("_w")).select("doc_id", shingle_hashes(F.col("_w"), size).alias("_h")).select("doc_id", F.explode_outer("_h").alias("h"))
    if sketch.limit(max_broadcast + 1).count() > max_broadcast:
        cells = sketch.select(F.pmod("h", F.lit(filter_cells)).alias("_cell")).distinct()
        probes = probes.join(F.broadcast(cells), F.pmod("h", F.lit(filter_cells)) == F.col("_cell"), "left_semi")
    # an id may repeat, so hits are counted per id: never fewer than those of one of its rows
    hits = join_checked(probes, sketch, "h", "inner", max_broadcast).groupBy("doc_id", "item_key").agg(F.count_distinct("h").alias("n"), F.first("need").alias("need"))
    pairs = stage(hits.where(F.col("n") >= F.col("need")).select("doc_id", "item_key"), "candidates")
    # verification reads the candidates' texts again
    held = stage(pairs.select("doc_id").distinct(), "candidate-docs")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    texts = join_checked(base, held.withColumnRenamed("doc_id", "_held"), same("doc_id", "_held"), "left_semi", max_broadcast)
    texts = texts.select("doc_id", words(texts).alias("_w")).select("doc_id", F.array_distinct(shingles(F.col("_w"), size)).alias("_d"))
    texts = join_checked(texts, pairs.withColumnRenamed("doc_id", "_held"), same("doc_id", "_held"), "inner", max_broadcast).drop("_held")
    item_shingles = items.select("item_key", "item_id", F.array_distinct(shingles(F.col("_w"), size)).alias("_i"))
    found = texts.join(item_shingles, "item_key").select("doc_id", "item_id", F.size(F.array_intersect("_d", "_i")).cast("long").alias("n_shared"), F.size("_i").cast("long").alias("n_item"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)


#: The same search by brute force: every item's shingles against every document's.
BRUTE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), bs AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b
), n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(n_item)::DOUBLE >= 0.8
"""
