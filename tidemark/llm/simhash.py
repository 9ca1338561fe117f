"""SimHash near-duplicates by bit-sliced comparison (operator 9).

Fingerprints are computed per document, made distinct, dealt into buckets that
share enough of their bits (pigeonhole), and compared inside each bucket in
vertical form: one bit plane holds the same bit of all fingerprints, and one
pass over the planes updates the distances of 64 pairs per machine word.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import giving_back, join_checked, stage

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; zero if it has no word."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(g), seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as the signed long of the same bits; with ``row``, that column of longs too."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*batch.schema.names[:-1], "fp"])

    keys = [F.col("doc_id").cast("long"), *([F.col(row)] if row else [])]
    return docs.select(*keys, "text").mapInArrow(giving_back(run), f"doc_id long, {f'`{row}` long, ' if row else ''}fp long")


def _block_masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of (table, bits): two fingerprints within ``radius`` share at least one entry.

    At most ``radius`` of the blocks can differ, so some ``blocks - radius`` of
    them are equal; each such choice of blocks is a table.
    """
    masks = _block_masks(blocks)
    chosen = [sum(m) for m in combinations(masks, blocks - radius)]
    return F.array(*[F.struct(F.lit(i).alias("tab"), fp.bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(chosen)])


def _lanes(flags: np.ndarray, n: int) -> np.ndarray:
    """Pack booleans into n words of 64 lanes."""
    out = np.zeros(n * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8").astype(np.uint64)


def close_pairs(fps: np.ndarray, groups: np.ndarray, radius: int):
    """Yield arrays (i, j) of rows of one group, adjacent in order, within ``radius`` bits.

    For each lag d, lane i compares rows i and i + d.  Per plane, the XOR is
    added to carry-save counters (ones, twos, then a sticky overflow), and
    words whose lanes have all exceeded the radius are abandoned.
    """
    n = len(fps)
    words = -(-n // 64) + 1
    octets = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    planes = np.stack([_lanes(bits[:, p], words) for p in range(64)])
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    rank = np.arange(n) - np.repeat(starts, sizes)  # place within the group
    left = np.repeat(sizes, sizes) - rank
    need = (radius + 1).bit_length()
    for d in range(1, int(sizes.max(initial=1))):
        over = ~_lanes(left > d, words)  # lanes without a partner count as exceeded
        live = np.flatnonzero(over != _ALL)
        over = over[live]
        counters = [np.zeros(len(live), np.uint64) for _ in range(need)]
        shift, bit = divmod(d, 64)
        for p in range(64):
            plane = planes[p]
            near = plane[np.minimum(live + shift, words - 1)] >> np.uint64(bit)
            if bit:
                near |= plane[np.minimum(live + shift + 1, words - 1)] << np.uint64(64 - bit)
            carry = plane[live] ^ near
            for k in range(need):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            # count > radius, compared from the highest counter bit down
            if p % 4 == 3 or p == 63:
                equal, more = ~over, np.zeros(len(live), np.uint64)
                for k in range(need - 1, -1, -1):
                    if radius >> k & 1:
                        equal &= counters[k]
                    else:
                        more |= equal & counters[k]
                        equal &= ~counters[k]
                over |= more
                keep = over != _ALL
                if not keep.all():
                    live, over = live[keep], over[keep]
                    counters = [c[keep] for c in counters]
                    if not len(live):
                        break
        if len(live):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            w, lane = np.nonzero(hit)
            i = live[w] * 64 + lane
            yield i, i + d


def _forest(fps: np.ndarray, groups: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (root, member) of a spanning forest of the close pairs."""
    parent = np.arange(len(fps))
    for i, j in close_pairs(fps, groups, radius):
        while True:  # hook larger roots to smaller ones until every pair agrees
            a, b = parent[i], parent[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(parent, up := parent[parent]):
                parent = up
    member = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[parent[member]], fps[member]


def close_edges(fps: DataFrame, radius: int = 3, blocks: int = 5, chunk: int = 4096) -> DataFrame:
    """Edges (src, dst) that connect exactly the distinct fingerprints (column fp) linked within ``radius`` bits.

    A bucket of more than ``chunk`` rows is cut into parts, and every pair of
    parts is a task group of its own, so no group exceeds two parts.
    """
    keyed = fps.select("fp", F.explode(bucket_keys(F.col("fp"), radius, blocks)).alias("k")).select("fp", "k.tab", "k.bits")
    big = stage(keyed.groupBy("tab", "bits").count().where(F.col("count") > chunk).select("tab", "bits", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "big-buckets")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    mine = F.pmod(F.xxhash64(F.lit(7), "fp"), parts).cast("int")
    dealt = (
        join_checked(keyed, big, ["tab", "bits"])
        .withColumn("mine", mine)
        .select("fp", "tab", "bits", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"), "mine")
        .select("fp", "tab", "bits", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    )

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def run(table: pa.Table):
            cols = [table.column(i).to_numpy() for i in range(5)]
            change = np.zeros(table.num_rows, bool)
            for c in cols[1:]:
                change[1:] |= c[1:] != c[:-1]
            src, dst = _forest(cols[0].view("u8"), np.cumsum(change), radius)
            return pa.RecordBatch.from_arrays([pa.array(src.view("i8")), pa.array(dst.view("i8"))], names=["src", "dst"])

        # a run ends between two groups; a group has at most two parts
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            table = pa.Table.from_batches(held)
            keys = np.stack([table.column(i).to_numpy() for i in range(1, 5)])
            differs = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
            if len(differs):
                cut = int(differs[-1]) + 1
                yield run(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield run(pa.Table.from_batches(held))

    group = ["tab", "bits", "a", "b"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "src long, dst long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, by label spreading with pointer jumping.

    Each round is written to the shared folder.  Rounds grow with the log of
    the longest chain.
    """
    both = stage(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    labels = stage(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root")).withColumnRenamed("src", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("root").alias("near"))
        step = stage(labels.join(near, labels.node == near.src).select("node", F.least("root", "near").alias("up"), F.col("root").alias("was")), "step")
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = stage(step.join(jump, "up").select("node", F.least("up", "top").alias("root"), (F.least("up", "top") != F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")


def _least_of_components(rows: DataFrame, key: Column, radius: int, blocks: int) -> DataFrame:
    """(fp, least) per distinct fingerprint of ``rows``: the least ``key`` of all rows that its component holds."""
    firsts = stage(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fps")
    linked = components(close_edges(firsts.select("fp"), radius, blocks))
    linked_first = stage(firsts.join(linked, firsts.fp == linked.node).select("fp", "root", "first"), "linked")
    root_first = stage(linked_first.groupBy("root").agg(F.min("first").alias("least")), "roots")
    moved = stage(linked_first.join(root_first, "root").select("fp", "least"), "moved")
    return stage(firsts.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("least")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest doc_id reachable.  A text without words (null,
    empty, white space) has fingerprint zero and links like any other.  Rows
    with a null doc_id keep a null id and take part in links; a component of
    such rows alone has a null component_id.  Repeated rows are kept.
    """
    rows = stage(with_fingerprints(docs, shingle), "fingerprints")
    of_fp = _least_of_components(rows, F.col("doc_id"), radius, blocks)
    return rows.join(of_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def repeated_rows(docs: DataFrame, row: str, shingle: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """The ``row`` of every row of ``docs`` but one per component of the same links.

    ``row`` names a column of written, distinct longs.  The row that stays is
    the one with the smallest doc_id (a null one comes last), then the smallest
    ``row``; what ids repeat or are null decides nothing else.
    """
    rows = stage(with_fingerprints(docs, shingle, row), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col(row).alias("row"))
    of_fp = _least_of_components(rows, key, radius, blocks)
    return rows.join(of_fp.select("fp", F.col("least.row").alias("_stays")), "fp").where(F.col(row) != F.col("_stays")).select(row)
