"""Alignment of two tokenizers' tokens by diagonal run skipping (operator 11).

Both tokenizers cut the same bytes, so their tokens are compared by the bytes
at which they end.  Where tokens correspond one to one, the two arrays of ends
agree along a diagonal: entry i of one equals entry i + shift of the other.
Such a run is skipped by comparing blocks of doubled length; in the block that
differs, the first difference ends the run.  Where a run breaks, the shorter
side advances until both end together; that irregular group sets the new shift.

Counts of linked ids are taken over the whole corpus: each document's distinct
pairs are written once, added up by a shuffle, and looked up again - frequent
pairs, a bounded number, in memory, all others by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, stage
from .tokenizer import CachedEncoder, byte_letters

#: Text of one step, and pairs in one written block.
STEP_BYTES = 1 << 21
BLOCK_PAIRS = 1 << 22
#: Entries of the first block that is compared.
PROBE = 8
#: Pairs whose counts are looked up in memory: at most this many, the most frequent ones.
IN_MEMORY = 1 << 20

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group: how many tokens of either side end with it or before.

    The arrays hold the ascending byte ends of tokens of the same bytes, so
    their last entries are equal.
    """
    wide = "<u4" if ends_a[-1] < 1 << 32 else "<u8"
    a, b = ends_a.astype(wide), ends_b.astype(wide)
    size, bytes_a, bytes_b, at_a, at_b = a.itemsize, a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    starts, lengths, after_a, after_b = [], [], [], []
    i, shift, n = 0, 0, len(at_a)
    number = int.from_bytes
    while i < n:
        run, step, start_b = 0, PROBE, i + shift
        while True:
            # probe blocks of doubled length along the diagonal, from here to the end at most
            at, bt, width = size * (i + run), size * (start_b + run), size * min(step, n - i - run)
            block_a, block_b = bytes_a[at : at + width], bytes_b[bt : bt + width]
            if block_a != block_b:
                # the lowest bit that differs lies in the first entry that does
                differ = number(block_a, "little") ^ number(block_b, "little")
                run += ((differ & -differ).bit_length() - 1) // (8 * size)
                break
            run, step = run + width // size, 2 * step
            if i + run == n:
                break
        starts.append((i, start_b))
        lengths.append(run)
        x, y = i + run, start_b + run
        if x < n:
            end_a, end_b = at_a[x], at_b[y]
            while end_a != end_b:
                if end_a < end_b:
                    x += 1
                    end_a = at_a[x]
                else:
                    y += 1
                    end_b = at_b[y]
            x, y = x + 1, y + 1
            after_a.append(x)
            after_b.append(y)
        i, shift = x, y - x
    # every run gives one group a token, and what follows it one group
    sizes = np.array(lengths, np.int64)
    whole = len(after_a)
    sizes[:whole] += 1
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(first)) - first
    origin = np.array(starts, np.int64).reshape(-1, 2)
    out_a, out_b = (np.repeat(origin[:, k], sizes) + place + 1 for k in (0, 1))
    last = np.cumsum(sizes[:whole]) - 1
    out_a[last], out_b[last] = after_a, after_b
    return out_a, out_b


#: Texts in which all releases of Unicode agree on what is a letter, a digit and a space.
STABLE = re.compile("[\\0-ɏ\u2000-\u2064]*\\Z").match
#: What neither fast path takes: runs without a space, and of spaces, that a quadratic merge would feel.
LONG = re.compile("[^ ]{400}| {400}").search
#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def fast_encoder(tokenizer, pieces: list[bytes]):
    """An encoder with the same merges, if ids ascend with them and texts are cut by :data:`CUTS`; else None."""
    import tiktoken

    model = json.loads(tokenizer.to_str())
    cut, merges = model["pre_tokenizer"], model["model"].get("merges", [])
    if model["normalizer"] or not cut or cut["type"] != "ByteLevel" or not cut.get("use_regex", True) or cut["add_prefix_space"]:
        return None
    vocabulary, added = model["model"]["vocab"], {t["content"] for t in model["added_tokens"]}
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(x >= y for x, y in zip(made, made[1:])) or model["model"].get("ignore_merges"):
        return None
    ranks = {pieces[i]: i for token, i in vocabulary.items() if token not in added}
    return tiktoken.Encoding("alignment", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})


class Strings:
    """A table of byte strings, and any sequence of its entries joined by one gather per block."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int32)
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.begin = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def joined(self, which: np.ndarray, block: int = 1 << 16) -> bytes:
        out = []
        for at in range(0, len(which), block):
            some = which[at : at + block]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes, dtype=np.int32)
            out.append(self.flat[np.repeat(self.begin[some] - ends + sizes, sizes) + np.arange(ends[-1], dtype=np.int32)].tobytes())
        return b"".join(out)


class WordCache(dict):
    """Ids of a piece model for texts whose words are parted by single spaces, with a bounded cache of words.

    No piece of such a model goes on after a space, which is checked, so words
    are encoded on their own, those of many texts at once.  Other texts go to
    the model whole.
    """

    def __init__(self, model, max_entries: int = 300_000):
        self.model, self.max_entries = model, max_entries
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        alone = all("▁" not in p[1:] or not p.strip("▁") for p in pieces) and len(pieces) < 1 << 16
        self.simple = re.compile("[!-~À-ÖØ-öø-ɏ\\n]+(?: [!-~À-ÖØ-öø-ɏ\\n]+)*\\Z").match if alone else lambda text: None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split(" ") if self.simple(t) else None for t in texts]
        new = list(set(chain.from_iterable(filter(None, split))).difference(self))
        if len(self) + len(new) > self.max_entries:
            self.clear()
            new = list(set(chain.from_iterable(filter(None, split))))
        found = self.model.encode(new, num_threads=1)
        packed = np.fromiter(chain.from_iterable(found), "<u2").tobytes()
        at = 0
        for word, ids in zip(new, found):
            self[word] = packed[at : at + 2 * len(ids)]
            at += 2 * len(ids)
        look_up = self.__getitem__
        return [np.frombuffer(b"".join(map(look_up, words)), "<u2").astype(np.int64) if words else np.array(self.model.encode(t, num_threads=1), np.int64) for words, t in zip(split, texts)]


@dataclass
class Side:
    """A vocabulary: the bytes of each id, their lengths, and the encoder of texts after a space."""

    pieces: list[bytes]
    encode: object

    def __post_init__(self):
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.bytes = Strings(self.pieces)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids, one after the other."""
        return self.bytes.joined(ids)


class Pair:
    """Both tokenizers, loaded once per worker process."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        encoder = CachedEncoder(path_a, plain=True)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        fast = fast_encoder(encoder.tokenizer, pieces)

        def encode_a(text: str) -> np.ndarray:
            if fast and STABLE(text) and not LONG(text):
                return np.array(fast.encode_ordinary(" " + text), np.int64)
            return np.frombuffer(encoder.encode_after_space(text), "<u4").astype(np.int64)

        self.a = Side(pieces, lambda texts: [encode_a(t) for t in texts])
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
        words = WordCache(model)
        self.b = Side(pieces, words.encode)
        self.caches = (encoder, words)
        width = len(self.b.pieces)
        self.width = width
        # the text of every id with each separator that can follow it
        self.written = Strings([b"%d%c" % (i, c) for side, marks in ((self.a, b",|"), (self.b, b",;")) for c in marks for i in range(len(side.pieces))])

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; none where it is empty or either side loses bytes."""
        none = np.empty(0, np.int64)
        real = [t for t in texts if t]
        found = iter(zip(real, self.a.encode(real), self.b.encode(real)))

        def checked(text: str, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (ids_a, ids_b) if self.a.joined(ids_a) == self.b.joined(ids_b) == b" " + text.encode() else (none, none)

        return [checked(*next(found)) if t else (none, none) for t in texts]

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:func:`group_ends` of both sides' ids."""
        if not len(ids_a):
            return ids_a, ids_b
        return group_ends(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]))

    def digest(self, ids_a: np.ndarray, ids_b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray) -> str:
        """SHA-256 of the groups as text, some groups at a time."""
        if not len(ids_a):
            return ""
        sha, size_a = hashlib.sha256(), len(self.a.pieces)
        begin_a, begin_b = np.append(0, groups_a[:-1]), np.append(0, groups_b[:-1])
        for at in range(0, len(groups_a), 1 << 18):
            some = slice(at, at + (1 << 18))
            a, b = ids_a[begin_a[at] : groups_a[some][-1]], ids_b[begin_b[at] : groups_b[some][-1]]
            count_a, count_b = groups_a[some] - begin_a[some], groups_b[some] - begin_b[some]
            last_a, last_b = np.cumsum(count_a) - 1, np.cumsum(count_b) - 1
            code_a, code_b = a.copy(), b + 2 * size_a
            code_a[last_a] += size_a
            code_b[last_b] += self.width
            order = np.empty(len(a) + len(b), np.int64)
            order[np.arange(len(a)) + np.repeat(last_b + 1 - count_b, count_a)] = code_a
            order[np.arange(len(b)) + np.repeat(last_a + 1, count_b)] = code_b
            text = self.written.joined(order)
            sha.update(text if at + (1 << 18) < len(groups_a) else text[:-1])
        return sha.hexdigest()


_loaded: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of the weights of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links): which id pairs share a group and how often; ``group_*`` number the tokens' groups, ascending.

    Equal ids of a group are joined first, so a long group of few ids has few pairs.
    """
    top = max(int(ids_a.max(initial=0)), int(ids_b.max(initial=0))) + 1
    a, times_a = _summed(group_a * top + ids_a, np.ones(len(ids_a), np.int64))
    b, times_b = _summed(group_b * top + ids_b, np.ones(len(ids_b), np.int64))
    of_b = b // top
    begin, end = np.searchsorted(of_b, a // top), np.searchsorted(of_b, a // top, "right")
    each = end - begin
    left = np.repeat(np.arange(len(a)), each)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin, each)
    return a[left] // top, a[left] % top * width + b[right] % top, times_a[left] * times_b[right]


def pack_pairs(pairs: np.ndarray, links: np.ndarray) -> bytes:
    """Ascending pairs as differences, and their numbers of links, in byte planes."""
    table = np.stack([np.diff(pairs, prepend=0), links]).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(table.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T
    table = np.ascontiguousarray(raw).view("<u8").reshape(2, -1).astype(np.int64)
    return np.cumsum(table[0]), table[1]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(row, doc_id, text) some megabytes at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text"))):
            held.append(row)
            size += len(row[2] or "")
            if size >= STEP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _align_task(path_a: str, path_b: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(path_a, path_b)
        for step in _numbered(batches):
            rows, ids, groups, n_groups = [], ([], []), ([], []), 0
            doc_of_group = []
            for k, ((row, doc_id, _), (a, b)) in enumerate(zip(step, both.encode([text for _, _, text in step]))):
                ends_a, ends_b = both.align(a, b)
                count_a, count_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
                rows.append([row, doc_id, len(a), len(b), len(ends_a), int((count_a * count_b).sum()), both.digest(a, b, ends_a, ends_b), None])
                for side, (x, counts) in enumerate(((a, count_a), (b, count_b))):
                    ids[side].append(x)
                    groups[side].append(np.repeat(np.arange(len(counts)) + n_groups, counts))
                doc_of_group.append(np.full(len(ends_a), k))
                n_groups += len(ends_a)
            a, b, group_a, group_b, owner = (np.concatenate(x) for x in (ids[0], ids[1], groups[0], groups[1], doc_of_group))
            extra = _fill_pairs(rows, a, b, group_a, group_b, owner, both.width)
            for part in (rows, extra):
                if part:
                    columns = list(zip(*part))
                    kinds = [*[pa.int64()] * 6, pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in ALIGNED.split(", ")])
        for cache in both.caches:
            cache.clear()

    return task


def _fill_pairs(rows: list[list], a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, owner: np.ndarray, width: int) -> list[list]:
    """Put each document's packed pairs into its row; what one block cannot hold goes to further rows."""
    extra: list[list] = []
    if not len(owner):
        return extra
    counts = np.bincount(group_a, minlength=len(owner)) * np.bincount(group_b, minlength=len(owner))
    blocks = int(counts.sum()) // BLOCK_PAIRS + 1
    # a block takes a range of A's ids, so no pair is in two blocks
    bounds = np.quantile(a, np.linspace(0, 1, blocks + 1)[1:-1], method="lower") if blocks > 1 else []
    bounds = [0, *sorted({int(x) + 1 for x in bounds}), int(a.max(initial=0)) + 1]
    for low, high in zip(bounds[:-1], bounds[1:]):
        some = (a >= low) & (a < high) if blocks > 1 else slice(None)
        group, pair, links = linked_pairs(a[some], b, group_a[some], group_b, width)
        space = int(pair.max(initial=0)) + 1
        keys, links = _summed(owner[group] * space + pair, links)
        doc = keys // space
        first = np.searchsorted(doc, np.arange(len(rows) + 1))
        for k, row in enumerate(rows):
            if first[k] < first[k + 1]:
                blob = pack_pairs(keys[first[k] : first[k + 1]] % space, links[first[k] : first[k + 1]])
                if row[7] is None:
                    row[7] = blob
                else:
                    extra.append([row[0], None, None, None, None, None, None, blob])
    return extra


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many documents of some a pair is linked."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    held, size = [], 0
    for batch in batches:
        for blob in batch["pairs"]:
            held.append(unpack_pairs(blob.as_py())[0])
            size += len(held[-1])
            if size >= BLOCK_PAIRS:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold a linked pair, and whether no pair of its A id has more.

    ``pair`` is A's id times ``width`` plus B's id; an A id has at most ``width`` pairs.
    """
    parts = aligned.where("pairs IS NOT NULL").select("pairs").mapInArrow(giving_back(_count_task), "pair long, n long")
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / width))
    return stage(counts.withColumn("best", F.col("n") == F.max("n").over(of_a)), "pair-counts")


def _most_frequent(counts: DataFrame, at_most: int) -> DataFrame:
    """The pairs above the lowest power of two that leaves at most ``at_most`` of them."""
    size = F.length(F.bin("n"))
    held, least = 0, None
    for r in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 64 rows
        held += r["count"]
        if held > at_most:
            break
        least = r["size"]
    return counts.where(size >= least) if least is not None else counts.limit(0)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, ids_a, ids_b, ends_a, ends_b): the tokens of each document, and per group how many of either side it ends.

    A null or empty text, and one whose bytes a tokenizer changes, has no tokens.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(path_a, path_b)
        for batch in batches:
            for doc_id, (a, b) in zip(batch["doc_id"].to_pylist(), both.encode(batch["text"].to_pylist())):
                columns = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (a, b, *both.align(a, b))]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *columns], ["doc_id", "ids_a", "ids_b", "ends_a", "ends_b"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(task), "doc_id long, ids_a array<int>, ids_b array<int>, ends_a array<int>, ends_b array<int>")


def link_report(docs: DataFrame, path_a: str, path_b: str, in_memory: int = IN_MEMORY) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose bytes a tokenizer changes, has zeros and
    an empty digest.  Repeated rows are documents of their own; an empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    aligned = stage(numbered.mapInArrow(giving_back(_align_task(path_a, path_b)), ALIGNED), "aligned")
    width = len(pair_of(path_a, path_b).b.pieces)
    counts = pair_counts(aligned, width)
    top = _most_frequent(counts, in_memory).select("pair", "n", "best").orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast([top[c].to_numpy() for c in ("pair", "n", "best")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums over frequent pairs, and the other pairs with their links."""
        pairs, n, best = known.value
        for batch in batches:
            sums, best_sums, others, times, offsets = [], [], [], [], [0]
            for blob in batch["pairs"]:
                mine, links = unpack_pairs(blob.as_py()) if blob.is_valid else (np.empty(0, np.int64), np.empty(0, np.int64))
                at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
                hit = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
                at = at[hit]
                sums.append(int((n[at] * links[hit]).sum()) if len(at) else 0)
                best_sums.append(int(links[hit][best[at]].sum()) if len(at) else 0)
                others.append(mine[~hit])
                times.append(links[~hit])
                offsets.append(offsets[-1] + len(others[-1]))
            entries = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (others, times)], ["pair", "links"])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(best_sums, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)], ["row", "n_best", "count_sum", "others"])

    seen = stage(aligned.select("row", "pairs").mapInArrow(giving_back(look_up), "row long, n_best long, count_sum long, others array<struct<pair:long,links:long>>"), "looked-up")
    other = seen.select("row", F.explode("others").alias("o")).select("row", "o.pair", "o.links").join(counts, "pair")
    other = other.select("row", F.when(F.col("best"), F.col("links")).otherwise(F.lit(0)).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    given = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    sums = seen.select("row", "n_best", "count_sum").unionByName(other)
    rows = aligned.select("row", *given).unionByName(sums, allowMissingColumns=True)
    whole = rows.groupBy("row").agg(*[F.max(c).alias(c) for c in given], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")])
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
