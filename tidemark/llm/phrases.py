"""Phrase collocation mining with stripes (operator 13).

A stripe belongs to a prefix of up to three words and maps each next word to
how often it follows; the stripe of the empty prefix counts the words.  One
entry is the count of an extension, and of the prefix that a longer stripe
belongs to; the largest entry of a stripe decides whether an extension
subsumes its prefix.

Tasks build the stripes of a few megabytes of text at a time; Spark brings the
stripes of a prefix together, sorted, and they are merged entry by entry as
they stream past.  A phrase can be frequent only if its words and word pairs
are, so words are counted first, then pairs, then longer phrases, and each
level is asked only for what the one before left over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import giving_back, stage

#: Characters that end a piece, and those that separate words inside one.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Text of one task's step; its temporary arrays take some ten times as much.
STEP_BYTES = 1 << 23
#: A prefix with one part in so many of all words has its stripe split, so that each segment is about one such part.
SHARES = 1024
#: Bits of a filter: at least 32 for each frequent key, at most 8 MB.
MAX_BITS = 1 << 26

#: As stripes travel: next words and counts are joined by spaces, which no word has, as arrays would take thrice the room.
STRIPES = "lang string, prefix string, seg int, next string, counts string"
MERGED = "lang string, prefix string, seg int, best long, next array<string>, counts array<long>"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


@dataclass
class Words:
    """The words of some text: a code per word, whether the next word continues the piece, and the words by code."""

    codes: np.ndarray
    joined: np.ndarray
    names: pa.StringArray


def words_of(text: bytes) -> Words:
    """Split UTF-8 text, lower-casing A-Z; all delimiters are single bytes, so bytes can be compared."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]]))
    encoded = array.dictionary_encode()
    joined = np.zeros(len(starts), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    return Words(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), joined, encoded.dictionary)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """(lang, words) of texts of one language, some megabytes at a time; a longer piece is never cut."""
    held: dict[str, list[str]] = {}
    size = 0

    def all_held() -> Iterator[tuple[str, Words]]:
        for lang, texts in held.items():
            data = "\n".join(texts).encode()
            texts.clear()
            at = 0
            while at < len(data):
                end = len(data)
                if end - at > 2 * STEP_BYTES:
                    # a break in the second half of the step, else the first one after it
                    part = np.frombuffer(data, np.uint8, STEP_BYTES, at + STEP_BYTES // 2)
                    breaks = np.flatnonzero(_KIND[part] == 2)
                    rest = data[at + STEP_BYTES * 3 // 2 :] if not len(breaks) else b""
                    later = min((k for b in BREAKS if (k := rest.find(b)) >= 0), default=-1)
                    end = at + STEP_BYTES // 2 + int(breaks[-1]) + 1 if len(breaks) else at + STEP_BYTES * 3 // 2 + later + 1 if later >= 0 else end
                words = words_of(data[at:end])
                at = end
                if len(words.codes):
                    yield lang, words
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= STEP_BYTES:
                    yield from all_held()
                    size = 0
    yield from all_held()


def _hashes(lang: str, names: pa.StringArray) -> np.ndarray:
    """What ``F.xxhash64`` gives for language, NUL and phrase, unsigned."""
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + n.encode(), 42) for n in names.to_pylist()), np.uint64, len(names))


class Filter:
    """A bit per hashed key: false only for keys that are not frequent.  At most ``MAX_BITS``, whatever the corpus."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """From a column ``h`` of hashes."""
        wanted = max(keys.count() * 32, 1 << 16)
        size = min(1 << (wanted - 1).bit_length(), MAX_BITS)
        at = F.col("h").bitwiseAND(F.lit(size - 1))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        found = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(one).alias("mask")).toArrow()
        words = np.zeros(size // 64, np.uint64)
        words[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
        return cls(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(len(self.bits) * 64 - 1)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


@dataclass
class Known:
    """What one level knows of the levels before: filters, and into how many segments the stripes of hot prefixes fall."""

    words: Filter
    hot_words: dict[tuple[str, str], int]
    pairs: Filter | None = None
    hot_pairs: dict[tuple[str, str], int] | None = None


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n); the empty word counts all words."""
    for lang, words in _steps(batches):
        counts = np.bincount(words.codes, minlength=len(words.names))
        names = pa.concat_arrays([words.names, pa.array([""])])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names, pa.array(np.append(counts, counts.sum()))], ["lang", "word", "n"])


def _stripe_rows(lang: str, owner: np.ndarray, following: np.ndarray, prefixes: pa.StringArray, segments: np.ndarray, names: pa.StringArray, name_hashes: np.ndarray) -> pa.RecordBatch:
    """Stripes from one (prefix, next word) pair per occurrence."""
    width = max(len(names), 1)
    keys, counts = np.unique(owner * width + following, return_counts=True)
    owner, following = keys // width, keys % width
    seg = np.where(segments[owner] > 1, name_hashes[following].astype(np.int64) % np.maximum(segments[owner], 1), -1)
    if (segments > 1).any():
        order = np.lexsort((following, seg, owner))
        owner, following, counts, seg = owner[order], following[order], counts[order], seg[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])))
    offsets = pa.array(np.append(first, len(owner)).astype(np.int32))
    words = names.take(pa.array(following))
    rows = [
        pa.array([lang] * len(first), pa.string()), prefixes.take(pa.array(owner[first])), pa.array(seg[first].astype(np.int32)),
        pc.binary_join(pa.ListArray.from_arrays(offsets, words), " "), pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)).cast(pa.string())), " "),
    ]
    return pa.RecordBatch.from_arrays(rows, ["lang", "prefix", "seg", "next", "counts"])


def _sliced(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _segments(lang: str, names: pa.StringArray, hot: dict[tuple[str, str], int]) -> np.ndarray:
    out = np.ones(len(names), np.int64)
    for (of, name), parts in hot.items():
        if of == lang and (i := pc.index(names, name).as_py()) >= 0:
            out[i] = parts
    return out


def _pair_stripes(known: Broadcast):
    """Stripes of one-word prefixes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _steps(batches):
            hashes = _hashes(lang, words.names)
            keep = known.value.words.has(hashes)[words.codes]
            at = np.flatnonzero(words.joined[:-1] & keep[1:] & keep[:-1])
            if len(at):
                segments = _segments(lang, words.names, known.value.hot_words)
                yield from _sliced(_stripe_rows(lang, words.codes[at], words.codes[at + 1], words.names, segments, words.names, hashes))

    return task


def _long_stripes(known: Broadcast):
    """Stripes of prefixes of two and of three words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _steps(batches):
            codes, width = words.codes, len(words.names) + 1
            hashes = _hashes(lang, words.names)
            keep = known.value.words.has(hashes)[codes]
            at = np.flatnonzero(words.joined[:-1] & keep[1:] & keep[:-1])  # where such a pair starts
            if not len(at):
                continue
            keys, pair = np.unique(codes[at] * width + codes[at + 1], return_inverse=True)
            pairs = pc.binary_join_element_wise(words.names.take(pa.array(keys // width)), words.names.take(pa.array(keys % width)), " ")
            good = known.value.pairs.has(_hashes(lang, pairs))[pair]
            at, pair = at[good], pair[good]
            id_at = np.full(len(codes) + 3, -1)  # the pair that starts at a place
            id_at[at] = pair
            parts = _segments(lang, pairs, known.value.hot_pairs)
            on = id_at[at + 1] >= 0
            at, pair = at[on], pair[on]
            if not len(at):
                continue
            yield from _sliced(_stripe_rows(lang, pair, codes[at + 2], pairs, parts, words.names, hashes))
            on = id_at[at + 2] >= 0
            at, pair = at[on], pair[on]
            if not len(at):
                continue
            keys, triple = np.unique(pair * width + codes[at + 2], return_inverse=True)
            triples = pc.binary_join_element_wise(pairs.take(pa.array(keys // width)), words.names.take(pa.array(keys % width)), " ")
            # a triple is no more frequent than either of its pairs
            first = np.zeros(len(keys), np.int64)
            first[triple] = np.minimum(parts[pair], parts[id_at[at + 1]])
            yield from _sliced(_stripe_rows(lang, triple, codes[at + 3], triples, first, words.names, hashes))

    return task


def _merge(min_count: int):
    """Merge sorted stripes: what streams past holds one prefix at most beside the batch."""

    def keep(lang, prefix, seg, first, words, counts) -> pa.RecordBatch:
        """Rows for whole stripes, whose entries begin at ``first``."""
        wanted = counts >= min_count
        sizes = np.add.reduceat(wanted.astype(np.int64), first)
        rows = np.flatnonzero(sizes)
        best = np.maximum.reduceat(counts, first)
        offsets = pa.array(np.append(0, np.cumsum(sizes[rows])).astype(np.int32))
        take, at = pa.array(rows), pa.array(np.flatnonzero(wanted))
        out = [lang.take(take), prefix.take(take), pa.array(seg[rows].astype(np.int32)), pa.array(best[rows]),
               pa.ListArray.from_arrays(offsets, words.take(at)), pa.ListArray.from_arrays(offsets, pa.array(counts[wanted]))]
        return pa.RecordBatch.from_arrays(out, ["lang", "prefix", "seg", "best", "next", "counts"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [pc.split_pattern(batch[c], " ") for c in ("next", "counts")]
            batch = pa.RecordBatch.from_arrays([batch["lang"], batch["prefix"], batch["seg"], parts[0], parts[1].cast(pa.list_(pa.int64()))], batch.schema.names)
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            lang, prefix, seg = batch["lang"], batch["prefix"], batch["seg"].to_numpy(zero_copy_only=False)
            a, b = (c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in (lang, prefix))
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (seg[1:] != seg[:-1]))
            run, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            encoded = batch["next"].flatten().dictionary_encode()
            width = max(len(encoded.dictionary), 1)
            owner = np.repeat(run, pc.list_value_length(batch["next"]).to_numpy(zero_copy_only=False))
            key = owner * width + encoded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            counts = np.add.reduceat(batch["counts"].flatten().to_numpy(zero_copy_only=False)[order], first)
            words = encoded.dictionary.take(pa.array(key[first] % width))
            starts = np.searchsorted(key[first] // width, np.arange(len(heads)))
            cut = int(starts[-1])  # the last stripe may go on in the next batch
            take = pa.array(heads)
            lang, prefix, seg = lang.take(take), prefix.take(take), seg[heads]
            tail = pa.array([0, len(words) - cut], pa.int32())
            held = pa.RecordBatch.from_arrays(
                [lang[-1:], prefix[-1:], pa.array(seg[-1:].astype(np.int32)), pa.ListArray.from_arrays(tail, words[cut:]), pa.ListArray.from_arrays(tail, pa.array(counts[cut:]))],
                ["lang", "prefix", "seg", "next", "counts"],
            )
            if len(heads) > 1:
                yield keep(lang[:-1], prefix[:-1], seg[:-1], starts[:-1], words[:cut], counts[:cut])
        if held is not None:
            counts = held["counts"].flatten().to_numpy(zero_copy_only=False)
            yield keep(held["lang"], held["prefix"], held["seg"].to_numpy(zero_copy_only=False), np.array([0]), held["next"].flatten(), counts)

    return task


def _merged(texts: DataFrame, task, min_count: int) -> DataFrame:
    rows = texts.mapInArrow(giving_back(task), STRIPES)
    together = rows.repartition("lang", "prefix", "seg").sortWithinPartitions("lang", "prefix", "seg")
    return stage(together.mapInArrow(giving_back(_merge(min_count)), MERGED), "stripes")


def _hash(phrase: str):
    return F.xxhash64(F.concat("lang", F.lit("\0"), phrase)).alias("h")


def _hot(counted: DataFrame, name: str, count: str, total: int) -> dict[tuple[str, str], int]:
    """Segments of what holds at least one of ``SHARES`` parts of all words: never more than that many keys."""
    rows = counted.where(F.col(count) * SHARES >= max(total, 1)).where(F.col(count) >= 2 * SHARES).select("lang", name, count).collect()
    return {(r[0], r[1]): -(-r[2] * SHARES // total) + 1 for r in rows}


@dataclass(frozen=True)
class Stripes:
    """Merged stripes with their frequent entries, that of the empty prefix, and the number of words per language.

    ``rows`` has lang, prefix, seg, best, next and counts; ``seg`` is -1 for a
    whole stripe, and numbers the segments of a hot prefix's stripe, which hold
    different next words.  ``words`` has lang, word and n.
    """

    rows: DataFrame
    words: DataFrame
    sizes: DataFrame

    def phrases(self) -> DataFrame:
        """(lang, words, a): frequent phrases of two to four words."""
        pairs = self.rows.select("lang", "prefix", F.explode(F.arrays_zip("next", "counts")).alias("e"))
        return pairs.select("lang", F.split(F.concat_ws(" ", "prefix", "e.next"), " ", -1).alias("words"), F.col("e.counts").alias("a"))

    def totals(self) -> DataFrame:
        """(lang, prefix, f): the count of every frequent prefix of one to three words, read from the stripe one word shorter."""
        longer = self.phrases().where(F.size("words") < 4).select("lang", F.array_join("words", " ").alias("prefix"), F.col("a").alias("f"))
        return self.words.select("lang", F.col("word").alias("prefix"), F.col("n").alias("f")).unionByName(longer)

    def best(self) -> DataFrame:
        """(lang, prefix, best): the count of the most frequent extension."""
        return self.rows.groupBy("lang", "prefix").agg(F.max("best").alias("best"))


def mine_stripes(docs: DataFrame, min_count: int = 30) -> Stripes:
    """Stripes of all phrases of up to four words that occur ``min_count`` times or more in their language.

    ``docs`` needs text and lang.  A null text is empty, a null language is
    ``und``; repeated rows count as often as they occur; an empty table has no
    stripes.  Words and pieces as in :data:`BREAKS` and :data:`BLANKS`.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = texts.mapInArrow(giving_back(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stage(counted.where((F.col("n") >= min_count) | (F.col("word") == "")), "words")
    sizes = counted.where("word = ''").select("lang", "n")
    frequent = counted.where("word <> ''")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = Known(Filter.of(frequent.select(_hash("word"))), _hot(frequent, "word", "n", total))
    pairs = _merged(texts, _pair_stripes(spark.sparkContext.broadcast(known)), min_count)
    entries = pairs.select("lang", "prefix", F.explode(F.arrays_zip("next", "counts")).alias("e")).select("lang", F.concat_ws(" ", "prefix", "e.next").alias("pair"), F.col("e.counts").alias("n"))
    known = Known(known.words, known.hot_words, Filter.of(entries.select(_hash("pair"))), _hot(entries, "pair", "n", total))
    long = _merged(texts, _long_stripes(spark.sparkContext.broadcast(known)), min_count)
    return Stripes(pairs.unionByName(long), frequent, sizes)


def score_cuts(stripes: Stripes, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, a, l, r, score): every frequent phrase under its lowest-scoring cut, ties to the shortest first part.

    The counts of both parts are entries of shorter stripes; products are decimals of 38
    digits, so nothing is rounded before the floor.
    """
    phrases = stripes.phrases()
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "a", "words", cut)
    side = lambda name, words: F.struct(F.lit(name).alias("side"), F.array_join(words, " ").alias("part"))
    left, right = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    parts = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(side("l", left), side("r", right))).alias("p")).select("lang", "phrase", "a", "k", "p.side", "p.part")
    found = parts.join(stripes.totals().withColumnRenamed("prefix", "part"), ["lang", "part"])
    # at most six rows a phrase
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    both = found.groupBy("lang", "phrase", "a", "k").agg(of("l").alias("l"), of("r").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", whole("a") * F.lit(scale).cast("decimal(10,0)"), whole("l") + whole("r"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def subsumed(stripes: Stripes, percent: int = 80) -> DataFrame:
    """(lang, phrase): phrases that occur inside a longer frequent one at least ``percent`` of the time.

    The longest count among longer phrases is that of a phrase with one word
    more, as counts fall with length: the best entry of the phrase's own
    stripe, or the largest entry that ends with it.
    """
    phrases = stripes.phrases().withColumn("phrase", F.array_join("words", " "))
    before = phrases.where(F.size("words") > 2).select("lang", F.array_join(F.slice("words", F.lit(2), F.size("words") - 1), " ").alias("phrase"), F.col("a").alias("best"))
    after = stripes.best().select("lang", F.col("prefix").alias("phrase"), "best")
    most = before.unionByName(after).groupBy("lang", "phrase").agg(F.max("best").alias("best"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return phrases.select("lang", "phrase", "a").join(most, ["lang", "phrase"]).where(wide("best") * 100 >= wide("a") * percent).select("lang", "phrase")


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """``rank`` from 1 within each language, at most ``top``: first within 64 parts of a language, then over what is left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language by score, then count, then phrase in byte order.

    Returns lang, rank, phrase, a, l, r, n, score.  Nulls, repeats and empty
    tables as in :func:`mine_stripes`; columns other than text and lang are
    not read.
    """
    stripes = mine_stripes(docs, min_count)
    kept = score_cuts(stripes).join(subsumed(stripes), ["lang", "phrase"], "left_anti")
    ranked = first_of_each(kept, top).join(F.broadcast(stripes.sizes), "lang")  # one row a language
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting every phrase of the corpus.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  q AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM p),
  g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM q, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k),
  f AS (SELECT lang, k AS m, g, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
  c AS (SELECT lang, m, g, f AS a FROM f WHERE m > 1 AND f >= 30),
  cut AS (SELECT lang, m AS size, g, a, unnest(range(1, m)) AS k FROM c),
  s AS (SELECT cut.lang, cut.g, cut.a, cut.k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f)) AS score FROM cut
    JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:cut.k] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[cut.k + 1:size]),
  low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
  part AS (SELECT lang, a, g[i:i + len - 1] AS part FROM c, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) AS s(i, len) WHERE i + len - 1 <= m AND len < m),
  gone AS (SELECT DISTINCT part.lang, part FROM part JOIN c ON c.lang = part.lang AND c.g = part WHERE 100 * part.a >= 80 * c.a),
  ranked AS (SELECT low.*, array_to_string(g, ' ') AS phrase FROM low ANTI JOIN gone ON gone.lang = low.lang AND gone.part = low.g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) QUALIFY rank <= 2000
"""
