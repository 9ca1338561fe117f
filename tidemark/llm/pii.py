"""Personal data: exact base patterns, then bootstrapped contextual extraction (operator 5).

Base matches are the seed entities.  The contexts in which they stand are
lexical patterns; a bipartite graph links patterns to the identifiers found in
them.  Spark scores both sides in turns: a pattern by the share of its places
that hold a believed instance, an instance by its believed patterns.  Patterns
of high confidence, and seeds that stand elsewhere in a form no base pattern
matches, then mark further identifiers.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, join_checked, stage

KINDS = ("email", "ip", "card", "phone")

#: The base patterns.  The e-mail one is split at its @ and matched from there, see _emails.  A match of
#: the address pattern starts and ends where a run of digits does; saying so keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

#: Fixed value: no base kind has more digits.
MAX_DIGITS = 19

_DIGIT = re.compile("[0-9]").search
_NO_DIGITS = re.compile("[^0-9]+").sub
_TOKEN = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]").search
_EDGES = ".,;:!?()[]{}<>\"'"
_KEY = re.compile(r"[^\W\d_]+[:=](?=.)")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain.

    The local part has no @, so a match around an @ starts where the run of
    local characters before it starts, or where the last match ended.  This
    is linear where the plain pattern rescans every word.
    """
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start."""
    spans = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                spans.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((3, *m.span()))
    return spans


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _pieces(tokens: list[tuple[int, int]], taken: list[tuple[int, int]]):
    """The parts of tokens outside the ``taken`` spans (sorted), in order."""
    k = 0
    for a, b in tokens:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(taken) and taken[j][0] < b:
            if taken[j][0] > at:
                yield at, taken[j][0]
            at = max(at, taken[j][1])
            j += 1
        if at < b:
            yield at, b


def _candidates(text: str, tokens: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, list[int]]]:
    """(start, ends) of identifier-like parts of a text outside its base spans, in order, see ``occurrences``."""
    run: list[tuple[int, int, int]] = []

    def trimmed(a: int, b: int) -> tuple[int, int]:
        while a < b and text[a] in _EDGES and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in _EDGES:
            b -= 1
        return a, b

    def readings() -> Iterator[tuple[int, list[int]]]:
        for i, (a, _, digits) in enumerate(run):
            ends, held, j = [run[i][1]], digits, i + 1
            while j < len(run) and held + run[j][2] <= MAX_DIGITS:
                held += run[j][2]
                ends.append(run[j][1])
                j += 1
            if i == 0 and j < len(run):
                ends.append(run[-1][1])
            yield a, ends
        run.clear()

    last = 0
    for a, b in _pieces(tokens, taken):
        if run and not text[last:a].isspace():
            yield from readings()
        piece, last = text[a:b], b
        digits = len(_NO_DIGITS("", piece)) if _DIGIT(piece) and not _LETTER(piece) and "@" not in piece else 0
        if digits:
            run.append((*trimmed(a, b), digits))
            continue
        yield from readings()
        key = _KEY.match(piece)
        x, y = trimmed(a + key.end() if key else a, b)
        if "@" in text[x + 1 : y - 1] or _DIGIT(text, x, y):
            yield x, [y]
    yield from readings()


def each_occurrence(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int, list[int]]]:
    """:func:`occurrences` one by one; beside the text only its tokens are held."""
    if "@" not in text and not _DIGIT(text):
        return
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = array("q", [a for a, _ in tokens])

    @lru_cache(4096)
    def word(at: int, to: int) -> str:
        return re.sub("[0-9]+", "0", text[at:to].lower().strip(".,;()[]\"'"))

    def left_of(a: int) -> tuple[str, str]:
        k = bisect_right(starts, a) - 1
        inside = text[starts[k] : a] if k >= 0 else ""
        before = [word(*t) for t in tokens[max(0, k - 2) : k]] + ([word(starts[k], a)] if inside.strip("(") else [])
        return tuple(["^", "^", *before][-2:])

    def right_of(b: int) -> str:
        after = bisect_left(starts, b)
        return word(*tokens[after]) if after < len(tokens) else "$"

    for kind, a, b in spans:
        body, left = text[a:b], left_of(a)
        shape = "@" if "@" in body else "#"
        instance = _hash(f"{shape} {body.lower()}")
        yield a, b, kind, instance, instance, [_hash(f"L {left[0]} {left[1]} {shape}"), _hash(f"B {left[1]} {right_of(b)} {shape}")]
    for a, ends in _candidates(text, tokens, sorted((a, b) for _, a, b in spans)):
        left, whole = left_of(a), text[a : ends[-1]].lower()
        shape = "@" if "@" in whole else "#"
        site, first, head = _hash(f"{shape} {whole}"), _hash(f"L {left[0]} {left[1]} {shape}"), f"B {left[1]} "
        for b in ends[:-1]:
            yield a, b, -1, _hash(f"{shape} {whole[: b - a]}"), site, [first, _hash(f"{head}{right_of(b)} {shape}")]
        b = ends[-1]
        yield a, b, -1, site, site, [first, _hash(f"{head}{right_of(b)} {shape}")]


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(start, end, seed kind or -1, instance, site, patterns) of base spans and identifier-like parts of the rest.

    Identifier-like is what has an @ inside or a digit: single tokens (without
    a key such as ``phone:`` before them), and of a run of tokens without
    letters every sub-run of at most ``MAX_DIGITS`` digits, as no base kind has
    more, and the whole run.  Base spans are cut out first.  A pattern is the
    two words before, or the words on either side, with the coarse shape; a key
    at the token's start counts as a word.  ``site`` is the longest candidate
    from the same start: candidates of one site are readings of one place, and
    the first pattern counts them once.
    """
    return list(each_occurrence(text, spans))


def choose_spans(score: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, readings: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the marked candidates that stay, see :func:`chosen`; one byte per character tells what is taken."""
    if not len(start):
        return []
    origin = int(start.min())
    taken = bytearray(int(end.max()) - origin)
    kept: list[tuple[int, int, int]] = []

    def add(k: int, a: int, b: int) -> bool:
        if taken.find(1, a - origin, b - origin) >= 0:
            return False
        taken[a - origin : b - origin] = b"\1" * (b - a)
        kept.append((k, a, b))
        return True

    order = np.lexsort((kind, start, start - end, -score))
    rest = []
    for at in range(0, len(order), 1 << 16):
        some = order[at : at + (1 << 16)]
        rest += [m for m in zip(kind[some].tolist(), start[some].tolist(), end[some].tolist()) if not add(*m)]
    if rest:
        by_start = np.lexsort((readings[1], readings[0]))
        firsts, lasts, end_of = readings[0][by_start], readings[1][by_start], 0
        for k, a, b in sorted(rest, key=lambda m: (m[1], -m[2])):
            if b <= end_of:  # inside an earlier one
                continue
            end_of = b
            low, high = np.searchsorted(firsts, (a, b))
            inside = [(x, y) for x, y in zip(firsts[low:high].tolist(), lasts[low:high].tolist()) if y <= b]
            for x, y in sorted(inside, key=lambda r: (r[0] - r[1], r[0])):
                add(k, x, y)
    return sorted(kept, key=lambda m: m[1])


def chosen(marked: list[tuple[float, int, int, int]], readings: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the marked candidates (score, kind, start, end) that stay: best score first, then the longest.

    None overlap.  What a marked candidate holds besides a better one inside
    it stays as the longest of the other ``readings`` (start, end) there.
    """
    score, kind, start, end = (np.array(x, t) for x, t in zip(zip(*marked) if marked else ((), (), (), ()), (float, np.int64, np.int64, np.int64)))
    return choose_spans(score, kind, start, end, tuple(np.array([r[k] for r in readings], np.int64) for k in (0, 1)))


SCANNED = "uid long, doc_id long, part int, base array<struct<kind:int,start:int,end:int>>, occ array<struct<start:int,end:int,seed:int,instance:long,site:long,patterns:array<long>>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


class _Rows:
    """Rows of ``SCANNED`` by column, so that an occurrence is six numbers and no object."""

    def __init__(self):
        self.heads: list[tuple] = []
        self.offsets = [0]
        self.numbers = [array("q") for _ in range(5)]
        self.patterns = array("q")

    def add(self, occurrence: tuple) -> None:
        for column, value in zip(self.numbers, occurrence):
            column.append(value)
        self.patterns.extend(occurrence[5])

    def close(self, uid: int, doc_id: int | None, part: int, base: list[tuple[int, int, int]]) -> None:
        self.heads.append((uid, doc_id, part, base))
        self.offsets.append(len(self.numbers[0]))

    def batch(self) -> pa.RecordBatch:
        n = len(self.numbers[0])
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        numbers = [pa.array(np.frombuffer(c, np.int64) if n else [], pa.int64()).cast(t) for c, t in zip(self.numbers, kinds)]
        patterns = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2), pa.array(np.frombuffer(self.patterns, np.int64) if n else [], pa.int64()))
        occ = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), pa.StructArray.from_arrays([*numbers, patterns], ["start", "end", "seed", "instance", "site", "patterns"]))
        uid, doc_id, part, base = zip(*self.heads)
        spans = pa.array([[dict(zip(("kind", "start", "end"), x)) for x in b] for b in base], pa.list_(_SPAN))
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(part, pa.int32()), spans, occ], ["uid", "doc_id", "part", "base", "occ"])


def scan(docs: DataFrame, uid: str | None = None, block: int = 1 << 14) -> DataFrame:
    """Base spans and occurrences of the rows of ``docs``, written once.

    A row of ``docs`` has a row of part 0 with its base spans, and further
    parts where it has more than ``block`` occurrences, so neither a task nor a
    row ever holds all occurrences of a long text.  ``uid`` names a column that
    tells the rows apart; without it one is made.
    """

    def run(batches):
        rows = _Rows()
        for batch in batches:
            for number, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                spans, part = base_spans(text or ""), 0
                for found in each_occurrence(text or "", spans):
                    rows.add(found)
                    if len(rows.numbers[0]) >= block:
                        rows.close(number, doc_id, part, spans if part == 0 else [])
                        yield rows.batch()
                        rows, part = _Rows(), part + 1
                if part == 0 or len(rows.numbers[0]):
                    rows.close(number, doc_id, part, spans if part == 0 else [])
            if rows.heads:
                yield rows.batch()
                rows = _Rows()

    number = F.col(uid) if uid else F.monotonically_increasing_id()
    rows = docs.select(number.alias("uid"), F.col("doc_id").cast("long"), "text")
    return stage(rows.mapInArrow(giving_back(run), SCANNED), "pii-scan")


def _seeds(occ: DataFrame) -> DataFrame:
    """(instance, kind, conf) of the base matches."""
    return occ.where("seed >= 0").select("instance", F.col("seed").alias("kind")).distinct().withColumn("conf", F.lit(1.0))


def loose_seeds(scanned: DataFrame) -> DataFrame:
    """(instance, kind): seeds that also stand where no base pattern matches them."""
    occ = scanned.select(F.explode("occ").alias("o")).select("o.*")
    loose = occ.where("seed < 0").select("instance").distinct()
    return stage(join_checked(loose, stage(_seeds(occ), "pii-seeds"), "instance", "inner").select("instance", "kind"), "pii-loose")


def believed_patterns(scanned: DataFrame, rounds: int = 3, min_support: int = 3, min_precision: float = 0.8) -> DataFrame:
    """(pattern, kind, conf) of the patterns that the scores of the last round believe.

    The graph holds distinct (pattern, site, instance) triples, so copies of a
    text add nothing and a frequent context is only as heavy as its sites.  A
    site is believed as much as the best of its instances, and a pattern makes
    only the longest reading of a site believed, not each number in it.
    """
    occ = scanned.select(F.explode("occ").alias("o")).select("o.*")
    # the first pattern is that of all candidates from one start, the second one that of a candidate alone
    linked = F.explode(F.transform("patterns", lambda p, i: F.struct(p.alias("pattern"), F.when(i == 0, F.col("site")).otherwise(F.col("instance")).alias("site"))))
    edges = stage(occ.select(linked.alias("e"), "instance").select("e.pattern", "e.site", "instance").distinct(), "pii-edges")
    totals = stage(edges.groupBy("pattern").agg(F.count_distinct("site").alias("n")), "pii-totals")
    seeds = stage(_seeds(occ), "pii-seeds")
    believed = seeds
    for _ in range(rounds):
        hits = join_checked(edges, believed, "instance", "inner").groupBy("pattern", "site", "kind").agg(F.max("conf").alias("conf")).groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"), F.count("*").alias("support"))
        scored = join_checked(stage(hits, "pii-hits"), totals, "pattern", "inner").withColumn("conf", F.col("mass") / F.col("n"))
        patterns = stage(scored.where((F.col("support") >= min_support) & (F.col("conf") >= min_precision)).select("pattern", "kind", F.least("conf", F.lit(0.99)).alias("conf")), "pii-patterns")
        reached = join_checked(edges.where("site = instance"), patterns, "pattern", "inner").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("conf"))
        new = reached.where(F.col("conf") >= min_precision)
        believed = stage(seeds.unionByName(new).groupBy("instance", "kind").agg(F.max("conf").alias("conf")), "pii-believed")
    return patterns


def find_personal_data(docs: DataFrame, rounds: int = 3, uid: str | None = None) -> DataFrame:
    """(uid, doc_id, base, spans): base spans and all spans per row of ``docs`` (doc_id, text).

    An added span takes the kind of its most confident patterns: an e-mail only
    for tokens with an @, another kind only for numbers.  Of added spans that
    overlap, the best one stays.  Offsets are code points, ends exclusive.  A
    null text has no spans; null ids and repeated rows are kept; an empty table
    gives no rows.
    """
    scanned = scan(docs, uid)
    patterns = believed_patterns(scanned, rounds)
    loose = scanned.select("uid", F.explode("occ").alias("o")).where("o.seed < 0").select("uid", "o.start", "o.end", "o.instance", "o.patterns")
    by_pattern = join_checked(loose.select("uid", "start", "end", F.explode("patterns").alias("pattern")), patterns, "pattern", "inner")
    by_pattern = by_pattern.groupBy("uid", "start", "end", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
    by_seed = join_checked(loose, loose_seeds(scanned), "instance", "inner").select("uid", "start", "end", "kind", F.lit(1.0).alias("score"))
    marked = stage(by_pattern.unionByName(by_seed).groupBy("uid").agg(F.collect_list(F.struct("score", "kind", "start", "end")).alias("marked")), "pii-marked")

    def choose(batches):
        for batch in batches:
            spans = []
            for i, base in enumerate(batch.column(2).to_pylist()):
                marks, readings = batch.column(4)[i].values, batch.column(3)[i].values
                found = []
                if marks is not None and len(marks):
                    one = lambda values, name: values.field(name).to_numpy(zero_copy_only=False)
                    pairs = [np.empty(0, np.int64)] * 2 if readings is None else [one(readings, n) for n in ("start", "end")]
                    found = choose_spans(*(one(marks, n) for n in ("score", "kind", "start", "end")), tuple(pairs))
                spans.append([dict(zip(("kind", "start", "end"), x)) for x in sorted([(x["kind"], x["start"], x["end"]) for x in base] + found)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.list_(_SPAN))], names=["uid", "doc_id", "base", "spans"])

    # only rows with a mark need their readings
    loose_parts = F.transform(F.filter("occ", lambda o: o["seed"] < 0), lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end")))
    readings = scanned.join(marked.select("uid"), "uid", "left_semi").groupBy("uid").agg(F.flatten(F.collect_list(loose_parts)).alias("readings"))
    kind = "array<struct<kind:int,start:int,end:int>>"
    joined = scanned.where("part = 0").join(marked.join(readings, "uid"), "uid", "left").select("uid", "doc_id", "base", "readings", "marked")
    return joined.mapInArrow(giving_back(choose), f"uid long, doc_id long, base {kind}, spans {kind}")


def span_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, per row."""
    found = find_personal_data(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(F.array_sort("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Replace spans (kind, start, end) by their kind's name in angle brackets; overlapping ones by the first's."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame, rounds: int = 3, max_broadcast: int = 500_000) -> DataFrame:
    """``docs`` with the personal data in ``text`` masked; other columns as they were.

    The believed patterns are learned over all rows.  Up to ``max_broadcast``
    of them and of the seeds that stand unmatched somewhere are broadcast and
    each text is scanned again where it stands, so texts are not shuffled;
    beyond that the spans are joined to the rows.
    """
    scanned = scan(docs)
    patterns, seeds = believed_patterns(scanned, rounds), loose_seeds(scanned)
    at = docs.columns.index("text")
    if patterns.limit(max_broadcast + 1).count() + seeds.limit(max_broadcast + 1).count() > max_broadcast:
        return _mask_by_join(docs, rounds)
    of_pattern: dict[int, list[tuple[int, float]]] = {}
    for pattern, kind, conf in patterns.toLocalIterator():
        of_pattern.setdefault(pattern, []).append((kind, conf))
    of_seed: dict[int, list[int]] = {}
    for instance, kind in seeds.toLocalIterator():
        of_seed.setdefault(instance, []).append(kind)
    shared = docs.sparkSession.sparkContext.broadcast((of_pattern, of_seed))

    def run(batches):
        of_pattern, of_seed = shared.value
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                spans = base_spans(text or "")
                marked, readings = [], (array("q"), array("q"))
                for start, end, seed, instance, _, pats in each_occurrence(text or "", spans):
                    if seed >= 0:
                        continue
                    readings[0].append(start)
                    readings[1].append(end)
                    doubt: dict[int, float] = {}
                    for kind, conf in [x for p in pats for x in of_pattern.get(p, ())]:
                        doubt[kind] = doubt.get(kind, 1.0) * (1 - conf)
                    marked += [(1 - d, kind, start, end) for kind, d in doubt.items()]
                    marked += [(1.0, kind, start, end) for kind in of_seed.get(instance, ())]
                columns_of = zip(zip(*marked), (float, np.int64, np.int64, np.int64)) if marked else ()
                found = choose_spans(*(np.array(c, t) for c, t in columns_of), tuple(np.array(r, np.int64) for r in readings)) if marked else []
                texts.append(mask(text, spans + found))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(giving_back(run), docs.schema)


def _mask_by_join(docs: DataFrame, rounds: int) -> DataFrame:
    """The same masks, with each row's spans found and joined by a row number that is written first."""
    longest = max(map(len, docs.columns))
    row, found_in = "r" * (longest + 1), "s" * (longest + 1)  # no column of the rows has such a name
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "pii-rows")
    found = find_personal_data(numbered, rounds, row).where(F.size("spans") > 0).select(F.col("uid").alias(row), F.col("spans").alias(found_in))
    joined = numbered.join(stage(found, "pii-spans"), row, "left").select(*docs.columns, found_in)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(at).to_pylist(), batch.column(len(docs_columns)).to_pylist())
            texts = [mask(t, [(s["kind"], s["start"], s["end"]) for s in spans or []]) for t, spans in rows]
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = list(docs.columns)
    return joined.mapInArrow(run, docs.schema)


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    """The digest of ``span_report`` in plain Python, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)).encode()).hexdigest()
