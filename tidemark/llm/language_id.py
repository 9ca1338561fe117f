"""Language identification of mixed-language text (operator 3).

Script ranges narrow a word's candidate languages, hashed character trigrams
score it under each, and a Viterbi pass with a switching penalty labels spans.
The Viterbi recursion runs over many documents at once, one word per step.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, giving_back, stage

#: First code points of script ranges, and the script of each (0: none in particular).
SCRIPT_STARTS = [
    0x0000, 0x0041, 0x02B0, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00,
    0x0B80, 0x0C00, 0x0C80, 0x0D00, 0x0D80, 0x0E00, 0x0E80, 0x0F00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1780,
    0x1800, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00,
]
SCRIPT_OF = [
    0, 1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 11,
    12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 0, 24,
    25, 1, 2, 0, 26, 26, 0, 27, 0, 22, 0, 27, 0,
]
N_SCRIPTS = 28

_LETTER: np.ndarray | None = None
_SCRIPT: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its script."""
    global _LETTER, _SCRIPT
    if _LETTER is None:
        n = 0x110000
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        _SCRIPT = np.array(SCRIPT_OF, np.uint8)[np.searchsorted(SCRIPT_STARTS, np.arange(n), side="right") - 1]
    return _LETTER, _SCRIPT


def script_of(character: str) -> int:
    """Script number of one character, by range."""
    return SCRIPT_OF[bisect_right(SCRIPT_STARTS, ord(character)) - 1]


def word_features(words: list[str], buckets: int):
    """Hashed trigrams of lower-cased words.

    Returns (bucket, word index) of every trigram, and per word its number of
    letters and its script mask.  Non-letters end a trigram's run like the
    word's own ends do.
    """
    letter, script = _tables()
    lowered = [w.lower() for w in words]
    points = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    # where words end goes by their lengths: a word may hold any character
    at_end = np.zeros(len(points), bool)
    at_end[np.cumsum([0, *(len(w) + 1 for w in lowered)])] = True
    owner = np.cumsum(at_end) - 1  # the end before word k belongs to k; the last one to nobody
    is_letter = letter[points]
    points = np.where(is_letter, points, 0).astype(np.uint32)
    a, b, c = points[:-2], points[1:-1], points[2:]
    keep = (b > 0) & ~at_end[1:-1]
    h = a[keep] * np.uint32(0x9E3779B1) ^ b[keep] * np.uint32(0x85EBCA77) ^ c[keep] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    bucket = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - buckets.bit_length() + 1)
    word = owner[1:-1][keep]
    n = len(words)
    masks = np.zeros(n, np.int64)
    np.bitwise_or.at(masks, word, np.int64(1) << script[b[keep]].astype(np.int64))
    return bucket.astype(np.int64), word, np.bincount(word, minlength=n), masks


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of trigram buckets and the scripts of each language."""

    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    scripts: np.ndarray  # script mask per language
    buckets: int


def learn(train: DataFrame, most_buckets: int = 1 << 16, most_cells: int = 1 << 25) -> LanguageModel:
    """Count trigrams per language over all of ``train`` (text, lang); rows with a null in either are left out.

    Each task adds up its own rows; what is shuffled and collected is at most
    buckets + scripts per language.  There are ``most_buckets`` buckets, or for
    more than ``most_cells / most_buckets`` languages the largest power of two
    that keeps the model within ``most_cells``.
    """
    known = train.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    languages = sorted(r[0] for r in known.select("lang").distinct().toLocalIterator())
    buckets = most_buckets
    while buckets > 1024 and buckets * len(languages) > most_cells:
        buckets //= 2

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, dict[str, int]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = by_lang.setdefault(lang, {})
                for w in text.split():
                    words[w] = words.get(w, 0) + 1
                if len(words) > 60_000:
                    add(totals, lang, by_lang.pop(lang))
            for lang, words in by_lang.items():
                add(totals, lang, words)
        for lang, total in totals.items():
            where = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where)), pa.array(where), pa.array(total[where])], names=["lang", "slot", "n"])

    def add(totals, lang, words):
        bucket, word, letters, masks = word_features(list(words), buckets)
        times = np.fromiter(words.values(), np.int64, len(words))
        total = totals.setdefault(lang, np.zeros(buckets + N_SCRIPTS, np.int64))
        total[:buckets] += np.bincount(bucket, weights=times[word], minlength=buckets).astype(np.int64)
        for s in range(N_SCRIPTS):
            total[buckets + s] += int((times * letters)[masks >> s & 1 == 1].sum())

    rows = known.mapInArrow(giving_back(count), "lang string, slot long, n long")
    rows = stage(rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")), "trigram-counts")
    row_of = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), buckets + N_SCRIPTS))
    for batch in rows.toArrow().to_batches():
        at = [row_of[x] for x in batch.column(0).to_pylist()]
        counts[at, batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    grams, letters = counts[:, :buckets], counts[:, buckets:]
    log_p = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * buckets))
    used = letters >= 0.01 * np.maximum(letters.sum(1, keepdims=True), 1)
    scripts = (used * (1 << np.arange(N_SCRIPTS, dtype=np.int64))).sum(1).astype(np.int64) if languages else np.zeros(0, np.int64)
    return LanguageModel(languages, log_p.T.astype(np.float32), scripts, buckets)


def score_words(words: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Per word: log score per language relative to the best one, and its number of letters.

    A language whose scripts the word does not use is out, unless no language
    uses them; such a word scores alike under all.
    """
    bucket, word, letters, masks = word_features(words, model.buckets)
    scores = np.stack([np.bincount(word, weights=model.log_p[bucket, k], minlength=len(words)) for k in range(len(model.languages))], 1)
    fits = (masks[:, None] & model.scripts[None, :]) != 0
    known = fits.any(1)
    scores[~known] = 0
    scores = np.where(fits | ~known[:, None], scores, -1e4)
    return scores - scores.max(1, keepdims=True), letters


def viterbi(emissions: np.ndarray, word_of: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word, for many documents at once.

    ``word_of`` gives each position's row of ``emissions``; documents follow
    each other, ``sizes`` positions each.  Changing the language between two
    words costs ``penalty``.  Ties go to staying, then to the first language.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # documents with more than t words
    n, k = len(word_of), emissions.shape[1]
    stay, best = np.ones((n, k), bool), np.zeros(n, np.int16)
    labels = np.zeros(n, np.int16)
    score = np.zeros((len(sizes), k))
    last = np.zeros(len(sizes), np.int64)
    for t in range(steps):
        m = active[t]
        at, s = starts[:m] + t, score[:m]
        if t:
            top = s.argmax(1)
            jump = s[np.arange(m), top][:, None] - penalty
            kept = s >= jump
            stay[at], best[at] = kept, top
            s = np.where(kept, s, jump)
        score[:m] = s + emissions[word_of[at]]
    last[:] = score.argmax(1) if len(sizes) else last
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        labels[at] = last[:m]
        if t:
            last[:m] = np.where(stay[at, last[:m]], last[:m], best[at])
    return labels


def identify(docs: DataFrame, model: LanguageModel, penalty: float = 8.0, chunk_chars: int = 4_000_000, max_words: int = 200_000) -> DataFrame:
    """Append lang_pred, score, support and spans to ``docs`` (any columns, among them text).

    ``lang_pred`` is the language with most letters over the labelled spans,
    ``und`` for a text that is null or has no letter (or if nothing was
    learned).  ``score`` is its share of the letters times its posterior given
    the whole text's word scores.  ``support`` is the mean over all letters of
    the posterior of their own span's label given that span's word scores, so
    several languages in one text do not lower it.  ``spans`` lists (first,
    last, lang) by position among the white-space separated words.  Earlier
    columns of these four names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inputs = docs.drop("lang_pred", "score", "support", "spans")
    at_text = inputs.columns.index("text")
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([*inputs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("support", T.DoubleType()), T.StructField("spans", span)])
    has_letter = re.compile(r"[^\W\d_]").search

    def run(batches):
        m = shared.value
        rows: dict[str, int] = {}
        table, letters = np.zeros((0, len(m.languages))), np.zeros(0, np.int64)

        def label(texts):
            nonlocal rows, table, letters
            if not m.languages:
                return [("und", 0.0, 0.0, [])] * len(texts)
            split = [t.split() if t and has_letter(t) else [] for t in texts]
            new = set().union(*split).difference(rows)
            if len(rows) + len(new) > max_words:
                rows, new, table, letters = {}, set().union(*split), table[:0], letters[:0]
            if new:
                more = sorted(new)
                rows.update(zip(more, range(len(rows), len(rows) + len(more))))
                parts = [score_words(more[k : k + 40_000], m) for k in range(0, len(more), 40_000)]
                table, letters = np.concatenate([table, *(p[0] for p in parts)]), np.concatenate([letters, *(p[1] for p in parts)])
            sizes = np.array([len(w) for w in split], np.int64)
            of = np.fromiter((rows[w] for words in split for w in words), np.int64, int(sizes.sum()))
            path = viterbi(table, of, sizes, penalty)
            out, at = [], 0
            for size in sizes.tolist():
                mine, langs = of[at : at + size], path[at : at + size]
                at += size
                per = np.bincount(langs, weights=letters[mine], minlength=len(m.languages))
                if not per.sum():
                    out.append(("und", 0.0, 0.0, []))
                    continue
                total = table[mine].sum(0)
                odds = np.exp(total - total.max())
                pick = int(per.argmax())
                cuts = np.r_[0, np.flatnonzero(langs[1:] != langs[:-1]) + 1, size]
                inside, own = np.add.reduceat(table[mine], cuts[:-1]) if len(cuts) > 2 else total[None], langs[cuts[:-1]]
                odds_in = np.exp(inside - inside.max(1, keepdims=True))
                sure = odds_in[np.arange(len(own)), own] / odds_in.sum(1)
                support = float((np.add.reduceat(letters[mine], cuts[:-1]) * sure).sum() / per.sum())
                spans = [{"first": int(a), "last": int(b) - 1, "lang": m.languages[langs[a]]} for a, b in zip(cuts[:-1], cuts[1:])]
                out.append((m.languages[pick], float(per[pick] / per.sum() * odds[pick] / odds.sum()), support, spans))
            return out

        arrow_span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            done, begin, held = [], 0, 0
            for i, text in enumerate(texts):
                held += len(text or "")
                if held >= chunk_chars or i == len(texts) - 1:
                    done += label(texts[begin : i + 1])
                    begin, held = i + 1, 0
            langs, scores, supports, spans = zip(*done) if done else ((), (), (), ())
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(supports, pa.float64()), pa.array(spans, arrow_span)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return inputs.mapInArrow(giving_back(run), schema)


def identify_held_out(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every row, learned from the rows that are not held out.

    A row is held out if crc32 of its id as text leaves ``held`` modulo
    ``modulus``; a null id counts as empty text, which is not held out.
    Repeated rows are predicted one by one; an empty table gives no rows.
    """
    base = docs.select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), modulus) == held)
    model = learn(base.where(~F.col("held_out")))
    found = identify(base.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
