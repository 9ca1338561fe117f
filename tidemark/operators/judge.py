"""Adjudicating chunks of candidates with a judge, resumably."""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import request_key
from tidemark.operators.usage import COUNTERS
from tidemark.operators.verdicts import BUCKETS, VERDICTS, VerdictError, violations
from tidemark.sources.chunk_store import Work, write_chunks

CHUNKS = "chunk_id int, input_hash string"
CALLS = "key string, stage string, system_excerpt string, user_excerpt string, response string, model string, " + ", ".join(f"{c} long" for c in COUNTERS)

#: The request's fixed part; {FACTS} is replaced.
TEMPLATE = """Judge each listed line against the facts below. Put every line into exactly one of proposed_sites,
flag_uncertain and considered_and_rejected, each with file, line, pattern, snippet and reason. Lines in test or mock
paths, and lines that build or fill a stand-in for the package, are never rejected.

{FACTS}
"""


class JudgeError(RuntimeError):
    """A judge that failed."""


class AnswerTruncated(JudgeError):
    """An answer cut off by a length limit, which is not the same as a malformed one."""


class ReplayMiss(JudgeError):
    """A request that the recording does not have."""


@dataclass(frozen=True)
class Answer:
    """What a judge returned: JSON text, the tokens it used by counter, and whether a limit cut it off."""

    text: str
    usage: dict[str, int] = field(default_factory=dict)
    truncated: bool = False
    model: str = ""


class Judge(ABC):
    """Gives verdicts on one chunk.  Instances are sent to tasks, so they must pickle."""

    @abstractmethod
    def decide(self, candidates: list[dict], system: str = "") -> Answer:
        """Answer for candidates with file, line, snippet and pattern; ``system`` holds the instructions and the facts."""

    def identity(self) -> str:
        """What the judge is; an answer is asked again when it changes."""
        state = {k: sorted(v) if isinstance(v, (set, frozenset)) else v for k, v in vars(self).items()}
        return f"{type(self).__module__}.{type(self).__qualname__} {json.dumps(state, sort_keys=True, default=repr)}"


def user_text(candidates: list[dict]) -> str:
    """The candidates of a request, without what is internal to the audit."""
    return json.dumps([{k: c[k] for k in ("file", "line", "snippet")} for c in candidates], ensure_ascii=False)


def call_key(candidates: list[dict], system: str = "") -> str:
    """The key of a request in a recording, the same as that of ``request_key``."""
    return hashlib.sha256(f"{system}\0{user_text(candidates)}".encode("utf-8", "surrogatepass")).hexdigest()[:24]


class ReplayJudge(Judge):
    """Answers from a recording, keyed by the request."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    @classmethod
    def load(cls, recording: DataFrame) -> ReplayJudge:
        """From (key, response), one row per judged chunk."""
        return cls({r.key: r.response for r in recording.select("key", "response").toLocalIterator()})

    def decide(self, candidates: list[dict], system: str = "") -> Answer:
        key = call_key(candidates, system)
        if key not in self.answers:
            raise ReplayMiss(f"no recorded answer for {key}")
        return Answer(self.answers[key], model="replay")

    def identity(self) -> str:
        return "replay " + hashlib.sha256(json.dumps(self.answers, sort_keys=True).encode()).hexdigest()


class RuleJudge(Judge):
    """Proposes candidates of some patterns, flags those of others and rejects the rest: the offline baseline."""

    def __init__(self, propose: set[str], flag: set[str] = frozenset()):
        self.propose, self.flag = propose, flag

    def decide(self, candidates: list[dict], system: str = "") -> Answer:
        out: dict[str, list[dict]] = {k: [] for k in BUCKETS}
        for c in candidates:
            bucket = "proposed_sites" if c["pattern"] in self.propose else "flag_uncertain" if c["pattern"] in self.flag else "considered_and_rejected"
            out[bucket].append({"file": c["file"], "line": c["line"], "pattern": c["pattern"], "snippet": c["snippet"], "reason": f"pattern {c['pattern']}"})
        return Answer(json.dumps(out))


def chunk_hash(candidates: list[dict], system: str = "", identity: str = "") -> str:
    """Hash of all that an answer depends on: sites, patterns, instructions with facts, and the judge."""
    body = json.dumps([[c["file"], c["line"], c["snippet"], c["pattern"]] for c in candidates], ensure_ascii=False)
    return hashlib.sha256("\0".join([body, system, identity]).encode("utf-8", "surrogatepass")).hexdigest()[:24]


def _rows_of(answer: Answer, rows: list[dict]) -> list[tuple]:
    if answer.truncated:
        raise AnswerTruncated("the answer was cut off")
    try:
        document = json.loads(answer.text)
    except ValueError as error:
        raise VerdictError(f"the answer is not JSON: {error}") from error
    bad = violations(document)
    given = [(r["file"], r["line"]) for k in BUCKETS for r in document.get(k, [])] if not bad else []
    if not bad and sorted(given) != sorted((r["file"], r["line"]) for r in rows):
        bad = ["the answer does not cover the chunk exactly"]
    if bad:
        raise VerdictError("; ".join(bad))
    return [(name, r["file"], r["line"], r.get("pattern"), r.get("snippet"), r["reason"]) for k, name in BUCKETS.items() for r in document[k]]


def adjudicate(chunks: DataFrame, judge: Judge, done: DataFrame | None = None, facts: str = "", template: str = TEMPLATE, store: str | None = None, calls: str | None = None) -> DataFrame:
    """Verdicts per chunk: chunk_id, input_hash and the verdict columns.

    ``chunks`` has chunk_id, file, line, snippet, pattern.  An answer that
    breaks the contract, or does not cover its chunk exactly, fails the run.

    With ``store``, the URI of a folder that all executors share, chunks are
    judged at once.  Each is published there as soon as it is valid, under the
    hash of all that its answer depends on, and a chunk that is there is not
    asked again, be it from an earlier run or from an earlier attempt of the
    same task.  Each call is published to ``calls`` before its answer is read,
    so it counts even if that is bad.

    Without ``store``, nothing is kept but the result, and a chunk whose hash is
    in ``done`` (an earlier result) keeps its old verdicts.
    """
    system, identity = template.replace("{FACTS}", facts), judge.identity()

    def decide(chunk: int, rows: list[dict], log) -> list[dict]:
        key, answer = call_key(rows, system), judge.decide(rows, system)
        used = {c: int(answer.usage.get(c, 0)) for c in COUNTERS}
        log(key, [{"key": key, "stage": f"chunk {chunk}", "system_excerpt": system[:200], "user_excerpt": user_text(rows)[:200], "response": answer.text, "model": answer.model, **used}])
        head = {"chunk_id": chunk, "input_hash": chunk_hash(rows, system, identity)}
        return [head | dict(zip(("bucket", "file", "line", "pattern", "snippet", "reason"), r)) for r in _rows_of(answer, rows)]

    if store is not None:
        sites = F.collect_list(F.struct("file", "line", "snippet", "pattern")).alias("sites")
        write_chunks(chunks.groupBy("chunk_id").agg(sites), store, Work(lambda rows: chunk_hash(rows, system, identity), decide), calls)
        return read_chunks(chunks.sparkSession, store).drop("chunk_id").join(chunk_hashes(chunks, judge, facts, template), "input_hash").select(*_names(f"{CHUNKS}, {VERDICTS}"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["file", "line"]).to_dict("records")
        return pd.DataFrame(decide(int(pdf["chunk_id"].iat[0]), rows, lambda key, calls: None))

    schema = f"{CHUNKS}, {VERDICTS}"
    if done is None:
        return chunks.groupBy("chunk_id").applyInPandas(run, schema)
    known = done.join(chunk_hashes(chunks, judge, facts, template), ["chunk_id", "input_hash"], "left_semi")
    pending = chunks.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return known.unionByName(pending.groupBy("chunk_id").applyInPandas(run, schema))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def chunk_hashes(chunks: DataFrame, judge: Judge, facts: str = "", template: str = TEMPLATE) -> DataFrame:
    """(chunk_id, input_hash) of what would be asked now."""
    system, identity = template.replace("{FACTS}", facts), judge.identity()

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["file", "line"]).to_dict("records")
        return pd.DataFrame({"chunk_id": [int(pdf["chunk_id"].iat[0])], "input_hash": [chunk_hash(rows, system, identity)]})

    return chunks.groupBy("chunk_id").applyInPandas(name, CHUNKS)


def chunk_status(chunks: DataFrame, judge: Judge, done: DataFrame, facts: str = "", template: str = TEMPLATE) -> DataFrame:
    """(chunk_id, status): done, stale (judged on other input) or pending."""
    old = done.select("chunk_id", F.col("input_hash").alias("old")).distinct()
    status = F.when(F.col("old").isNull(), "pending").when(F.col("old") == F.col("input_hash"), "done").otherwise("stale")
    return chunk_hashes(chunks, judge, facts, template).join(old, "chunk_id", "left").select("chunk_id", status.alias("status"))


def read_chunks(spark: SparkSession, store: str) -> DataFrame:
    """All chunks written so far."""
    return spark.read.schema(f"{CHUNKS}, {VERDICTS}").json(store)


def read_calls(spark: SparkSession, calls: str) -> DataFrame:
    """All calls written so far: a recording, and what they used."""
    return spark.read.schema(CALLS).json(calls)


def replay_answers(requests: DataFrame, recording: DataFrame) -> DataFrame:
    """(key, response) for requests (system, user) from a recording (key, response); a miss is an error."""
    asked = requests.select(request_key(F.col("system"), F.col("user")).alias("key"))
    found = asked.join(recording.select("key", "response"), "key", "left")
    missing = [r.key for r in found.where("response IS NULL").limit(5).collect()]
    if missing:
        raise ReplayMiss(f"no recorded answer for {', '.join(missing)}")
    return found
