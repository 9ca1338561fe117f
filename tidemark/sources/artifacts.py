"""Small artifacts of a run: JSON and Markdown files that appear whole or not at all."""

from __future__ import annotations

import json
import os
import re

from tidemark.operators.verdicts import BUCKETS


def write_text(path: str, text: str) -> None:
    """Write beside the target, then rename over it."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    partial = f"{path}.{os.getpid()}.partial"
    with open(partial, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(partial, path)


def write_json(path: str, data) -> None:
    """JSON with a stable layout; values JSON does not know are written as text."""
    write_text(path, json.dumps(data, indent=2, ensure_ascii=False, default=str) + "\n")


class FactError(ValueError):
    """A fact block that breaks its contract."""


def check_factblock(data) -> None:
    """Raise unless data is {package_name, facts: [{number, text}]} with a bare name and distinct numbers."""
    if not isinstance(data, dict):
        raise FactError("not an object")
    name, facts = data.get("package_name"), data.get("facts")
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII):
        raise FactError(f"not a bare package name: {name!r}")
    if not isinstance(facts, list) or not facts:
        raise FactError("facts: missing or empty")
    seen: set[int] = set()
    for i, fact in enumerate(facts):
        if not isinstance(fact, dict) or type(fact.get("number")) is not int or not isinstance(fact.get("text"), str) or not fact["text"].strip():
            raise FactError(f"facts[{i}]: needs an integer number and a text")
        if fact["number"] in seen:
            raise FactError(f"facts[{i}]: number {fact['number']} occurs twice")
        seen.add(fact["number"])


def render_facts(data) -> str:
    """Facts as numbered paragraphs."""
    return "\n\n".join(f"{f['number']}. {f['text']}" for f in data["facts"])


def report(document: dict[str, list[dict]], stats: dict, n_facts: int, n_patterns: int) -> str:
    """The audit as Markdown: counters, proposed and flagged sites by place, rejected ones as a number."""
    size = {k: len(document[k]) for k in BUCKETS}
    out = ["# Audit", "", f"- facts: {n_facts}", f"- patterns: {n_patterns}", *(f"- {k}: {v}" for k, v in stats.items()), ""]
    for title, bucket in (("Proposed", "proposed_sites"), ("Flagged", "flag_uncertain")):
        out.append(f"## {title} ({size[bucket]})\n")
        for r in sorted(document[bucket], key=lambda r: (r["file"], r["line"])):
            out.append(f"- `{r['file']}:{r['line']}` {r['reason']}" + (f"\n  `{r['snippet'].strip()}`" if r.get("snippet") else ""))
        out.append("")
    out.append(f"Rejected: {size['considered_and_rejected']}\n")
    return "\n".join(out)
