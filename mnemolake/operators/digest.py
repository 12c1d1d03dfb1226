"""Small deterministic pieces around models: tolerant parsing, digests, budgets and configuration."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_tokens(usage: Column) -> tuple[Column, Column]:
    """Input and output tokens of a usage JSON; cached tokens are input, what isn't reported stays null."""
    n = lambda *paths: F.aggregate(F.filter(F.array(*[F.get_json_object(usage, p).cast("long") for p in paths]), lambda x: x.isNotNull()), F.lit(None).cast("long"), lambda a, x: F.coalesce(a, F.lit(0).cast("long")) + x)
    return n("$.input_tokens", "$.cache_read_input_tokens", "$.cache_creation_input_tokens"), n("$.output_tokens")


def last_result(lines: DataFrame) -> DataFrame:
    """Of the output lines (run, at, line) of each run the last result line, else the last that is a JSON object."""
    kind = F.get_json_object("line", "$.type")
    own = lines.where(F.coalesce(F.get_json_object("line", "$").startswith("{"), F.lit(False)))
    return own.groupBy("run").agg(F.max_by("line", F.struct((kind == "result"), F.col("at"))).alias("line"))


def shape_extract(text: str) -> list[dict]:
    """Facts from a model's reply: an array or an object with ``facts``, code fences allowed; empty contents drop out."""
    plain = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text or "")
    try:
        got = json.loads(plain)
    except ValueError:
        return []
    rows = got.get("facts", []) if isinstance(got, dict) else got
    return [r for r in rows if isinstance(r, dict) and str(r.get("content") or "").strip()] if isinstance(rows, list) else []


def briefing(key_facts: Sequence[str], summary: str | None, threads: Sequence[str], recent: Sequence[str]) -> str:
    """A Markdown digest of at most 15 key facts, the last summary, 5 threads and 20 recent facts; empty sections are left out."""
    parts = [("Key facts", [f"- {x}" for x in key_facts[:15]]), ("Last session", [summary] if summary else []), ("Open threads", [f"- {x}" for x in threads[:5]]), ("Recent", [f"- {x}" for x in recent[:20]])]
    return "\n\n".join(f"## {title}\n" + "\n".join(lines) for title, lines in parts if lines)


def historic_selection(text: str) -> dict | None:
    """``all``, ``200`` (events), ``7d`` (days) or ``no``; anything else raises."""
    t = text.strip().lower()
    if t in ("no", "none", "0", ""):
        return None
    if t == "all":
        return {"kind": "all"}
    if m := re.fullmatch(r"(\d+)(d?)", t):
        return {"kind": "days" if m[2] else "limit", "n": int(m[1])}
    raise ValueError(f"not a selection: {text!r}")


def token_budget(config: dict | None) -> dict[str, dict[str, int]]:
    """Caps by provider and window; numbers or ``10M``. A bare string is refused."""
    out: dict[str, dict[str, int]] = {}
    if isinstance(config, str):
        raise ValueError("a token budget names a provider and a window")
    for provider, windows in (config or {}).items():
        for scale, cap in windows.items():
            if scale not in ("hour", "day", "week", "month"):
                raise ValueError(f"unknown window: {scale}")
            m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmg]?)\s*", str(cap).lower())
            if not m:
                raise ValueError(f"not a number of tokens: {cap!r}")
            out.setdefault(provider, {})[scale] = round(float(m[1]) * {"": 1, "k": 1e3, "m": 1e6, "g": 1e9}[m[2]])
    return out


def merged(base: dict, over: dict) -> dict:
    """Configuration merged deeply; lists are replaced."""
    return {k: merged(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}
