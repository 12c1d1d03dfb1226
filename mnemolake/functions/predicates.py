"""Predicates on tables of the store. Every ``now`` is a parameter."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemolake import schemas as S


def current(now: Column) -> Column:
    """Facts in force: active, latest, not past their validity."""
    return (F.col("status") == "active") & F.col("is_latest") & (F.col("valid_until").isNull() | (F.col("valid_until") > now))


def as_of(at: Column) -> Column:
    """What the store held at ``at``, whatever became of it."""
    return (F.col("created_at") <= at) & (F.col("system_retired_at").isNull() | (F.col("system_retired_at") > at))


def in_force(now: Column, at: Column | None = None) -> Column:
    return current(now) if at is None else as_of(at)


def eligible(types: tuple[str, ...] = S.EXTRACT_TYPES, roles: tuple[str, ...] = S.EXTRACT_ROLES, least: int = S.EXTRACT_LEAST) -> Column:
    """Events that extraction reads; a null content has length 0."""
    return F.col("event_type").isin(*types) & F.col("role").isin(*roles) & (F.length(F.coalesce("content", F.lit(""))) >= least)


def said_at(occurred: Column, mtime: Column, created: Column) -> Column:
    return F.coalesce(occurred, mtime, created)


def parse_system_time(text: str) -> datetime:
    """An instant; a bare date is midnight UTC. Anything that doesn't begin with a date raises ValueError."""
    if len(text) < 10 or text[4] != "-" or text[7] != "-":
        raise ValueError(f"not an instant: {text!r}")
    got = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return got if got.tzinfo else got.replace(tzinfo=timezone.utc)


def system_time_warning(at: datetime, since: datetime | None) -> str | None:
    """A warning if ``at`` lies before the store kept system time."""
    if since is None:
        return "This store does not record since when it keeps system time."
    return f"System time is kept since {since.isoformat()}; earlier reads are incomplete." if at < since else None


def temporal_score(now: Column) -> Column:
    """Decay by age from valid_from or created_at, slower for important facts."""
    anchor = F.coalesce("valid_from", "created_at")
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(anchor)) / 86_400_000_000)
    return 1 / (1 + days / (S.DECAY_DAYS * F.greatest(F.col("importance"), F.lit(S.DECAY_FLOOR))))


def interlocutor_prior(roles: dict[str, float], speakers: dict[str, float]) -> Column:
    """Product of the role's and the speaker's weights; 1 where none is set."""

    def weight(name: str, table: dict[str, float]) -> Column:
        if not table:
            return F.lit(1.0)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col(name)), F.lit(1.0))

    return weight("speaker_role", roles) * weight("speaker", speakers)
