"""Column functions on text: folding, tokens, overlap, predicates and parsing. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that carry no content when two sentences are compared.
STOP_WORDS = (
    "i", "me", "my", "mine", "myself", "you", "your", "yours",
    "a", "an", "the", "is", "am", "are", "was", "were", "be", "been", "being",
    "to", "of", "in", "on", "at", "for", "with", "by", "from", "as",
    "and", "or", "but", "not", "no", "do", "does", "did", "have", "has", "had",
    "it", "this", "that", "these", "those", "will", "would", "should", "could",
    "now", "instead",
)
# Fixed value: whole lines that agree with what was said before.
ASSENT = ("yes", "yeah", "yep", "ok", "okay", "correct", "that's right", "that is right")
# Fixed value: words that mark a sentence as replacing an earlier one.
NEGATIONS = ("not", "no longer", "don't", "doesn't", "stopped", "quit", "now prefer", "instead")
# Fixed value: what only the host's own chrome contains.
NOISE = "<task-notification>|<command-name>|<local-command"
# Older names of stages.
STAGE_ALIASES = {
    "stage-1-extract": "extract",
    "stage-2-reconcile": "reconcile",
    "stage-3-supersede": "supersede",
    "stage-4-summarise": "summarise",
    "stage-classify": "classify",
    "stage-entities": "entities",
}

_SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def dedup_key(c: Column) -> Column:
    """Lower case, trimmed, without closing punctuation, white space collapsed: the order matters."""
    return F.regexp_replace(F.regexp_replace(trimmed(F.lower(c)), "[.,;:!?]+$", ""), _SPACE, " ")


def canonical_name(c: Column) -> Column:
    return trimmed(F.lower(c))


def fold(c: Column) -> Column:
    """A name's fold: hyphens, underscores and other marks as spaces, collapsed."""
    spaced = F.regexp_replace(F.lower(c), "[\\s\\-_]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[^\\p{L}\\p{N} ]", " "), " +", " "))


def content_tokens(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The set of words between white space, punctuation kept, stop words dropped."""
    return F.array_distinct(F.filter(F.split(F.lower(c), _SPACE), lambda w: (w != "") & ~w.isin(*stop_words)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def search_tokens(c: Column) -> Column:
    """Index tokens: lower case, Latin marks stripped, split at what is neither letter nor digit."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def domain_name(c: Column) -> Column:
    folded = F.regexp_replace(trimmed(F.lower(c)), _SPACE, "_")
    return F.when(folded.isNull() | (folded == ""), F.lit("general")).otherwise(folded)


def spoken_text(c: Column) -> Column:
    """Only what stands in user_query tags, if there are any."""
    inner = F.regexp_extract_all(c, F.lit("(?s)<user_query>(.*?)</user_query>"), F.lit(1))
    return F.when(F.size(inner) > 0, F.concat_ws("\n", F.transform(inner, trimmed))).otherwise(c)


def looks_json(c: Column) -> Column:
    t = trimmed(c)
    return (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))


def iso_timestamp(c: Column) -> Column:
    """An instant from text that begins with a date, else null."""
    return F.when(c.rlike("^\\d{4}-\\d{2}-\\d{2}"), F.try_to_timestamp(c))


def about_user(c: Column) -> Column:
    return c.rlike("(?i)^\\s*(the\\s+)?user\\s+\\S")


def is_assent(c: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(F.lower(c)), "[.!]$", "")).isin(*ASSENT)


def has_negation(c: Column) -> Column:
    return c.rlike("(?i)\\b(" + "|".join(NEGATIONS) + ")\\b")


def clip(c: Column, most: int, mark: str = "") -> Column:
    """At most ``most`` characters; ``mark`` in the last place if something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(mark)), F.lit(mark))).otherwise(c)


def squeezed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, _SPACE, " "))


def tool_name(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, '"name"\\s*:\\s*"([^"]*)"', 1), F.lit(""))


def conversation_key(client: Column, mcp: Column, own: Column) -> Column:
    return F.coalesce(F.nullif(client, F.lit("")), F.nullif(mcp, F.lit("")), own)


def conversation_kind(client: Column, mcp: Column) -> Column:
    return F.when(F.coalesce(client, F.lit("")) != "", "client").when(F.coalesce(mcp, F.lit("")) != "", "mcp").otherwise("unkeyed")


def speaker_role(c: Column) -> Column:
    return F.when(c.isin("user", "assistant", "system", "tool"), c)


def speaker_name(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def group_dir_plain(c: Column) -> Column:
    """A working directory as a group directory: each other character becomes a dash."""
    return F.regexp_replace(F.regexp_replace(c, "[\\\\/]+$", ""), "[^a-zA-Z0-9]", "-")


def group_dir_slug(c: Column) -> Column:
    """Lower case, runs of other characters as one dash, none at the edges."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, "[\\\\/]+$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_noise(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(NOISE)


def project_key(c: Column) -> Column:
    """A project's comparable key; null for blank or numeric values, broken percent escapes and hashed slugs."""
    escaped = c.contains("%") & c.rlike("^[A-Za-z0-9._~%-]+$")
    raw = F.when(escaped, F.try_url_decode(c)).when(c.rlike("-[0-9a-f]{16}$") & (F.octet_length(c) <= 57), F.lit(None).cast("string")).otherwise(c)
    return F.when((trimmed(c) != "") & ~c.rlike("^[0-9]+$"), F.nullif(group_dir_slug(raw), F.lit("")))


def project_relation(a: Column, b: Column) -> Column:
    """same (equal, or one a dash-delimited prefix of the other), different, or not_comparable if either is null."""
    near = (a == b) | a.startswith(F.concat(b, F.lit("-"))) | b.startswith(F.concat(a, F.lit("-")))
    return F.when(a.isNull() | b.isNull(), "not_comparable").when(near, "same").otherwise("different")


def size_bytes(c: Column) -> Column:
    """``2GB`` and the like in bytes (binary units), else null."""
    n = F.regexp_extract(F.upper(c), "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(B|KB|MB|GB|TB)\\s*$", 1)
    unit = F.regexp_extract(F.upper(c), "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(B|KB|MB|GB|TB)\\s*$", 2)
    factor = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).when(unit == "TB", 1 << 40).otherwise(1)
    return F.when(n != "", F.floor(F.nullif(n, F.lit("")).cast("double") * factor).cast("long"))


def token_count(c: Column) -> Column:
    """``10M`` and the like as a number (decimal k, M, G); byte units are refused (null)."""
    n = F.regexp_extract(F.lower(c), "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([kmg]?)\\s*$", 1)
    unit = F.regexp_extract(F.lower(c), "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([kmg]?)\\s*$", 2)
    factor = F.when(unit == "k", 1000).when(unit == "m", 1_000_000).when(unit == "g", 1_000_000_000).otherwise(1)
    return F.when(n != "", F.round(F.nullif(n, F.lit("")).cast("double") * factor).cast("long"))


def stage_name(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STAGE_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(known, c), F.regexp_replace(F.regexp_replace(c, "^stage-[0-9]+-", ""), "^stage-", ""))
