"""Personal data: fixed patterns, and bootstrapped contextual extraction, in DataFrame functions alone.

One pass over the texts finds the entities of the fixed patterns (seeds) and other identifier-like tokens
(candidates), each with its patterns: the one or two words right before it, the word after it, the words on both sides,
and two general ones, the shapes of the words on both sides with and without the marks between. The edges between
patterns and instances form a graph that is scored in rounds: a pattern by the mean score of its instances, an instance
by its best pattern, seeds always by 1. Instances that a round accepts count as seeds in the next, so each round reaches
a context further. Patterns of high confidence and enough distinct seeds then discover the candidates beside them. A
general pattern is confident only where most identifier-like tokens of such places in the whole corpus are seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import written

#: Rounds of scoring; distinct seed or accepted instances and the confidence that a pattern needs; instances of a general
#: pattern.
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, GENERAL_SEEDS = 3, 3, 0.6, 20
#: Code points on each side of an entity in which its patterns are looked for.
CONTEXT = 48
#: Elements that a running sum takes at a time: its cost is that of copying so many for each element.
RUN = 64
FOUND = "id"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Kind, cheap precondition, pattern, and the pattern that a match must have in full. The patterns match what the
#: contract's do, leftmost and non-overlapping, written so that no text makes them scan a run of characters anew from
#: each of its places: possessive runs that begin where a run begins, or where the last match ended (\G). Cards are
#: matched as whole runs of 14 to 19 digits, as shorter and longer runs fail in any case.
KINDS: tuple[tuple[str, str, str, str | None], ...] = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None),
    ("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    ("card", "", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", None),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", None),
)
#: What else may be an identifier: a token of at least six letters, digits, _ or - with a digit in it.
CANDIDATE = r"(?<![\p{L}\p{N}_.@+-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{5,}+"
#: The last one or two words before an entity, with what follows them; the last one of these; the first one after it.
LEFT = r"((?:\p{L}++[^\p{L}\p{N}]++)?\p{L}++[^\p{L}\p{N}]*+)$"
LAST = r"(?<!\p{L})(\p{L}++[^\p{L}\p{N}]*+)$"
RIGHT = r"^([^\p{L}\p{N}]*+\p{L}++)"
#: What a pattern begins with, by its kind; general ones come after the others.
TWO, ONE, AFTER, BOTH, MARKED, SHAPED = "2", "1", ">", "_", "~", "~~"


def running(values: Column, op, zero: int) -> Column:
    """Sums (or whatever ``op`` makes) of integers up to each element. Blocks of RUN keep it from being quadratic."""
    none = F.array().cast("array<int>")
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(zero))
    up_to = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / RUN).cast("int")), lambda i: up_to(F.slice(values, i * RUN + 1, F.lit(RUN))))
    before = lambda bs: F.concat(F.array(F.lit(zero)), up_to(F.transform(bs, last)))
    joined = lambda bs, base: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda x: op(F.get(base, i), x))))
    whole = _let(blocks, lambda bs: _let(before(bs), lambda base: joined(bs, base)))
    return F.when(F.size(values) > 0, whole).otherwise(none)


def _let(x: Column, body) -> Column:
    """``body`` of ``x``, which is evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def shape(word: Column) -> Column:
    """0: no word, a: lower-case or without case, A: capitals alone, Aa: others."""
    return F.when(word == "", "0").when(~word.rlike(r"\p{Lu}"), "a").when(word.rlike(r"^\p{Lu}{2,}$"), "A").otherwise("Aa")


def contexts(before: Column, after: Column) -> Column:
    """The patterns of an entity from the text right before and after it, as strings: their kind, then the words."""
    left, right = F.regexp_extract(F.lower(before), LEFT, 1), F.regexp_extract(F.lower(after), RIGHT, 1)
    last = F.regexp_extract(left, LAST, 1)
    word = lambda x, pattern: shape(F.regexp_replace(F.regexp_extract(x, pattern, 1), r"[^\p{L}]", ""))
    marks = lambda x: F.regexp_replace(x, r"[\p{L}\s]", "")
    sides = F.concat_ws(" ", word(before, LAST), word(after, RIGHT))
    return F.array_compact(F.array_distinct(F.array(
        F.when(left != last, F.concat(F.lit(TWO), left)), F.when(last != "", F.concat(F.lit(ONE), last)),
        F.when(right != "", F.concat(F.lit(AFTER), right)), F.when((last != "") & (right != ""), F.concat(F.lit(BOTH), last, F.lit(BOTH), right)),
        F.concat(F.lit(MARKED), F.left(marks(last), F.lit(4)), F.lit(" "), F.left(marks(right), F.lit(4)), F.lit(" "), sides), F.concat(F.lit(SHAPED), sides),
    )))


def spans(text: Column, found: Column, pattern: str, kind: str, order: int) -> Column:
    """Structs (s, k, e, kind, value, contexts) of the matches ``found``: positions from the lengths of what lies between."""

    def made(parts: Column) -> Column:
        ends = running(F.transform(found, lambda v, i: F.length(F.get(parts, i)) + F.length(v)), lambda a, x: a + x, 0)

        def one(e: Column, i: Column) -> Column:
            value = F.get(found, i)
            around = contexts(F.right(F.get(parts, i), F.lit(CONTEXT)), F.left(F.get(parts, i + 1), F.lit(CONTEXT)))
            return F.struct((e - F.length(value)).alias("s"), F.lit(order).alias("k"), e.alias("e"), F.lit(kind).alias("kind"), value.alias("value"), around.alias("contexts"))

        return F.transform(ends, one)

    empty = F.array().cast("array<struct<s:int,k:int,e:int,kind:string,value:string,contexts:array<string>>>")
    return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), made)).otherwise(empty)


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(KINDS[1][3])
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda x: valid(kind, x["value"])


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, sha, base, candidates): one pass over the texts. Candidates don't touch base spans."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    digits = text.rlike("[0-9]")
    for kind, mark, pattern, _ in KINDS:
        rows = rows.withColumn(f"_{kind}", F.when(F.contains(text, F.lit(mark)) & digits if kind != "email" else F.contains(text, F.lit(mark)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_other", F.when(digits, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    each = [F.filter(spans(text, F.col(f"_{kind}"), pattern, kind, i), _valid(kind)) for i, (kind, _, pattern, _) in enumerate(KINDS)]
    rows = rows.select("doc_id", "sha", F.array_sort(F.concat(*each)).alias("base"), spans(text, F.col("_other"), CANDIDATE, FOUND, len(KINDS)).alias("other"))
    free = F.filter("other", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return rows.select("doc_id", "sha", "base", free.alias("candidates"))


def confident_patterns(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, general_seeds: int = GENERAL_SEEDS) -> DataFrame:
    """Patterns (pattern, confidence) that seeds or accepted instances support, by scoring the whole graph in rounds.

    Edges are distinct, so a passage that many documents share counts once. An instance is accepted that a pattern with
    enough seeds and confidence is beside; only such patterns lend it their confidence as a score.
    """
    each = lambda name, seed: scanned.select(F.explode(name).alias("x")).select(F.explode("x.contexts").alias("pattern"), F.sha2("x.value", 256).alias("instance"), F.lit(seed).alias("seed"))
    edges = each("base", 1).union(each("candidates", 0)).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = written(edges, "pattern-edges")
    score = written(edges.where("seed = 1").select("instance", F.lit(1.0).cast("double").alias("score")).distinct(), "scores")
    enough = F.col("support") >= F.when(F.startswith(F.col("pattern"), F.lit(MARKED)), general_seeds).otherwise(min_seeds)
    for _ in range(rounds):
        # Instances without a score count in the mean, as 0. Sums are partial before the shuffle, so a pattern that a
        # third of all instances have is no burden; the joins are between plain scans, whose hot keys Spark may split.
        known = edges.join(score.hint("merge"), "instance", "left")
        patterns = known.groupBy("pattern").agg((F.coalesce(F.sum("score"), F.lit(0.0)) / (F.count("*") + 1)).alias("confidence"), F.count("score").alias("support"))
        patterns = written(patterns.where(enough & (F.col("confidence") >= min_confidence)).select("pattern", "confidence"), "patterns")
        got = edges.join(patterns.hint("merge"), "pattern", "left").groupBy("instance").agg(F.max(F.when(F.col("seed") == 1, 1.0).otherwise(F.col("confidence"))).alias("score"))
        score = written(got.where("score IS NOT NULL"), "scores")
    return patterns


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, general_seeds: int = GENERAL_SEEDS) -> DataFrame:
    """Rows (id, sha, base, found): arrays of structs (s, k, e, kind), base by the fixed patterns.

    One row for each row of ``docs``: spans depend on the text and on corpus-wide patterns only. ``sha`` is the
    SHA-256 of the text (null: empty). Positions are in code points, ends exclusive. An empty table gives an empty one.
    """
    scanned = written(scan(docs, id_col, text_col), "pii")
    patterns = confident_patterns(scanned, rounds, min_seeds, min_confidence, general_seeds).select("pattern")
    place = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))
    extra = scanned.select("doc_id", "sha", F.explode("candidates").alias("x")).select("doc_id", "sha", place(F.col("x")).alias("x"), F.explode("x.contexts").alias("pattern")).join(patterns.hint("merge"), "pattern")
    extra = extra.groupBy("doc_id", "sha").agg(F.array_sort(F.collect_set("x")).alias("found")).select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "found")
    base = scanned.select("doc_id", "sha", F.transform("base", place).alias("base"))
    joined = base.join(extra.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    return joined.select(F.col("doc_id").alias(id_col), "sha", "base", F.coalesce("found", F.array().cast(joined.schema["found"].dataType)).alias("found"))


def _joined(x: Column) -> Column:
    return F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found), one for each row of ``docs``.

    Spans are kind:start:end by start, then kind as listed (``id`` last), comma-joined. Null and empty texts have none; repeated rows
    and null ids stay; other columns are ignored.
    """
    got = find(docs, id_col, text_col, **options)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select(id_col, *(count(k[0]) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in brackets, all columns and rows kept.

    Of spans that overlap the first names the kind; the whole stretch goes. A null text stays null.
    """
    got = find(docs, id_col, text_col, **options).where(F.size("base") + F.size("found") > 0)
    spans_ = got.select(F.col(id_col).alias("_pii_id"), F.col("sha").alias("_pii_sha"), F.array_sort(F.concat("base", "found")).alias("_pii")).dropDuplicates(["_pii_id", "_pii_sha"])
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    both = docs.join(spans_.hint("merge"), F.col(id_col).eqNullSafe(F.col("_pii_id")) & (sha == F.col("_pii_sha")), "left")
    text = F.col(text_col)

    def cut(ends: Column) -> Column:
        # What lies between the stretch before and this span, and the span's kind; nothing where they overlap.
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        one = lambda x, i: F.when(x["s"] >= before(i), F.concat(F.substring(text, before(i) + 1, x["s"] - before(i)), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.concat(F.concat_ws("", F.transform("_pii", one)), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    ends = running(F.transform("_pii", lambda x: x["e"]), F.greatest, 0)
    return both.withColumn(text_col, F.when(F.col("_pii").isNotNull(), _let(ends, cut)).otherwise(text)).select(*docs.columns)
