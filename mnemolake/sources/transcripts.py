"""Transcript lines (JSON) to log events, in DataFrame functions. Lines that don't parse or aren't speech give nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.text import iso_timestamp, looks_json, spoken_text, trimmed

# Kinds of lines that are the host's own bookkeeping.
SKIPPED = (
    "system", "progress", "attachment", "file-history-snapshot", "file-history-delta", "queue-operation", "summary",
    "custom-title", "compact", "last-prompt", "mode", "permission-mode", "ai-title", "agent-name", "atis-latch", "turn_ended",
)
_BLOCKS = "array<struct<type:string,text:string,name:string,input:string,id:string,content:string,tool_use_id:string>>"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (path, line, value, mtime) of JSONL files; ``line`` counts from 1 within a file, ``mtime`` is when the file last changed.

    Files are read whole (no split), so a line's number is its place in its file's rows.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    lines = raw.select("path", "mtime", F.posexplode(F.split("value", "\n")).alias("at", "value"))
    return lines.where(trimmed(F.col("value")) != "").select("path", (F.col("at") + 1).cast("long").alias("line"), "value", "mtime")


def _blocks(content: Column) -> Column:
    """Content as blocks: a plain string is one text block."""
    plain = F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), content, F.lit("name"), F.lit(None).cast("string"), F.lit("input"), F.lit(None).cast("string"), F.lit("id"), F.lit(None).cast("string"), F.lit("content"), F.lit(None).cast("string"), F.lit("tool_use_id"), F.lit(None).cast("string")))
    return F.when(content.startswith("["), F.coalesce(F.from_json(content, _BLOCKS), plain)).otherwise(plain)


def _event(kind: str, role: Column, content: Column) -> Column:
    return F.struct(F.lit(kind).alias("event_type"), role.alias("role"), content.alias("content"))


def map_lines(lines: DataFrame) -> DataFrame:
    """Rows (path, line, ordinal, session_id, event_type, role, content, content_type, occurred_at, speaker).

    Text blocks of a line are one message, before its tool rows. Thinking is dropped; user text keeps only what
    stands in query tags, if there are any; tool results have the role tool. A line without a clock of its own has the
    file's (``mtime``), if ``lines`` has it.
    """
    clock = F.col("mtime") if "mtime" in lines.columns else F.lit(None)
    j = lambda path: F.get_json_object("value", path)
    own = lines.withColumns({"_type": j("$.type"), "_meta": j("$.isMeta"), "_role": F.coalesce(j("$.message.role"), j("$.role"), j("$.type")), "_content": F.coalesce(j("$.message.content"), j("$.content")), "session_id": F.coalesce(j("$.sessionId"), j("$.session_id")), "occurred_at": F.coalesce(iso_timestamp(j("$.timestamp")), clock.cast("timestamp")), "speaker": F.nullif(trimmed(j("$.speaker")), F.lit(""))})
    own = own.where(~F.coalesce("_type", F.lit("")).isin(*SKIPPED) & (F.coalesce("_meta", F.lit("false")) != "true") & F.col("_role").isin("user", "assistant") & F.col("_content").isNotNull())
    own = own.withColumn("_blocks", _blocks(F.col("_content")))
    text = F.concat_ws("\n", F.transform(F.filter("_blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]))
    said = F.when(F.col("_role") == "user", spoken_text(text)).otherwise(text)
    message = F.when(trimmed(said) != "", F.array(_event("message", F.col("_role"), said))).otherwise(F.array().cast("array<struct<event_type:string,role:string,content:string>>"))
    calls = F.transform(F.filter("_blocks", lambda b: b["type"] == "tool_use"), lambda b: _event("tool_call", F.lit("assistant"), F.to_json(F.struct(b["name"].alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("input"), b["id"].alias("id")))))
    results = F.transform(F.filter("_blocks", lambda b: b["type"] == "tool_result"), lambda b: _event("tool_result", F.lit("tool"), F.coalesce(b["content"], F.lit(""))))
    rows = own.select("path", "line", "session_id", "occurred_at", "speaker", F.posexplode(F.concat(message, calls, results)).alias("ordinal", "e"))
    return rows.select("path", "line", "ordinal", "session_id", "e.event_type", "e.role", "e.content", F.when(looks_json(F.col("e.content")), "json").otherwise("text").alias("content_type"), "occurred_at", "speaker")


def map_chat_history(lines: DataFrame) -> DataFrame:
    """The same for chat histories whose tool calls carry their arguments as JSON text; reasoning, system and synthetic lines give nothing."""
    j = lambda path: F.get_json_object("value", path)
    clock = F.col("mtime") if "mtime" in lines.columns else F.lit(None)
    own = lines.withColumns({"_type": j("$.type"), "_content": j("$.content"), "_calls": F.from_json(j("$.tool_calls"), "array<struct<id:string,name:string,arguments:string>>"), "occurred_at": F.coalesce(iso_timestamp(j("$.timestamp")), clock.cast("timestamp"))})
    own = own.where(~F.col("_type").isin("reasoning", "system") & j("$.synthetic_reason").isNull()).withColumn("_blocks", _blocks(F.coalesce("_content", F.lit(""))))
    text = F.concat_ws("\n", F.transform(F.filter("_blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]))
    role = F.when(F.col("_type") == "tool_result", "tool").otherwise(F.col("_type"))
    message = F.when(trimmed(text) != "", F.array(_event("message", role, F.when(role == "user", spoken_text(text)).otherwise(text)))).otherwise(F.array().cast("array<struct<event_type:string,role:string,content:string>>"))
    calls = F.transform(F.coalesce("_calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: _event("tool_call", F.lit("assistant"), F.to_json(F.struct(c["name"].alias("name"), c["arguments"].alias("input"), c["id"].alias("id")))))
    return own.select("path", "line", "occurred_at", F.posexplode(F.concat(message, calls)).alias("ordinal", "e")).select("path", "line", "ordinal", "e.event_type", "e.role", "e.content", "occurred_at")


def discover(files: DataFrame, kind: str) -> DataFrame:
    """Paths (path) of a connector's transcripts among ``files``; children of other sessions are left out."""
    path = F.col("path")
    if kind == "project":
        return files.where(path.rlike(r"/projects/[^/]+/([^/]+/)?[^/]+\.jsonl$")).select("path").distinct()
    if kind == "agent":
        return files.where(path.rlike(r"/projects/[^/]+/agent-transcripts/.*\.jsonl$") & ~path.contains("/subagents/")).select("path").distinct()
    if kind == "chat":
        own = files.where(path.rlike(r"/sessions/[^/]+/[^/]+/chat_history\.jsonl$")).select("path", F.regexp_extract("path", r"/sessions/[^/]+/([^/]+)/", 1).alias("session")).distinct()
        children = files.where(path.contains("/subagents/")).select(F.regexp_extract("path", r"/subagents/([^/.]+)", 1).alias("session")).distinct()
        return own.join(children, "session", "left_anti").select("path")
    raise ValueError(f"unknown kind of source: {kind}")


#: Fixed value: names of folders are at most so many bytes; longer ones are shortened by their writer, and found by their ``.cwd``.
NAME_BYTES = 255


def folder_names(cwds: DataFrame) -> DataFrame:
    """Rows (cwd, spelling, name): the folders that a working directory's sessions may be in, percent-encoded or, for one segment, as it is.

    A path of a drive is also tried with a capital letter and backslashes. A name that could lead out of the root isn't tried.
    """
    bare = F.regexp_replace("cwd", r"[\\/]+$", "")
    drive = F.when(bare.rlike(r"^[a-zA-Z]:[\\/]"), F.concat(F.upper(F.left(bare, F.lit(1))), F.replace(F.substring(bare, 2, 1 << 20), F.lit("/"), F.lit("\\"))))
    spelled = cwds.select("cwd", F.explode(F.array_distinct(F.array_compact(F.array(drive, bare)))).alias("spelling")).where("spelling <> ''")
    encoded = F.replace(F.replace(F.replace(F.url_encode("spelling"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    one = F.when(~F.col("spelling").rlike(r"[\\/]"), F.col("spelling"))
    names = spelled.select("cwd", "spelling", F.explode(F.array_distinct(F.array_compact(F.array(encoded, one)))).alias("name"))
    return names.where((F.octet_length("name") <= NAME_BYTES) & ~F.col("name").isin(".", "..") & ~F.col("name").rlike(r"[\\/]"))


def folders_of(files: DataFrame, cwds: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows (cwd, folder): folders of ``files`` (root, path) that a working directory (cwd) has, by name; where none has its name, those whose
    record (folder, text) says so."""
    inner = F.substring_index(F.regexp_replace(F.expr("substring(path, length(root) + 1)"), "^/+", ""), "/", 1)
    folders = files.where(F.startswith("path", F.col("root"))).select(F.concat_ws("/", F.regexp_replace("root", "/+$", ""), inner).alias("folder"), inner.alias("name")).distinct()
    names = folder_names(cwds)
    found = names.join(folders, "name").select("cwd", "folder").distinct()
    said = recorded.select("folder", F.regexp_replace(trimmed(F.col("text")), r"[\\/]+$", "").alias("spelling"))
    bare = F.regexp_replace("cwd", r"[\\/]+$", "")
    rest = cwds.select("cwd").distinct().join(found.select("cwd").distinct(), "cwd", "left_anti")
    spelled = rest.select("cwd", bare.alias("spelling")).union(names.select("cwd", "spelling")).distinct().join(rest, "cwd", "left_semi")
    return found.union(spelled.join(said, "spelling").join(folders.select("folder"), "folder", "left_semi").select("cwd", "folder").distinct())


def records(folders: DataFrame) -> DataFrame:
    """Rows (folder, text): what the ``.cwd`` file of each folder (folder) says, read where the rows are; folders without one have none."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for folder in b.column(0).to_pylist():
                try:
                    with open(f"{folder.removeprefix('file:')}/.cwd", encoding="utf-8", errors="replace") as f:
                        rows.append((folder, f.read(1 << 16)))
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["folder", "text"])

    return folders.select("folder").distinct().mapInArrow(read, "folder string, text string")


def resolve(sources: list[dict]) -> list[dict]:
    """Checked sources; an unknown kind or a missing home raises, an empty list is fine."""
    for s in sources:
        if s.get("kind") not in ("project", "agent", "chat"):
            raise ValueError(f"unknown kind of source: {s.get('kind')}")
        if not s.get("home"):
            raise ValueError(f"source {s['kind']} has no home")
    return [{"kind": s["kind"], "home": s["home"], "cwd": s.get("cwd")} for s in sources]


def copy_new(lines: DataFrame, copied: DataFrame) -> DataFrame:
    """Lines that were not copied before, by (path, line): a batch copy that is safe to repeat."""
    return lines.join(copied.select("path", "line"), ["path", "line"], "left_anti")
