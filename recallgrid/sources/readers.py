"""Readers: tables, nested ingest requests, chat exports, attachment bytes, settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import numbered
from ..schema import DDL, SCHEMA_VERSION
from .arrays import array_objects

# File names that are text whatever their type says, and who speaks in an export.
TEXT_ENDINGS = ["txt", "md", "csv", "json", "xml", "html", "htm", "yaml", "yml", "log", "py", "js", "ts", "sh", "sql"]
SENDERS = {"human": "user", "assistant": "claude"}
TOOL_ARGUMENTS = ["path", "file_path", "title", "id", "query", "url"]
MAX_MESSAGES, MAX_FILES, MAX_FILE_CHARS = 5000, 20, 34_000_000

REQUEST = (
    "source_app string, conversation_id string, title string, messages array<struct<external_id:string,speaker:string,content:string,created_at:string,"
    "attachments:array<struct<filename:string,mime:string,data_b64:string>>>>"
)
BLOCK = "struct<type:string,text:string,thinking:string,name:string,input:struct<path:string,file_path:string,title:string,id:string,query:string,url:string,command:string,content:string,old_str:string,new_str:string>>"
EXPORT = (
    f"uuid string, name string, created_at string, chat_messages array<struct<uuid:string,sender:string,created_at:string,text:string,content:array<{BLOCK}>,"
    "attachments:array<struct<file_name:string,extracted_content:string>>,files:array<struct<file_name:string>>>>"
)
PROJECT = "uuid string, name string, description string, prompt_template string, created_at string, docs array<struct<uuid:string,filename:string,content:string,created_at:string>>"


@dataclass
class Settings:
    """Defaults, then config.json, then config.local.json, then MEMORY_<NAME> from the environment."""

    user_name: str = "Alex"
    trusted_apps: list[str] = field(default_factory=list)
    grounding_allowlist: list[str] = field(default_factory=list)
    word_budget: int = 800
    backup_keep: int = 14
    mirror_keep: int = 7

    @classmethod
    def load(cls, folder: str, env: dict[str, str] | None = None) -> Settings:
        values: dict = {}
        for name in ("config.json", "config.local.json"):
            path = os.path.join(folder, name)
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    values |= json.load(f)
        for f in fields(cls):
            if (given := (os.environ if env is None else env).get(f"MEMORY_{f.name.upper()}")) is not None:
                values[f.name] = int(given) if f.type == "int" else given.split(",") if str(f.type).startswith("list") else given
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})


def create_tables(spark: SparkSession, folder: str) -> None:
    """Empty tables of the schema below folder; refuses a folder that a newer version wrote."""
    marker = f"{folder}/_schema"
    try:
        found = spark.read.schema("version int").parquet(marker).first()["version"]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found is not None:
        if found > SCHEMA_VERSION:
            raise ValueError(f"tables of schema version {found}; this is version {SCHEMA_VERSION}")
        return
    for name, ddl in DDL.items():
        spark.createDataFrame([], ddl).write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.parquet(marker)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(DDL[name]).parquet(f"{folder}/{name}")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).json(path, multiLine=True)


def refused(too_much: Column, reason: str, otherwise: Column) -> Column:
    """otherwise, or an error with the reason, so that the sender splits the call."""
    return F.when(too_much, F.raise_error(F.lit(reason))).otherwise(otherwise)


def request_messages(requests: DataFrame) -> DataFrame:
    """One row a message, in request order, times as epochs. A request of more than MAX_MESSAGES is an error.

    Where a conversation is sent in several requests, first is the position of a request's first message.
    """
    from ..functions.scoring import to_epoch

    messages = refused(F.size("messages") > MAX_MESSAGES, f"too many messages in one request (at most {MAX_MESSAGES})", F.col("messages"))
    first = F.col("first") if "first" in requests.columns else F.lit(0)
    rows = requests.select("source_app", F.col("conversation_id").alias("conversation_external_id"), "title", first.alias("first"), F.posexplode(messages).alias("pos", "m"))
    return rows.select("source_app", "conversation_external_id", "title", (F.col("first") + F.col("pos")).alias("pos"), "m.external_id", "m.speaker", "m.content", to_epoch(F.col("m.created_at")).alias("created_at"), F.col("m.attachments").alias("attachments"))


def request_files(messages: DataFrame) -> DataFrame:
    """One row an attachment whose base64 is sound: bytes, digest, size, stored name and text. Too many files or too long a file is an error."""
    files = refused(F.size("attachments") > MAX_FILES, f"too many files at one message (at most {MAX_FILES})", F.col("attachments"))
    rows = messages.select("source_app", "conversation_external_id", F.col("external_id").alias("message_external_id"), F.explode(files).alias("a"))
    data = refused(F.length("a.data_b64") > MAX_FILE_CHARS, f"file too long (at most {MAX_FILE_CHARS} characters of base64)", F.try_to_binary(F.col("a.data_b64"), F.lit("base64")))
    rows = rows.select("*", "a.filename", "a.mime", data.alias("data")).where("data is not null").drop("a")
    ending = F.when(F.contains("filename", F.lit(".")), F.concat(F.lit("."), F.substring_index("filename", ".", -1))).otherwise("")
    return rows.withColumns({"sha256": F.sha2("data", 256), "size": F.octet_length("data").cast("long")}).withColumns({"stored_name": F.concat("sha256", ending), "extracted_text": extract_text(F.col("data"), F.col("filename"), F.col("mime"))})


def extract_text(data: Column, filename: Column, mime: Column) -> Column:
    """Text of text files, bad bytes replaced; else empty (as for PDF where no reader is installed)."""
    ending = F.lower(F.substring_index(filename, ".", -1))
    is_text = mime.startswith("text/") | ending.isin(TEXT_ENDINGS)
    return F.when(is_text, F.make_valid_utf8(data.cast("string"))).otherwise(F.lit(""))


def read_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """conversations, projects and memories of a chat export; a project file holds one or a list.

    conversations.json, the large one, is read by byte ranges (arrays.array_objects); the others are small.
    """
    projects = spark.read.schema(PROJECT).json(f"{folder}/projects/*.json", multiLine=True)
    return {"conversations": export_rows(array_objects(spark, f"{folder}/conversations.json"), EXPORT), "projects": projects, "memories": memory_rows(spark.read.text(f"{folder}/memories.json", wholetext=True))}


def export_rows(texts: DataFrame, schema: str) -> DataFrame:
    """Rows of schema (EXPORT or PROJECT) from texts(value), one JSON object each."""
    return texts.select(F.from_json("value", schema).alias("x")).select("x.*")


def memory_rows(texts: DataFrame, order: str | None = None) -> DataFrame:
    """at (order of the text, place of the entry in it) and memory map<string,variant> of each entry of texts(value), JSON lists."""
    at = F.col(order) if order else F.input_file_name()
    return texts.select(at.alias("text_at"), F.posexplode(F.from_json("value", "array<map<string,variant>>")).alias("entry_at", "memory"))


# Fixed value: white space that is stripped and collapsed, beyond ASCII too.
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
TEXT = "text/plain"
NO_FILES = "array<struct<filename:string,mime:string,text:string>>"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}|{BLANK}$", "")


def given(x: Column) -> Column:
    """x, or null where it is empty."""
    return F.when(x != "", x)


def tool_marker(block: Column) -> Column:
    """A tool call as one line: its name and the first argument that says what it is about."""
    args = [given(block["input"][a]) for a in TOOL_ARGUMENTS]
    arg = F.substring(strip(F.regexp_replace(F.coalesce(*args, F.lit("")), BLANK, " ")), 1, 120)
    return F.concat(F.lit("[tool: "), F.coalesce(given(block["name"]), F.lit("tool")), F.when(arg != "", F.concat(F.lit(" "), arg)).otherwise(""), F.lit("]"))


def artifact_text(block: Column) -> Column:
    """What an artifact call made, as text: title, content, and what an update changed; empty if nothing."""
    i = block["input"]
    change = F.when(F.coalesce(given(i["old_str"]), given(i["new_str"])).isNotNull(), F.concat(F.lit("[update]\n--- old\n"), F.coalesce(i["old_str"], F.lit("")), F.lit("\n--- new\n"), F.coalesce(i["new_str"], F.lit(""))))
    return strip(F.concat_ws("\n\n", F.concat(F.lit("# "), given(i["title"])), given(i["content"]), change))


def export_content(message: Column) -> Column:
    """Text of an export message: its blocks, or its text where they say nothing, then names of files."""
    said = lambda x: given(strip(x))
    part = lambda b: F.when(b["type"] == "text", said(b["text"])).when(b["type"] == "thinking", F.concat(F.lit("[thinking]\n"), said(b["thinking"]))).when(b["type"] == "tool_use", tool_marker(b))
    none = F.array().cast("array<string>")
    there = lambda parts: F.coalesce(F.filter(parts, lambda x: x.isNotNull()), none)
    parts = there(F.transform(message["content"], part))
    parts = F.when(F.size(parts) > 0, parts).otherwise(there(F.array(said(message["text"]))))
    files = there(F.transform(message["files"], lambda f: F.concat(F.lit("[file: "), given(f["file_name"]), F.lit("]"))))
    attached = there(F.transform(message["attachments"], lambda f: F.concat(F.lit("[attachment: "), F.coalesce(given(f["file_name"]), F.lit("attachment")), F.lit("]"))))
    return strip(F.array_join(F.concat(parts, files, attached), "\n\n"))


def export_files(message: Column) -> Column:
    """Texts that come with an export message: what artifact calls made, and attachments' extracted texts."""
    file = lambda name, text: F.struct(name.alias("filename"), F.lit(TEXT).alias("mime"), text.alias("text"))
    made = F.transform(F.filter(message["content"], lambda b: (b["type"] == "tool_use") & (b["name"] == "artifacts")), lambda b: file(F.concat(F.coalesce(given(b["input"]["id"]), F.lit("artifact")), F.lit(".txt")), artifact_text(b)))
    came = F.transform(message["attachments"], lambda f: file(F.coalesce(given(f["file_name"]), F.lit("attachment")), strip(F.coalesce(f["extracted_content"], F.lit("")))))
    none = F.array().cast(NO_FILES)
    return F.filter(F.concat(F.coalesce(made, none), F.coalesce(came, none)), lambda f: f["text"] != "")


def export_messages(conversations: DataFrame, now: float) -> DataFrame:
    """conversation uuid, name, message uuid, speaker, content, created_at, attachments of the messages that say or bring something."""
    from ..functions.scoring import to_epoch

    rows = conversations.select(F.col("uuid").alias("conversation"), F.coalesce("name", F.lit("")).alias("name"), F.col("created_at").alias("began"), F.posexplode("chat_messages").alias("pos", "m"))
    known = F.create_map(*(F.lit(x) for pair in SENDERS.items() for x in pair))
    sender = F.coalesce(F.element_at(known, F.col("m.sender")), given(F.col("m.sender")), F.lit("unknown"))
    when = F.coalesce(to_epoch(F.col("m.created_at")), to_epoch(F.col("began")), F.lit(float(now)))
    out = rows.select("conversation", "name", "pos", F.col("m.uuid").alias("external_id"), sender.alias("speaker"), export_content(F.col("m")).alias("content"), when.alias("created_at"), export_files(F.col("m")).alias("attachments"))
    return out.where((F.col("content") != "") | (F.size("attachments") > 0))


def project_messages(projects: DataFrame, now: float) -> DataFrame:
    """A project's own texts, and each of its documents with its text attached, as the owner's messages of one conversation."""
    from ..functions.scoring import to_epoch

    began = F.coalesce(to_epoch(F.col("created_at")), F.lit(float(now)))
    name, none = F.coalesce("name", F.lit("")), F.array().cast(NO_FILES)
    home = [F.concat(F.lit("project-"), F.col("uuid")).alias("conversation"), F.concat(F.lit("Project: "), name).alias("name")]
    head = F.concat_ws("\n\n", strip(F.concat(F.lit("[project] "), name)), given(F.col("description")), F.concat(F.lit("[prompt template]\n"), given(F.col("prompt_template"))))
    top = projects.select(*home, F.lit(0).alias("pos"), F.concat(F.lit("project-"), F.col("uuid")).alias("external_id"), strip(head).alias("content"), began.alias("created_at"), none.alias("attachments"))
    docs = projects.select(*home, began.alias("began"), F.posexplode("docs").alias("at", "d"))
    text = strip(F.coalesce("d.content", F.lit("")))
    file = F.array(F.struct(F.coalesce(given(F.col("d.filename")), F.lit("doc.txt")).alias("filename"), F.lit(TEXT).alias("mime"), text.alias("text")))
    docs = docs.select(
        "conversation", "name", (F.col("at") + 1).alias("pos"), F.col("d.uuid").alias("external_id"), F.concat(F.lit("[project doc: "), F.coalesce("d.filename", F.lit("")), F.lit("]")).alias("content"),
        F.coalesce(to_epoch(F.col("d.created_at")), F.col("began")).alias("created_at"), F.when(text != "", file).otherwise(none).alias("attachments"),
    )
    return top.unionByName(docs).withColumn("speaker", F.lit("user"))


def memory_messages(memories: DataFrame) -> DataFrame:
    """Every string of memory snapshots that isn't blank, stripped, as system messages memory-0, memory-1, ... in order."""
    rows = memories.select("text_at", "entry_at", F.posexplode(F.map_entries("memory")).alias("value_at", "x"))
    texts = rows.where(F.schema_of_variant("x.value") == "STRING").select("text_at", "entry_at", "value_at", strip(F.try_variant_get("x.value", "$", "string")).alias("content")).where("content <> ''")
    return numbered(texts, ["text_at", "entry_at", "value_at"], 0).select(F.concat(F.lit("memory-"), F.col("id").cast("string")).alias("external_id"), F.lit("system").alias("speaker"), "content")


def import_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """What an import takes in: repeated ids of a conversation's messages, and equal texts of a message, count once."""
    total = conversations.select(F.col("uuid").alias("conversation"), F.coalesce(F.size("chat_messages"), F.lit(0)).alias("n"))
    per = messages.groupBy("conversation").agg(F.count("*").alias("rows"), F.count_distinct("external_id").alias("kept"))
    both = total.join(per, "conversation", "left").na.fill(0, ["rows", "kept"])
    counts = both.agg(F.count_if(F.col("rows") > 0).alias("conversations"), F.count_if(F.col("rows") == 0).alias("empty_conversations"), F.coalesce(F.sum("kept"), F.lit(0)).alias("messages"), F.coalesce(F.sum(F.col("n") - F.col("rows")), F.lit(0)).alias("empty_messages"))
    files = messages.select("conversation", "external_id", F.explode("attachments").alias("a")).select("conversation", "external_id", F.sha2("a.text", 256).alias("sha")).distinct()
    return counts.crossJoin(files.agg(F.count("*").alias("attached")))  # one row each


def not_imported(accounts: DataFrame, settings: DataFrame) -> DataFrame:
    """accounts(uuid) without an import marker in settings."""
    return accounts.join(settings.where(F.col("key").startswith("import:")).select(F.substring("key", 8, 1000).alias("uuid")), "uuid", "left_anti")
