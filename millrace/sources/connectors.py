"""Connectors: rows that were fetched from a service become documents ``(external_id, title, kind, text, updated_at)``."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.ingest import kind_of, strip_html, title_of
from millrace.operators.jobs import enqueue
from millrace.operators.state import upsert

#: Re-read before a cursor: late edits of messages, and of issues.
SLACK_REWIND_HOURS, JIRA_REWIND_MINUTES = 26, 1
MAX_FILE_BYTES, MAX_UPLOAD_BYTES, MAX_COMMENTS = 400_000, 20 << 20, 60
# Folders and files of a repository that hold no text of its own, and messages that are none.
SKIP_FOLDERS = ("node_modules", "vendor", "dist", "build", "target", ".git", ".next", "__pycache__", ".venv", "site-packages")
SKIP_SUFFIXES = (".min.js", ".min.css", ".map", ".lock", "-lock.json", ".snap")
SKIP_SUBTYPES = ("channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "bot_add", "bot_remove", "pinned_item")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with their kind; ``problem`` says why one is refused. Spark's reader leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    problem = F.when(F.col("length") > MAX_UPLOAD_BYTES, "too large").when(kind_of(F.col("path")).isNull(), "unknown kind")
    return files.select(F.col("path").alias("external_id"), F.substring_index("path", "/", -1).alias("title"), kind_of(F.col("path")).alias("kind"), F.col("content").alias("data"), F.col("modificationTime").alias("updated_at"), problem.alias("problem"))


def docx_markdown(data: bytes) -> str:
    """Paragraphs of a word-processor file in order, heading styles as ATX lines; then its tables, cells apart by ``|``."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{space}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{space}t"))
    lines = []
    for p in body.findall(f"{space}p"):
        style = p.find(f"{space}pPr/{space}pStyle")
        level = re.fullmatch(r"Heading ?([1-6])", style.get(f"{space}val", "") if style is not None else "")
        if text := said(p).strip():
            lines.append("#" * int(level[1]) + " " + text if level else text)
    for table in body.findall(f"{space}tbl"):
        lines += [" | ".join(said(c).strip() for c in row.findall(f"{space}tc")) for row in table.findall(f"{space}tr")]
    return "\n\n".join(lines)


def _office(data: pd.Series) -> pd.Series:
    def one(x):
        try:
            return None if x is None else docx_markdown(bytes(x))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
            return None

    return data.map(one)


def office_text(data: Column) -> Column:
    """Text of a word-processor file; null if it cannot be read."""
    return F.pandas_udf(_office, "string")(data)


def web_pages(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` as documents titled by the page or its URL."""
    return pages.select(F.col("url").alias("external_id"), title_of(F.col("html"), F.col("url")).alias("title"), F.lit("html").alias("kind"), strip_html(F.col("html")).alias("text"))


def indexable(path: Column, size: Column) -> Column:
    """Whether a repository's file is worth indexing."""
    ok = (size <= MAX_FILE_BYTES) & kind_of(path).isNotNull() & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_FOLDERS)))
    for suffix in SKIP_SUFFIXES:
        ok = ok & ~F.endswith(path, F.lit(suffix))
    return F.coalesce(ok, F.lit(False))


def repository_files(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """``files(path, size, content)``: text files without NUL in their first 8000 bytes; only the ``changed(path)`` ones if that is known."""
    kept = files.where(indexable(F.col("path"), F.col("size"))).where(~F.contains(F.substring("content", 1, 8000).cast("binary"), F.lit(b"\0")))
    kept = kept if changed is None else kept.join(changed.select("path").distinct(), "path", "left_semi")
    return kept.select(F.col("path").alias("external_id"), F.col("path").alias("title"), kind_of(F.col("path")).alias("kind"), F.col("content").cast("string").alias("text"))


#: Changed files beyond which a comparison of two commits may be cut short.
MAX_CHANGED = 300


def changed_paths(compared: DataFrame | None) -> DataFrame | None:
    """``compared(path)`` of two commits, if it can be trusted: null without a comparison or with MAX_CHANGED files, when every file is read again."""
    return None if compared is None or compared.limit(MAX_CHANGED).count() >= MAX_CHANGED else compared.select("path").distinct()


# Media types of a drive that are exported as text, or read whole, and their kinds of document.
EXPORTED = {"application/vnd.google-apps.document": "txt", "application/vnd.google-apps.spreadsheet": "txt", "application/vnd.google-apps.presentation": "txt"}
DOWNLOADED = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/plain": "txt", "text/markdown": "md", "text/csv": "txt", "text/html": "html", "application/json": "txt"}
MAX_EXPORT_BYTES, MAX_DOWNLOAD_BYTES = 10 << 20, 25 << 20
FOLDER = "application/vnd.google-apps.folder"


def drive_files(files: DataFrame, modified_after: Column | None = None, folder: str | None = None) -> DataFrame:
    """``files(id, name, mime_type, size, modified_at, trashed, parents, owner, link, data binary)`` as documents.

    Files changed after the cursor (in one folder, if it is named); types
    without text are left out, and ``problem`` says why others are not read.
    Text kinds have ``text``, the others keep ``data``.
    """
    of = lambda table: F.coalesce(*(F.when(F.col("mime_type") == k, v) for k, v in table.items()))
    rows = files.where(~F.coalesce("trashed", F.lit(False)) & (F.coalesce("mime_type", F.lit("")) != FOLDER))
    rows = rows if modified_after is None else rows.where(F.col("modified_at") > modified_after)
    rows = rows if folder is None else rows.where(F.array_contains("parents", folder))
    native = of(EXPORTED)
    rows = rows.withColumn("kind", F.coalesce(native, of(DOWNLOADED), kind_of(F.col("name")))).where("kind is not null")
    problem = F.when(native.isNotNull() & (F.octet_length("data") > MAX_EXPORT_BYTES), "too large to export").when(native.isNull() & (F.col("size") > MAX_DOWNLOAD_BYTES), "too large to download")
    plain = F.col("kind").isin("txt", "md", "html", "code")
    return rows.select(
        F.col("id").alias("external_id"), F.coalesce("name", "id").alias("title"), "kind", F.when(problem.isNull() & plain, F.try_validate_utf8("data")).alias("text"), F.when(problem.isNull() & ~plain, F.col("data")).alias("data"),
        F.col("modified_at").alias("updated_at"), F.create_map(F.lit("mime_type"), F.col("mime_type"), F.lit("owner"), F.col("owner"), F.lit("uri"), F.col("link")).alias("metadata"), problem.alias("problem"),
    )


def next_cursor(rows: DataFrame, before: Column | None = None, column: str = "updated_at") -> Column | None:
    """The newest time among the rows and the cursor before, as the next cursor; null if there is neither."""
    newest = rows.agg(F.max(column)).first()[0]
    found = [F.lit(newest)] if newest is not None else []
    found += [before] if before is not None else []
    return F.greatest(*found) if len(found) > 1 else found[0] if found else None


def next_cursors(rows: DataFrame, stored: DataFrame, by: str = "source_id", column: str = "updated_at") -> DataFrame:
    """``stored(by, cursor)`` moved on to the newest time among each source's rows; a cursor never goes back, and sources of either table have one."""
    newest = rows.groupBy(by).agg(F.max(column).alias("_newest"))
    return stored.select(by, "cursor").join(newest, by, "full_outer").select(by, F.greatest("cursor", "_newest").alias("cursor"))


def enqueue_documents(documents: DataFrame, jobs: DataFrame, fetched: DataFrame, source: DataFrame, now: Column, first_job: int, priority: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fetched rows ``(document_id, source_id, external_id, title, kind, text, data)`` -> documents, jobs and blobs.

    A document takes the default access rules of its ``source(source_id,
    tenant_id, default_acl_public, default_acl_groups)``; a known one changes
    title and kind only. A job carries the text, a blob ``(document_id, data)``
    the bytes; a document with a live job gets no second one.
    """
    owned = fetched.join(source, "source_id")
    new = owned.select("document_id", "tenant_id", "source_id", "external_id", "title", "kind", F.col("default_acl_public").alias("acl_public"), F.col("default_acl_groups").alias("acl_groups"))
    after = upsert(documents, new, ["document_id"], ["title", "kind"])
    none = lambda c: F.lit(None).cast(jobs.schema[c].dataType)
    own = {
        "id": F.lit(first_job) + F.col("document_id"), "kind": F.lit("ingest_document"), "status": F.lit("queued"), "priority": F.lit(priority), "attempts": F.lit(0), "max_attempts": F.lit(5), "run_after": now, "created_at": now,
        "dedupe_key": F.concat(F.lit("ingest:"), F.col("document_id").cast("string")), "payload": F.to_json(F.struct("document_id", "tenant_id", F.col("external_id").alias("path"), "text")),
    }
    asked = owned.select(*((own[c].cast(jobs.schema[c].dataType) if c in own else none(c)).alias(c) for c in jobs.columns))
    return after, enqueue(jobs, asked), owned.where("data is not null").select("document_id", "data")


def clean_message(text: Column, users: dict[str, str] | None = None) -> Column:
    """Chat markup as plain text on one line; mentions take the names of ``users`` by id, however many there are."""
    said = F.coalesce(text, F.lit(""))
    mention, names = r"<@([^|>]+)(?:\|[^>]*)?>", F.from_json(F.lit(json.dumps(users or {})), "map<string,string>")
    ids, raw = F.regexp_extract_all(said, F.lit(mention), F.lit(1)), F.regexp_extract_all(said, F.lit(f"({mention})"), F.lit(1))
    shown = F.zip_with(ids, raw, lambda i, m: F.coalesce(F.concat(F.lit("@"), F.try_element_at(names, i)), F.when(i.rlike("^[A-Z0-9]+$"), F.concat(F.lit("@"), i)), m))
    between = F.split(said, mention, -1)
    out = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get(shown, i), F.lit("")))), "")
    out = F.regexp_replace(out, r"<#[A-Z0-9]+\|([^>]+)>", "#$1")
    out = F.regexp_replace(out, r"<#([A-Z0-9]+)\|?>", "#$1")
    out = F.regexp_replace(out, r"<(?:https?:|mailto:)[^|>]+\|([^>]+)>", "$1")
    out = F.regexp_replace(out, r"<((?:https?:|mailto:)[^|>]+)>", "$1")
    for reference, put in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(reference), F.lit(put))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def subject(text: Column, limit: int = 70) -> Column:
    """A thread's title from its first message."""
    return F.when(text == "", "thread").when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def worth_indexing(subtype: Column, text: Column) -> Column:
    return ~F.coalesce(subtype.isin(*SKIP_SUBTYPES), F.lit(False)) & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= 3)


def channel_documents(messages: DataFrame, users: dict[str, str] | None = None) -> DataFrame:
    """``messages(channel, ts timestamp, thread_ts timestamp, user, text, subtype)`` -> a document for each thread and channel-day.

    A thread has two messages at least and is keyed by its first; a thread of
    one counts as an ordinary message; replies without their parent wait for it.
    """
    kept = messages.where(worth_indexing(F.col("subtype"), F.col("text"))).withColumn("root", F.coalesce("thread_ts", "ts"))
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), F.coalesce("user", F.lit("unknown")), F.lit(": "), clean_message(F.col("text"), users))
    lines = kept.withColumn("entry", F.struct("ts", line.alias("line"), clean_message(F.col("text"), users).alias("clean")))
    sizes = lines.groupBy("channel", "root").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    lines = lines.join(sizes, ["channel", "root"])
    whole = F.col("first") == F.col("root")
    threads = lines.where((F.col("n") > 1) & whole).groupBy("channel", F.col("root").cast("string").alias("key")).agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.max("ts").alias("updated_at"))
    days = lines.where((F.col("n") == 1) & whole).groupBy("channel", F.date_format("ts", "yyyy-MM-dd").alias("key")).agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.max("ts").alias("updated_at"))

    def documents(rows: DataFrame, name: Column, prefix: str) -> DataFrame:
        title = F.concat(F.lit("#"), F.col("channel"), F.lit(" · "), name)
        return rows.select(F.concat_ws("/", "channel", F.lit(prefix), "key").alias("external_id"), title.alias("title"), F.lit("conversation").alias("kind"), F.concat_ws("\n", F.concat(F.lit("# "), title), F.col("entries.line")).alias("text"), "updated_at")

    return documents(threads, subject(F.get("entries", F.lit(0))["clean"]), "thread").unionByName(documents(days, F.col("key"), "day"))


def conversation_threads(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> a thread for each conversation of two turns at least."""
    lines = turns.where(worth_indexing(F.lit(None).cast("string"), F.col("text"))).select("conv_id", F.struct("turn", F.concat(F.col("role"), F.lit(": "), clean_message(F.col("text"))).alias("line"), clean_message(F.col("text")).alias("clean")).alias("entry"))
    threads = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list("entry")).alias("entries")).where("size(entries) >= 2")
    title = F.concat(F.lit("# "), subject(F.get("entries", F.lit(0))["clean"]))
    return threads.select("conv_id", F.size("entries").alias("message_count"), F.concat_ws("\n", title, F.col("entries.line")).alias("text"))


# Signs around rich text by its marks, from the inside out.
_SIGNS = (("code", "`"), ("bold", "**"), ("italic", "*"), ("strikethrough", "~~"))


def _rich(parts: list[dict] | None) -> str:
    """Pieces of rich text as Markdown; blank ones take neither signs nor links."""
    out = []
    for p in parts or []:
        text, before, after = p.get("plain_text") or "", "", ""
        if text.strip():
            marks = p.get("annotations") or {}
            signs = [sign for mark, sign in _SIGNS if marks.get(mark)]
            before, after = "".join(reversed(signs)), "".join(signs)
            if p.get("href"):
                before, after = "[" + before, f"{after}]({p['href']})"
        out += before, text, after
    return "".join(out)


# A block's line by its kind, and the field without which it says nothing. Kinds that are not named are plain text.
_LINES = {
    "heading_1": ("# {said}", "said"), "heading_2": ("## {said}", "said"), "heading_3": ("### {said}", "said"), "bulleted_list_item": ("- {said}", "said"), "numbered_list_item": ("1. {said}", "said"),
    "quote": ("> {icon}{said}", "said"), "callout": ("> {icon}{said}", "said"), "toggle": ("- {said}", "said"), "code": ("```{language}\n{text}\n```", "text"), "to_do": ("- [{tick}] {text}", "text"),
    "image": ("[{label}]({url})", "url"), "file": ("[{label}]({url})", "url"), "video": ("[{label}]({url})", "url"), "pdf": ("[{label}]({url})", "url"), "embed": ("[{label}]({url})", "url"), "bookmark": ("[{label}]({url})", "url"),
    "equation": ("$$ {expression} $$", "expression"), "table_row": ("| {cells} |", "cells"), "divider": ("---", None), "child_page": ("- {title}", None),
}
_PLAIN = ("{said}", "said")


def _said(kind: str, own: dict) -> str:
    text = _rich(own.get("rich_text"))
    return text if text.strip() else ""


def _icon(kind: str, own: dict) -> str:
    sign = ((own.get("icon") or {}).get("emoji") or "").strip()
    return f"{sign} " if sign else ""


#: Fields of the lines, from a block's kind and content.
_FIELDS: dict[str, Callable[[str, dict], str]] = {
    "said": _said,
    "icon": _icon,
    "text": lambda kind, own: _rich(own.get("rich_text")),
    "language": lambda kind, own: own.get("language") or "",
    "tick": lambda kind, own: "x" if own.get("checked") else " ",
    "url": lambda kind, own: own.get("url") or (own.get("external") or {}).get("url") or "",
    "label": lambda kind, own: _rich(own.get("caption")) or kind,
    "expression": lambda kind, own: own.get("expression") or "",
    "cells": lambda kind, own: " | ".join(map(_rich, own.get("cells") or [])),
    "title": lambda kind, own: own.get("title") or "Untitled",
}


def _block_line(kind: str, own: dict) -> str:
    """One block without its children; empty if it says nothing."""
    line, needed = _LINES.get(kind, _PLAIN)
    values = {name: _FIELDS[name](kind, own) for name in {needed} - {None} | set(re.findall(r"{(\w+)}", line))}
    return line.format_map(values) if needed is None or values[needed] else ""


def blocks_markdown(blocks: list[dict], depth: int = 0, most_depth: int = 4) -> str:
    """A tree of page blocks as Markdown; children of list items are indented."""
    lines = []
    for b in blocks:
        kind = b.get("type") or ""
        lines.append(_block_line(kind, b.get(kind) or {}))
        if b.get("children") and depth < most_depth:
            inner = blocks_markdown(b["children"], depth + 1, most_depth)
            lines.append("\n".join("  " + x for x in inner.split("\n")) if kind.endswith("list_item") else inner)
    return "\n".join(filter(None, lines))


# What stands before and after the content of a node of an issue tracker's document, and nodes without content.
_AROUND = {"paragraph": ("\n", "\n"), "heading": ("\n", "\n"), "listItem": ("- ", "\n"), "codeBlock": ("\n```\n", "\n```\n"), "blockquote": ("\n> ", "\n")}
_ALONE = {"hardBreak": "\n", "rule": "\n---\n"}


def _events(root: dict) -> Iterator[tuple[bool, dict]]:
    """Each node of a tree when it begins (true) and when it has ended, in reading order."""
    todo: list[tuple[bool, dict]] = [(True, root)]
    while todo:
        begins, node = todo.pop()
        yield begins, node
        if begins:
            todo.append((False, node))
            todo += [(True, c) for c in reversed(node.get("content") or []) if isinstance(c, dict)]


def adf_text(root: dict) -> str:
    """A document tree of an issue tracker as Markdown."""
    written: list[str] = []
    opened: list[int] = []
    for begins, node in _events(root):
        kind = node.get("type")
        if begins:
            opened.append(len(written))
            continue
        first = opened.pop()
        inner = "".join(written[first:])
        before, after = _AROUND.get(kind, ("", ""))
        if kind == "text" or kind in _ALONE:
            inner = _ALONE.get(kind) or node.get("text") or ""
        elif kind in ("listItem", "blockquote"):
            inner = inner.strip()
        elif kind == "heading":
            before += "#" * int((node.get("attrs") or {}).get("level") or 0)
            before += " " if before.endswith("#") else ""
        written[first:] = [before + inner + after]
    return "".join(written)


def _pages(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: None if x is None else blocks_markdown(json.loads(x)))


def _issues(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: "" if x is None else adf_text(json.loads(x)).strip() if x.lstrip().startswith("{") else x.strip())


def page_markdown(payload: Column) -> Column:
    """JSON arrays of page blocks as Markdown; nulls stay null."""
    return F.pandas_udf(_pages, "string")(payload)


def issue_text(payload: Column) -> Column:
    """A description or comment, plain or as a JSON tree, as text."""
    return F.pandas_udf(_issues, "string")(payload)


def issue_documents(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """``issues(key, summary, status, issue_type, assignee, reporter, labels, description)`` and ``comments(key, author, created, body)`` -> documents; the first MAX_COMMENTS comments in order."""
    entry = F.concat(F.lit("\n**"), F.coalesce("author", F.lit("unknown")), F.lit("** · "), F.date_format("created", "yyyy-MM-dd HH:mm"), F.lit("\n"), issue_text(F.col("body")))
    said = comments.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("created", entry.alias("entry")))), 1, MAX_COMMENTS).alias("said"))
    title = F.concat(F.col("key"), F.lit(" · "), F.coalesce("summary", F.lit("Untitled")))
    people = [F.concat(F.lit(f"{said_as} "), F.coalesce(c, F.lit(none))) for c, said_as, none in (("assignee", "assigned to", "unassigned"), ("reporter", "reported by", "unknown"))]
    about = F.concat_ws(" · ", F.coalesce("issue_type", F.lit("issue")), F.coalesce("status", F.lit("unknown")), *people, F.concat(F.lit("labels: "), F.when(F.size("labels") > 0, F.array_join("labels", ", ")).otherwise("none")))
    body = F.coalesce(F.nullif(issue_text(F.col("description")), F.lit("")), F.lit("_No description._"))
    text = F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), about, F.lit(""), F.lit("## Description"), body, F.when(F.size("said") > 0, F.concat(F.lit("\n## Comments\n"), F.array_join("said.entry", "\n"))))
    return issues.join(said, "key", "left").select(F.col("key").alias("external_id"), title.alias("title"), F.lit("md").alias("kind"), text.alias("text"))


def since(rows: DataFrame, cursor: Column | None, rewind: str, column: str = "updated_at") -> DataFrame:
    """Rows changed at or after the cursor less the rewind, from the start of that UTC day; all without a cursor."""
    return rows if cursor is None else rows.where(F.col(column) >= F.date_trunc("day", cursor - F.expr(f"interval {rewind}")))
