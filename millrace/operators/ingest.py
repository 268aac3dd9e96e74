"""Extraction, hashing and the decision what to reindex, as Column expressions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# File extensions by kind of document, and languages of code.
PROSE_EXTENSIONS = {"pdf": "pdf", "docx": "docx", "md": "md", "markdown": "md", "mdx": "md", "html": "html", "htm": "html", "txt": "txt", "text": "txt", "rst": "txt", "csv": "txt"}
CODE_LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "sql": "sql", "sh": "shell", "bash": "shell", "yml": "yaml", "yaml": "yaml", "toml": "toml", "json": "json",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.get(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table.items())), lambda x: x["k"] == key), F.lit(0))["v"]


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))


def kind_of(path: Column) -> Column:
    """Kind of document by file name; null for unknown ones."""
    ext = extension(path)
    return F.when(ext.isin(list(CODE_LANGUAGES)), F.lit("code")).otherwise(_lookup(ext, PROSE_EXTENSIONS))


def language_of(path: Column) -> Column:
    return _lookup(extension(path), CODE_LANGUAGES)


def tidy(text: Column) -> Column:
    """Line ends, no-break spaces, blank lines and trailing blanks made plain; stripped."""
    out = F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" "), F.lit(" "))
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?md)[ \t]+$", "")  # d: a line ends at \n alone
    return F.regexp_replace(out, r"(?d)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def _character(number: Column) -> Column:
    """The character of a code point below 0x110000 that is no surrogate."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def numeric_references(text: Column) -> Column:
    """Decimal character references decoded; one that names no character stays."""

    def decoded(part: Column, i: Column) -> Column:
        digits = F.regexp_extract(part, r"^([0-9]{1,9});", 1)
        number = F.when(digits != "", digits.cast("long"))
        valid = (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        rest = F.substring(part, F.length(digits) + 2, F.length(part))
        return F.when(i == 0, part).when(valid, F.concat(_character(number), rest)).otherwise(F.concat(F.lit("&#"), part))

    return F.array_join(F.transform(F.split(text, "&#"), decoded), "")


def strip_html(html: Column) -> Column:
    """Text of a page with headings as ATX lines and blocks apart by blank lines; references are decoded, ``&amp;`` last."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style.*?</style>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}[^>]*>", "\n\n" + "#" * level + " ")
    out = F.regexp_replace(out, r"(?i)</(p|div|section|article|li|tr|h[1-6])>", "\n\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for reference, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(reference), F.lit(put))
    return tidy(F.replace(numeric_references(out), F.lit("&amp;"), F.lit("&")))


def content_hash(pages: Column) -> Column:
    """SHA-256 of an array of page texts, each followed by a unit separator."""
    return F.sha2(F.array_join(F.transform(pages, lambda p: F.concat(F.coalesce(p, F.lit("")), F.lit("\x1f"))), ""), 256)


def text_hash(text: Column) -> Column:
    """SHA-256 of a text alone."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def needs_reindex(scope: Column) -> Column:
    return F.coalesce(scope != "none", F.lit(False))


def extracted(kind: Column, text: Column) -> Column:
    """A fetched text by kind: pages stripped of markup, code with plain line ends only, everything else tidied; null for no text."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.when(kind == "html", strip_html(text)).when(kind == "code", F.when(F.trim(F.translate(lines, "\n\t\f\x0b", "    ")) != "", lines)).otherwise(tidy(text))
    return F.nullif(out, F.lit(""))


def extraction_problem(kind: Column, text: Column) -> Column:
    """Why a fetched text cannot be read; null if it can."""
    return F.when(kind == "pdf", "no reader for this kind").when(text.isNull() & (kind == "html"), "The HTML contained no readable text.").when(text.isNull(), "The file is empty.")


def token_estimate(text: Column) -> Column:
    """About four characters a token, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def reindex_scope(now: DataFrame, stored: DataFrame) -> DataFrame:
    """``scope`` of each document of ``now``: full, embed or none.

    Both have ``document_id, content_hash, extractor_version, chunker_version,
    embedding_version``. A new or changed text, or another extractor or chunker,
    asks for everything; another embedding version for embeddings only.
    """
    versions = ("content_hash", "extractor_version", "chunker_version", "embedding_version")
    old = stored.select("document_id", *(F.col(c).alias(f"old_{c}") for c in versions))
    same = F.lit(True)
    for c in versions[:3]:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    scope = F.when(F.col("old_content_hash").isNull() | ~same, "full").when(~F.col("embedding_version").eqNullSafe(F.col("old_embedding_version")), "embed").otherwise("none")
    return now.join(old, "document_id", "left").withColumn("scope", scope).select("document_id", "scope")


#: Texts sent to a provider of embeddings at once, and tries for one that fails.
EMBED_BATCH, EMBED_TRIES = 100, 4


def _provided(texts: list[str], embed: Callable[[list[str]], list], tries: int, wait: float) -> list:
    """Embeddings of the texts; a batch that fails is halved, and a text that fails alone is tried again after longer and longer waits."""
    for turn in range(tries):
        try:
            return list(embed(texts))
        except Exception:
            if len(texts) > 1:
                half = len(texts) // 2
                return _provided(texts[:half], embed, tries, wait) + _provided(texts[half:], embed, tries, wait)
            if turn == tries - 1:
                raise
            time.sleep(wait * 2**turn)
    return []


def embedded(rows: DataFrame, embed: Callable[[list[str]], list], width: int, batch: int = EMBED_BATCH, tries: int = EMBED_TRIES, wait: float = 1.0) -> DataFrame:
    """``rows(document_id, ordinal, context_text)`` -> ``(document_id, ordinal, embedding)`` of length one, by a provider called in the tasks.

    An embedding of another width than ``width`` is an error; one of zeros stays.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["context_text"].fillna("").tolist()
            found = [v for at in range(0, len(texts), batch) for v in _provided(texts[at : at + batch], embed, tries, wait)]
            vectors = np.array(found, np.float64).reshape(len(texts), -1)
            if len(texts) and vectors.shape[1] != width:
                raise ValueError(f"embeddings of {vectors.shape[1]} numbers instead of {width}")
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.DataFrame({"document_id": frame["document_id"], "ordinal": frame["ordinal"], "embedding": list((vectors / np.where(norm > 0, norm, 1.0)).astype(np.float32))})

    return rows.select("document_id", "ordinal", "context_text").mapInPandas(run, "document_id long, ordinal int, embedding array<float>")


def group_list(text: Column) -> Column:
    """Groups named in a form field, as a JSON array or apart by commas, without blanks."""
    items = F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def normalised(vector: Column) -> Column:
    """The vector at length one (unchanged if it has none)."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def title_of(html: Column, url: Column) -> Column:
    """A page's title, or its URL."""
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(title != "", title).otherwise(url)
