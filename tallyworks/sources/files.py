"""Files as sources: a corpus tree, pages, manifests, metrics in text form, prompts."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.functions.text import tidy_name, doc_type, folder_year
from tallyworks.sources.shared import shared_folder
from tallyworks.sources.tables import table

#: Deepest folder level first; what a file at that depth belongs to.
SCOPES = {1: "REFERENCE", 2: "SUB_DISTRICT"}


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """The files below root with their scope, area, year, project, kind, key and anomalies; hidden ones and notes (.md) are left out.

    Only the first bytes decide whether a file is a PDF; its content is not kept.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub("^file:/*", "/", root).rstrip("/")
    relative = F.regexp_extract("path", rf"\Q{base}\E/(.*)$", 1)
    own = files.select(relative.alias("source_path"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"), F.col("length"))
    return catalogued(own)


def catalogued(files: DataFrame) -> DataFrame:
    """What the paths of files (source_path, is_pdf) tell about them."""
    parts = F.split("source_path", "/")
    name = F.element_at(parts, -1)
    depth = F.size(parts)
    kept = files.filter(~name.startswith(".") & ~F.lower(name).endswith(".md"))
    kind = doc_type(name)
    clean = tidy_name(name)
    final = F.when(kind.isNotNull(), F.concat(kind, F.lit(".pdf"))).when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))
    anomalies = F.array_compact(F.array(F.when(clean != name, "filename-normalized"), F.when(kind.isNull() & ~F.lower(clean).endswith(".pdf"), "extension-added"), F.when(~F.col("is_pdf"), "not-a-pdf")))
    part = lambda place: F.when(depth > place, tidy_name(F.get(parts, F.lit(place - 1))))
    scope = F.when(depth <= 2, SCOPES[1]).when(depth == 3, SCOPES[2]).otherwise("PROJECT")
    found = kept.select("source_path", "is_pdf", scope.alias("scope"), part(2).alias("sub_district"), F.when(depth > 3, folder_year(F.get(parts, F.lit(2)))).alias("fiscal_year"), part(4).alias("project_name"), kind.alias("doc_type"), anomalies.alias("anomalies"), final.alias("_name"))
    return found.withColumn("normalized_key", F.concat_ws("/", F.lower("scope"), "sub_district", "fiscal_year", "project_name", "_name")).drop("_name")


def refused(files: DataFrame) -> DataFrame:
    """Files that an upload must not take: no PDF, or a project without a year."""
    return files.filter(~F.col("is_pdf") | ((F.col("scope") == "PROJECT") & F.col("fiscal_year").isNull()))


def page_texts(spark: SparkSession, root: str) -> DataFrame:
    """document, page and text of pages kept as <document>/page_<n>.md; a page that is empty counts as not read."""
    read = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    page = F.regexp_extract("path", r"page_([0-9]+)\.md$", 1).try_cast("int")
    return read.select(F.element_at(F.split("path", "/"), -2).alias("document"), page.alias("page"), "text").filter("page is not null and trim(text) <> ''")


def without_comments(text):
    """Markdown without comments, which may go over several lines."""
    return F.regexp_replace(text, "(?s)<!--.*?-->", "")


ENTRY = "sub_district string, fiscal_year int, name string, files array<string>"
KEYS = ("sub_district", "fiscal_year", "name")


def checked_entries(rows: DataFrame) -> DataFrame:
    """The entries of a manifest (sub_district, fiscal_year, name, files); wrong years or repeated projects are errors."""
    wrong = rows.filter(~F.coalesce(F.col("fiscal_year").between(2500, 2600), F.lit(False))).limit(1).collect()
    twice = rows.groupBy(*KEYS).count().filter("count > 1").limit(1).collect()
    if wrong or twice:
        raise ValueError(f"manifest: {wrong or twice}")
    return rows


def manifest_entries(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The entries of a parsed manifest, checked."""
    return checked_entries(spark.createDataFrame(entries, ENTRY))


def entry_lines(entry: dict) -> list[str]:
    """An entry of a manifest in YAML; strings are quoted as in JSON, which YAML reads as well."""
    quoted = lambda s: json.dumps(s, ensure_ascii=False)
    return [f"- sub_district: {quoted(entry['sub_district'])}", f"  fiscal_year: {json.dumps(entry['fiscal_year'])}", f"  name: {quoted(entry['name'])}", "  files:", *[f"  - {quoted(f)}" for f in entry["files"] or []]]


FIELD = re.compile(r"(?P<item>- |  )(?P<key>[a-z_]+):(?: (?P<value>.*))?|  - (?P<file>.*)")


def parsed_manifest(text: str) -> list[dict]:
    """The entries of a manifest in YAML: a list under projects, of two levels; values are plain, or quoted once or twice."""

    def value(own: str | None):
        own = (own or "").strip()
        if own[:1] == '"':
            return json.loads(own)
        if own[:1] == "'" and own[-1:] == "'" and len(own) > 1:
            return own[1:-1].replace("''", "'")
        return None if own in ("", "null", "~") else own

    out: list[dict] = []
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#") or line.rstrip() == "projects:":
            continue
        found = FIELD.fullmatch(line.rstrip("\r"))
        if not found or (not out and found["item"] != "- "):
            raise ValueError(f"manifest: line {number}: {line!r}")
        if found["item"] == "- ":
            out.append({"files": []})
        if found["key"] is None:
            out[-1]["files"].append(value(found["file"]))
        elif found["key"] == "fiscal_year":
            out[-1]["fiscal_year"] = None if value(found["value"]) is None else int(value(found["value"]))
        elif found["key"] in KEYS:
            out[-1][found["key"]] = value(found["value"])
        elif found["key"] != "files":
            raise ValueError(f"manifest: line {number}: {line!r}")
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the manifest at path, a file or a folder of them; each file is read and parsed by a task. Wrong lines, years and repeated projects are errors."""
    entry = pa.list_(pa.struct([("sub_district", pa.string()), ("fiscal_year", pa.int32()), ("name", pa.string()), ("files", pa.list_(pa.string()))]))

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([parsed_manifest(t or "") for t in batch.to_pylist()], entry)

    texts = spark.read.text(path, wholetext=True)
    return checked_entries(texts.select(F.inline(F.arrow_udf(parse, f"array<struct<{ENTRY}>>")("value"))))


def write_manifest(files: DataFrame, path: str) -> None:
    """A manifest of catalogued project files as a folder of files: areas, their projects, their files, all in order over the files.

    Each task writes the entries of its range of keys as a manifest of its own.
    """
    grouped = files.filter("scope = 'PROJECT'").groupBy("sub_district", "fiscal_year", F.col("project_name").alias("name")).agg(F.array_sort(F.collect_list("source_path")).alias("files"))

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            lines = [x for entry in batch.to_pylist() for x in entry_lines(entry)]
            yield pa.RecordBatch.from_pydict({"value": pa.array(["\n".join(lines if begun else ["projects:", *lines])] if lines else [], pa.string())})
            begun = begun or bool(lines)

    ordered = grouped.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).select(*KEYS, "files")
    ordered.mapInArrow(text, "value string").write.text(path)


def histogram_totals(lines: DataFrame, metric: str) -> DataFrame:
    """sum and count of a histogram over all its label sets, from lines of metrics in text form; NULL without the metric."""
    value = F.regexp_extract("value", r"\s([0-9.eE+-]+)\s*$", 1).try_cast("double")
    of = lambda suffix: F.sum(F.when(F.col("value").rlike(rf"^{metric}_{suffix}(\{{| )"), value))
    return lines.agg(of("sum").alias("sum"), of("count").alias("count"))


def histogram_delta(snapshots: DataFrame) -> DataFrame:
    """Milliseconds per event between one snapshot (at, sum, count) of a source and the next; NULL where nothing happened."""
    order = Window.partitionBy("source").orderBy("at")
    change = lambda c: F.col(c) - F.lag(c).over(order)
    return snapshots.select("source", "at", (F.try_divide(change("sum"), change("count")) * 1000).alias("mean_ms"))


def prompt(folder: str, version: str, allowed: set[str]) -> str:
    """The prompt of a version; placeholders other than the allowed ones are an error."""
    import string

    text = Path(folder, f"{version}.txt").read_text(encoding="utf-8")
    unknown = {name for _, name, _, _ in string.Formatter().parse(text) if name} - allowed
    if unknown:
        raise ValueError(f"unknown placeholders: {sorted(unknown)}")
    return text


def manifest_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of projects (a source in a year), written as a manifest and read again."""
    docs = table(spark, folder, "documents").filter("doc_id is not null")
    files = docs.select(F.lit("PROJECT").alias("scope"), F.coalesce("source", F.lit("?'\"")).alias("sub_district"), (2500 + F.col("doc_id") % 90).cast("int").alias("fiscal_year"), F.concat(F.lit('โครงการ "'), F.coalesce("lang", F.lit("")), F.lit('"')).alias("project_name"), F.format_string("%d.pdf", "doc_id").alias("source_path"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_manifest(files, path)
    return read_manifest(spark, path).select("sub_district", "fiscal_year", "name", F.explode("files").alias("file"))


QUERIES = {"manifest_round_trip": manifest_round_trip}
ORACLE = {
    "manifest_round_trip": """SELECT coalesce(source, '?''"') AS sub_district, CAST(2500 + doc_id % 90 AS INTEGER) AS fiscal_year, 'โครงการ "' || coalesce(lang, '') || '"' AS name, doc_id || '.pdf' AS file FROM documents WHERE doc_id IS NOT NULL""",
}
