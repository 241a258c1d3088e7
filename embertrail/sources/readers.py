"""Sources: every reader returns source_file, raw: one JSON object an event, as text.

Readers are lazy and split as Spark splits their files: XML and EVTXtract are cut at the closing tag of an event by the
text reader, so one large file is many tasks. Lines that are no event are dropped.
"""

from __future__ import annotations

import bz2
import csv as csv_rows
import gzip
import io
import json
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evtx as binary_log

RAW = "source_file string, raw string"


def _file() -> Column:
    return F.col("_metadata.file_path").alias("source_file")


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def is_archive(path: str | list[str]) -> bool:
    """Whether the files are archives, which Spark's own readers do not open (.gz and .bz2 they do)."""
    return all(p.lower().endswith((".zip", ".7z")) for p in _paths(path))


def _files(spark: SparkSession, path: str | list[str], glob: str | None = None, password: str | None = None) -> DataFrame:
    """path, content of whole files; what is packed is unpacked."""
    key = password.encode() if password else None
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield pd.DataFrame({"path": [name], "content": [unpacked(name, bytes(content), key)]})

    return r.load(_paths(path)).select("path", "content").mapInPandas(run, "path string, content binary")


def _text(spark: SparkSession, path: str | list[str], line_sep: str | None = None, encoding: str = "UTF-8", glob: str | None = None, password: str | None = None) -> DataFrame:
    """source_file, value: the lines of text files, or of the one file in each archive."""
    if is_archive(path):
        sep = line_sep or "\n"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for name, content in zip(b["path"], b["content"]):
                    lines = bytes(content).decode(encoding, "replace").split(sep)
                    for i in range(0, len(lines), 10_000):
                        some = [x.rstrip("\r") if sep == "\n" else x for x in lines[i : i + 10_000]]
                        yield pd.DataFrame({"source_file": [name] * len(some), "value": some})

        return _files(spark, path, glob, password).mapInPandas(run, "source_file string, value string")
    r = spark.read.option("recursiveFileLookup", "true").option("encoding", encoding)
    if line_sep:
        r = r.option("lineSep", line_sep)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path).select(_file(), F.col("value"))


def _python(df: DataFrame, fn: Callable[[str], dict | None]) -> DataFrame:
    """source_file, value to source_file, raw by a function of one text; None is dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [fn(v) for v in b["value"]]
            keep = [i for i, g in enumerate(got) if g]
            yield pd.DataFrame({"source_file": b["source_file"].iloc[keep].tolist(), "raw": [json.dumps(got[i], ensure_ascii=False) for i in keep]}, dtype=object)

    return df.mapInPandas(run, RAW)


def jsonl(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", glob: str | None = None, password: str | None = None, **_: object) -> DataFrame:
    """One object a line; blank and malformed lines are skipped."""
    df = _text(spark, path, encoding=encoding, glob=glob, password=password)
    return df.where(F.trim("value") != "").where(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")).select("source_file", F.col("value").alias("raw"))


def json_array(spark: SparkSession, path: str | list[str], glob: str | None = None, password: str | None = None, **_: object) -> DataFrame:
    """Arrays of objects; members that are no object are skipped."""
    if is_archive(path):
        df = _files(spark, path, glob, password).select(F.col("path").alias("source_file"), F.try_parse_json(F.decode("content", "UTF-8")).alias("v"))
    else:
        r = spark.read.option("recursiveFileLookup", "true").option("multiLine", "true").option("singleVariantColumn", "v")
        if glob:
            r = r.option("pathGlobFilter", glob)
        df = r.json(path).select(_file(), "v")
    members = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = df.select("source_file", F.explode(members).alias("m")).select("source_file", F.to_json("m").alias("raw"))
    return rows.where(F.col("raw").startswith("{"))


def csv(spark: SparkSession, path: str | list[str], glob: str | None = None, password: str | None = None, encoding: str = "UTF-8", **_: object) -> DataFrame:
    """A header line and commas; all values are text."""
    if is_archive(path):

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for name, content in zip(b["path"], b["content"]):
                    rows = [json.dumps({k: v for k, v in r.items() if k is not None and v}, ensure_ascii=False) for r in csv_rows.DictReader(io.StringIO(bytes(content).decode(encoding, "replace"), newline=""))]
                    yield pd.DataFrame({"source_file": [name] * len(rows), "raw": rows}, dtype=object)

        return _files(spark, path, glob, password).mapInPandas(run, RAW)
    r = spark.read.option("recursiveFileLookup", "true").option("header", "true").option("multiLine", "true").option("escape", '"').option("inferSchema", "false").option("encoding", encoding)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.csv(path)
    return df.select(_file(), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw"))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _value(text: str | None) -> object:
    return "" if not text else int(text) if re.fullmatch(r"\s*[+-]?\d+\s*", text) else text


def event_dict(e: ElementTree.Element) -> dict:
    """An Event element as the dictionary of the event: section, then child.

    Data elements go by their Name (None without one), Qualifiers keep their text, and the attributes of any other
    element take the place of its text.
    """
    out: dict = {"#attributes": {"xmlns": e.tag[1:].rsplit("}", 1)[0] if e.tag.startswith("{") else ""}}
    for section in e:
        own: dict = {}
        for child in section:
            name = _tag(child)
            if name == "Data":
                own[str(child.get("Name"))] = _value(child.text)
            elif name == "Qualifiers":
                own[name] = child.text
            else:
                own[name] = {"#attributes": dict(child.attrib)} if child.attrib else _value(child.text)
        out[_tag(section)] = own
    return {"Event": out}


def xml_event(text: str | None) -> dict | None:
    """The dictionary of a text that holds <Event ...> up to, but for, its closing tag; None if it is no event.

    Damaged events before a whole one are passed over.
    """
    body = re.sub(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010FFFF]", "", text or "")
    end = body.rfind("</Event>")
    body = body[: end + 8] if end >= 0 else body + "</Event>"
    for at in re.finditer(r"<Event[\s>]", body):
        try:
            return event_dict(ElementTree.fromstring(body[at.start() :]))
        except ElementTree.ParseError:
            continue
    return None


def xml(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", glob: str | None = None, password: str | None = None, **_: object) -> DataFrame:
    return _python(_text(spark, path, "</Event>", encoding, glob, password), xml_event)


def evtxtract(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", glob: str | None = None, password: str | None = None, **_: object) -> DataFrame:
    """XML recovered from raw bytes: NUL and vertical tabs are dropped, blocks that do not parse are skipped."""
    df = _text(spark, path, "</Event>", encoding, glob, password)
    return _python(df.withColumn("value", F.translate("value", "\x00\x0b", "")), xml_event)


def sysmon_linux(spark: SparkSession, path: str | list[str], encoding: str = "ISO-8859-1", glob: str | None = None, password: str | None = None, **_: object) -> DataFrame:
    df = _text(spark, path, encoding=encoding, glob=glob, password=password)
    return _python(df.where(F.col("value").contains("<Event>")), xml_event)


def auditd_fields(line: Column) -> Column:
    """k=v pairs of an audit line as a map; the last of equal keys wins; host is offline unless given."""
    tokens = F.split(F.translate(line, "\x1d", " "), " ")

    def pair(x: Column) -> Column:
        bare = F.translate(F.regexp_replace(x, "msg=", ""), "\"'", "")
        seconds = F.regexp_extract(x, r"msg=audit\((\d+(?:\.\d+)?):", 1).try_cast("double")
        time = F.coalesce(F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
        stamp = F.struct(F.lit("timestamp").alias("key"), time.alias("value"))
        return F.when(x.contains("msg=audit"), stamp).otherwise(F.struct(F.split_part(bare, F.lit("="), F.lit(1)).alias("key"), F.substring(bare, F.locate("=", bare) + 1, F.length(bare)).alias("value")))

    pairs = F.filter(F.transform(F.filter(tokens, lambda x: x.contains("=")), pair), lambda p: p["key"] != "")
    pairs = F.concat(F.array(F.struct(F.lit("host").alias("key"), F.lit("offline").alias("value"))), pairs)
    # The last of equal keys wins.
    kept = F.transform(F.array(pairs), lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"])))[0]
    return F.map_from_entries(kept)


def auditd(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", glob: str | None = None, password: str | None = None, **_: object) -> DataFrame:
    """Every line that is not blank is an event, with whatever pairs it holds."""
    df = _text(spark, path, encoding=encoding, glob=glob, password=password)
    return df.where(F.trim("value") != "").select("source_file", F.to_json(auditd_fields(F.col("value"))).alias("raw"))


def saved(spark: SparkSession, path: str | list[str], **_: object) -> DataFrame:
    """A log table saved as Parquet; already flat."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def sqlite(spark: SparkSession, path: str | list[str], glob: str | None = None, password: str | None = None, **_: object) -> DataFrame:
    """The rows of the table logs of SQLite files; a file without that table is skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                con.row_factory = sqlite3.Row
                try:
                    rows = con.execute("SELECT * FROM logs")
                except sqlite3.DatabaseError:
                    continue
                while some := rows.fetchmany(5000):
                    yield pd.DataFrame({"source_file": [name] * len(some), "raw": [json.dumps({k: r[k] for k in r.keys() if r[k] is not None}) for r in some]})

    return _files(spark, path, glob, password).mapInPandas(run, RAW)


class UnsupportedFormat(ValueError):
    """A format that needs a library which is not here."""


def unpacked(name: str, content: bytes, password: bytes | None = None) -> bytes:
    """The one file in a .gz, .bz2 or .zip; other names are returned as they are. An archive must hold exactly one file."""
    low = name.lower()
    if low.endswith(".gz"):
        return gzip.decompress(content)
    if low.endswith(".bz2"):
        return bz2.decompress(content)
    if low.endswith(".7z"):
        raise UnsupportedFormat("7z archives need a library that is not installed")
    if not low.endswith(".zip"):
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        files = [i for i in z.infolist() if not i.is_dir()]
        if len(files) != 1:
            raise ValueError(f"{name} must hold exactly one file, it holds {len(files)}")
        try:
            return z.read(files[0], pwd=password)
        except RuntimeError as e:
            raise ValueError(f"{name}: wrong or missing password") from e


def evtx(spark: SparkSession, path: str | list[str], glob: str | None = None, password: str | None = None, **_: object) -> DataFrame:
    """Binary event logs; damaged records and chunks are skipped."""
    return binary_log.scan(_files(spark, path, glob, password))


#: Archives (.zip) are read by every reader; "zip" is JSON lines in them.
READERS: dict[str, Callable[..., DataFrame]] = {
    "evtx": evtx, "json": jsonl, "json_array": json_array, "csv": csv, "xml": xml, "evtxtract": evtxtract, "sysmon_linux": sysmon_linux,
    "auditd": auditd, "saved": saved, "db": sqlite, "zip": jsonl,
}


def read(spark: SparkSession, path: str | list[str], fmt: str, **options: object) -> DataFrame:
    if fmt not in READERS:
        raise UnsupportedFormat(f"no reader for {fmt}")
    return READERS[fmt](spark, path, **options)


def select_paths(paths: list[str], select: list[str] | None = None, avoid: list[str] | None = None) -> list[str]:
    """Paths that hold any of select and none of avoid, without regard to case; select comes first."""
    low = lambda words: [w.lower() for w in words or []]
    out = [p for p in paths if not select or any(w in p.lower() for w in low(select))]
    return [p for p in out if not any(w in p.lower() for w in low(avoid))]


def path_filter(path: Column, select: list[str] | None = None, avoid: list[str] | None = None) -> Column:
    """The same as a column over a file path."""
    low = F.lower(path)
    out = F.lit(True)
    if select:
        hit = F.lit(False)
        for w in select:
            hit = hit | low.contains(w.lower())
        out = out & hit
    for w in avoid or []:
        out = out & ~low.contains(w.lower())
    return out
