"""Files as records: CSV, JSON, text, unknown; documents of many kinds; directories. Bad files are rows with an error, not failures."""

from __future__ import annotations

import configparser
import csv
import html.parser
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.binary import doc_document, jpeg_document, pdf_document, png_document

# Suffixes that are read, and the size over which a file is refused.
CODE = ("py", "js", "ts", "jsx", "tsx", "java", "cpp", "c", "h", "hpp", "cs", "rb", "go", "rs", "php", "swift", "kt", "scala", "r", "sql", "sh")
SUFFIXES = ("txt", "md", "markdown", "rst", "html", "htm", "pdf", "docx", "doc", "json", "jsonl", "csv", "xml", "png", "jpg", "jpeg", *CODE, "yaml", "yml", "toml", "ini", "log", "cfg")
MOST_BYTES = 50 * 1024 * 1024
RECORD = "raw_text string, text string, content string, memory_id string, session_id string, who_type string, who_id string, who_label string, what string, when_ts string, where_type string, where_value string, why string, how string"


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; quoted fields may hold commas and line ends."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def json_records(spark: SparkSession, path: str | list[str], schema: str = RECORD) -> DataFrame:
    """A list of records, a record, or an export, whose memories are the records. Fields that schema lacks are in extra, as text."""
    names = [c.split()[0] for c in schema.split(",")]
    known = F.array(*[F.lit(n) for n in names])
    text = F.trim("value")
    rows = F.when(F.rlike(text, F.lit(r"(?s)^\[")), F.from_json("value", "array<map<string,string>>")).otherwise(F.array(F.from_json("value", "map<string,string>")))
    top = spark.read.text(path, wholetext=True).select(F.explode(rows).alias("r"))
    inner = F.when(F.map_contains_key("r", F.lit("memories")), F.from_json(F.col("r")["memories"], "array<map<string,string>>")).otherwise(F.array("r"))
    one = top.where("r is not null").select(F.explode(inner).alias("m"))
    extra = F.map_filter("m", lambda k, v: ~F.array_contains(known, k))
    return one.select(*[F.col("m")[n].cast(t).alias(n) for n, t in (c.split() for c in schema.split(","))], F.when(F.size(extra) > 0, extra).alias("extra"))


def text_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw_text")


def kind_of(content: str) -> str:
    """json if it parses, csv if it has a line end and a comma or tab, else text."""
    try:
        json.loads(content)
        return "json"
    except ValueError:
        return "csv" if "\n" in content and ("," in content or "\t" in content) else "text"


def any_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of files of unknown kinds: each whole file tells its own, in the executors; the driver holds a kind for each file."""

    def sniff(batches):
        import pyarrow as pa

        for b in batches:
            kinds = [kind_of(x.decode("utf-8", "replace")) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(kinds, pa.string())], names=["path", "kind"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(sniff, "path string, kind string").collect()
    out = None
    for kind, read in (("json", json_records), ("csv", csv_records), ("text", text_records)):
        own = sorted(f.path for f in files if f.kind == kind)
        if own:
            got = read(spark, own)
            out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return text_records(spark, path) if out is None else out


def dispatch_columns(records: DataFrame) -> dict[str, Column]:
    """content (the first text field with any, else the record as JSON), event_type, actor, and whether a record is a memory already, or long enough for several."""
    have = set(records.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    texts = [F.nullif(col(c), F.lit("")) for c in ("raw_text", "text", "content")]
    content = F.coalesce(*texts, F.to_json(F.struct(*records.columns)))  # with extra, so all fields
    who = F.coalesce(col("who_type"), F.lit("user"))
    kind = F.when(who == "llm", "llm").when(who == "system", "system").otherwise("user")
    return {
        "content": content,
        "event_type": F.when(kind == "llm", "llm_message").when(kind == "system", "system").otherwise("user_message"),
        "actor": F.concat_ws(":", kind, F.coalesce(col("who_id"), F.lit("unknown"))),
        "is_memory": col("memory_id").isNotNull() & col("who_type").isNotNull(),
        "is_long": F.length(content) > 500,
    }


def dispatched(records: DataFrame) -> DataFrame:
    """What an import does with each record."""
    return records.select(*[c.alias(n) for n, c in dispatch_columns(records).items()])


class _Html(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.title, self.author, self.open = [], "", None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.open.append(tag)
        if tag == "meta" and dict(attrs).get("name") == "author":
            self.author = dict(attrs).get("content")

    def handle_endtag(self, tag):
        if self.open and self.open[-1] == tag:
            self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1] == "title":
            self.title += data
        if not self.open or self.open[-1] == "title":
            self.out.append(data)


def html_document(data: bytes) -> tuple[str, dict]:
    p = _Html()
    p.feed(data.decode("utf-8", "ignore"))
    bits = (b.strip() for line in "".join(p.out).splitlines() for b in line.strip().split("  "))
    return "\n".join(b for b in bits if b), {k: v for k, v in (("title", p.title), ("author", p.author)) if v}


def markdown_document(data: bytes) -> tuple[str, dict]:
    """Front matter between lines of three dashes is metadata."""
    text = data.decode("utf-8", "ignore")
    m = re.match(r"---\s*\n(.*?)\n---\s*\n", text, re.S)
    meta = dict(x.split(":", 1) for x in m[1].splitlines() if ":" in x) if m else {}
    return (text[m.end() :] if m else text).strip(), {k.strip(): v.strip() for k, v in meta.items()}


def json_document(data: bytes) -> tuple[str, dict]:
    got = json.loads(data)
    return json.dumps(got, indent=2, ensure_ascii=False), {"keys": ",".join(got)} if isinstance(got, dict) else {"items": str(len(got))}


def csv_document(data: bytes) -> tuple[str, dict]:
    rows = list(csv.reader(io.StringIO(data.decode("utf-8", "ignore"))))
    return "\n".join(", ".join(r) for r in rows), {"columns": ",".join(rows[0]) if rows else "", "rows": str(max(0, len(rows) - 1))}


def xml_document(data: bytes) -> tuple[str, dict]:
    root = ElementTree.fromstring(data)
    return "\n".join(t.strip() for t in root.itertext() if t.strip()), {"root": root.tag}


def ini_document(data: bytes) -> tuple[str, dict]:
    p = configparser.ConfigParser()
    text = data.decode("utf-8", "ignore")
    p.read_string(text)
    return text, {"sections": ",".join(p.sections())}


def toml_document(data: bytes) -> tuple[str, dict]:
    import tomllib

    text = data.decode("utf-8", "ignore")
    return text, {"keys": ",".join(tomllib.loads(text))}


def yaml_document(data: bytes) -> tuple[str, dict]:
    """Where the yaml library is installed the parsed text, written anew, and its keys; else the text and what looks like a key."""
    text = data.decode("utf-8", "ignore")
    try:
        import yaml
    except ImportError:
        return text, {"keys": ",".join(re.findall(r"(?m)^([\w-]+):", text))}
    got = yaml.safe_load(text)
    return yaml.safe_dump(got, sort_keys=False, allow_unicode=True) if isinstance(got, (dict, list)) else text, {"keys": ",".join(map(str, got))} if isinstance(got, dict) else {}


def docx_document(data: bytes) -> tuple[str, dict]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n\n".join(t for p in root.iter(f"{ns}p") if (t := "".join(x.text or "" for x in p.iter(f"{ns}t")).strip())), {}


def log_document(data: bytes) -> tuple[str, dict]:
    text = data.decode("utf-8", "ignore")
    return text, {x: str(sum(x in line.upper() for line in text.splitlines())) for x in ("ERROR", "WARNING", "INFO", "DEBUG")}


def plain_document(data: bytes) -> tuple[str, dict]:
    return data.decode("utf-8", "ignore"), {}


def code_document(data: bytes) -> tuple[str, dict]:
    """The text, its number of lines, and the first ten lines that begin like imports, functions and classes."""
    text = data.decode("utf-8", "ignore")
    meta: dict = {"type": "code", "lines": str(len(text.splitlines()))}
    for line in text.splitlines():
        kind = next((k for k, p in X.OUTLINE.items() if re.match(p, line)), None)
        if kind and len(meta.setdefault(kind, [])) < 10:
            meta[kind].append(line.strip())
    return text, {k: "\n".join(v) if isinstance(v, list) else v for k, v in meta.items()}


#: Readers by suffix; more can be added. What isn't listed is read as text.
PARSERS: dict[str, Callable[[bytes], tuple[str | None, dict]]] = {c: code_document for c in CODE} | {"html": html_document, "htm": html_document, "md": markdown_document, "markdown": markdown_document, "json": json_document, "csv": csv_document, "xml": xml_document, "ini": ini_document, "cfg": ini_document, "toml": toml_document, "yaml": yaml_document, "yml": yaml_document, "docx": docx_document, "log": log_document, "pdf": pdf_document, "doc": doc_document, "png": png_document, "jpg": jpeg_document, "jpeg": jpeg_document}


def document_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = SUFFIXES, recursive: bool = True, parsers: dict | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, suffix, size, text, metadata, error: a row for each file. Larger files than most_bytes and files that can't be read have an error
    and no text; the others aren't held up. Files are read in the executors, from any store that Spark reads."""
    readers = PARSERS | (parsers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    if suffixes is not None:
        files = files.where(F.col("suffix").isin(*suffixes))
    # the length is tested by the scan: what is too large is never loaded
    own = files.where(F.col("length") <= most_bytes).select("path", "suffix", F.col("length").alias("size"), "content")
    files = own.unionByName(files.where(F.col("length") > most_bytes).select("path", "suffix", F.col("length").alias("size"), F.lit(None).cast("binary").alias("content")))

    def read(batches):
        import pandas as pd

        for b in batches:
            out = []
            for p, s, n, data in zip(b["path"], b["suffix"], b["size"], b["content"]):
                text, meta, error = None, {}, None
                if data is None:
                    error = f"larger than {most_bytes} bytes"
                else:
                    try:
                        text, meta = readers.get(s, plain_document)(bytes(data))
                        text = f"[Image: {p.rsplit('/', 1)[-1]}]" if text is None else text
                    except Exception as e:  # any reader's failure is this file's error row
                        error = f"{type(e).__name__}: {e}"
                out.append((p, s, n, text, {k: str(v) for k, v in meta.items()}, error))
            yield pd.DataFrame(out, columns=["path", "suffix", "size", "text", "metadata", "error"])

    return files.mapInPandas(read, "path string, suffix string, size long, text string, metadata map<string,string>, error string")


def chunk_memories(files: DataFrame, chunker) -> DataFrame:
    """Documents' chunks as memory texts: path, chunk_index, total_chunks, memory_text."""
    from tessera.functions.chunks import chunked

    rows = chunked(files.where("error is null"), chunker, "text", "path")
    return rows.select("path", "chunk_index", "total_chunks", X.part_text(F.col("chunk"), F.col("chunk_index") + 1, F.col("total_chunks"), F.regexp_extract("path", r"[^/]*$", 0)).alias("memory_text"))
