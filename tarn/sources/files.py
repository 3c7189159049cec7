"""Sources: files, records, pages of markup."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.text import dirty_count, squeeze, stem, strip_dirty, suspicious_names
from tarn.session import ship

ITEM_SCHEMA = (
    "id string, suite string, split string, type string, difficulty string, question string, ground_truth string, key_claims array<string>, "
    "supporting_docs array<string>, expected_behavior string, safety_type string, injection_marker string, authoring map<string,string>, notes string"
)
LABEL_SCHEMA = "id string, criterion string, label string, reason string, mode string"
RESULT_SCHEMA = (
    "id string, suite string, type string, split string, question string, trace_id string, latency_ms double, cost_cny double, "
    "metrics struct<refused: boolean, `recall@5`: double, mrr: double, oos_refusal_pass: boolean, false_refusal: boolean, marker_leak: boolean, injection_rule_pass: boolean, safety_refusal_rule_pass: boolean>, "
    "judge map<string, struct<verdict: string, evidence: string, reason: string>>"
)


def discover(spark: SparkSession, paths: Sequence[str], glob: str = "*.{txt,pdf}") -> DataFrame:
    """Files below folders, hidden ones left out, each path once: path, length, modificationTime, content (read only if used)."""
    out = None
    for p in paths:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(p)
        out = f if out is None else out.unionByName(f)
    return out.where(~F.col("path").rlike(r"/\.[^/]")).dropDuplicates(["path"])


@F.pandas_udf(T.StringType())
def decode(content: pd.Series) -> pd.Series:
    """UTF-8, without a byte order mark; GBK with replacement characters where that fails."""

    def one(b: bytes) -> str:
        try:
            return bytes(b).decode("utf-8-sig")
        except UnicodeDecodeError:
            return bytes(b).decode("gb18030", "replace")

    return content.map(one)


@F.pandas_udf(T.StringType())
def _read_gb(content: pd.Series) -> pd.Series:
    """Bytes as GB 18030 (of which GBK is a part); null where they are not."""

    def text(b: bytes | None) -> str | None:
        if b is None:
            return None
        t = bytes(b).decode("gb18030", "surrogateescape")
        return None if any("\udc80" <= ch <= "\udcff" for ch in t) else t

    return content.map(text)


def sniff(content: Column) -> Column:
    """Text of bytes in UTF-8 or GB 18030: the first reading that is whole and has more than 20 Han characters; else UTF-8 without what is invalid."""
    plain = lambda c: F.regexp_replace(c, r"^\x{FEFF}+", "")
    chinese = lambda c: ~F.contains(c, F.lit("\ufffd")) & (F.regexp_count(c, F.lit(r"[\x{4e00}-\x{9fff}]")) > 20)
    as_utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    as_gb = _read_gb(F.when(F.coalesce(~chinese(as_utf8), F.lit(True)), content))
    rest = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
    return plain(F.when(chinese(as_utf8), as_utf8).when(chinese(as_gb), as_gb).otherwise(rest))


def pages_of(files: DataFrame) -> DataFrame:
    """Sanitised pages of text files: doc_id, page, path, content_hash, text, chars_removed, suspicious (found in the raw text).

    PDF files are left to ``pdf_pages``; any other kind of file is an error.
    """
    ship(files.sparkSession)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    is_text = F.when(kind.isin("txt", "pdf"), kind == "txt").otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.col("path"))).cast("boolean"))
    # a valid text stays in the JVM; only others go to Python
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}", ""))
    raw = files.where(is_text).select("path", F.sha2("content", 256).alias("content_hash"), "content", utf8.alias("_u"))
    good = raw.where("_u is not null").select("path", "content_hash", F.col("_u").alias("raw"))
    odd = raw.where("_u is null").select("path", "content_hash", decode("content").alias("raw"))
    r = good.unionByName(odd)
    return r.select(stem(F.col("path")).alias("doc_id"), F.lit(0).alias("page"), "path", "content_hash", strip_dirty(F.col("raw")).alias("text"), dirty_count(F.col("raw")).alias("chars_removed"), suspicious_names(F.col("raw")).alias("suspicious"))


def _pdf_reader():
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf package") from e
    return lambda content: PdfReader(content).pages


def pdf_pages(files: DataFrame, reader: Callable = _pdf_reader) -> DataFrame:
    """Pages of PDF files (path, content_hash, page, text), where a reader library is installed. A page that cannot be read is empty, a file that cannot be opened is one empty page: neither is a failure.

    ``reader()`` gives a function from a file's bytes, as a stream, to its pages with ``extract_text``.
    """
    ship(files.sparkSession)

    def run(batches):
        import io

        pages = reader()
        for pdf in batches:
            rows = []
            for path, digest, content in zip(pdf["path"], pdf["content_hash"], pdf["content"], strict=True):
                try:
                    found = list(pages(io.BytesIO(content)))
                except Exception:  # noqa: BLE001
                    found = [None]
                for i, page in enumerate(found):
                    try:
                        rows.append((path, digest, i, page.extract_text() or ""))
                    except Exception:  # noqa: BLE001
                        rows.append((path, digest, i, ""))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "page", "text"])

    return files.select("path", F.sha2("content", 256).alias("content_hash"), "content").mapInPandas(run, "path string, content_hash string, page int, text string")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = ITEM_SCHEMA, strict: bool = True) -> DataFrame:
    """Records of JSON lines by a stated schema; blank lines are passed over, fields beyond the schema ignored.

    With ``strict`` a line that does not fit stops the job and is shown; else it is left out.
    """
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*s.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.text(path).where(F.trim("value") != "")
    r = raw.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    if not strict:
        return r.where("_corrupt is null").drop("_corrupt")
    first = s.fields[0].name
    checked = F.when(F.col("_corrupt").isNull(), F.col(first)).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("_corrupt", 1, 200))).cast(s.fields[0].dataType))
    return r.withColumn(first, checked).drop("_corrupt")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with header, in UTF-8 with or without byte order mark; files in GB 18030 are decoded first, then read as text columns."""
    raw = spark.read.format("binaryFile").load(path)
    if raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).isEmpty():
        r = spark.read.option("header", "true").option("multiLine", "true")
        df = (r.schema(schema) if schema else r).csv(path)
        return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    ship(spark)

    def parse(batches):
        import csv
        import io

        for pdf in batches:
            rows = [(i, r) for text in pdf["text"] for i, r in enumerate(csv.reader(io.StringIO(text))) if r]
            yield pd.DataFrame(rows, columns=["n", "fields"])

    rows = raw.select(decode("content").alias("text")).mapInPandas(parse, "n int, fields array<string>")
    head = rows.where("n = 0").first()["fields"]
    df = rows.where("n > 0").select(*[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(head)])
    return df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(schema).fields]) if schema else df


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: id without version, title, summary (500 characters), published (the day), pdf link."""
    schema = "id string, title string, summary string, published string, link array<struct<_href: string, _title: string>>"
    x = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    line = lambda c: F.trim(F.replace(F.col(c), F.lit("\n"), F.lit(" ")))
    return x.select(F.regexp_replace(F.regexp_extract("id", r"([^/]+)$", 1), r"v\d+$", "").alias("id"), line("title").alias("title"), F.substring(line("summary"), 1, 500).alias("summary"), F.substring("published", 1, 10).alias("published"), F.get(F.filter("link", lambda v: v["_title"] == "pdf"), F.lit(0))["_href"].alias("pdf"))


def markdown_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, title, body) of second-level sections; what stands before the first is left out."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n##[ \t]+")
    p = df.select(key, F.posexplode(parts).alias("ord", "_p")).where("ord > 0")
    return p.select(key, "ord", F.trim(F.substring_index("_p", "\n", 1)).alias("title"), squeeze(F.when(F.instr("_p", "\n") > 0, F.expr("substring(_p, instr(_p, '\n') + 1)")).otherwise(F.lit(""))).alias("body"))


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())]))
def html_article(page: pd.Series) -> pd.DataFrame:
    """Title and paragraphs of a page by walking its tags (headings give the title, paragraphs the body)."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.stack: list[str] = []
            self.title: list[str] = []
            self.body: list[str] = []

        def handle_starttag(self, tag, attrs):
            if tag in ("br", "img", "hr", "meta", "link", "input"):
                return
            self.stack.append(tag)
            if tag == "p":
                self.body.append("\n")

        def handle_endtag(self, tag):
            while self.stack and self.stack.pop() != tag:
                pass

        def handle_data(self, data):
            if "script" in self.stack or "style" in self.stack:
                return
            if "h1" in self.stack or ("title" in self.stack and not self.title):
                self.title.append(data)
            elif any(t in self.stack for t in ("p", "li", "h2", "h3", "td")):
                self.body.append(data)

    rows = []
    for p in page:
        w = Walk()
        w.feed(p or "")
        rows.append((" ".join("".join(w.title).split()), "".join(w.body).strip()))
    return pd.DataFrame(rows, columns=["title", "body"])


def passages(parents: DataFrame, rich: Column, least: int = 400, most: int = 1400) -> DataFrame:
    """Parents of fitting length that are rich enough, as one array for each document."""
    p = parents.where(F.length("text").between(least, most) & rich)
    return p.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("passages"))
