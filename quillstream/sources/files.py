"""Readers and writers of the files of a literature collection."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
_AUTHOR = T.StructType([T.StructField("author", T.StringType()), T.StructField("affiliation", _TEXTS)])
SCALARS = ("citation_in_text", "journal", "volume", "issue", "year", "title", "pages", "doi", "abstract")
#: A record of the store as it stands in its file.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in SCALARS] + [T.StructField("authors", T.ArrayType(_AUTHOR))] + [T.StructField(n, _TEXTS) for n in ("publication_types", "keywords", "references")]
)


def parse_journals(text: DataFrame, column: str = "value") -> DataFrame:
    """nlmid, journaltitle, medabbr, ord of a journal list: records between lines of hyphens, ``Key: value`` lines.

    Of a key that a record has twice the last value counts; missing values are empty. Text without a record gives
    no rows.
    """
    records = text.select(F.posexplode(F.split(column, r"(?m)^[ \t]*---.*$")).alias("ord", "r")).where("trim(r) <> ''")
    value = lambda k: F.coalesce(F.trim(F.try_element_at(F.regexp_extract_all("r", F.lit(rf"(?m)^[ \t]*{k}: (.*)$"), 1), F.lit(-1))), F.lit(""))
    return records.select(value("NlmId").alias("nlmid"), value("JournalTitle").alias("journaltitle"), value("MedAbbr").alias("medabbr"), "ord")


def read_journal_text(spark: SparkSession, path: str) -> DataFrame:
    """``parse_journals`` of a file."""
    return parse_journals(spark.read.text(path, wholetext=True))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: What ends a record in the layout of ``store_json``, and the lines that this layout has outside of records.
_RECORD_END = "\n  },"
_OUTER = r'(?s)^(?:\{|\}|  \},?|  "(?:[^"\\]|\\.)*": \{|    .*)$'


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """pmid, ord and the fields of each record of a store file (one JSON object by pmid); no rows if the file is missing.

    ``ord`` rises with the place in the file. A file in the layout of ``write_store`` is read in parts, record by record; one in any
    other layout is parsed as a whole, by one task. A damaged record is an error.
    """
    schema = T.MapType(T.StringType(), RECORD)
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("pmid", T.StringType()), T.StructField("ord", T.LongType()), *RECORD.fields]))
    head = spark.read.text(path).limit(1).collect()
    if head and head[0][0] == "{" and spark.read.text(path).where(~F.col("value").rlike(_OUTER)).isEmpty():
        each = spark.read.text(path, lineSep=_RECORD_END).select("value", (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))).alias("ord"))
        bare = F.regexp_replace("value", r"^\{", "")
        entry = F.concat(F.lit("{"), bare, F.when(F.col("value").rlike(r"\n\}\s*$"), "").otherwise("}}"))
        parts = each.select("ord", F.explode(F.map_entries(F.from_json(entry, schema, {"mode": "FAILFAST"}))).alias("e"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
        parts = whole.select(F.posexplode(F.map_entries("m")).alias("ord", "e")).withColumn("ord", F.col("ord").cast("long"))
    return parts.select(F.col("e.key").alias("pmid"), "ord", "e.value.*")


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """nlmid, journaltitle, medabbr, ord of a journal store (one JSON object by id)."""
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("JournalTitle", T.StringType()), T.StructField("MedAbbr", T.StringType())]))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    return whole.select(F.posexplode(F.map_entries("m")).alias("ord", "e")).select(F.col("e.key").alias("nlmid"), F.col("e.value.JournalTitle").alias("journaltitle"), F.col("e.value.MedAbbr").alias("medabbr"), "ord")


def store_json(rows: Iterator[dict], one_line: tuple[str, ...] = ("publication_types", "keywords", "references")) -> Iterator[str]:
    """The text of a store file in pieces, record by record: indented, with the lists ``one_line`` on one line each."""
    yield from _joined(_entry(r, one_line) for r in rows)


def _entry(r: dict, one_line: tuple[str, ...] = ("publication_types", "keywords", "references")) -> str:
    """The text of one record with its id."""
    body = json.dumps({k: v for k, v in r.items() if k not in ("pmid", "ord")}, indent=2, ensure_ascii=False)
    for k in one_line:
        if r.get(k):
            flat = ", ".join(json.dumps(x, ensure_ascii=False) for x in r[k])
            body = body.replace(f'"{k}": ' + json.dumps(r[k], indent=2, ensure_ascii=False).replace("\n", "\n  "), f'"{k}": [ {flat} ]')
    return "\n  " + json.dumps(str(r["pmid"]), ensure_ascii=False) + ": " + body.replace("\n", "\n  ")


def _joined(entries: Iterator[str]) -> Iterator[str]:
    yield "{"
    first = True
    for e in entries:
        yield e if first else "," + e
        first = False
    yield "}\n" if first else "\n}\n"


def open_output(path: str):
    """A binary file for writing on the file system that ``path`` names (an object store as well), by default the local one."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        system, name = fs.FileSystem.from_uri(path)
        return system.open_output_stream(name)
    return open(re.sub(r"^file:/+", "/", path), "wb")  # noqa: SIM115


def append_lines(rows: DataFrame, path: str) -> None:
    """Append each row as a line of JSON to the folder ``path``, from the tasks that have them."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def write_store(store: DataFrame, path: str) -> None:
    """Write a store as one file in the order of ``ord``: the tasks make the texts of the records, the driver strings them together one at a time."""
    fields = [f.name for f in RECORD.fields if f.name in store.columns]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_entry(r) for r in b.to_pylist()], pa.string())], ["entry"])

    rows = store.orderBy("ord").select("pmid", *fields).mapInArrow(texts, "entry string").toLocalIterator(prefetchPartitions=True)
    with open_output(path) as f:
        for piece in _joined(r.entry for r in rows):
            f.write(piece.encode())


def write_journals(journals: DataFrame, path: str) -> None:
    """Write a journal catalogue as one file, in the order of ``first_ord``."""
    rows = journals.orderBy("first_ord").select("nlmid", "journaltitle", "medabbr").toLocalIterator()
    with open_output(path) as f:
        for piece in store_json({"pmid": r.nlmid, "JournalTitle": r.journaltitle, "MedAbbr": r.medabbr} for r in rows):
            f.write(piece.encode())


def _empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files without content, which scans leave out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.isFile() and s.getLen() == 0]


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """stem, ext, full_text of the Markdown and text files of a folder; an empty file has an empty text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,txt}").load(folder).select(F.decode("content", "UTF-8").alias("value"), F.col("_metadata.file_name").alias("_f"))
    empty = [("", n) for n in _empty_files(spark, folder) if re.search(r"\.(md|txt)$", n)]
    name = F.url_decode(F.replace("_f", F.lit("+"), F.lit("%2B")))
    if empty:
        files = files.unionAll(spark.createDataFrame(empty, "value string, _f string").withColumn("_f", F.replace(F.url_encode("_f"), F.lit("+"), F.lit("%20"))))
    return files.select(F.regexp_replace(name, r"\.(md|txt)$", "").alias("stem"), F.regexp_extract(name, r"\.(md|txt)$", 1).alias("ext"), F.col("value").alias("full_text"))


def read_extracts(spark: SparkSession, folder: str) -> DataFrame:
    """stem, authors, references of the JSON extracts of a folder."""
    schema = T.StructType([T.StructField("authors", T.ArrayType(_AUTHOR)), T.StructField("references", _TEXTS)])
    rows = spark.read.schema(schema).json(folder, multiLine=True, pathGlobFilter="*.json").select("*", F.col("_metadata.file_name").alias("_f"))
    return rows.select(F.regexp_replace(F.url_decode(F.replace("_f", F.lit("+"), F.lit("%2B"))), r"\.json$", "").alias("stem"), "authors", "references")


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths where there is no file."""
    return [p for p in paths if not _exists(spark, p)]


def read_pdfs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, content of the PDF files that exist; the others are left out (``missing`` names them)."""
    lost = set(missing(spark, paths))
    there = [p for p in paths if p not in lost]
    if not there:
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").load(there).select("path", "length", "content")


def convert_pdfs(pdfs: DataFrame, extract: Callable[[bytes], str], fallback: Callable[[bytes], str] | None = None, least: int = 2000) -> DataFrame:
    """path, text, error: ``extract`` run on each file; where it yields under ``least`` letters, ``fallback`` instead.

    An extractor that fails gives an error for its file and doesn't stop the others. Null content is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    text = extract(bytes(content))
                    if fallback is not None and sum(c.isalpha() for c in text) < least:
                        text = fallback(bytes(content))
                    rows.append((path, text, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return pdfs.select("path", "content").mapInPandas(run, "path string, text string, error string")


def write_markdown(converted: DataFrame) -> DataFrame:
    """path, target, error: the texts of ``convert_pdfs`` written beside their files, as ``{stem}.md``.

    Each task writes its own texts, through the file system that the path names. A file that can't be written is an
    error and doesn't stop the others; files that couldn't be converted keep their error and are not written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, error in zip(b["path"], b["text"], b["error"]):
                target = re.sub(r"\.[^./]*$", "", path) + ".md"
                if error is None:
                    try:
                        with open_output(target) as f:
                            f.write(text.encode())
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                rows.append((path, None if error is not None else target, error))
            yield pd.DataFrame(rows, columns=["path", "target", "error"])

    return converted.select("path", "text", "error").mapInPandas(run, "path string, target string, error string")
