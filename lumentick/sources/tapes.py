"""Tapes and instrument profiles as text files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One field of a delimited line: quoted, with doubled quotes inside, or plain.
_FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def read_tape(spark: SparkSession, path: str | list[str], schema: T.StructType | str, start: str | None = None, stop: str | None = None, time: str = "ts", delimiter: str = ",", multiline: bool = False) -> DataFrame:
    """A tape of delimited text (files, a folder or a glob; gzip is read as it is), rows in the window [start, stop).

    ``multiline``: quoted fields may hold line breaks; a file is then read by one task.
    """
    rows = spark.read.schema(schema).option("sep", delimiter).option("multiLine", multiline).option("escape", '"').csv(path)
    if start:
        rows = rows.where(F.col(time) >= F.lit(start).cast(rows.schema[time].dataType))
    if stop:
        rows = rows.where(F.col(time) < F.lit(stop).cast(rows.schema[time].dataType))
    return rows


def followed(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a folder's files, those that are added later as well."""
    reader = spark.readStream.schema(schema).option("sep", delimiter)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).csv(path)


def series_files(files: list[str], start: datetime | None = None, stop: datetime | None = None, form: str = "%Y%m%d-%H%M%S%z") -> list[str]:
    """Of a series ``name-<time>.ext``, the files that can hold times in [start, stop), in order of time.

    A file holds times from its own until the next one's.
    """
    timed = sorted((datetime.strptime(m[1], form), f) for f in files if (m := re.search(r"(\d{8}-\d{6}[+-]\d{4})", f.rpartition("/")[2])))
    ends = [t for t, _ in timed[1:]] + [None]
    return [f for (t, f), end in zip(timed, ends) if (stop is None or t < stop) and (start is None or end is None or end > start)]


def read_series(spark: SparkSession, folder: str, schema: T.StructType | str, start: datetime | None = None, stop: datetime | None = None, time: str = "ts") -> DataFrame:
    """A series of tapes: only the files of the window are read. Their names come from Spark's own file source."""
    names = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*-[0-9]*").load(folder).select("path").collect()]
    text = lambda t: t and t.strftime("%Y-%m-%d %H:%M:%S")
    files = series_files(names, start, stop)
    return read_tape(spark, files, schema, text(start), text(stop), time) if files else spark.createDataFrame([], schema)


def replayed(rows: DataFrame, start, time: str = "ts", speed: float = 1.0, begin=None) -> DataFrame:
    """Archived rows from ``start`` on with ``replay_ts``, the time at which a replay at ``speed`` begun at ``begin`` shows them."""
    begin = F.lit(start if begin is None else begin).cast("timestamp_ntz")
    since = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp_ntz").cast("timestamp"))
    at = F.timestamp_micros(F.unix_micros(begin.cast("timestamp")) + F.rint(since / F.lit(float(speed))).cast("long"))
    return rows.where(F.col(time) >= F.lit(start).cast("timestamp_ntz")).withColumn("replay_ts", at.cast("timestamp_ntz"))


def extracted(rows: DataFrame, symbols: DataFrame, records: list[str], start: Column, stop: Column, record: str = "record", symbol: str = "symbol", time: str = "ts") -> DataFrame:
    """Historic rows of the asked symbols and records in [start, stop)."""
    wanted = symbols.select(F.col("symbol").alias(symbol)).distinct()
    return rows.where(F.col(record).isin(*records) & (F.col(time) >= start) & (F.col(time) < stop)).join(wanted, symbol, "left_semi")


def published(rows: DataFrame, folder: str, contracts: dict[str, str], record: str = "record") -> None:
    """Append rows to the contracts that their record feeds (``contracts``: contract name to a pattern of records), one folder each."""
    for name, pattern in contracts.items():
        rows.where(F.col(record).rlike(f"^(?:{pattern})$")).write.mode("append").parquet(f"{folder}/{name}")


def write_tape(rows: DataFrame, path: str, split: str = "yyyyMMdd", time: str = "ts", form: str = "csv") -> None:
    """A tape split by period, one folder a period; a period's rows are dealt to as many tasks as Spark finds fit."""
    rows.withColumn("period", F.date_format(time, split)).hint("rebalance", "period").write.mode("overwrite").partitionBy("period").format(form).save(path)


def expired_periods(spark: SparkSession, path: str, keep: int) -> list[str]:
    """The periods of a tape beyond its newest ``keep``: what a retention job deletes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"/period=([^/]*)/", 1).alias("period")).where("period <> ''").distinct()
    return [r[0] for r in files.orderBy(F.desc("period")).offset(keep).collect()]


def format_of(head: bytes) -> str:
    """What a tape is, by its first bytes: gzip, zip, binary, text (``=`` descriptions, tabs) or csv."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] == b"PK\x03\x04":
        return "zip"
    if any(x < 9 or 13 < x < 32 for x in head):
        return "binary"
    return "text" if b"\t" in head or head[:1] in (b"=", b"#") else "csv"


def detected(spark: SparkSession, path: str) -> DataFrame:
    """(path, format) of each file, from its first bytes; tasks look at them."""
    head = F.substring("content", 1, 4096)
    mark = F.hex(F.substring("content", 1, 4))
    text = F.decode(head, "ISO-8859-1")
    kind = F.when(mark.startswith("1F8B"), "gzip").when(mark == "504B0304", "zip").when(text.rlike(r"[\x00-\x08\x0e-\x1f]"), "binary").when(text.contains("\t") | text.rlike("^[=#]"), "text").otherwise("csv")
    return spark.read.format("binaryFile").load(path).select("path", kind.alias("format"))


def blobs(spark: SparkSession, path: str, record: str, symbol: str) -> DataFrame:
    """Files as payloads of one record and symbol."""
    return spark.read.format("binaryFile").load(path).select(F.lit(record).alias("record"), F.lit(symbol).alias("symbol"), "path", F.col("modificationTime").alias("ts"), F.col("content").alias("payload"))


def zipped_lines(spark: SparkSession, path: str, batch: int = 10_000) -> DataFrame:
    """(path, entry, line) of the text files inside zip archives; an archive passes through one task, line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in z.namelist():
                        with z.open(entry) as f:
                            lines = []
                            for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == batch:
                                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([entry] * len(lines)), pa.array(lines)], names=["path", "entry", "line"])
                                    lines = []
                            if lines:
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([entry] * len(lines)), pa.array(lines)], names=["path", "entry", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, entry string, line string")


def _first(head: DataFrame, key: str, value: str) -> DataFrame:
    """Of several descriptions of one name the first in the order of files and lines."""
    return head.groupBy(key).agg(F.min_by(value, F.struct("file", "line")).alias(value))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def described(spark: SparkSession, path: str) -> DataFrame:
    """A text tape: lines ``=Record<TAB>fields...`` describe the rows ``Record<TAB>values...``; gives (record, values).

    A description holds for its whole tape, so it may stand in another split than its rows.
    """
    lines = _lines(spark, path).withColumn("parts", F.split("value", "\t"))
    head = _first(lines.where(F.col("value").startswith("=")).select("file", "line", F.expr("substr(parts[0], 2)").alias("record"), F.expr("slice(parts, 2, size(parts))").alias("fields")), "record", "fields")
    body = lines.where(~F.col("value").rlike("^[=#]|^$")).select(F.col("parts")[0].alias("record"), F.expr("slice(parts, 2, size(parts))").alias("v"))
    return body.join(head, "record").select("record", F.map_from_arrays("fields", F.expr("transform(fields, (f, i) -> get(v, i))")).alias("values"))


def split_line(line: Column) -> Column:
    """The fields of a line with commas between them, any number of them; quotes around a field are taken off."""
    return F.transform(F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def quoted(c: Column) -> Column:
    """A field as such a line has it: in quotes where it holds a comma, a quote or a line break."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Instrument profiles: ``#TYPE::=TYPE,FIELD,...`` names the fields of rows of a type; gives (type, symbol, fields).

    Empty fields are left out, values beyond the named fields too.
    """
    lines = _lines(spark, path)
    head = _first(lines.where(F.col("value").rlike(r"^#[^:]+::=")).select("file", "line", F.regexp_extract("value", r"^#([^:]+)::=", 1).alias("type"), F.split(F.regexp_replace("value", r"^#[^:]+::=", ""), ",").alias("names")), "type", "names")
    body = lines.where(~F.col("value").rlike("^#|^$")).select(split_line(F.col("value")).alias("v")).withColumn("type", F.col("v")[0])
    pairs = F.expr("map_from_entries(filter(transform(names, (f, i) -> struct(f, get(v, i))), x -> x.col2 is not null and x.col2 <> ''))")
    return body.join(head, "type").select("type", pairs.alias("fields")).withColumn("symbol", F.try_element_at("fields", F.lit("SYMBOL"))).select("type", "symbol", "fields")


def profile_lines(profiles: DataFrame, names: list[str]) -> DataFrame:
    """Profiles as lines of the text form, header lines first within each type (``part`` 0 before 1)."""
    value = F.concat_ws(",", quoted(F.col("type")), *[quoted(F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])
    head = profiles.select("type").distinct().select("type", F.lit(0).alias("part"), F.concat(F.lit("#"), "type", F.lit("::=TYPE,"), F.lit(",".join(n.upper() for n in names))).alias("line"))
    return head.unionByName(profiles.select("type", F.lit(1).alias("part"), value.alias("line")))


def used_fields(profiles: DataFrame, names: list[str]) -> list[str]:
    """The fields that some profile uses: one row of flags comes to the driver."""
    used = profiles.agg(*[F.max(F.coalesce(F.col(n).cast("string") != "", F.lit(False))).alias(n) for n in names]).first()
    return [n for n in names if used[n]]


def write_profiles(profiles: DataFrame, path: str, names: list[str]) -> None:
    """Profile files, one folder a type, each file with its header line first; a file ends with its rows (``##COMPLETE`` closes the set in a file of its own)."""
    lines = profile_lines(profiles, names)
    # Every part of a type needs the header, so the parts are few: a type's rows are dealt into parts of about a million.
    n = F.ceil(F.count("*").over(Window.partitionBy("type")) / 1_000_000)
    body = lines.where("part = 1").withColumn("of", n).withColumn("piece", F.pmod(F.xxhash64("line"), F.col("of")))
    head = body.select("type", "piece").distinct().join(lines.where("part = 0").select("type", "line"), "type").select("type", "piece", F.lit(0).alias("part"), "line")
    both = head.unionByName(body.select("type", "piece", F.lit(1).alias("part"), "line"))
    both.repartition("type", "piece").sortWithinPartitions("type", "piece", "part", "line").select("type", "line").write.mode("overwrite").partitionBy("type").text(path)
    profiles.sparkSession.createDataFrame([("##COMPLETE",)], "line string").write.mode("overwrite").text(f"{path}/complete")


def fixml_securities(spark: SparkSession, path: str, row: str = "SecDef") -> DataFrame:
    """Security definitions of FIXML files: instrument attributes as columns."""
    ins = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in ("Sym", "ID", "Src", "CFI", "MMY", "MatDt", "StrkPx", "Mult", "Exch")])
    t = spark.read.format("xml").option("rowTag", row).schema(T.StructType([T.StructField("Instrmt", ins)])).load(path)
    at = lambda k: F.col(f"Instrmt._{k}")
    return t.select(at("Sym").alias("symbol"), at("CFI").alias("cfi"), at("MMY").alias("mmy"), at("MatDt").cast("date").alias("expiration"), at("StrkPx").try_cast("double").alias("strike"), at("Mult").try_cast("double").alias("multiplier"), at("Exch").alias("exchange"))


def market_codes(spark: SparkSession, path: str) -> DataFrame:
    """Market identifier codes of a csv list with headers: (mic, operating_mic, country, name), active ones."""
    t = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    up = {c.upper().strip(): c for c in t.columns}
    pick = lambda *names: F.coalesce(*[F.col(f"`{up[n]}`") for n in names if n in up], F.lit(None).cast("string"))
    status = F.upper(F.coalesce(pick("STATUS"), F.lit("ACTIVE")))
    return t.where(~status.isin("DELETED", "EXPIRED")).select(pick("MIC").alias("mic"), pick("OPERATING MIC").alias("operating_mic"), pick("ISO COUNTRY CODE (ISO 3166)", "ISO COUNTRY CODE").alias("country"), pick("MARKET NAME-INSTITUTION DESCRIPTION", "NAME-INSTITUTION DESCRIPTION").alias("name"))


def escaped(c: Column) -> Column:
    """A text field of a tape: backslashes, tabs and line breaks escaped, a null as ``\\NULL``."""
    out = c
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.coalesce(out, F.lit("\\NULL"))


def unescaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for plain, code in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.when(c != "\\NULL", F.replace(out, F.lit("\x00"), F.lit("\\")))


def random_ticks(spark: SparkSession, n: int, symbols: int, seed: int = 1) -> DataFrame:
    """Ticks for load tests: the same for the same seed and partitioning."""
    row = spark.range(n)
    return row.select(
        F.col("id").alias("seq"), F.concat(F.lit("SYM"), F.floor(F.rand(seed) * symbols).cast("string")).alias("symbol"), (F.floor(F.rand(seed + 1) * 10000) / 100).alias("price"), F.floor(F.rand(seed + 2) * 100 + 1).cast("double").alias("size"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"),
    )
