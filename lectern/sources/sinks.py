"""Writers. Files are written by tasks or by Spark's writers; the driver writes only small summaries."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import codecs
from lectern.session import mounted
from lectern.sources import places


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


#: What Spark's writers name the folder of a null, and the characters that they escape in names of folders.
NO_VALUE, ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def text_files(df: DataFrame, path: str, by: str, text: str) -> None:
    """Writes each row's text and a line end as a file of its own, ``<by>=<value>/part-<task>-<number>.txt`` below the new folder ``path``, and ``_SUCCESS`` last.

    Folders are those of Spark's writer, which does the same where tasks can't open ``path``. On a mounted file system that writer begins about eight
    processes a file and moves each twice, so tasks put the files themselves; one that runs again puts the same ones.
    """
    value = F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit(NO_VALUE))
    rows = df.select(value.alias(by), F.col(text).cast("string").alias(text)).sortWithinPartitions(by, text)
    at = mounted(df.sparkSession, path)
    if at is None:
        rows.write.partitionBy(by).option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, number, n = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            for value, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now, number = value, number + 1 if value == now else 0
                folder = ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value)
                places.put(f"{at}/{by}={folder}/part-{task:05d}-{number}.txt", (data or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.withColumn(text, F.col(text).cast("binary")).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    places.put(f"{at}/_SUCCESS", b"")


def replace_scope(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has rows of and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def object_name(kind: str, content: bytes, extension: str, compress: bool = False) -> str:
    """Place of an object by its content."""
    digest = hashlib.sha256(content).hexdigest()
    return f"objects/{kind}/{digest[:2]}/{digest}.{extension}{'.gz' if compress else ''}"


def packed_object(content: bytes, compress: bool) -> bytes:
    """The bytes that are stored: gzip without a time, so equal contents are equal objects."""
    return gzip.compress(content, mtime=0) if compress else content


def store_objects(df: DataFrame, content: str, kind: str, extension: str, put: Callable[[str, bytes], None], compress: bool = False) -> DataFrame:
    """Puts each distinct content once by its name and gives (name, size, sha256). ``put`` must be idempotent, as tasks may run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                name = object_name(kind, data, extension, compress)
                put(name, packed_object(data, compress))
                rows.append((name, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["name", "size", "sha256"])

    distinct = df.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("_h")).agg(F.any_value(content).alias("c"))
    return distinct.select("c").mapInArrow(run, "name string, size bigint, sha256 string")


def masked_object(value: dict, key: str) -> tuple[bytes, int, str]:
    """A JSON object as stored (gzipped, then masked by its key), with the clear size and SHA-256."""
    clear = json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()
    return codecs.mask(gzip.compress(clear, mtime=0), key), len(clear), hashlib.sha256(clear).hexdigest()


def bulk(df: DataFrame, send: Callable[[list[dict]], list[str]], size: int = 500) -> DataFrame:
    """Sends rows in batches of ``size`` within each task and gives how many went; any error ends the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                rows = batch.slice(a, size).to_pylist()
                if errors := send(rows):
                    raise RuntimeError(f"{len(errors)} documents were refused: {errors[0]}")
                n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["sent"])

    return df.mapInArrow(run, "sent bigint").agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"))


def release_state(documents: DataFrame, release: str, expected: int) -> str:
    """absent, complete or partial: how many documents of a release an index has against those expected."""
    n = documents.where(F.col("releaseId") == release).count()
    return "absent" if n == 0 else "complete" if n == expected else "partial"


#: Rows that a report for people may have; it is one file.
MOST_REPORT = 100_000


def _report(df: DataFrame) -> DataFrame:
    if df.limit(MOST_REPORT + 1).count() > MOST_REPORT:
        raise ValueError(f"a report of more than {MOST_REPORT} rows")
    return df


def csv_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file of fixed columns with a header behind a byte-order mark; other columns are left out. More than :data:`MOST_REPORT` rows are an error."""
    _report(df.select(*columns)).withColumnRenamed(columns[0], "\ufeff" + columns[0]).coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def json_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """The same rows as one file of JSON lines, nulls included."""
    _report(df.select(*columns)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown_table(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """One row ``markdown``: a table of a report. More than :data:`MOST_REPORT` rows are an error."""
    cell = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("—"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |"
    listed = _report(df).select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), line.alias("l")).agg(F.array_sort(F.collect_list(F.struct("o", "l"))).alias("ls"))
    return listed.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("markdown"))


def year_manifest(files: DataFrame) -> DataFrame:
    """One row ``json``: years (newest first) with their files, from files(year, file)."""
    years = files.groupBy("year").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return years.agg(F.to_json(F.struct(F.reverse(F.array_sort(F.collect_list(F.struct("year", "files")))).alias("years"))).alias("json"))


def publish(phases: list[tuple[str, Callable[[], None]]]) -> list[str]:
    """Runs phases in order, the commit marker last; an error leaves what follows undone."""
    done = []
    for name, run in phases:
        run()
        done.append(name)
    return done


def stale_and_missing(remote: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """(path, state) of remote objects that nothing expects and of expected ones that are not there."""
    stale = remote.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("state", F.lit("stale"))
    return stale.union(expected.select(key).distinct().join(remote.select(key), key, "left_anti").withColumn("state", F.lit("missing")))
