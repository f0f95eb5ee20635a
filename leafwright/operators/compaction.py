"""Too many small files: size-tiered incremental compaction with a transaction journal.

Files not yet in the journal are read, their records taken apart, each record kept once, and written as a
run (a folder of files of about ``target_bytes``). Runs are tiered by their bytes, a tier reaching from a power
of ``fanout`` to the next; whenever a tier below ``target_bytes`` holds ``fanout`` runs, these are merged into
one, which falls into a higher tier: only runs of similar size are ever merged, and a run of full files is never
written again. Each merge is a transaction named by a digest of its inputs. A transaction writes its
output folder first and its journal entry last, so a run that was interrupted is repeated as a whole and
a run that was finished is skipped: no record is lost or doubled by running again. Each load also keeps
which file each record came from (``origins``), the copies that were left out included.

Nothing about single records or files reaches the driver; it sees one row per run (bounded by
``total bytes / target_bytes``) and per transaction.

Defined cases: a null, empty or damaged body holds no record; keys other than the two named are kept
out of a record's identity; values that are not strings make no record; a file delivered twice counts
once; files without an id are told apart by their bodies; an empty table makes no transaction; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.storage import require, written

RECORD = "file_id bigint, ord int, filename string, html string, digest binary"
JOURNAL = "txn string, level int, n_inputs bigint, n_records bigint, bytes bigint, inputs array<string>, output string"


def _refuse(token: str) -> None:
    raise ValueError(token)


def parse_records(body: str | None) -> list[tuple[int, str, str]]:
    """(position, Filename, ColoredTextHTML) of a body: an object or a list of objects, strict JSON."""
    if not body:
        return []
    try:
        value = json.loads(body, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return []
    found = []
    for i, item in enumerate(value if isinstance(value, list) else [value]):
        if isinstance(item, dict):
            name, html = item.get("Filename"), item.get("ColoredTextHTML")
            if isinstance(name, str) and isinstance(html, str):
                found.append((i, name, html))
    return found


def record_digest(name: str, html: str) -> bytes:
    """128 bits over both strings; the length of the first keeps ("ab", "c") and ("a", "bc") apart."""
    a, b = name.encode("utf-8", "surrogatepass"), html.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(a).to_bytes(8, "big") + a + b, digest_size=16).digest()


def _printable(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), ([], [], [], [], [])
        for file_id, body in zip(ids, batch.column(1).to_pylist(), strict=True):
            for i, name, html in parse_records(body):
                for column, value in zip(rows, (file_id, i, _printable(name), _printable(html), record_digest(name, html)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["file_id", "ord", "filename", "html", "digest"])


def file_records(files: DataFrame, file_id: str = "file_id", body: str = "body") -> DataFrame:
    """All records of all files, each file once: ``file_id, ord, filename, html, digest``."""
    return _each_once(require(files, file_id, body), file_id).mapInArrow(_parse_batches, RECORD)


def _each_once(files: DataFrame, file_id: str) -> DataFrame:
    """Files without repeats; those without an id are told apart by all their columns."""
    named = files.where(F.col(file_id).isNotNull()).dropDuplicates([file_id])
    return named.unionByName(files.where(F.col(file_id).isNull()).dropDuplicates())


def repeated_records(records: DataFrame) -> DataFrame:
    """``digest, file_id`` of the records that stand in more than one file; each pair once."""
    held = records.select("digest", "file_id").distinct()
    counts = held.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return held.join(counts, "digest", "left_semi")


def files_sharing_records(records: DataFrame) -> DataFrame:
    """Pairs of files (the smaller id first) that hold at least one record in common."""
    held = repeated_records(records)
    other = held.select("digest", F.col("file_id").alias("file_b"))
    return held.withColumnRenamed("file_id", "file_a").join(other, "digest").where("file_a < file_b").select("file_a", "file_b").distinct()


def distinct_records(records: DataFrame) -> DataFrame:
    """Each record once, from the file with the smallest id (then the first place in it)."""
    best = records.groupBy("digest").agg(F.min_by(F.struct("file_id", "ord", "filename", "html"), F.struct("file_id", "ord")).alias("r"))
    return best.select("r.*", "digest")


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """Finished transactions below ``folder``; none if there is no journal yet."""
    path = f"{folder}/journal"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], JOURNAL)
    return spark.read.schema(JOURNAL).json(path)


def live_runs(spark: SparkSession, folder: str) -> list:
    """Outputs of finished transactions that no later one has merged: bounded by bytes / target_bytes."""
    done = journal(spark, folder)
    used = done.select(F.explode("inputs").alias("output"))
    return done.join(used, "output", "left_anti").where("n_records > 0").orderBy("level", "txn").collect()


def _commit(spark: SparkSession, folder: str, txn: str, level: int, n_inputs: int, inputs: list[str], rows: DataFrame, target_bytes: int) -> None:
    if journal(spark, folder).where(F.col("txn") == txn).limit(1).count():
        return
    output = f"{folder}/runs/{txn}"
    size = F.sum(F.octet_length("filename") + F.octet_length("html"))
    total = rows.agg(F.coalesce(size, F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    parts = max(1, -(-total["b"] // target_bytes))
    rows.repartition(parts, "digest").write.mode("overwrite").parquet(output)
    entry = [(txn, level, n_inputs, total["n"], total["b"], inputs, output)]
    spark.createDataFrame(entry, JOURNAL).coalesce(1).write.mode("append").json(f"{folder}/journal")


def byte_tier(size: int, fanout: int) -> int:
    """The tier of a run: the largest t with fanout ** t <= size (0 for an empty one)."""
    tier = 0
    while size >= fanout ** (tier + 1):
        tier += 1
    return tier


def next_merge(runs: list, fanout: int, target_bytes: int) -> list:
    """The runs to merge next: those of the lowest tier that holds ``fanout`` runs or more; none if no tier does."""
    tiers: dict[int, list] = {}
    for run in runs:
        if run["bytes"] < target_bytes:
            tiers.setdefault(byte_tier(run["bytes"], fanout), []).append(run)
    crowded = sorted(t for t, held in tiers.items() if len(held) >= fanout)
    return tiers[crowded[0]] if crowded else []


def compact(files: DataFrame, folder: str, target_bytes: int = 128 << 20, fanout: int = 4) -> DataFrame:
    """Bring the files of ``files`` that are new into the store below ``folder``; returns its journal.

    ``files`` has ``file_id`` and ``body``. A new file's records make a run of level 0 unless the store has
    them; then runs of a tier are merged as long as a tier holds ``fanout`` runs or more.
    """
    if fanout < 2:
        raise ValueError("a merge takes two runs at least")
    spark = files.sparkSession
    fresh = _each_once(require(files, "file_id", "body"), "file_id")
    seen = _seen_files(spark, folder)
    if seen is not None:
        fresh = fresh.join(seen, "file_id", "left_anti")
    digest = fresh.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("file_id").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    if digest["n"]:
        txn = hashlib.blake2b(f"0:{digest['n']}:{digest['h']}".encode(), digest_size=12).hexdigest()
        parsed = written(fresh.mapInArrow(_parse_batches, RECORD), "parsed")
        records = distinct_records(parsed)
        runs = [r["output"] for r in live_runs(spark, folder)]
        if runs:
            records = records.join(spark.read.parquet(*runs).select("digest"), "digest", "left_anti")
        rows = written(records.select("file_id", "ord", "filename", "html", "digest"), "compact")
        fresh.select("file_id").write.mode("overwrite").parquet(f"{folder}/files/{txn}")
        parsed.select("digest", "file_id").distinct().write.mode("overwrite").parquet(f"{folder}/origins/{txn}")
        _commit(spark, folder, txn, 0, digest["n"], [], rows, target_bytes)
    while merging := next_merge(live_runs(spark, folder), fanout, target_bytes):
        inputs, level = sorted(r["output"] for r in merging), 1 + max(r["level"] for r in merging)
        txn = hashlib.blake2b(f"{level}:{inputs}".encode(), digest_size=12).hexdigest()
        _commit(spark, folder, txn, level, len(inputs), inputs, spark.read.parquet(*inputs), target_bytes)
    return journal(spark, folder)


def _loads(spark: SparkSession, folder: str) -> list[str]:
    return [r["txn"] for r in journal(spark, folder).where("level = 0").select("txn").distinct().collect()]


def _seen_files(spark: SparkSession, folder: str) -> DataFrame | None:
    """File ids of finished loads."""
    done = _loads(spark, folder)
    return spark.read.parquet(*[f"{folder}/files/{t}" for t in done]) if done else None


def origins(spark: SparkSession, folder: str) -> DataFrame:
    """``digest, file_id``: which files each record of the store came from, as its finished loads recorded it."""
    done = _loads(spark, folder)
    return spark.read.parquet(*[f"{folder}/origins/{t}" for t in done]) if done else spark.createDataFrame([], "digest binary, file_id bigint")


def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    """What the store holds now."""
    runs = live_runs(spark, folder)
    return spark.read.parquet(*[r["output"] for r in runs]) if runs else spark.createDataFrame([], RECORD)


def tier_plan(files: DataFrame, target_bytes: int = 128 << 20, growth: int = 4) -> DataFrame:
    """Files by size tier (powers of ``growth``) and the merge group each tier puts them in.

    A tier of b bytes gets ceil(b / target_bytes) groups; a file's group is a hash of its id, so no
    group needs an ordering of all files. Tiers are at most 64, so their totals join by broadcast.
    """
    sized = require(files, "file_id", "size_bytes").dropDuplicates(["file_id"])
    tiers = sized.withColumn("tier", F.floor(F.log(F.greatest(F.coalesce("size_bytes", F.lit(0)), F.lit(1))) / F.log(F.lit(float(growth)))).cast("int"))
    totals = tiers.groupBy("tier").agg(F.greatest(F.ceil(F.sum("size_bytes") / target_bytes), F.lit(1)).alias("groups"))
    grouped = tiers.join(F.broadcast(totals), "tier").withColumn("merge_group", F.pmod(F.xxhash64("file_id"), F.col("groups")))
    return grouped.groupBy("tier", "merge_group").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
