"""File sources, parsed logs, labelled pairs and table replacement."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions import scalars as S
from tonearm.storage import shared_dir

# Extensions of audio files.
AUDIO = (".mp3", ".flac", ".m4a", ".aac", ".ogg", ".opus", ".wav", ".wma")


def walk(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = AUDIO, skip: str = ".quarantine") -> DataFrame:
    """(path, name, size, modified) of the files with an allowed extension under the roots.  Only the listing is read, not the files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path", "length", "modificationTime")
    rows = found.where(~F.col("path").contains(f"/{skip}/"))
    rows = rows.where(S.extension(F.col("path")).isin(*extensions)).dropDuplicates(["path"])
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def volume_flags(logs: DataFrame, log: str) -> DataFrame:
    """Peak and mean level, flags and silent sections from an analyser's log."""
    number = lambda name: F.regexp_extract(log, name + r": (-?[0-9.]+) dB", 1).cast("double")
    rows = logs.withColumn("peak_db", number("max_volume")).withColumn("mean_db", number("mean_volume"))
    return rows.withColumn("clipping", F.col("peak_db") >= 0).withColumn("low_volume", F.col("mean_db") < -30).withColumn("silence_sections", F.regexp_count(log, F.lit("silence_start")))


def labelled_pairs(lines: DataFrame, line: str) -> DataFrame:
    """(set, labels, complete): which expectations each set of labelled pairs covers."""
    rows = lines.select(F.from_json(line, "struct<a:string,b:string,expect:int,set:string>").alias("x")).select("x.*")
    got = rows.groupBy("set").agg(F.sort_array(F.collect_set("expect")).alias("labels"))
    return got.withColumn("complete", F.col("labels") == F.array(F.lit(0), F.lit(1), F.lit(2)))


# Fixed values of the bandwidth measurement.
RATE, FRAME, BAND, LOW, HIGH, CLIFF_DB = 44_100, 4096, 500.0, 5_000.0, 21_000.0, 12.0


def cutoff(samples: np.ndarray, rate: int = RATE) -> tuple[float | None, float | None]:
    """(cutoff, fall in dB) of the steepest fall over 1 kHz; (None, fall) if it is no cliff, (None, None) if there is too little sound."""
    if len(samples) < FRAME or not np.abs(samples).max(initial=0) > 0:
        return None, None
    frames = samples[: len(samples) // FRAME * FRAME].reshape(-1, FRAME) * np.hanning(FRAME)
    power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).mean(0)
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    edges = np.arange(0, rate / 2, BAND)
    bands = np.array([power[(hz >= e) & (hz < e + BAND)].mean() for e in edges])
    level = 10 * np.log10(bands + 1e-20)
    at = np.flatnonzero((edges >= LOW) & (edges + 2 * BAND <= HIGH))
    fall = level[at] - level[at + 2]
    best = int(np.argmax(fall))
    return (float(edges[at[best]] + BAND) if fall[best] >= CLIFF_DB else None), float(fall[best])


def measure_bandwidth(rows: DataFrame) -> DataFrame:
    """(id, cutoff_hz, cliff_db) of sounds made from each vector: noise through a low pass that the vector chooses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for i, vector in zip(part["id"], part["vector"], strict=True):
                noise = np.random.Generator(np.random.PCG64(int(i))).standard_normal(3 * FRAME)
                spectrum = np.fft.rfft(noise)
                limit = 8_000 + 12_000 * min(1.0, abs(float(vector[0])))
                spectrum[np.fft.rfftfreq(len(noise), 1 / RATE) > limit] *= 1e-3
                out.append((int(i), *cutoff(np.fft.irfft(spectrum, len(noise)))))
            yield pd.DataFrame(out, columns=["id", "cutoff_hz", "cliff_db"]).round(6)

    return rows.mapInPandas(run, "id long, cutoff_hz double, cliff_db double")


CURRENT = "CURRENT"


def _place(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, at, at.getFileSystem(conf)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of a table's version in force; None if there is no table.  Any other trouble is an error."""
    jvm, _, at, fs = _place(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(at, CURRENT)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The version in force of a table that ``replace_table`` writes, or None."""
    at = current_version(spark, path)
    return None if at is None else (spark.read.schema(schema) if schema is not None else spark.read).parquet(at)


def replace_table(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Write a new version of a table and make it the one in force.

    A version is a folder of its own, and a pointer file names the one in force; the pointer is replaced by one atomic rename, so a reader or
    a crash at any moment finds the old version or the new one.  The version before stays for its readers; older ones go.
    """
    spark = rows.sparkSession
    if path is None:
        shared_dir(spark)
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/replaced-{uuid.uuid4().hex}"
    before = current_version(spark, path)
    name = f"version-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    jvm, conf, at, fs = _place(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(at, f"{CURRENT}-{name}")
    stream = fs.create(fresh)
    stream.write(name.encode())
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(at, CURRENT)), options)
    for status in fs.listStatus(at):
        folder = status.getPath().getName()
        if folder.startswith("version-") and folder not in (name, (before or "").rsplit("/", 1)[-1]):
            fs.delete(status.getPath(), True)
    return spark.read.schema(rows.schema).parquet(f"{path}/{name}")
