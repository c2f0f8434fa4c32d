"""The music library's tables, as views over the driver's tables.

There is no audio here, so each table is a deterministic view that keeps the columns and the
irregularities (missing tags, absent files, shared hashes) that the operators depend on.
``tonearm.plans.views`` has the same views as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators.identity import with_content_id
from tonearm.operators.matching import packed
from tonearm.storage import settled

EXTENSIONS = ("flac", "mp3", "m4a", "ogg", "opus", "wav", "aiff", "wv")
CODECS = ("flac", "mp3", "aac")
KEYS = ("C", "C#", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb")


#: So many ids of copies, at most, are broadcast.
FEW_IDS = 1_000_000


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files give fewer splits than there are cores; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Library:
    """Lazily defined tables under one directory; only the columns that a query uses are read."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def hashed(self) -> DataFrame:
        """Documents with the hash of their text in place of it."""
        return self.table("documents").withColumn("audio_hash", F.sha2("text", 256))

    @cached_property
    def track(self) -> DataFrame:
        """One row per file; files with equal hashes share a content."""
        i = F.col("doc_id")
        unless = lambda n, value: F.when(i % n != 0, value)
        rows = self.hashed.select(
            i.alias("id"),
            F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), i.cast("string"), F.lit("."), _pick(EXTENSIONS, i % 8)).alias("path"),
            F.col("n_chars").alias("size"),
            unless(11, 1_700_000_000.0 + (i * 37) % 1000).alias("mtime"),
            unless(13, F.lit(1).cast("long")).alias("dev"),
            unless(13, i - i % 2).alias("inode"),
            unless(7, 128_000 + (i % 5) * 48_000).alias("bitrate"),
            unless(4, F.concat(F.lit("Title "), i.cast("string"))).alias("tag_title"),
            F.when(i % 5 == 0, "").otherwise(F.col("source")).alias("tag_artist"),
            unless(6, F.concat(F.lit("Album "), (i % 50).cast("string"))).alias("tag_album"),
            unless(9, F.col("lang")).alias("tag_genre"),
            (i % 10 != 3).alias("present"),
            F.col("n_chars").alias("n_chars"),
            "audio_hash",
        )
        return with_content_id(rows, "audio_hash", "id", "content_id")

    @cached_property
    def content(self) -> DataFrame:
        """One row per distinct hash."""
        c = F.col("id")
        return self.track.where("id = content_id").select(
            c, "audio_hash", F.when(c % 6 == 0, "whole_file").otherwise("stream").alias("hash_method"), (F.col("n_chars") / 10.0).alias("duration"),
            _pick(CODECS, c % 3).alias("codec"), F.when(c % 2 == 0, 44_100).otherwise(48_000).alias("sample_rate"),
        )

    @cached_property
    def copies(self) -> DataFrame:
        """(id,) of the files that aren't contents, written once."""
        first = F.coalesce(F.col("id") == F.col("content_id"), F.lit(False))
        return settled(self.track.groupBy("id").agg(F.max(first).alias("first")).where("id is not null and not first").select("id"))

    @cached_property
    def features(self) -> DataFrame:
        c = F.col("id")
        return self.content.where(c % 8 != 5).select(
            c.alias("content_id"), F.when(c % 17 != 0, 50 + (c * 31 % 1700) / 10.0).alias("bpm"), F.when(c % 14 != 0, _pick(KEYS, c % 12)).alias("key_name"),
            F.when(c % 2 == 0, "major").otherwise("minor").alias("scale"), F.when(c % 19 != 0, (c * 7 % 100) / 100.0).alias("energy"),
            (-30.0 + c % 25).alias("loudness"), (1000.0 + c * 13 % 3000).alias("centroid"), ((c * 11 % 100) / 100.0).alias("danceability"),
        )

    @cached_property
    def embedding(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("content_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")

    @cached_property
    def scored(self) -> DataFrame:
        """Contents with features and a short vector (the first 13 components)."""
        return self.features.join(self.embedding, "content_id").select("content_id", "bpm", "key_name", "scale", "energy", F.slice("vector", 1, 13).alias("mfcc"))

    @cached_property
    def bandwidth(self) -> DataFrame:
        """(null, cliff): the whole band; (null, null): can't be measured."""
        c = F.col("id")
        return self.content.where(c % 9 != 4).select(c.alias("content_id"), F.when(c % 5 != 0, 12_000.0 + (c % 17) * 500).alias("cutoff_hz"), F.when(c % 23 != 0, 12.0 + c % 20).alias("cliff_db"))

    @cached_property
    def quality_flag(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("content_id"), (F.col("toxic") == 1).alias("clipping"), (F.col("quality") == 0).alias("low_volume"), (F.col("doc_id") % 3).alias("silence_sections"))

    @cached_property
    def words(self) -> DataFrame:
        """(content_id, words): white space separates."""
        plain = F.translate("text", "\n\t\r", "   ")
        docs = spread(self.table("documents").select(F.col("doc_id").alias("id"), "text"))
        if self.copies.count() <= FEW_IDS:  # sent to the texts, so that these stay where they are
            mine = docs.where("id is not null").join(F.broadcast(self.copies), "id", "left_anti")
        else:  # the texts are dealt by id, not the lists of words, which are more than twice as long
            mine = docs.join(self.content.select("id"), "id", "left_semi")
        return mine.select(F.col("id").alias("content_id"), F.filter(F.split(plain, " "), lambda x: x != "").alias("words"))

    @cached_property
    def fingerprint(self) -> DataFrame:
        """(content_id, fp): ``_runs`` of the contents with three words."""
        return self._runs.where("fp is not null")

    @cached_property
    def _runs(self) -> DataFrame:
        """(content_id, fp): 32 bits in a bigint for each run of three words; null without three."""
        n = F.greatest(F.size("words") - 2, F.lit(0))
        # the words are zipped with their successors first: inside a lambda the whole list would be made again for each item
        runs = F.arrays_zip(*[F.slice("words", i, n).alias(f"w{i}") for i in (1, 2, 3)])
        item = lambda x: F.conv(F.substring(F.md5(F.concat_ws(" ", x["w1"], x["w2"], x["w3"]).cast("binary")), 1, 8), 16, 10).cast("long")
        return self.words.select("content_id", F.when(F.size("words") >= 3, F.transform(runs, item)).alias("fp"))

    @cached_property
    def fingerprints(self) -> DataFrame:
        """``fingerprint`` packed (content_id, n, items) and written once, for what reads it several times."""
        return settled(packed(self._runs))

    @cached_property
    def lookup(self) -> DataFrame:
        """(request_hash, content_id, response): responses of a metadata service, some without a match, some broken."""
        p = F.col("p_partkey")
        artist = lambda n: F.concat(F.lit('{"id":"a'), ((p * n) % 40).cast("string"), F.lit('","name":"Artist '), ((p * n) % 40).cast("string"), F.lit('"}'))
        result = lambda k, s: F.concat(F.lit('{"id":"r'), (p * 10 + k).cast("string"), F.lit('","score":'), (((p * s) % 100) / 100.0).cast("string"), F.lit(',"recordings":[{"id":"m'), (p * 10 + k).cast("string"), F.lit('","title":"'), F.col("p_name"), F.lit('","artists":['), artist(3), F.lit(","), artist(7), F.lit('],"releasegroups":[{"id":"g'), (p % 30).cast("string"), F.lit('","title":"Album '), (p % 30).cast("string"), F.lit('","type":"Album"}]}]}'))
        response = (
            F.when(p % 11 == 0, F.lit("{broken"))
            .when(p % 7 == 0, F.lit('{"status":"ok","results":[]}'))
            .when(p % 13 == 0, F.lit('{"status":"error"}'))
            .otherwise(F.concat(F.lit('{"status":"ok","results":['), result(1, 17), F.lit(","), result(2, 29), F.lit("]}")))
        )
        return self.table("part").select(F.sha2(F.concat(F.lit("request "), p.cast("string")), 256).alias("request_hash"), p.alias("content_id"), response.alias("response"))
