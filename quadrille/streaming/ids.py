"""An exact set of ids on disk, for batches and streams that go on for ever.

Ids are kept as SHA-1 digests in 256 buckets by the digest's first byte, with a Bloom filter a bucket. A batch meets the
filters first; only ids that a filter may know are looked up, and only in the buckets they fall into. What is new is
written as one segment, whose entry in the log makes it count, so a batch that is cut off leaves nothing behind, and one
that is tried again is not taken twice. A stream holds no state of its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quadrille.sources.versions import Log
from quadrille.storage import stored

BUCKETS, BITS, PROBES = 256, 10, 5
FILTERS = "bucket int, bits binary"


def _probes(digests: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers of digests (hex) in a filter of so many bits, one row a probe."""
    raw = np.array([bytes.fromhex(d) for d in digests], "S20").view("u1").reshape(-1, 20)
    a, b = (np.ascontiguousarray(raw[:, k : k + 8]).view(">u8")[:, 0].astype(np.uint64) for k in (2, 10))
    return np.stack([(a + np.uint64(i) * (b | np.uint64(1))) % np.uint64(size) for i in range(PROBES)])


def filter_of(digests: np.ndarray) -> bytes:
    bits = np.zeros(max(64, len(digests) * BITS) // 8 * 8, bool)
    bits[_probes(digests, len(bits)).ravel().astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_know(bits: bytes, digests: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return held[_probes(digests, len(held)).astype(np.int64)].all(axis=0)


class IdStore:
    """Ids are the values of some columns together; rows in which one of them is null have no id and are left out."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)
        self.schema, self.keys = schema, schema.fieldNames()
        self.rows = StructType([*schema.fields, StructField("digest", StringType()), StructField("bucket", IntegerType())])

    def _segments(self, part: str) -> list[str]:
        return [f"{self.path}/{name}/{part}" for name in self.log.entries().values()]

    def _read(self) -> DataFrame:
        """All ids with digest and bucket; a filter on the bucket reads those folders only."""
        found = [self.spark.read.schema(self.rows).parquet(p) for p in self._segments("ids")]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], self.rows)

    def ids(self) -> DataFrame:
        return self._read().select(*self.keys)

    def _digested(self, batch: DataFrame) -> DataFrame:
        digest = F.sha1(F.to_json(F.struct(*self.keys)))
        rows = batch.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).dropna().distinct()
        return rows.withColumn("digest", digest).withColumn("bucket", F.conv(F.substring("digest", 1, 2), 16, 10).cast("int"))

    def suspects(self, rows: DataFrame) -> DataFrame:
        """(digest, bucket) of rows that a filter may know. Digests fall evenly into buckets, so a bucket's rows are a
        256th of the batch."""

        def judge(own: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            digests = own["digest"].to_numpy(str)
            known = np.zeros(len(digests), bool)
            for bits in filters["bits"] if len(digests) else ():
                known |= may_know(bits, digests)
            return own[known][["digest", "bucket"]]

        filters = self.spark.read.schema(FILTERS).parquet(*self._segments("filters"))
        return rows.select("digest", "bucket").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(judge, "digest string, bucket int")

    def add(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """The ids of the batch that the store did not have, which it has from now on. ``number``: of a stream's batch; if
        it is in the log already, what it added then."""
        entries = self.log.entries()
        number = max(entries, default=-1) + 1 if number is None else number
        if number not in entries:
            rows = stored(self._digested(batch), "ids")
            if entries:
                met = stored(self.suspects(rows), "suspects")
                touched = [r["bucket"] for r in met.select("bucket").distinct().collect()]  # 256 at most
                known = self._read().where(F.col("bucket").isin(touched)).join(met, ["digest", "bucket"], "left_semi").select("digest")
                rows = rows.join(known, "digest", "left_anti")
            folder = self.log.new_folder(number)
            rows.select(*self.keys, "digest", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/ids")
            written = self.spark.read.schema(self.rows).parquet(f"{folder}/ids")
            make = lambda pdf: pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "bits": [filter_of(pdf["digest"].to_numpy(str))]})
            written.select("digest", "bucket").groupBy("bucket").applyInPandas(make, FILTERS).write.parquet(f"{folder}/filters")
            self.log.commit(number, folder)
            entries = self.log.entries()
        return self.spark.read.schema(self.rows).parquet(f"{self.path}/{entries[number]}/ids").select(*self.keys)


def dedup_stream(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run a stream until its files are done and give all ids that the store has then."""
    store = IdStore(stream.sparkSession, path, stream.select(*keys).schema)

    def take(batch: DataFrame, number: int) -> None:
        store.add(batch, number)

    query = stream.select(*keys).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(take).start()
    query.awaitTermination()
    return store.ids()
