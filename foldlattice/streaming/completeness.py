"""Which queries are complete, from part reports that arrive in any order, late or twice.

A search reports each (query, chunk) with its return code and number of rows.  Queries are dealt out to buckets by a
hash; a bucket's state holds the chunks of each of its queries that have succeeded, as bits, and their rows, and one
call takes all of a bucket's reports in a batch.  A query is told once, when its last chunk comes in.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldlattice.streaming.sweep import shared_folder, write_dealt


def completed_queries(parts: DataFrame, chunks: int, buckets: int = 1024) -> DataFrame:
    """``query_id, chunks, rows`` of each query once all of ``chunks`` have come in with rc 0.

    ``parts`` is a stream of query_id, chunk (from 0), rc and rows.  A chunk counts by its first success; failed
    and repeated reports change nothing, and a told query isn't told again.  A call holds one bucket of queries,
    so ``buckets`` should grow with their number once they are tens of millions.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = pd.concat(frames, ignore_index=True).drop_duplicates(["query_id", "chunk"])
        ids, bits, rows = pickle.loads(state.get[0]) if state.exists else (got["query_id"].iloc[:0], np.zeros((0, -(-chunks // 8)), np.uint8), np.zeros(0, np.int64))
        # held queries keep their places, new ones follow
        place, known = pd.factorize(pd.concat([ids, got["query_id"]]), use_na_sentinel=False)
        place, new = place[len(ids) :], len(known) - len(ids)
        bits, rows = np.pad(bits, ((0, new), (0, 0))), np.pad(rows, (0, new))
        before = np.bitwise_count(bits).sum(axis=1) == chunks
        chunk, count = (got[c].to_numpy(np.int64) for c in ("chunk", "rows"))
        fresh = bits[place, chunk >> 3] >> (chunk & 7) & 1 == 0
        np.bitwise_or.at(bits, (place[fresh], chunk[fresh] >> 3), (1 << (chunk[fresh] & 7)).astype(np.uint8))
        np.add.at(rows, place[fresh], count[fresh])
        told = (np.bitwise_count(bits).sum(axis=1) == chunks) & ~before
        state.update((pickle.dumps((pd.Series(known), bits, rows)),))
        if told.any():
            yield pd.DataFrame({"query_id": known[told], "chunks": chunks, "rows": rows[told]})

    kind = dict(parts.dtypes)["query_id"]
    bucket = F.when(F.col("query_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("query_id"), F.lit(buckets)))
    good = parts.where(f"rc = 0 AND chunk BETWEEN 0 AND {chunks - 1}").select("query_id", "chunk", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), bucket.alias("bucket"))
    return good.groupBy("bucket").applyInPandasWithState(step, f"query_id {kind}, chunks int, rows long", "held binary", "append", GroupStateTimeout.NoTimeout)


def completed_by_files(parts: DataFrame, chunks: int, files: int) -> DataFrame:
    """Write reports as files, read them as a stream in about ``files`` batches, and return all queries told."""
    spark = parts.sparkSession
    folder = f"{shared_folder(spark)}/completeness-{uuid.uuid4().hex}"
    own = parts.select("query_id", "chunk", "rc", "rows")
    a_batch = write_dealt(own, f"{folder}/in", files)
    if not a_batch:
        return spark.createDataFrame([], f"query_id {dict(own.dtypes)['query_id']}, chunks int, rows long")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", a_batch).parquet(f"{folder}/in").select(own.columns)
    told = completed_queries(stream, chunks)
    told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{folder}/out")
