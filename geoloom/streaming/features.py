"""The feature filter on a stream of landed GeoJSONL files."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import geometry as G
from ..operators.filters import normalize_props, shape_filter
from ..sources.readers import parse_lines
from ..sources.scratch import exists, rename


def filter_lines(lines: DataFrame, rings: list, schema: dict[str, str]) -> DataFrame:
    """Feature lines within a polygon, their properties normalised; the same for batches and streams."""
    rows = parse_lines(lines).where("not is_bad")
    rows = rows.select(
        F.get_json_object("line", "$.geometry").alias("geometry"),
        F.get_json_object("line", "$.geometry.type").alias("geom_type"),
        F.get_json_object("line", "$.properties").alias("properties"),
    )
    # worked out once, in generators; as plain columns both would be worked out again for each use in the filter
    rows = rows.withColumn("coords", F.explode(F.array_compact(F.array(G.coords_from_json(F.col("geometry"))))))
    rows = rows.withColumn("bbox", F.explode(F.array(G.bbox(F.col("coords")))))
    return normalize_props(shape_filter(rows, rings), schema)


class Counters(StreamingQueryListener):
    """Rows, unparsed rows and bytes of every batch of a query, summed as the batches end."""

    def __init__(self):
        self.total: dict[str, dict[str, int]] = {}
        self.ended: dict[str, Event] = {}

    def _of(self, run: str) -> dict[str, int]:
        return self.total.setdefault(run, {"count": 0, "unparsed": 0, "bytes": 0})

    def onQueryStarted(self, event):
        self.ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get("features")
        if seen is not None:
            total = self._of(str(event.progress.runId))
            for k in total:
                total[k] += int(seen[k] or 0)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.setdefault(str(event.runId), Event()).set()

    def of(self, query, seconds: float = 60) -> dict[str, int]:
        """What a query that has ended saw; waits until its last batch has been reported, and raises ``TimeoutError`` if it isn't in time."""
        if not self.ended.setdefault(str(query.runId), Event()).wait(seconds):
            raise TimeoutError(f"the end of the query was not reported within {seconds} seconds")
        return dict(self._of(str(query.runId)))


def stream_filter(spark: SparkSession, in_dir: str, out_dir: str, rings: list, schema: dict[str, str], checkpoint: str, files: int = 1000, counters: Counters | None = None):
    """Start a query that filters files as they land; ends when all present ones are done. ``counters`` adds up what it observes."""
    if counters is not None:
        spark.streams.addListener(counters)
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(in_dir).withColumnRenamed("value", "line")
    bad = F.try_parse_json("line").isNull()
    lines = lines.observe("features", F.count(F.lit(1)).alias("count"), F.count_if(bad).alias("unparsed"), F.sum(F.octet_length("line")).alias("bytes"))
    out = filter_lines(lines, rings, schema).select("geometry", "properties.*")
    return out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: Published batches of a ledger: a folder for each stream and batch.
BATCHES = "stream=*/batch=*"


def process_new(spark: SparkSession, landing: str, done: str, fn, checkpoint: str, schema: str, key: str = "dataset"):
    """Process datasets as they land, each exactly once; ``done`` is the ledger.

    ``schema`` is that of the landing files. A dataset that lands again, in the
    same batch or later, is left out; one without a key is never new.

    ``fn`` gets a batch's new rows and returns what becomes of them, or None. A
    batch stands under its number: first the rows that were chosen, then the
    results, and one rename publishes both. A batch that was published is
    passed over when it is played again; one that was broken off goes on with
    the rows that were chosen then, and its results are written anew. What
    ``fn`` does beyond its results may thus happen again, so leave that out or
    make it repeatable. Renames of folders must be atomic in the file system.
    """

    def batch(df: DataFrame, number: int) -> None:
        stream = spark.read.json(f"{checkpoint}/metadata").first()["id"]  # a new checkpoint counts its batches anew
        pending, published = (f"{done}/stream={stream}/{name}={number}" for name in ("_batch", "batch"))
        if exists(spark, published):
            return
        if not exists(spark, f"{pending}/rows/_SUCCESS"):
            new = df.where(F.col(key).isNotNull()).dropDuplicates([key])
            if exists(spark, f"{done}/{BATCHES}/rows"):
                new = new.join(spark.read.schema(df.schema).parquet(f"{done}/{BATCHES}/rows").select(key), key, "left_anti")
            new.select(df.columns).write.mode("overwrite").parquet(f"{pending}/rows")
        result = fn(spark.read.schema(df.schema).parquet(f"{pending}/rows"))
        if result is not None:
            result.write.mode("overwrite").parquet(f"{pending}/results")
        rename(spark, pending, published)

    return spark.readStream.schema(schema).json(landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def processed(spark: SparkSession, done: str) -> DataFrame:
    """The results of all published batches; raises where there are none."""
    return spark.read.parquet(f"{done}/{BATCHES}/results")
