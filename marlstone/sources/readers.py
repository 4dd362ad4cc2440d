"""Reading and writing the tables that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BARS = "date date, ticker string, open double, high double, low double, close double, volume double"
NEWS = "id string, title string, url string, publisher string, published_at string, published_date_only boolean, summary string"


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV with a header (S1). Columns are matched by name."""
    raw = spark.read.option("header", True).csv(path)
    kinds = {f.split()[0]: f.split()[1] for f in BARS.split(", ")}
    return raw.select(*[(F.expr(f"try_cast({c} AS {k})") if c in raw.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])


def normalize_bars(wide: DataFrame, tickers: list[str]) -> DataFrame:
    """One row for each date and ticker from columns named ticker_field; tickers that lack a field are skipped, as are rows without a close."""
    fields = ["open", "high", "low", "close", "volume"]
    full = [t for t in tickers if all(f"{t}_{f}" in wide.columns for f in fields)]
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), *[F.col(f"`{t}_{f}`").cast("double").alias(f) for f in fields]) for t in full]))
    if not full:
        return wide.sparkSession.createDataFrame([], BARS)
    return wide.select("date", rows.alias("r")).select("date", "r.*").filter("close is not null and not isnan(close)")


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(ticker) from text lines, without blank ones and comments (S3); clean_tickers is applied."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '#')")
    return clean_tickers(lines.select(F.col("value").alias("ticker")))


def clean_tickers(tickers: DataFrame) -> DataFrame:
    """Trimmed, upper case, distinct, none empty."""
    return tickers.select(F.upper(F.trim("ticker")).alias("ticker")).filter("ticker <> ''").distinct()


def dataset_manifest(bars: DataFrame, provider: str, start: str, end: str) -> DataFrame:
    """One row on a table of bars: provider, requested range, tickers, rows."""
    per = bars.agg(F.count("*").alias("row_count"), F.array_sort(F.collect_set("ticker")).alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return per.select(F.lit(provider).alias("provider"), F.lit(start).cast("date").alias("requested_start"), F.lit(end).cast("date").alias("requested_end"), "row_count", "tickers", "first_date", "last_date")


def read_news_archive(spark: SparkSession, path: str, as_of: str | None = None, *, include_hindsight: bool = False) -> DataFrame:
    """News from JSON lines, one file a ticker; bad lines and items without id, title or web address go.

    The first seen (file, then position) of each title and day stays, or of each id and time with hindsight, which is marked.
    """
    raw = spark.read.schema(NEWS + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    df = raw.withColumns({"ticker": F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1), "_pos": F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))})
    df = df.filter("_corrupt_record is null and url rlike '^https?://' and trim(coalesce(title, '')) <> '' and id is not null").drop("_corrupt_record")
    at = F.try_to_timestamp("published_at")
    bare = F.coalesce("published_date_only", F.lit(False)) | (F.length("published_at") == 10)
    at = F.when(bare, F.date_trunc("day", at) + F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND")).otherwise(at)
    df = df.withColumns({"published_at": at, "published_date_only": bare}).filter("published_at is not null")
    df = df.withColumn("hindsight", F.lit(False) if as_of is None else F.col("published_at") > F.lit(as_of).cast("timestamp"))
    key = [F.col("id"), F.col("published_at")] if include_hindsight else [F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""), F.to_date("published_at")]
    kept = df if include_hindsight else df.filter("not hindsight")
    return kept.withColumn("_n", F.row_number().over(W.partitionBy("ticker", *key).orderBy("_pos"))).filter("_n = 1").drop("_n", "_pos")


def read_universe_text(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, sector): lines of tickers under comments that name their sector, such as ``# Energy · 12``."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    named = F.when(F.startswith("line", F.lit("#")), F.trim(F.regexp_extract("line", r"^#\s*([^·]*)", 1)))
    lines = lines.withColumn("sector", F.last(named, ignorenulls=True).over(W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    return lines.filter("line <> '' and not startswith(line, '#')").select(F.upper("line").alias("ticker"), "sector")


def write_pair_fits(fits: DataFrame, path: str) -> None:
    """Fits as Parquet by as_of; only the dates written are replaced; a pair's groups are collected."""
    rest = [c for c in fits.columns if c not in ("as_of", "a", "b", "grp")]
    one = fits.groupBy("as_of", "a", "b").agg(*[F.min_by(c, "grp").alias(c) for c in rest], F.array_sort(F.collect_set("grp")).alias("groups"))
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


def read_pair_fits(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The fits of one date; only its partition is read."""
    return spark.read.parquet(path).filter(F.col("as_of") == F.lit(as_of).cast("date"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet by graph."""
    nodes.write.mode("append").partitionBy("graph_id").parquet(f"{path}/nodes")
    edges.write.mode("append").partitionBy("graph_id").parquet(f"{path}/edges")


def list_runs(runs: DataFrame) -> DataFrame:
    """(graph_id, label, at): the latest run of each graph (S11). runs: (graph_id, label, at)."""
    return runs.groupBy("graph_id").agg(F.max_by("label", "at").alias("label"), F.max("at").alias("at"))
