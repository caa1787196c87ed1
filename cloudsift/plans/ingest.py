"""The ingest job: delimited text files → typed, shuffled, sharded Parquet.

S1 (list, sorted, fail if none; one pass over the raw files stages the records
with their file and position, W1b; columns by name, U1; missing tokens nulled,
types inferred) → narrow types (S2) → a keyed bijection of the line numbers
(W1) → shards (W2) → sharded write (S3/S4) → reports (A1, A10, A11, W6).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudsift.operators.permute import by_ranges, permute_rows
from cloudsift.operators.ranks import assign_shards
from cloudsift.roles import Roles
from cloudsift.sources import shards as SH
from cloudsift.sources import tables as TB


@dataclass
class IngestResult:
    path: str
    rows_per_file: DataFrame  # A1
    shard_report: DataFrame  # A10
    cumulative: DataFrame  # W6
    reduction: DataFrame  # A11


def read_keyed(spark: SparkSession, pattern: str, roles: Roles | None = None, sep: str = "\t") -> DataFrame:
    """Every data record of every file as typed columns plus ``SOURCE_KEY``
    (its file, its line there, its number in the input). Files may have unlike
    columns (U1); ids and categories stay text."""
    text = (*roles.categorical, *([roles.id_col] if roles.id_col else [])) if roles else ()
    return TB.read_tables(spark, pattern, sep, with_source=True, with_number=True, text_columns=text)


def run_ingest(spark: SparkSession, pattern: str, out: str, roles: Roles, n_shards: int = 10,
               seed: int = 42, sep: str = "\t") -> IngestResult:
    """The whole job. Rows are permuted by their number in the input, which is
    dense and unique whatever the columns hold, so a repeated or skewed
    ``row_key`` neither collects in a task nor makes the order depend on the
    partitioning; the rows move once, to the task that writes their range."""
    df = TB.normalise_types(read_keyed(spark, pattern, roles, sep), roles)
    n = df.count()
    placed = assign_shards(permute_rows(df, "source_row", n, seed).withColumn("n_rows", F.lit(n).cast("bigint")), n_shards)
    SH.write_shards(by_ranges(placed.drop("source_row"), n, SH.ROWS_PER_FILE), out)
    rep = SH.shard_report(spark, out)
    return IngestResult(
        path=out,
        rows_per_file=df.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("source_file"), "n")),
        shard_report=rep,
        cumulative=SH.cumulative_size(rep),
        reduction=SH.size_reduction(spark, pattern, out),
    )
