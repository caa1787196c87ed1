"""Delimited text ingest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cloudsift.operators.ranks import MAX_BROADCAST_SPLITS
from cloudsift.roles import Roles
from cloudsift.session import staged

# Tokens the pandas CSV reader treats as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")


def list_inputs(spark: SparkSession, pattern: str) -> list[str]:
    """Files matching a glob, sorted by name; FileNotFoundError when none.
    Only the listing (names) passes through the driver."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    statuses = fs.globStatus(path) or []
    files = sorted(str(s.getPath().toString()) for s in statuses if s.isFile())
    if not files:
        raise FileNotFoundError(f"no input files match {pattern}")
    return files


def null_tokens(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Missing-value tokens → null in every string column."""
    toks = list(tokens)
    clean = lambda c: F.when(c.isin(toks), F.lit(None)).otherwise(c)
    return df.select(*((clean(F.col(f"`{f.name}`")) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")).alias(f.name)
                       for f in df.schema.fields))


#: What counts as a number in text: digits with an optional sign, point and
#: exponent, or infinity. (Spark's cast also takes "12d" or "7f"; those are text.)
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[Ii]nf(inity)?)\s*$"


def infer_types(df: DataFrame, text_columns=()) -> DataFrame:
    """One scan decides, per string column, as the pandas reader would:
    bigint if every value is an integer and none is missing, double if every
    non-missing value is a number, else string. ``text_columns`` stay text
    whatever they hold (ids and categories such as 007)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in text_columns]
    if not cols:
        return df
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, c in enumerate(cols):
        col = F.col(f"`{c}`")
        aggs += [F.count(col).alias(f"n{k}"),
                 F.count(F.when(col.rlike(_INTEGER), F.trim(col).try_cast("bigint"))).alias(f"i{k}"),
                 F.count(F.when(col.rlike(_NUMBER), F.trim(col).try_cast("double"))).alias(f"d{k}")]
    stats = df.agg(*aggs).first()
    casts = {}
    for k, c in enumerate(cols):                    # the scan has proved that no cast fails
        n, i, d = stats[f"n{k}"], stats[f"i{k}"], stats[f"d{k}"]
        if n > 0 and i == n and n == stats["rows"]:
            casts[c] = F.trim(F.col(f"`{c}`")).try_cast("bigint")
        elif n > 0 and d == n:
            casts[c] = F.trim(F.col(f"`{c}`")).try_cast("double")
    return df.select(*(casts.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns)) if casts else df


MAX_COLUMNS = 128

#: What ``read_records`` adds to the data columns: the file's name, the record's
#: number in it (1 for the first after the header), and its number in the whole
#: input (from 0, files in the order of their paths, dense).
SOURCE_KEY = ("source_file", "source_line", "source_row")


def _column_names(head):
    """The names of a header as the pandas reader gives them: an empty name is
    ``Unnamed: i``, the second of two equal names ``name.1``."""
    named = F.transform(head, lambda x, i: F.coalesce(x, F.concat(F.lit("Unnamed: "), i.cast("string"))))

    def unlike(x, i):
        earlier = F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: y == x))
        return F.when(earlier > 0, F.concat(x, F.lit("."), earlier.cast("string"))).otherwise(x)

    return F.transform(named, unlike)


def _widest_record(spark: SparkSession, files: list[str], sep: str, most: int, multi_line: bool) -> int:
    """At least the number of fields of every record, and at most ``most``:
    one more than the separators of any line. Lines are records unless quotes
    are left once the quoted fields that end on their line are taken out; then
    a record may go on over lines, and the answer is ``most``."""
    lines = spark.read.option("lineSep", "\n").text(files)
    value, cut = F.col("value"), re.escape(sep)
    seps = F.max((F.length(value) - F.length(F.replace(value, F.lit(sep), F.lit("")))) / len(sep))
    # possessive: no turning back on long fields
    quoted = rf'(?:^|(?<={cut}))"(?:[^"]++|"")*+"(?=\r?$|{cut})'
    left = F.when(value.contains('"'), F.regexp_replace(value, quoted, "").contains('"'))
    got = lines.agg(seps.alias("seps"), F.coalesce(F.bool_or(left), F.lit(False)).alias("left")).first()
    return most if multi_line and got.left else max(1, min(most, int(got.seps or 0) + 1))


def _raw_records(spark: SparkSession, files: list[str], sep: str, columns: list[str], multi_line: bool) -> DataFrame:
    """The fields of every record (headers too) as one array ``_f`` up to the
    last that is not empty, with the split it comes from."""
    schema = ", ".join(f"{c} string" for c in columns)
    if multi_line:
        read = (spark.read.schema(schema).option("sep", sep).option("header", False).option("multiLine", True)
                .option("escape", '"').option("mode", "PERMISSIVE").csv(files))
        fields = F.array(*columns)
    else:                                     # blank lines are no records, as for the pandas reader
        read = spark.read.text(files).where(~F.col("value").rlike("^ *$"))
        parsed = F.from_csv("value", schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})
        fields = F.array(*(F.col("_r").getField(c) for c in columns))
        read = read.withColumn("_r", parsed)
    split = [F.col("_metadata.file_path").alias("_fp"), F.col("_metadata.file_name").alias("_fn"),
             F.col("_metadata.file_block_start").alias("_fs"), F.monotonically_increasing_id().alias("_mid")]
    last = F.array_max(F.transform("_f", lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)))
    rec = read.select(*split, fields.alias("_f")).withColumn("_width", last)
    return rec.withColumn("_f", F.slice("_f", F.lit(1), F.col("_width")))


def read_records(spark: SparkSession, pattern: str, sep: str = "\t", max_columns: int = MAX_COLUMNS,
                 multi_line: bool | None = None) -> DataFrame:
    """Every data record of every file as text columns, matched by the name in
    its own file's header (a column that a file lacks is null), plus
    ``SOURCE_KEY``. Equal names in one header are told apart as ``name``,
    ``name.1``. A record with more fields than its header, equal names that
    cannot be told apart, and columns named as ``SOURCE_KEY`` raise ValueError:
    nothing is left out silently. Only headers: no rows.

    A look at the lines finds how many fields a record can have, so that no
    more are parsed. Then the records (quotes honoured, blank lines skipped) are
    read once and staged in the shared folder with their file, split and position. The
    header is the first record of a file; a header row yields null in every
    column, under any plan the optimizer makes of it, and is then dropped, so
    a filter, cast or join that moves below that step never meets its text.

    ``multi_line`` honours line breaks inside quotes, but makes a task of each
    file. By default it is on where that costs nothing (every file is gzip,
    which cannot be split) and off for plain files, which are split."""
    files = list_inputs(spark, pattern)
    if multi_line is None:
        multi_line = all(f.endswith(".gz") for f in files)
    width = _widest_record(spark, files, sep, max_columns + 1, multi_line)
    rec = staged(_raw_records(spark, files, sep, [f"_c{i}" for i in range(width)], multi_line), "records")
    splits = staged(rec.groupBy("_fp", "_fn", "_fs").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"), F.max("_width").alias("_widest")), "splits")
    # one row per file: its header, its widest record, the data records of the files before it
    per_file = splits.groupBy("_fp", "_fn").agg(F.min_by("_m0", "_fs").alias("_mid"), F.sum("_n").alias("_rows"), F.max("_widest").alias("_widest"))
    before = Window.orderBy("_fp").rowsBetween(Window.unboundedPreceding, -1)
    heads = staged(rec.select("_fp", "_mid", F.col("_f").alias("_head")).join(per_file, ["_fp", "_mid"]).select(
        "_fp", "_fn", "_widest", F.size("_head").alias("_n_names"), _column_names(F.col("_head")).alias("_names"),
        F.coalesce(F.sum(F.col("_rows") - 1).over(before), F.lit(0)).alias("_rows_before")), "headers")
    wrong = heads.select("_fn", (F.col("_n_names") > max_columns).alias("many"), (F.col("_widest") > F.col("_n_names")).alias("wide"),
                         (F.size(F.array_distinct("_names")) < F.col("_n_names")).alias("equal")).where("many or wide or equal").first()
    if wrong:
        raise ValueError(f"{wrong._fn}: " + (f"more than {max_columns} columns: pass max_columns" if wrong.many else
                         "a record has more fields than the header" if wrong.wide else "column names that cannot be told apart"))
    named = heads.select("_fp", F.posexplode("_names").alias("_i", "_name")).groupBy("_name").agg(F.min(F.struct("_fp", "_i")).alias("_at"))
    every = [r._name for r in named.orderBy("_at").select("_name").collect()]          # distinct column names
    if set(every) & set(SOURCE_KEY):
        raise ValueError(f"columns must not be named {SOURCE_KEY}")
    in_file = Window.partitionBy("_fp").orderBy("_fs").rowsBetween(Window.unboundedPreceding, -1)
    # per split: the record number of its first record in the file, and where each column stands in a record
    places = F.array(*(F.array_position("_names", name).cast("int") - 1 for name in every)) if every else F.array().cast("array<int>")
    starts = splits.select("_fp", "_fs", "_m0", F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_before")).join(
        heads.select("_fp", "_fn", "_rows_before", places.alias("_places")), "_fp")
    few = splits.count() * (len(every) + 8) <= MAX_BROADCAST_SPLITS * 16
    data = rec.select("_fp", "_fs", "_mid", "_f").join(F.broadcast(starts) if few else starts, ["_fp", "_fs"])
    data = data.withColumn("_line", F.col("_before") + F.col("_mid") - F.col("_m0"))        # 0: the header
    place = lambda i: F.get("_places", F.lit(i))
    cols = [F.when((F.col("_line") > 0) & (place(i) >= 0), F.get("_f", place(i))).alias(name) for i, name in enumerate(every)]
    return data.where(F.col("_line") > 0).select(
        *cols, F.col("_fn").alias("source_file"), F.col("_line").cast("bigint").alias("source_line"),
        (F.col("_rows_before") + F.col("_line") - 1).cast("bigint").alias("source_row"))


def read_tables(spark: SparkSession, pattern: str, sep: str = "\t", schema=None,
                infer: bool = True, with_source: bool = False, text_columns=(), multi_line: bool | None = None,
                with_number: bool = False) -> DataFrame:
    """Every file of the glob, header line first, columns matched by name,
    missing tokens nulled, types inferred (or taken from ``schema``);
    ``text_columns`` stay text. ``with_source`` adds ``source_file`` and
    ``source_line``, ``with_number`` adds ``source_row``; see ``read_records``
    for ``multi_line`` and for what raises."""
    df = null_tokens(read_records(spark, pattern, sep, multi_line=multi_line))
    if schema is not None:
        fields = schema.fields if hasattr(schema, "fields") else spark.createDataFrame([], schema).schema.fields
        df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields), *SOURCE_KEY)
    elif infer:
        df = infer_types(df, {*text_columns, "source_file"})
    return df.drop(*(() if with_source else SOURCE_KEY[:2]), *(() if with_number else SOURCE_KEY[2:]))


def normalise_types(df: DataFrame, roles: Roles, strict: bool = True) -> DataFrame:
    """Float / smallint / string for the role columns that exist.
    ``strict`` raises on a smallint overflow (ANSI cast); else try_cast → null."""
    present = set(df.columns)
    casts = {}
    for c in roles.float_cols:
        if c in present:
            casts[c] = F.nanvl(F.col(c).cast("float"), F.lit(None).cast("float"))
    for c in roles.smallint_cols:
        if c in present:
            casts[c] = F.col(c).cast("smallint") if strict else F.col(c).try_cast("smallint")
    for c in roles.categorical:
        if c in present:
            casts[c] = F.col(c).cast("string")
    return df.withColumns(casts) if casts else df


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """Stack inputs, columns matched by name, missing → null, duplicates kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def row_counts(df: DataFrame, file: str = "source_file") -> DataFrame:
    """A1: rows per input file (of ``read_tables`` with its source), plus the
    total (file = null)."""
    return df.select(F.col(file).alias("file")).rollup("file").agg(F.count(F.lit(1)).alias("n"))
