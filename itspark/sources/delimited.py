"""Delimited text in, small result tables out.

Line breaks inside quotes do not keep a file from being split. A line begins a record if the quotes before it
in its file are even in number. Each task reads the lines of its byte ranges and counts quotes inside a range;
the quotes of whole ranges are summed per file afterwards, and tell of every line whether it begins a record,
and if not, where the record begins that it goes on with. Only the lines of broken records are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itspark.functions.recode import blank_to_null

#: A record of more lines than this is taken for a quote that was never closed.
MAX_LINES = 100_000
LINES = "file string, at long, line long, text string, before int, odd int, even_start long, odd_start long"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files by byte range (file, at): their number in it, whether the quotes before and in
    them are odd, and the last line so far that begins a record if the quotes before the range are even, or odd.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, line, quotes, last = None, 0, 0, [-1, -1]
        for batch in batches:
            if not batch.num_rows:
                continue
            files, at = batch.column("file"), batch.column("at").to_numpy()
            ids = files.dictionary_encode()
            ids = ids.indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(at) != 0)) + 1).tolist(), batch.num_rows]
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for a, b in zip(cuts, cuts[1:]):
                if (files[a].as_py(), int(at[a])) != here:
                    here, line, quotes, last = (files[a].as_py(), int(at[a])), 0, 0, [-1, -1]
                own = pc.count_substring(batch.column("text").slice(a, b - a), '"').to_numpy(zero_copy_only=False).astype(np.int64)
                before = (quotes + np.cumsum(own) - own) % 2
                number = line + np.arange(b - a)
                starts = []
                for odd in (0, 1):
                    found = np.maximum.accumulate(np.where(before == odd, number, -1))
                    starts.append(np.maximum(found, last[odd]))
                line, quotes, last = line + b - a, (quotes + int(own.sum())) % 2, [int(x[-1]) for x in starts]
                for column, value in zip(columns, (number, before, own % 2, *starts)):
                    column.append(value)
            number, before, odd, even_start, odd_start = (np.concatenate(c) for c in columns)
            values = [files, pa.array(at), pa.array(number), batch.column("text"), pa.array(before, pa.int32()), pa.array(odd, pa.int32()), pa.array(even_start), pa.array(odd_start)]
            yield pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in LINES.split(", ")])

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("text"))
    return lines.mapInArrow(work, LINES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``first`` (whether it is the file's first one), and ``record``: lines, or several with the breaks
    between them where quotes hold them together. Empty ones are left out."""
    lines = numbered_lines(spark, path)
    # Quotes of each range, and its last record under either condition; a row for each range.
    of_range = lines.groupBy("file", "at").agg(
        F.sum("odd").alias("odd"), F.max("even_start").alias("even_start"), F.max("odd_start").alias("odd_start")
    )
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("flip") == 0, F.col("even_start")).otherwise(F.col("odd_start"))
    open_record = F.last(F.when(begun >= 0, F.struct("at", begun.alias("line"))), ignorenulls=True).over(earlier)
    ranges = of_range.withColumn("flip", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    ranges = ranges.select("file", "at", "flip", open_record.alias("open"))

    known = lines.join(ranges, ["file", "at"])
    within = (F.col("before") + F.col("flip")) % 2 == 1
    start = F.when(F.col("flip") == 0, F.col("even_start")).otherwise(F.col("odd_start"))
    start = F.when(start >= 0, F.struct("at", start.alias("line"))).otherwise(F.col("open"))
    known = known.select("file", "text", F.struct("at", "line").alias("place"), start.alias("start"), (within | (F.col("odd") == 1)).alias("broken"))
    whole = known.filter(~F.col("broken")).select("file", F.col("place").alias("start"), F.col("text").alias("record"))
    parts = known.filter("broken").groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"))
    never_closed = F.raise_error(F.lit(f"a record has more than {MAX_LINES} lines: is a quote not closed?"))
    joined = F.when(F.size("parts") > MAX_LINES, never_closed.cast("string")).otherwise(F.array_join("parts.text", "\n"))
    every = whole.unionAll(parts.select("file", "start", joined.alias("record")))
    first = (F.col("start.at") == 0) & (F.col("start.line") == 0)
    return every.select("file", first.alias("first"), "record").filter("first or trim(record) != ''")


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    blank_is_null: bool = True,
    sep: str = ",",
    trim: bool | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header line; ``NA`` is null, and so is blank text unless ``blank_is_null`` is off.

    Quotes inside quoted text are doubled; a backslash is a character like any other. ``trim`` takes spaces
    and tabs off both ends of text, quoted or not; by default where blank text is null. ``multi_line``
    allows line breaks inside quotes; files are split among tasks all the same.

    Columns are matched by name. Without a schema every column is text. With one, the columns it does not
    name are skipped, and a value that does not fit its type becomes null.
    """
    # No null text is declared: Spark then reads an unquoted blank as null, a quoted one as '' and NA as NA.
    options = {"sep": sep, "quote": '"', "escape": '"'}
    raw = spark.read.options(header=True, multiLine=multi_line, **options).csv(path)
    names = [c.lstrip("\ufeff") for c in raw.columns]
    if multi_line:
        fields = ", ".join(f"c{k} string" for k in range(len(names)))
        parsed = records(spark, path).filter(~F.col("first")).select(F.from_csv("record", fields, options).alias("r"))
        raw = parsed.select("r.*")
    raw = raw.toDF(*names)
    if schema is None:
        wanted = [T.StructField(c, T.StringType()) for c in raw.columns]
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    trim = blank_is_null if trim is None else trim

    def typed(field):
        col = F.btrim(F.col(f"`{field.name}`"), F.lit(" \t")) if trim else F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            text = blank_to_null(col) if blank_is_null else F.coalesce(col, F.lit(""))
            return F.nullif(text, F.lit("NA")).alias(field.name)
        return col.try_cast(field.dataType).alias(field.name)

    return raw.select(*[typed(f) for f in wanted])


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV in one file per partition, nulls as ``NA``, quotes inside quoted text doubled, white space kept."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, nullValue="NA", emptyValue="", quote='"', escape='"', **spaces).csv(path)


def write_result(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV file, for tables of the size of a printed result."""
    write_delimited(df.coalesce(1), path, mode)
