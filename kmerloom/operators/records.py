"""Record batches: checked ranges, normalised (separator-joined) form and the layout of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kmerloom.config import Config
from kmerloom.functions import kmers as K


def _in_order(group: str | None):
    return Window.partitionBy(*([group] if group else [])).orderBy("record_index")


def validated(ranges: DataFrame, config: Config, total: str = "total_bytes", group: str | None = None) -> DataFrame:
    """Ranges (record_index, sequence_offset, sequence_bytes, total bytes of the text) with a column `problem`: null, or what is wrong."""
    end, w = F.col("sequence_offset") + F.col("sequence_bytes"), config.alphabet.width
    before = F.lag(end).over(_in_order(group))
    return ranges.withColumn(
        "problem",
        F.when((F.col("sequence_offset") < 0) | (F.col("sequence_bytes") < 0) | (end > F.col(total)), "record range is out of bounds")
        .when(before > F.col("sequence_offset"), "record ranges overlap or are out of order")
        .when(F.col("sequence_bytes") % w != 0, "record length is not a multiple of the symbol width"),
    )


def require_valid(ranges: DataFrame, config: Config, total: str = "total_bytes", group: str | None = None) -> DataFrame:
    """The ranges, or an error when one is wrong."""
    v = validated(ranges, config, total, group)
    return v.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("problem")).cast("boolean"))).drop("problem")


def _padded(n: Column, w: int) -> Column:
    return F.ceil(n / w) * w


def normalized(records: DataFrame, config: Config, sequence: str = "sequence", group: str | None = None) -> DataFrame:
    """group, record_index, input_offset (in the joined payload), size, valid_kmers of each record in a batch."""
    size = F.octet_length(sequence).cast("long")
    before = F.coalesce(F.sum(size).over(_in_order(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return records.select(*([group] if group else []), "record_index", before.alias("input_offset"), size.alias("size"), K.valid_kmer_count(F.col(sequence), config).alias("valid_kmers"))


def layout(meta: DataFrame, config: Config, group: str | None = None) -> DataFrame:
    """normalized()'s rows with hit_offset and hit_count: where a record's windows stand in the windows of the separator-joined text."""
    w, k = config.alphabet.width, config.k
    rows = _in_order(group).rowsBetween(Window.unboundedPreceding, -1)
    # A separator stands before a record only if the text isn't empty by then.
    out = meta.withColumn("__pad", _padded(F.col("size"), w)).withColumn("__before", F.coalesce(F.sum("__pad").over(rows), F.lit(0)))
    first = F.min(F.when(F.col("size") > 0, F.col("record_index"))).over(Window.partitionBy(*([group] if group else [])))
    out = out.withColumn("__gap", F.when(F.col("record_index") > first, w).otherwise(0))
    gaps = F.sum("__gap").over(_in_order(group).rowsBetween(Window.unboundedPreceding, 0))
    count = F.greatest(F.floor(F.col("size") / w) - k + 1, F.lit(0)).cast("long")
    return out.withColumn("hit_offset", ((F.col("__before") + gaps) / w).cast("long")).withColumn("hit_count", count).drop("__pad", "__before", "__gap")


def joined_text(records: DataFrame, config: Config, sequence: str = "sequence", group: str | None = None) -> DataFrame:
    """The separator-joined text of each batch: group, normalized. A batch is one text in memory, as in its source."""
    a = config.alphabet
    ordered = F.array_sort(F.collect_list(F.struct("record_index", F.col(sequence).alias("s"))))
    text = F.array_join(F.transform(ordered, lambda r: F.rpad(r["s"], (_padded(F.length(r["s"]), a.width)).cast("int"), F.lit(a.separator))), a.separator * a.width)
    return records.groupBy(*([group] if group else [])).agg(text.alias("normalized"))


def total_valid(meta: DataFrame) -> DataFrame:
    return meta.agg(F.coalesce(F.sum("valid_kmers"), F.lit(0)).cast("long").alias("total_valid_kmers"))
