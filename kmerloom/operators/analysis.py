"""Analysis of benchmark results: metric tables, joins, skyline, pivot, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kmerloom.session import saved

KEYS = ("s", "m", "h")
PARTS = 200


def throughput(items_per_second: Column) -> Column:
    """Items a second in units of 10**9."""
    return items_per_second / 1e9


def medians(runs: DataFrame, *by: str, value: str = "items_per_second") -> DataFrame:
    """The median of repetitions, as throughput."""
    return runs.groupBy(*by).agg(throughput(F.median(value)).alias("throughput"))


def bits_per_item(filter_bits: Column, items: Column) -> Column:
    return F.when(items > 0, filter_bits / items)


def overhead(host: Column, device: Column) -> Column:
    """(1 - host/device) in percent, from 0 to 100; 0 where either isn't positive."""
    share = F.least(F.lit(1.0), host / F.when(device > 0, device))
    return F.when((host > 0) & (device > 0), F.greatest(F.lit(0.0), (1 - share) * 100)).otherwise(F.lit(0.0))


def metric_table(insert: DataFrame, query: DataFrame, fpr: DataFrame, *by: str) -> DataFrame:
    """Outer join of three metric tables on their keys."""
    return insert.join(query, list(by), "outer").join(fpr, list(by), "outer")


def overriding(base: DataFrame, other: DataFrame, *by: str) -> DataFrame:
    """Rows of base whose key isn't in other, and all of other."""
    return base.join(other.select(*by), list(by), "left_anti").unionByName(other, allowMissingColumns=True)


def skyline(points: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """points with `pareto`: no other point is at most as large in both and smaller in one (both are minimised).

    In order of x, then y, a point is dominated if a point before its x has a y of at most its own, or one of the same x a smaller y; so one sort
    replaces the comparison of all pairs. Distinct x are ordered within PARTS ranges of them; what comes before a range is a row for each.
    """
    per_x = points.groupBy(*by, x).agg(F.min(y).alias("__low"))
    ranged = saved(per_x.repartitionByRange(PARTS, x).withColumn("__part", F.spark_partition_id()), "skyline")
    part = ranged.groupBy(*by, "__part").agg(F.min("__low").alias("__least"))
    upto = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    part = part.withColumn("__earlier", F.min("__least").over(upto)).drop("__least")
    own = Window.partitionBy(*by, "__part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.withColumn("__own", F.min("__low").over(own)).join(F.broadcast(part) if not by else part, [*by, "__part"]).withColumn("__before", F.least("__own", "__earlier"))
    out = points.join(before, [*by, x])
    dominated = F.coalesce(F.col("__before") <= F.col(y), F.lit(False)) | (F.col("__low") < F.col(y))
    return out.withColumn("pareto", ~dominated).select(*points.columns, "pareto")


def pivoted(metrics: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    """A heat map's table; values: the columns in order."""
    return metrics.groupBy(row).pivot(column, values).agg(F.first(metric, ignorenulls=True))


def distinct_values(metrics: DataFrame, *columns: str) -> DataFrame:
    """column, value: the sorted distinct values of each."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("value")) for c in columns))).alias("p")
    return metrics.select(pairs).select("p.*").where("value is not null").distinct()


def series_order(metrics: DataFrame, series: str, value: str) -> DataFrame:
    """Series with their largest value and their place by it, largest first (ties by name)."""
    top = metrics.groupBy(series).agg(F.max(value).alias("top"))
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("top"), series)))  # a row a series


def parsed_names(rows: DataFrame, name: str = "name", keep: tuple[str, ...] = ()) -> DataFrame:
    """Benchmark names `fixture/op/size_..._aggregate` and K_S_M_H parameters as columns, and the columns `keep`."""
    n = F.col(name)
    number = lambda tag: F.regexp_extract(n, f"(?:^|[^A-Za-z0-9]){tag}(\\d+)", 1).try_cast("long").alias(tag.lower())
    return rows.select(
        n, F.regexp_extract(n, r"^([^/]+)", 1).alias("fixture"), F.regexp_extract(n, r"(Insert|Query|FPR)", 1).alias("operation"), F.regexp_extract(n, r"/(\d+)(?:/|_|$)", 1).try_cast("long").alias("size"),
        *map(number, ("K", "S", "M", "H")), F.regexp_extract(n, r"_(mean|median|stddev|cv)$", 1).alias("aggregate"), *keep,
    )


def labelled(name: Column, prefixes: dict[str, str]) -> Column:
    """What the first fitting prefix stands for; else the name in lower case."""
    out = F.lower(name)
    for prefix, label in reversed(prefixes.items()):
        out = F.when(name.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def selected(rows: DataFrame, operations: tuple[str, ...] = ("Insert", "Query"), values: tuple[str, ...] = ()) -> DataFrame:
    """Median rows of the given operations whose `values` are all there (neither null nor NaN), with the name's parts."""
    for v in values:
        rows = rows.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    return parsed_names(rows, keep=values).where(F.col("name").endswith("_median") & F.col("operation").isin(*operations))


def stacked(*tables: DataFrame) -> DataFrame:
    """Results of several runs one after the other; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def shares(total: int, parts: int) -> list[tuple[int, int]]:
    """Begin and length of an even split, the remainder in the last part."""
    size = total // parts
    return [(i * size, size if i < parts - 1 else total - size * (parts - 1)) for i in range(parts)]


#: Columns of a benchmark's result table.
RESULT = "name string, real_time double, items_per_second double, fpr_percentage double, false_positives double, filter_bits double, memory_bytes double, bits_per_item double, num_kmers double, s double, m double, hashes double"


def read_results(spark, path: str, columns: str = RESULT) -> DataFrame:
    """Result tables in CSV. Lines before a file's header are skipped; columns are found by their name, missing ones are null."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("ls"))
    first = lines.select("ls", F.array_position(F.transform("ls", lambda x: x.startswith("name,")), True).alias("at")).where("at > 0")
    rows = first.select(F.split(F.element_at("ls", F.col("at").cast("int")), ",").alias("header"), F.explode(F.slice("ls", F.col("at") + 1, F.size("ls"))).alias("line")).where("line <> ''")
    cells = F.transform(F.regexp_extract_all("line", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))
    found = rows.select("header", cells.alias("cells"))
    of = lambda name, kind: F.get(F.col("cells"), (F.array_position("header", name) - 1).cast("int")).try_cast(kind).alias(name)
    at = lambda name, kind: F.when(F.array_contains("header", name), of(name, kind)).alias(name)
    return found.select(*(at(*c.split()) for c in columns.split(", ")))
