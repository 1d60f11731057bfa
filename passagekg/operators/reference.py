"""Reference tables: join of two databases and analysis of the merged table (SRC10-SRC12, J2, J4, A10-A13, F12).

Defined results: null refcodes are dropped before the join; of repeated refcodes the first row (by the given order)
is kept on either side; values that are no number count as missing; a ratio over nothing is 0.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekg.functions.text import elements_in, strip

# Solvents that identifiers name; others are reported as CID_n.
CID_NAMES = {962: "water", 6228: "DMF", 174: "ethanol", 887: "methanol", 31374: "DEF"}
# Metal and linker part that a framework's definition states.
COMPOSITIONS = {
    "Cu₃(BTC)₂": ("Cu", "benzenetricarboxylic"),
    "MIL-101(Cr)": ("Cr", "terephthalic"),
    "ZIF-8": ("Zn", "methylimidazole"),
    "UiO-66 node": ("Zr", "terephthalic"),
    "UiO-66-NH₂": ("Zr", "terephthalic"),
    "%AA UiO-66-NH₂": ("Zr", "terephthalic"),
    "MM@UiO-66": ("Zr", "terephthalic"),
    "UiO-67-Ti": ("Zr", "biphenyl"),
    "MOF-801": ("Zr", "fumaric"),
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC10, SRC11: a CSV (with header) or Parquet export of a database."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def digimof_rows(df: DataFrame, refcode: str = "refcode") -> DataFrame:
    return df.where(F.col(refcode).isNotNull()).withColumn(refcode, strip(F.col(refcode).cast("string")))


def synmof_rows(df: DataFrame, filename: str = "filename") -> DataFrame:
    return df.withColumn("refcode", strip(F.replace(F.col(filename).cast("string"), F.lit("_clean"), F.lit(""))))


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """First row per key. min_by combines map-side, so a hot key is reduced before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    placed = df.withColumn("_o", F.struct(*order) if order else F.monotonically_increasing_id())  # without an order: as read
    return placed.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, "_o").alias("_r")).select("_r.*")


def joined(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Inner join of the deduplicated sides; clashing columns of the right get the suffix _r."""
    a = keep_first(left, key, *left_order)
    b = keep_first(right, key, *right_order)
    clash = (set(a.columns) & set(b.columns)) - {key}
    for c in clash:
        b = b.withColumnRenamed(c, f"{c}_r")
    return a.join(b, key)


def join_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and dropped duplicates of both sides, one row per side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_unique")).select(F.lit(name).alias("side"), "n_rows", "n_unique", (F.col("n_rows") - F.col("n_unique")).alias("n_dropped"))

    return side(left, "left").unionByName(side(right, "right"))


def repeated_refcodes(merged: DataFrame) -> DataFrame:
    """SRC12: refcodes that come more than once."""
    return merged.groupBy("refcode").agg(F.count("*").alias("n")).where("n > 1")


def require_unique(merged: DataFrame) -> DataFrame:
    """SRC12 guard: raises when a refcode repeats."""
    if not repeated_refcodes(merged).isEmpty():
        raise ValueError("merged table contains duplicate refcodes; rebuild it with keep_first")
    return merged


FIELDS = ("metal", "clean_linker_1", "cn_topology", "temperature_celsius", "time_h", "yield_percent", "metal_ele1", "solvent1")


def coverage(merged: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A10: non-null count, total and percentage per field, in one aggregation."""
    sums = merged.agg(F.count("*").alias("total"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("n")) for i, c in enumerate(fields)])
    return sums.select("total", F.explode(rows).alias("r")).select("r.field", "r.n", "total", F.when(F.col("total") > 0, F.round(100 * F.col("r.n") / F.col("total"), 1)).otherwise(0.0).alias("pct"))


def solvent_distribution(merged: DataFrame) -> DataFrame:
    """Solvents of all five columns, most common first."""
    names = F.create_map(*[F.lit(x) for k, v in CID_NAMES.items() for x in (k, v)])
    cid = merged.select(F.explode(F.array(*[F.col(f"solvent{i}").cast("int") for i in range(1, 6)])).alias("cid")).where("cid IS NOT NULL")
    label = F.coalesce(F.try_element_at(names, F.col("cid")), F.concat(F.lit("CID_"), F.col("cid")))
    return cid.groupBy(label.alias("solvent")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "solvent")


def metal_distribution(merged: DataFrame) -> DataFrame:
    """Primary metals, nulls left out."""
    return merged.where("metal_ele1 IS NOT NULL").groupBy(F.col("metal_ele1").alias("metal")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "metal")


def conditions(merged: DataFrame) -> DataFrame:
    """Min, max and exact median of temperature and time, median and count of numeric yields."""
    y = F.col("yield_percent").try_cast("double")
    return merged.agg(
        F.min("temperature_celsius").alias("temperature_min"), F.max("temperature_celsius").alias("temperature_max"), F.median("temperature_celsius").alias("temperature_median"),
        F.min("time_h").alias("time_min"), F.max("time_h").alias("time_max"), F.median("time_h").alias("time_median"), F.median(y).alias("yield_median"), F.count(y).alias("n_yield"),
    )


def metal_agreement(merged: DataFrame) -> DataFrame:
    """Rows whose primary metal is among the listed metals, over rows that state both."""
    listed, primary = elements_in(F.col("metal")), elements_in(F.col("metal_ele1"))
    both = (F.size(listed) > 0) & (F.size(primary) > 0)
    agreed = both & (F.size(F.array_except(primary, listed)) == 0)
    n = lambda c: F.count(F.when(c, 1))
    return merged.agg(
        n(agreed).alias("agreed"), n(both).alias("comparable"), (F.count("*") - n(both)).alias("not_comparable"), F.when(n(both) > 0, F.round(100 * n(agreed) / n(both), 1)).otherwise(0.0).alias("pct")
    )


def gold_names(gold: DataFrame) -> DataFrame:
    """Distinct framework names of gold (subjects typed MOF)."""
    return gold.select(F.explode("triples").alias("t")).where("t.subject_type = 'MOF' AND t.subject_name IS NOT NULL").select(F.col("t.subject_name").alias("name")).distinct()


def composition_screen(merged: DataFrame, names: DataFrame, compositions: dict[str, tuple[str, str]] = COMPOSITIONS) -> DataFrame:
    """(name, refcode, metal, linker, topology) of rows whose metal and linker fit a gold framework's definition.

    The compositions are a fixed short list; they are expanded as expressions over one scan of the merged table.
    """
    spark = merged.sparkSession
    table = spark.createDataFrame([(n, m, k) for n, (m, k) in compositions.items()], "name string, has_metal string, has_linker string")
    wanted = names.join(F.broadcast(table), "name")
    rows = merged.select("refcode", "metal", F.col("clean_linker_1").alias("linker"), F.col("cn_topology").alias("topology"), F.explode(elements_in(F.col("metal"))).alias("has_metal"))
    # equi join on the metal first, then the substring test
    return rows.join(F.broadcast(wanted), "has_metal").where(F.lower("linker").contains(F.col("has_linker"))).select("name", "refcode", "metal", "linker", "topology").distinct()
