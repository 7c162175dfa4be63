"""Domain views derived from the driver tables, in Spark and as SQL fragments.

The grid has one row per supplier and 32 columns, so its size follows the data; years and
months come from ship dates. Values are missing for line 7 and for quantity 13.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 32
DIRECTIONS = ("NORTH", "SOUTH", "EAST", "WEST")
BINS = ("0-30", "30-150")
KERNEL_LABELS = tuple(f"to_{d}_{b}" for d in DIRECTIONS for b in BINS)

#: Lines whose groups meet in one task.
DEAL_ROWS = 1 << 19


class Views:
    """Lazy DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._lines: int | None = None

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def deal(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` dealt by ``keys`` over as many tasks as its lines need, so a task's groups do not grow with the table.

        Adaptive execution sizes tasks by compressed bytes; 64 MB of lines are more than 1 GB as groups. The row
        count comes from the files' footers.
        """
        if self._lines is None:
            self._lines = self.table("lineitem").count()
        return df.repartition(max(self.spark.sparkContext.defaultParallelism, -(-self._lines // DEAL_ROWS)), *keys)

    # -- rasters ---------------------------------------------------------------
    def cells(self) -> DataFrame:
        """(row, col, year, month, value): monthly observations, duplicates allowed."""
        q = F.col("l_quantity")
        return self.table("lineitem").select(
            F.col("l_suppkey").cast("int").alias("row"),
            F.pmod(F.col("l_partkey"), F.lit(WIDTH)).cast("int").alias("col"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
            F.when((F.col("l_linenumber") != 7) & (q != 13), q).alias("value"),
        )

    def annual(self) -> DataFrame:
        """(row, col, year, v): one value per cell-year, NULL when every layer is missing."""
        return self.cells().groupBy("row", "col", "year").agg(F.avg("value").alias("v"))

    def field(self) -> DataFrame:
        """(row, col, v): time mean per cell."""
        return self.cells().groupBy("row", "col").agg(F.avg("value").alias("v"))

    def grid(self) -> DataFrame:
        """(row, col, is_ocean) for every cell of the grid.

        Spark sizes an exploded table like the one before, so joins are told not to broadcast the grid.
        """
        return self.table("supplier").select(
            F.col("s_suppkey").cast("int").alias("row"),
            F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("col"),
        ).withColumn("is_ocean", (F.pmod(F.col("row") * 7 + F.col("col") * 3, F.lit(11)) == 0).cast("int")).hint("merge")

    def land(self) -> DataFrame:
        return self.grid().where("is_ocean = 0").select("row", "col")

    def land_field(self) -> DataFrame:
        """(row, col, v) on land only; land cells without data are absent."""
        return self.field().where("v IS NOT NULL").join(self.land(), ["row", "col"])

    # -- community -------------------------------------------------------------
    def abund(self) -> DataFrame:
        """(cell, species, week, x): weekly abundance, dealt by (cell, species).

        Lines are dealt after the join, where a part that holds a third of them is spread over its cells.
        """
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("species"))
        line = self.table("lineitem").select(
            F.col("l_suppkey").cast("int").alias("cell"),
            "l_partkey",
            F.least(F.lit(51), F.floor((F.dayofyear("l_shipdate") - 1) / 7)).cast("int").alias("week"),
            "l_quantity",
        )
        joined = line.join(part, line.l_partkey == part.p_partkey).select("cell", "species", "week", "l_quantity")
        return self.deal(joined, "cell", "species").groupBy("cell", "species", "week").agg(F.sum("l_quantity").alias("x"))

    def z(self) -> DataFrame:
        """(row, col, z ARRAY<DOUBLE>): latent vector per cell."""
        return self.table("embeddings").select(
            F.floor(F.col("vec_id") / 25).cast("int").alias("row"),
            F.pmod("vec_id", F.lit(25)).cast("int").alias("col"),
            F.col("embedding").cast("array<double>").alias("z"),
        )

    def zlong(self) -> DataFrame:
        """(row, col, dim, zv): one row per latent value."""
        return self.z().select("row", "col", F.posexplode("z").alias("dim", "zv"))

    # -- survey ----------------------------------------------------------------
    def effort(self) -> DataFrame:
        """One row per visit with its quality code."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("visit"),
            F.col("o_custkey").alias("route"),
            F.year("o_orderdate").alias("year"),
            (F.col("o_orderstatus") == "F").cast("int").alias("run_type"),
        )

    def counts(self) -> DataFrame:
        """(visit, species, n): detections per visit and species."""
        part = self.table("part").select("p_partkey", F.col("p_type").alias("species"))
        line = self.table("lineitem").groupBy(F.col("l_orderkey").alias("visit"), "l_partkey").agg(F.sum("l_quantity").alias("q"))
        return (
            line.join(part, line.l_partkey == part.p_partkey)
            .groupBy("visit", "species")
            .agg(F.sum("q").cast("bigint").alias("n"))
        )

    # -- series, traits, rates -------------------------------------------------
    def series(self) -> DataFrame:
        """(user_id, day, x): daily mean per key; absent days are gaps. Decimal sums are order-free."""
        return (
            self.table("events")
            .select("user_id", F.to_date("ts").alias("day"), F.col("value").cast("decimal(12,2)").alias("value"))
            .groupBy("user_id", "day")
            .agg((F.sum("value").cast("double") / F.count("*")).alias("x"))
        )

    def traits(self) -> DataFrame:
        """(part, size, price, qty, disc): numeric traits; disc is missing for small totals."""
        line = self.table("lineitem").groupBy("l_partkey").agg(
            F.sum("l_quantity").alias("qty"),
            F.avg(F.round(F.col("l_discount") * 100).cast("int")).alias("disc"),
        )
        part = self.table("part").select(
            F.col("p_partkey").alias("part"),
            F.col("p_size").cast("double").alias("size"),
            F.col("p_retailprice").alias("price"),
        )
        return part.join(line, part.part == line.l_partkey).select(
            "part", "size", "price", "qty", F.when(F.col("qty") > 100, F.col("disc")).alias("disc")
        )

    def rates(self) -> DataFrame:
        """(row, col, year, Sa, Sj, Fmax, K): demographic rates per cell-year, dealt by these three."""
        line = self.table("lineitem").select(
            F.col("l_suppkey").cast("int").alias("row"),
            F.pmod(F.col("l_partkey"), F.lit(WIDTH)).cast("int").alias("col"),
            F.year("l_shipdate").alias("year"),
            "l_quantity", "l_discount", "l_tax",
        )
        base = self.deal(line, "row", "col", "year").groupBy("row", "col", "year").agg(
            F.avg("l_quantity").alias("q"),
            F.avg(F.round(F.col("l_discount") * 100).cast("int")).alias("d"),
            F.avg(F.round(F.col("l_tax") * 100).cast("int")).alias("t"),
        )
        return base.select(
            "row", "col", "year",
            (F.lit(0.25) + F.col("d") / 16).alias("Sa"),
            (F.lit(0.125) + F.col("t") / 32).alias("Sj"),
            (F.col("q") / 16).alias("Fmax"),
            F.col("q").alias("K"),
        )

    def q_long(self, *keys: str) -> DataFrame:
        """(row, col, year, kernel, Q): journey survival per directional kernel; cell-years dealt by ``keys`` if given."""
        labels = F.array(*[F.lit(k) for k in KERNEL_LABELS])
        years = self.deal(self.rates(), *keys) if keys else self.rates()
        return years.select(
            "row", "col", "year", F.posexplode(labels).alias("k", "kernel")
        ).select(
            "row", "col", "year", "kernel",
            (F.lit(0.25) + F.pmod(F.col("row") + F.col("col") * F.col("k") + F.col("year"), F.lit(8)) / 16.0).alias("Q"),
        )

    def density(self) -> DataFrame:
        """(row, col, year, juv, adult): two life stages per cell-year."""
        return self.cells().groupBy("row", "col", "year").agg(
            F.sum(F.when(F.col("month") <= 4, F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("juv"),
            F.sum(F.when(F.col("month") > 4, F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("adult"),
        )

    def taxonomy(self) -> DataFrame:
        """(code, sci_name, common): code table from nation names, some codes upper case."""
        n = F.col("n_name")
        return self.table("nation").select(
            F.col("n_nationkey").alias("nk"),
            F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.lower(n)).otherwise(n).alias("code"),
            F.concat(F.lit(" Genus_"), n).alias("sci_name"),
            F.concat(F.lit("Bird "), F.col("n_nationkey").cast("string"), F.lit(" ("), n, F.lit(")")).alias("common"),
        )

    def edges(self) -> DataFrame:
        """(child, parent, length): supplier -> nation -> region -> root."""
        sup = self.table("supplier").select(
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"),
            F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"),
            (F.lit(1.0) + F.pmod("s_suppkey", F.lit(5))).alias("length"),
        )
        nat = self.table("nation").select(
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"),
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"),
            (F.lit(1.0) + F.pmod("n_nationkey", F.lit(5))).alias("length"),
        )
        reg = self.table("region").select(
            F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"),
            F.lit("root").alias("parent"),
            (F.lit(1.0) + F.pmod("r_regionkey", F.lit(5))).alias("length"),
        )
        return sup.unionByName(nat).unionByName(reg)

    def files(self) -> DataFrame:
        """(path, length): layer names; every 13th does not match the pattern."""
        name = F.concat(
            F.lower("p_brand"), F.lit("_abundance_median_"),
            F.date_format(F.date_add(F.lit("2023-01-04").cast("date"), (F.pmod("p_partkey", F.lit(52)) * 7).cast("int")), "yyyy-MM-dd"),
            F.lit(".tif"),
        )
        return self.table("part").select(
            F.col("p_partkey"),
            F.when(F.pmod("p_partkey", F.lit(13)) == 0, F.concat(F.lit("readme_"), F.col("p_partkey").cast("string"))).otherwise(name).alias("path"),
            (F.lit(5000) + F.col("p_size") * 1000).cast("bigint").alias("length"),
        )


# Fixed SQL twins of the views above, keyed by the name used inside oracle queries.
SQL = {
    "v_cells": f"""SELECT CAST(l_suppkey AS INTEGER) AS row, CAST(l_partkey % {WIDTH} AS INTEGER) AS col,
        CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
        CASE WHEN l_linenumber <> 7 AND l_quantity <> 13 THEN l_quantity END AS value FROM lineitem""",
    "v_annual": "SELECT row, col, year, avg(value) AS v FROM v_cells GROUP BY ALL",
    "v_field": "SELECT row, col, avg(value) AS v FROM v_cells GROUP BY ALL",
    "v_grid": f"""SELECT CAST(s_suppkey AS INTEGER) AS row, CAST(c AS INTEGER) AS col,
        CAST((s_suppkey * 7 + c * 3) % 11 = 0 AS INTEGER) AS is_ocean
        FROM supplier, range({WIDTH}) AS g(c)""",
    "v_land": "SELECT row, col FROM v_grid WHERE is_ocean = 0",
    "v_land_field": "SELECT row, col, v FROM v_field JOIN v_land USING (row, col) WHERE v IS NOT NULL",
    "v_abund": """SELECT CAST(l_suppkey AS INTEGER) AS cell, p_brand AS species,
        CAST(least(51, (dayofyear(l_shipdate) - 1) // 7) AS INTEGER) AS week, sum(l_quantity) AS x
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "v_z": """SELECT CAST(vec_id // 25 AS INTEGER) AS row, CAST(vec_id % 25 AS INTEGER) AS col,
        CAST(embedding AS DOUBLE[]) AS z FROM embeddings""",
    "v_zlong": """SELECT row, col, CAST(d AS INTEGER) AS dim, z[d + 1] AS zv
        FROM (SELECT row, col, z, unnest(range(len(z))) AS d FROM v_z)""",
    "v_effort": """SELECT o_orderkey AS visit, o_custkey AS route, CAST(year(o_orderdate) AS INTEGER) AS year,
        CAST(o_orderstatus = 'F' AS INTEGER) AS run_type FROM orders""",
    "v_counts": """SELECT l_orderkey AS visit, p_type AS species, CAST(sum(l_quantity) AS BIGINT) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "v_series": """SELECT user_id, CAST(ts AS DATE) AS day,
        CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS x FROM events GROUP BY ALL""",
    "v_traits": """SELECT p_partkey AS part, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, qty,
        CASE WHEN qty > 100 THEN disc END AS disc
        FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS qty,
            avg(CAST(round(l_discount * 100) AS INTEGER)) AS disc FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""",
    "v_rates": f"""SELECT row, col, year, 0.25::DOUBLE + d / 16 AS Sa, 0.125::DOUBLE + t / 32 AS Sj, q / 16 AS Fmax, q AS K
        FROM (SELECT CAST(l_suppkey AS INTEGER) AS row, CAST(l_partkey % {WIDTH} AS INTEGER) AS col,
            CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) AS q,
            avg(CAST(round(l_discount * 100) AS INTEGER)) AS d, avg(CAST(round(l_tax * 100) AS INTEGER)) AS t
            FROM lineitem GROUP BY 1, 2, 3)""",
    "v_q": "SELECT row, col, year, kernel, 0.25::DOUBLE + ((row + col * ki + year) % 8) / 16.0::DOUBLE AS Q FROM v_rates, (VALUES "
    + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KERNEL_LABELS))
    + ") AS kk(ki, kernel)",
    "v_density": """SELECT row, col, year,
        sum(CASE WHEN month <= 4 THEN coalesce(value, 0.0::DOUBLE) ELSE 0.0::DOUBLE END) AS juv,
        sum(CASE WHEN month > 4 THEN coalesce(value, 0.0::DOUBLE) ELSE 0.0::DOUBLE END) AS adult
        FROM v_cells GROUP BY row, col, year""",
    "v_taxonomy": """SELECT n_nationkey AS nk, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS code,
        ' Genus_' || n_name AS sci_name, 'Bird ' || n_nationkey || ' (' || n_name || ')' AS common FROM nation""",
    "v_edges": """SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent, 1.0::DOUBLE + s_suppkey % 5 AS length FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.0::DOUBLE + n_nationkey % 5 FROM nation
        UNION ALL SELECT 'r' || r_regionkey, 'root', 1.0::DOUBLE + r_regionkey % 5 FROM region""",
    "v_files": """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'readme_' || p_partkey
        ELSE lower(p_brand) || '_abundance_median_' || strftime(DATE '2023-01-04' + CAST((p_partkey % 52) * 7 AS INTEGER), '%Y-%m-%d') || '.tif' END AS path,
        CAST(5000 + p_size * 1000 AS BIGINT) AS length FROM part""",
}


def _needed(text: str) -> list[str]:
    found: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", body):
            if name in SQL and name not in found:
                visit(SQL[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def _rounded(text: str) -> str:
    """Write R6(x) as a six-digit rounding without negative zero."""
    while "R6(" in text:
        start = text.rindex("R6(")
        depth, end = 1, start + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:start]}(round({text[start + 3:end - 1]}, 6) + 0.0){text[end:]}"
    return text


def r6(x):
    """Spark twin of R6 in the SQL text: used where summation order may change the last bits."""
    return F.round(x, 6) + F.lit(0.0)


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses. A body may begin with its own ``name AS (...)`` list."""
    body = _rounded(body.strip())
    views = [f"{name} AS ({SQL[name]})" for name in _needed(body)]
    own = not body.upper().startswith("SELECT")
    if not views and not own:
        return body
    head = "WITH RECURSIVE " + ",\n".join(views)
    if own:
        return head + (",\n" if views else "") + body
    return head + "\n" + body
