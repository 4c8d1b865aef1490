"""Sources and sinks of filings: JSON payloads, the cleaned relations they make, labelled pairs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAYLOAD = (
    "Table array<struct<Fld_AuthoriseDate:string>>, Table2 array<struct<sLongName:string>>, "
    "Table1 array<struct<Fld_ShareHolderName:string,Fld_TotalNoOfShares:bigint,Fld_TotalPercentageOf_A_B_C2:double,Fld_Code:string,FLd_ShareholderType:string,Fld_Level:string,Fld_SubCategory:string>>"
)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """One row per holder of each payload (a whole-file JSON document): file, place in the payload, held, filed_on and the register's fields."""
    raw = spark.read.schema(PAYLOAD).json(path, multiLine=True).withColumn("file", F.input_file_name())
    rows = raw.select("file", F.col("Table2")[0]["sLongName"].alias("held"), F.to_date(F.substring(F.col("Table")[0]["Fld_AuthoriseDate"], 1, 10)).alias("filed_on"), F.posexplode("Table1").alias("place", "r"))
    return rows.select(
        "file", "place", "held", "filed_on", F.col("r.Fld_ShareHolderName").alias("holder"), F.col("r.Fld_TotalNoOfShares").alias("shares"), F.col("r.Fld_TotalPercentageOf_A_B_C2").alias("stake_pct"),
        F.col("r.Fld_Code").alias("code"), F.coalesce("r.FLd_ShareholderType", "r.Fld_Level").alias("kind"),
    )


def read_quarters(spark: SparkSession, path: str) -> DataFrame:
    """quarter, name, ends_on of a JSON map from codes to quarters whose end is written like 31 Mar 2026."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<fld_quartername:string,fld_enddate:string>>")).alias("quarter", "q"))
    return raw.select("quarter", F.col("q.fld_quartername").alias("name"), F.try_to_date("q.fld_enddate", "dd MMM yyyy").alias("ends_on"))


def tidied(rows: DataFrame, role: str | None = "Promoter") -> DataFrame:
    """rows with white space collapsed, role, and verdict: kept, or why a row is no relation (unnamed, no_shares, any_other, duplicate).

    Of relations with the same holder, held entity and role the first one stays: by the column `line`, else by file and place.
    """
    tidy = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    rows = rows.withColumns({"holder": tidy("holder"), "held": tidy("held")} | ({"role": F.lit(role)} if role else {}))
    anonymous = F.lower("holder").like("any other%") | (F.contains("kind", F.lit("Any Other")) if "kind" in rows.columns else F.lit(False))
    why = F.when(F.coalesce(F.col("holder"), F.lit("")) == "", "unnamed").when(F.coalesce(F.col("shares"), F.lit(0)) <= 0, "no_shares").when(F.coalesce(anonymous, F.lit(False)), "any_other")
    order = [F.col(c) for c in ("line", "file", "place") if c in rows.columns]
    same = Window.partitionBy(F.lower("holder"), F.lower("held"), "role", "verdict").orderBy(*order)
    rows = rows.withColumn("verdict", F.coalesce(why, F.lit("kept")))
    return rows.withColumn("verdict", F.when((F.col("verdict") == "kept") & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("verdict")))


def cleaned(rows: DataFrame, role: str | None = "Promoter") -> DataFrame:
    """The relations among tidied rows, typed by the register's code and kind."""
    kept = tidied(rows, role).filter("verdict = 'kept'").drop("verdict")
    person = F.lit(False)
    if "code" in rows.columns:
        person = person | F.coalesce(F.col("code").rlike("^A1a|(?i)individual"), F.lit(False))
    if "kind" in rows.columns:
        person = person | F.coalesce(F.col("kind").rlike("(?i)individual|huf"), F.lit(False))
    return kept.withColumn("entity_type", F.when(person, "individual").otherwise("corporate"))


def counters(rows: DataFrame, role: str | None = "Promoter") -> DataFrame:
    """verdict, role, rows: how many rows became relations, and why others did not."""
    return tidied(rows, role).groupBy("verdict", "role").agg(F.count("*").alias("rows"))


def latest(rows: DataFrame, key: str, quarter: str, usable: Column | None = None) -> DataFrame:
    """The rows of each key's latest quarter; with `usable`, of the latest quarter that has a row for which it holds, if any has."""
    of_key = Window.partitionBy(key)
    newest = F.max(quarter).over(of_key)
    if usable is not None:
        newest = F.coalesce(F.max(F.when(usable, F.col(quarter))).over(of_key), newest)
    return rows.withColumn("newest", newest).filter(F.col(quarter) == F.col("newest")).drop("newest")


def in_scope(rows: DataFrame, anchors: list[str]) -> DataFrame:
    """Rows of held entities that any holder's name ties to an anchor; the first anchor of the list is the group."""
    low = F.lower("holder")
    hit = F.coalesce(*[F.when(F.contains(low, F.lit(a.lower())), F.lit(i)) for i, a in enumerate(anchors)])
    groups = rows.groupBy("held").agg(F.min(hit).alias("anchor")).filter("anchor is not null")
    return rows.join(groups.withColumn("group", F.element_at(F.array(*map(F.lit, anchors)), F.col("anchor") + 1)).drop("anchor"), "held")


def group_of(rows: DataFrame) -> DataFrame:
    """held, group: the label that a held entity's last row states."""
    return rows.filter("`group` is not null").groupBy("held").agg(F.max_by("group", "line").alias("group"))


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """name_a, name_b, band, same_entity of a CSV; a label other than 0 or 1 stops the job."""
    rows = spark.read.csv(path, header=True, escape='"')
    label = F.when(F.trim("same_entity").isin("0", "1"), F.trim("same_entity")).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce("same_entity", F.lit("null")))))
    return rows.withColumn("same_entity", label.cast("int"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A CSV sink: arrays and structs as JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in rows.schema]
    rows.select(flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
