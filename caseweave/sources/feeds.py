"""Threat feeds and fixed dimensions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import constants as C
from ..playbooks import playbook_rows
from .events import table

def constant_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """Literal rows as a local relation, whose exact size the planner knows."""
    schema = T._parse_datatype_string(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(
        pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow))


KEV_SCHEMA = "struct<vulnerabilities:array<struct<cveID:string,dateAdded:string>>>"


# --- parsing -----------------------------------------------------------------

def parse_kev(docs: DataFrame, column: str = "value") -> DataFrame:
    """Known-exploited catalogue documents to (cve, kev_added), one row per cve."""
    v = F.explode(F.from_json(column, KEV_SCHEMA)["vulnerabilities"])
    return (docs.select(v.alias("v"))
            .select(F.col("v.cveID").alias("cve"), F.col("v.dateAdded").alias("kev_added"))
            .groupBy("cve").agg(F.max("kev_added").alias("kev_added")))


def parse_epss(docs: DataFrame, column: str = "value") -> DataFrame:
    """Documents that are one JSON object ``{cve: score}`` to (cve, epss)."""
    return (docs.select(F.explode(F.from_json(column, "map<string,double>")).alias("cve", "epss"))
            .groupBy("cve").agg(F.max("epss").alias("epss")))


def parse_blocklist(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines to distinct addresses: blanks and ``#`` comments dropped, padding trimmed."""
    return (lines.where(~F.col(column).startswith("#"))
            .select(F.trim(column).alias("ip")).where(F.col("ip") != "").distinct())


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    return parse_kev(spark.read.text(path, wholetext=True))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    return parse_epss(spark.read.text(path, wholetext=True))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocklist(spark.read.text(path))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    schema = ("asset_id string, name string, kind string, criticality double, "
              "software string, cpe_product string, version string")
    return spark.read.csv(path, header=True, schema=schema)


# --- feed documents derived from the given tables ------------------------------

def kev_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    cve = (F.when(F.col("p_partkey") == 1, "CVE-2022-22965").when(F.col("p_partkey") == 2, "CVE-2017-5638")
           .otherwise(F.concat(F.lit("CVE-2020-"), (10000 + F.col("p_partkey")).cast("string"))))
    day = F.concat(F.lit("2022-04-"), F.lpad((1 + F.col("p_partkey") % 28).cast("string"), 2, "0"))
    doc = F.to_json(F.struct(F.array(F.struct(cve.alias("cveID"), day.alias("dateAdded"))).alias("vulnerabilities")))
    return part.select(doc.alias("value"))


def epss_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    cve = (F.when(F.col("p_partkey") == 1, "CVE-2022-22965").when(F.col("p_partkey") == 3, "CVE-2024-25600")
           .otherwise(F.concat(F.lit("CVE-2020-"), (10000 + F.col("p_partkey")).cast("string"))))
    score = F.col("p_size") / 100.0
    return part.select(F.to_json(F.create_map(cve, score)).alias("value"))


def feodo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    line = (F.when(key % 5 == 0, F.concat(F.lit("# note "), key.cast("string"))).when(key % 5 == 1, F.lit("  "))
            .otherwise(F.concat(F.lit(" 45.155.205."), (10 + key % 4).cast("string"), F.lit(" "))))
    return table(spark, sf_dir, "supplier").select(line.alias("value"))


def tor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    line = (F.when(key % 7 == 0, F.lit("#comment"))
            .otherwise(F.concat(F.lit("185.220.101."), (10 + key % 3).cast("string"))))
    return table(spark, sf_dir, "customer").select(line.alias("value"))


class Feeds:
    """The four feeds as DataFrames; any of them may come from files or tables."""

    def __init__(self, kev: DataFrame, epss: DataFrame, feodo: DataFrame, tor: DataFrame):
        self.kev, self.epss, self.feodo, self.tor = kev, epss, feodo, tor

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> "Feeds":
        return cls(parse_kev(kev_documents(spark, sf_dir)), parse_epss(epss_documents(spark, sf_dir)),
                   parse_blocklist(feodo_lines(spark, sf_dir)), parse_blocklist(tor_lines(spark, sf_dir)))

    def reputation(self) -> DataFrame:
        """(ip, reputation_source, is_tor): the botnet list is asked before the exit list."""
        both = (self.feodo.select("ip", F.lit(0).alias("rank"))
                .unionByName(self.tor.select("ip", F.lit(1).alias("rank"))))
        best = both.groupBy("ip").agg(F.min("rank").alias("rank"))
        return best.select(
            "ip", F.when(F.col("rank") == 0, "Feodo Tracker").otherwise("Tor exit list").alias("reputation_source"),
            (F.col("rank") == 1).cast("int").alias("is_tor"))

    def status(self) -> DataFrame:
        """Row count per feed, with a note where a feed is empty."""
        parts = [df.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(n).alias("feed"), "entries")
                 for n, df in (("kev", self.kev), ("epss", self.epss), ("feodo", self.feodo), ("tor", self.tor))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        note = F.when(F.col("entries") == 0, "feed is empty").otherwise("loaded")
        return out.withColumn("note", note)


# --- fixed dimensions -----------------------------------------------------------

def assets(spark: SparkSession) -> DataFrame:
    return constant_table(
        spark, C.ASSETS, "asset_id string, name string, kind string, criticality double, "
                  "software string, cpe_product string, version string")


def path_cves(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(C.PATH_CVES)]
    return constant_table(
        spark, rows, "ordinal int, path string, cve string, cve_name string, product string, "
              "entry_asset string, hit_status int")


def techniques(spark: SparkSession) -> DataFrame:
    order = {t: i for i, t in enumerate(C.TACTIC_ORDER)}
    rows = [(t, n, tac, order.get(tac, 99)) for t, (n, tac) in C.TECHNIQUES.items()]
    return constant_table(spark, rows, "technique_id string, technique string, tactic string, tactic_order int")


def playbooks(spark: SparkSession) -> DataFrame:
    return constant_table(
        spark, playbook_rows(), "technique_id string, section string, section_ord int, ordinal int, action_id string, "
                         "action string, owner string, eta_min int, rollback string, query string")


def cve_dimension(spark: SparkSession, feeds: Feeds) -> DataFrame:
    """Path entries with feed facts and inventory match folded in: as many rows as the path table."""
    inventory = assets(spark).select(F.col("asset_id").alias("entry_asset"),
                                     F.col("cpe_product"), F.col("software").alias("entry_software"))
    kev = feeds.kev.withColumn("in_kev", F.lit(True))
    runs = F.coalesce(F.col("cpe_product") == F.col("product"), F.lit(False))
    return (F.broadcast(path_cves(spark)).join(F.broadcast(inventory), "entry_asset", "left")
            .join(kev, "cve", "left").join(feeds.epss, "cve", "left")
            .select("ordinal", "cve", "cve_name", "hit_status",
                    F.coalesce("in_kev", F.lit(False)).alias("in_kev"), "kev_added", "epss",
                    runs.alias("product_match"),
                    F.when(runs, F.col("entry_asset")).alias("matched_asset"),
                    F.when(runs, F.col("entry_software")).alias("matched_software")))
