"""Readers and writers with fixed schemas, and the sanction-list reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAIM_SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("network_id", T.StringType()), ("claim_id", T.StringType()),
            ("address", T.StringType()), ("claim_kind", T.StringType()),
            ("entity_id", T.StringType()), ("entity_name", T.StringType()),
            ("entity_type", T.StringType()), ("address_role", T.StringType()),
            ("confidence", T.DoubleType()), ("risk_level", T.IntegerType()),
            ("is_exposure_seed", T.IntegerType()), ("seed_category", T.StringType()),
            ("source_id", T.StringType()), ("source_reference", T.StringType()),
            ("evidence_refs", T.ArrayType(T.StringType())),
            ("review_status", T.StringType()), ("reviewed_by", T.StringType()),
            ("valid_from_unix_ms", T.LongType()), ("valid_to_unix_ms", T.LongType()),
            ("revision", T.LongType()),
        ]
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", **options: str) -> DataFrame:
    """Parquet, ORC, JSON-lines or CSV with an explicit schema."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Label claims, one JSON object per line; bad lines fail the read."""
    return spark.read.schema(CLAIM_SCHEMA).option("mode", "FAILFAST").json(path)


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Address labels from CSV with a header, quotes doubled inside quotes; malformed lines land in ``_bad``."""
    columns = ["address", "entity_id", "entity_name", "entity_type", "source_reference"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_bad"]])
    reader = spark.read.schema(schema).option("header", "true").option("escape", '"')
    return reader.option("columnNameOfCorruptRecord", "_bad").csv(path)


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = (),
                mode: str = "append", bloom: Sequence[str] = ()) -> None:
    """Append rows; ``bloom`` columns get a Parquet bloom filter for point reads."""
    writer = df.write.mode(mode)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)


def with_block_bucket(df: DataFrame, width: int = 100_000) -> DataFrame:
    """The partition column for range reads by block."""
    return df.withColumn("block_bucket", F.floor(F.col("block_number") / width).cast("bigint"))


# Currency symbols of the published sanction list and the
# networks they belong to; other symbols are skipped.
SANCTION_NETWORKS = {
    "XBT": "bip122:000000000019d6689c085ae165831e93",
    "BTC": "bip122:000000000019d6689c085ae165831e93",
    "ETH": "eip155:1",
    "BNB": "eip155:56",
    "BSC": "eip155:56",
    "TRX": "tron:mainnet",
}


def read_sanction_list(spark: SparkSession, path: str) -> DataFrame:
    """One row per (entry, digital-currency id) of the sanction list XML."""
    text = T.StringType()
    schema = T.StructType(
        [
            T.StructField("uid", text),
            T.StructField("lastName", text),
            T.StructField("firstName", text),
            T.StructField("sdnType", text),
            T.StructField(
                "idList",
                T.StructType(
                    [
                        T.StructField(
                            "id",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("uid", text),
                                        T.StructField("idType", text),
                                        T.StructField("idNumber", text),
                                    ]
                                )
                            ),
                        )
                    ]
                ),
            ),
        ]
    )
    entries = spark.read.format("xml").option("rowTag", "sdnEntry").schema(schema).load(path)
    one = entries.select(
        F.col("uid").alias("entry_uid"),
        F.concat_ws(" ", "firstName", "lastName").alias("name"),
        "sdnType",
        F.explode("idList.id").alias("i"),
    )
    prefix = "Digital Currency Address - "
    return one.where(F.col("i.idType").startswith(prefix)).select(
        "entry_uid",
        "name",
        F.col("sdnType").alias("entity_type"),
        F.col("i.uid").alias("id_uid"),
        F.substring(F.col("i.idType"), len(prefix) + 1, 16).alias("asset"),
        F.trim(F.col("i.idNumber")).alias("address"),
    )


def network_of_symbol(symbol: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in SANCTION_NETWORKS.items() for v in pair])
    return F.try_element_at(table, F.upper(symbol))
