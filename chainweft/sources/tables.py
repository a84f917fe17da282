"""Canonical frames built from the supplied star-schema tables.

The mapping is arithmetic on the stored columns, so a frame costs its scans
and at most the order/line join on the order key; nothing here sorts, ranks or
broadcasts.  Accounts: customers ``C<key>`` and suppliers ``S<key>``; one order
is one transaction and one line one transfer.  Unspent outputs: one line is an
output of its order and is spent by a later order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweft.functions.ids import ZERO_ADDRESS

ACCOUNT = "acct:1"
UTXO = "utxo:1"
BLOCK_TXS = 50
BLOCK_MS = 600_000
UTXO_START_MS = 1_300_000_000_000


def _text(prefix: str, *cols: Column | str) -> Column:
    parts: list[Column] = [F.lit(prefix)]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("-"))
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts)


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _day(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")


def _index() -> Column:
    """Position of a line in its order: unique without ranking the order's lines."""
    return (F.col("l_partkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey") % 100_000


def _div(c: Column | str, n: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / n).cast("bigint")


class Tables:
    """Lazy frames over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # accounts -----------------------------------------------------------

    def account_txs(self) -> DataFrame:
        """One transaction per order."""
        key = F.col("o_orderkey")
        minute = _day("o_orderdate") * 1440 + key % 1440
        return self.raw("orders").select(
            F.lit(ACCOUNT).alias("network_id"),
            _text("t", "o_orderkey").alias("tx_hash"),
            minute.alias("block_number"),
            (minute * 60_000).alias("block_timestamp_unix_ms"),
            _div(key, 1440).alias("transaction_index"),
            _text("C", "o_custkey").alias("from_address"),
            _text("S", F.col("o_custkey") % 50).alias("to_address"),
            (F.col("o_orderstatus") != "F").cast("int").alias("status"),
            (_cents("o_totalprice") % 100_000).cast("string").alias("fee_raw"),
            F.when(F.col("o_orderpriority").startswith("1"), "0xa9059cbb")
            .when(F.col("o_orderpriority").startswith("2"), "0x38ed1739")
            .when(F.col("o_orderpriority").startswith("5"), "")
            .otherwise("0x")
            .alias("input_data"),
        )

    def edges(self) -> DataFrame:
        """Account transfers: one per line, timed by the order."""
        line = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "l_quantity", "l_extendedprice", "l_returnflag",
        )
        order = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        both = line.join(order, line["l_orderkey"] == order["o_orderkey"])
        key = F.col("l_orderkey")
        minute = _day("o_orderdate") * 1440 + key % 1440
        customer, supplier = _text("C", "o_custkey"), _text("S", "l_suppkey")
        back = F.col("l_returnflag") == "R"
        nft = F.col("l_linenumber") == 7
        return both.select(
            F.lit(ACCOUNT).alias("network_id"),
            _text("r", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(
                "relationship_id"
            ),
            _text("t", "l_orderkey").alias("tx_hash"),
            minute.alias("block_number"),
            (minute * 60_000).alias("block_timestamp_unix_ms"),
            _div(key, 1440).alias("transaction_index"),
            _index().alias("event_index"),
            F.when(F.col("l_quantity") == 50, ZERO_ADDRESS)
            .otherwise(F.when(back, supplier).otherwise(customer))
            .alias("from_address"),
            F.when(F.col("l_quantity") == 49, ZERO_ADDRESS)
            .otherwise(F.when(back, customer).otherwise(supplier))
            .alias("to_address"),
            _text("asset:", F.col("l_partkey") % 25).alias("asset_id"),
            F.when(nft, F.col("l_partkey").cast("string")).alias("token_id"),
            F.when(nft, "1").otherwise(_cents("l_extendedprice").cast("string")).alias(
                "amount_raw"
            ),
            F.when(nft, "erc721_transfer")
            .when(F.col("l_partkey") % 25 == 0, "native_transfer")
            .otherwise("erc20_transfer")
            .alias("transfer_type"),
        )

    def features(self) -> DataFrame:
        """Per-transaction flags, folded from the parts a transaction touches."""
        part = F.col("l_partkey")
        flags = {
            "is_swap": 5, "is_bridge": 11, "is_mint": 13, "is_burn": 17,
            "is_liquidity_add": 19, "is_liquidity_remove": 23, "is_contract_call": 3,
        }
        return (
            self.raw("lineitem")
            .groupBy("l_orderkey")
            .agg(*[F.max((part % n == 0).cast("int")).alias(f) for f, n in flags.items()])
            .withColumn("tx_hash", _text("t", "l_orderkey"))
            .drop("l_orderkey")
        )

    def semantic_events(self) -> DataFrame:
        """Detector output, one row per supplied event."""
        kind = F.col("event_type")
        return self.raw("events").select(
            F.lit(ACCOUNT).alias("network_id"),
            _text("e", "event_id").alias("event_id"),
            _text("x", _div("event_id", 2)).alias("tx_hash"),
            _text("C", "user_id").alias("subject_id"),
            F.when(kind == "view", "swap")
            .when(kind == "click", "bridge_transfer")
            .when(kind == "error", "mixer_deposit")
            .when(kind == "purchase", "liquidity_add")
            .otherwise("liquidity_remove")
            .alias("event_type"),
            _text("p", F.get_json_object("props", "$.k").cast("int") % 10).alias("protocol"),
            (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("confidence"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("block_timestamp_unix_ms"),
            _cents("value").cast("string").alias("amount_raw"),
        )

    # labels -------------------------------------------------------------

    def sources(self) -> DataFrame:
        """Label sources with two revisions each."""
        nation = self.raw("nation")
        key = F.col("n_nationkey")
        rows = [
            nation.select(
                F.lit(ACCOUNT).alias("network_id"),
                _text("src", "n_nationkey").alias("source_id"),
                F.col("n_name").alias("source_name"),
                (F.lit(1) if rev == 1 else (key % 7 != 0).cast("int")).alias("is_active"),
                F.lit(rev).cast("bigint").alias("revision"),
            )
            for rev in (1, 2)
        ]
        return rows[0].unionByName(rows[1])

    def claims(self) -> DataFrame:
        """Label claims on supplier addresses; every third has a second revision."""
        supplier = self.raw("supplier")
        key = F.col("s_suppkey")
        base = supplier.select(
            F.lit(ACCOUNT).alias("network_id"),
            _text("cl", "s_suppkey").alias("claim_id"),
            _text("S", "s_suppkey").alias("address"),
            F.lit("label").alias("claim_kind"),
            _text("ent", key % 40).alias("entity_id"),
            F.concat(F.lit("Entity "), (key % 40).cast("string")).alias("entity_name"),
            F.when(key % 10 == 0, "exchange").when(key % 10 == 1, "DEX")
            .when(key % 10 == 2, "bridge").when(key % 10 == 3, "mixer")
            .when(key % 10 == 4, "Custodian").otherwise("unknown").alias("entity_type"),
            F.when(_div(key, 10) % 4 == 0, "HOT").when(_div(key, 10) % 4 == 1, "SWEEP")
            .when(_div(key, 10) % 4 == 2, "DEPOSIT").otherwise("COLD").alias("address_role"),
            ((key % 5 + 5) / 10.0).alias("confidence"),
            F.when(key % 25 == 7, 50 + key % 51).otherwise(0).cast("int").alias("risk_level"),
            (key % 25 == 7).cast("int").alias("is_exposure_seed"),
            F.when(key % 25 == 7, "sanctions").otherwise("").alias("seed_category"),
            _text("src", "s_nationkey").alias("source_id"),
            F.when(key % 4 == 3, "pending").otherwise("approved").alias("review_status"),
            F.when(key % 4 == 3, "").otherwise("analyst").alias("reviewed_by"),
            F.lit(0).cast("bigint").alias("valid_from_unix_ms"),
            F.when(key % 9 == 8, F.lit(900_000_000_000)).cast("bigint").alias("valid_to_unix_ms"),
            F.lit(1).cast("bigint").alias("revision"),
            key.alias("__k"),
        )
        newer = (
            base.where(F.col("__k") % 3 == 0)
            .withColumn("revision", F.lit(2).cast("bigint"))
            .withColumn("review_status", F.lit("approved"))
            .withColumn("reviewed_by", F.lit("lead"))
        )
        return base.unionByName(newer).drop("__k")

    def reviews(self) -> DataFrame:
        """Review decisions about claims, up to two revisions per claim."""
        supplier = self.raw("supplier")
        key = F.col("s_suppkey")

        def rows(rev: int, keep: Column, decision: Column) -> DataFrame:
            return supplier.where(keep).select(
                F.lit(ACCOUNT).alias("network_id"),
                _text("rv", key, F.lit(rev)).alias("review_id"),
                F.lit("claim").alias("subject_type"),
                _text("cl", "s_suppkey").alias("subject_id"),
                decision.alias("decision"),
                F.when(key % 3 == 0, "lead").otherwise("analyst").alias("reviewed_by"),
                F.when(key % 3 == 0, 2).otherwise(1).cast("bigint").alias("claim_revision"),
                F.lit(rev).cast("bigint").alias("revision"),
            )

        first = rows(1, key % 4 != 3, F.lit("approve"))
        second = rows(2, key % 6 == 5, F.when(key % 12 == 5, "reject").otherwise("revoke"))
        return first.unionByName(second)

    def exchanges(self) -> DataFrame:
        """Known exchange addresses, one row per address."""
        key = F.col("s_suppkey")
        return self.raw("supplier").where(key % 10 == 0).select(
            _text("S", "s_suppkey").alias("address"),
            _text("ent", key % 40).alias("entity_id"),
            F.concat(F.lit("Exchange "), (key % 40).cast("string")).alias("exchange_name"),
            F.when(_div(key, 10) % 4 == 0, "HOT").when(_div(key, 10) % 4 == 1, "SWEEP")
            .when(_div(key, 10) % 4 == 2, "DEPOSIT").otherwise("COLD").alias("address_role"),
            ((_div(key, 10) % 3 + 7) / 10.0).alias("confidence"),
        )

    # unspent outputs ----------------------------------------------------

    def _utxo_header(self, key: Column) -> list[Column]:
        height = _div(key, BLOCK_TXS)
        return [
            F.lit(UTXO).alias("network_id"),
            height.alias("block_number"),
            _text("b", height).alias("block_hash"),
            (F.lit(UTXO_START_MS) + height * BLOCK_MS).alias("block_timestamp_unix_ms"),
            _text("k", height).alias("commit_id"),
            F.when(height % 11 == 3, 2).otherwise(1).cast("bigint").alias("revision"),
            _text("u", key).alias("tx_hash"),
            (key % BLOCK_TXS).alias("transaction_index"),
        ]

    def _utxo_owner(self) -> list[Column]:
        key = F.col("l_suppkey")
        family = (
            F.when(key % 3 == 0, "1").when(key % 3 == 1, "3").otherwise("bc1p")
        )
        return [
            F.when(key % 16 != 15, F.concat(family, F.lit("S"), key.cast("string"))).alias(
                "address"
            ),
            F.concat(F.lit("6a"), F.lpad(key.cast("string"), 10, "0")).alias("script_hex"),
        ]

    def _value(self) -> Column:
        # a handful of round values so that equal outputs occur
        return (
            F.when(F.col("l_quantity") > 35, F.lit(1_000_000))
            .when(F.col("l_quantity") == 1, F.lit(0))
            .otherwise(_cents("l_extendedprice"))
            .cast("bigint")
        )

    def utxo_outputs(self) -> DataFrame:
        key = F.col("l_orderkey")
        return self.raw("lineitem").select(
            *self._utxo_header(key),
            _index().alias("output_index"),
            *self._utxo_owner(),
            self._value().alias("value_sats"),
            (key % BLOCK_TXS == 0).cast("int").alias("coinbase"),
        )

    def utxo_inputs(self) -> DataFrame:
        """Lines not marked N are spent one to seven orders later, never by a coinbase."""
        spender = F.col("l_orderkey") + 1 + F.col("l_partkey") % 7
        index = _index()
        return (
            self.raw("lineitem")
            .where((F.col("l_returnflag") != "N") & (spender % BLOCK_TXS != 0))
            .select(
                *self._utxo_header(spender),
                index.alias("input_index"),
                *self._utxo_owner(),
                self._value().alias("value_sats"),
                _text("u", "l_orderkey").alias("prev_tx_hash"),
                index.alias("prev_output_index"),
            )
        )

    def utxo_headers(self) -> DataFrame:
        """Transactions without their leg counts, one per order."""
        key = F.col("o_orderkey")
        return self.raw("orders").select(*self._utxo_header(key), (key % BLOCK_TXS == 0).cast("int").alias("coinbase"))

    def utxo_txs(self) -> DataFrame:
        """Transactions with declared leg counts and fee, one per order."""
        legs = (
            self.utxo_inputs()
            .select("tx_hash", F.lit(1).alias("i"), F.lit(0).alias("o"),
                    F.col("value_sats").alias("v"))
            .unionByName(
                self.utxo_outputs().select(
                    "tx_hash", F.lit(0).alias("i"), F.lit(1).alias("o"),
                    (-F.col("value_sats")).alias("v"),
                )
            )
            .groupBy("tx_hash")
            .agg(
                F.sum("i").cast("int").alias("input_count"),
                F.sum("o").cast("int").alias("output_count"),
                F.sum("v").alias("__fee"),
            )
        )
        txs = self.utxo_headers()
        return txs.join(legs, "tx_hash", "left").select(
            *txs.columns,
            F.coalesce("input_count", F.lit(0)).alias("input_count"),
            F.coalesce("output_count", F.lit(0)).alias("output_count"),
            F.when(F.col("coinbase") == 1, 0)
            .otherwise(F.greatest(F.coalesce("__fee", F.lit(0)), F.lit(0)))
            .alias("fee_sats"),
        )

    def occurrences(self) -> DataFrame:
        """Outputs whose outpoint (order, line) may occur again at a later position."""
        return self.raw("lineitem").select(
            _text("u", "l_orderkey").alias("tx_hash"),
            F.col("l_linenumber").alias("output_index"),
            _day("l_shipdate").alias("block_number"),
            F.col("l_partkey").alias("transaction_index"),
            _text("S", "l_suppkey").alias("address"),
            _cents("l_extendedprice").alias("value_sats"),
            (F.col("l_orderkey") % BLOCK_TXS == 0).cast("int").alias("coinbase"),
        )

    def spends(self) -> DataFrame:
        """Inputs that point at the outpoints of :meth:`occurrences`."""
        return (
            self.raw("lineitem")
            .where(F.col("l_linestatus") == "F")
            .select(
                _text("u", "l_orderkey").alias("prev_tx_hash"),
                F.col("l_linenumber").alias("prev_output_index"),
                (_day("l_shipdate") + F.col("l_quantity").cast("bigint")).alias("block_number"),
                F.col("l_suppkey").alias("transaction_index"),
                _text("x", "l_partkey", "l_suppkey").alias("tx_hash"),
            )
        )

    # blocks -------------------------------------------------------------

    def blocks(self) -> DataFrame:
        """Block journal with gaps, newer revisions and orphans."""
        height = _div("o_orderkey", BLOCK_TXS)
        per_block = (
            self.raw("orders")
            .groupBy(height.alias("block_number"))
            .agg(F.count("*").cast("int").alias("transaction_count"))
            .where(F.col("block_number") % 37 != 5)
        )
        h = F.col("block_number")

        def rows(rev: int) -> DataFrame:
            if rev == 1:
                canonical, status = F.lit(1), F.when(h % 29 == 7, "processing").otherwise("complete")
            else:
                canonical = (h % 22 != 3).cast("int")
                status = F.when(h % 22 == 3, "orphaned").otherwise("complete")
            base = per_block if rev == 1 else per_block.where(h % 11 == 3)
            return base.select(
                F.lit(UTXO).alias("network_id"),
                "block_number",
                _text("b", h).alias("block_hash"),
                F.when(h % 41 == 9, F.lit("fork")).otherwise(_text("b", h - 1)).alias("parent_hash"),
                (F.lit(UTXO_START_MS) + h * BLOCK_MS).alias("block_timestamp_unix_ms"),
                _text("k", h).alias("commit_id"),
                F.lit(rev).cast("bigint").alias("revision"),
                canonical.alias("canonical"),
                status.alias("ingestion_status"),
                (F.col("transaction_count") - (h % 53 == 0).cast("int")).alias("transaction_count"),
                F.lit(1).alias("receipt_coverage"),
                (h % 5 != 0).cast("int").alias("trace_coverage"),
            )

        return rows(1).unionByName(rows(2))

    def state(self) -> DataFrame:
        """Published state: one row, the tip two blocks below the last order's block."""
        tip = _div(F.max("o_orderkey"), BLOCK_TXS) - 2
        return self.raw("orders").agg(tip.alias("last_block_number")).select(
            F.lit(UTXO).alias("network_id"),
            F.lit(2).cast("bigint").alias("revision"),
            F.lit(1).alias("initialized"),
            F.lit(0).cast("bigint").alias("start_block"),
            "last_block_number",
            _text("b", "last_block_number").alias("last_block_hash"),
        )

    def failures(self) -> DataFrame:
        """Ingestion failures: one per supplied event of type error, two revisions."""
        key = F.col("event_id")
        base = self.raw("events").where(F.col("event_type") == "error")

        def rows(rev: int) -> DataFrame:
            kept = base if rev == 1 else base.where(key % 4 == 0)
            status = F.lit("pending") if rev == 1 else F.when(key % 8 == 0, "resolved").otherwise(
                "dead_letter"
            )
            return kept.select(
                F.lit(UTXO).alias("network_id"),
                _text("f", "event_id").alias("failure_id"),
                (key % 5000).alias("block_number"),
                status.alias("status"),
                F.lit(rev).alias("attempts"),
                (F.unix_millis(F.col("ts").cast("timestamp")) + rev * 60_000).alias(
                    "last_failed_at_unix_ms"
                ),
                F.lit(rev).cast("bigint").alias("revision"),
            )

        return rows(1).unionByName(rows(2))
