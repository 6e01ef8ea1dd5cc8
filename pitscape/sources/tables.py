"""Parquet and CSV sources: declared schemas, required and optional tables, pruned scans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

_D, _S, _L, _I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()


def _schema(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


# Columns and keys of the input tables.
RAW_SCHEMAS = {
    "funda": "gvkey string, datadate date, fyear int, fyr int, rdq date, sich int, naics int, "
    "revt double, sale double, cogs double, oibdp double, oiadp double, xrd double, xsga double, "
    "xad double, ib double, ni double, dp double, at double, ppent double, capx double, dltt double, "
    "dlc double, ceq double, che double, act double, lct double, csho double, prcc_f double",
    "crsp_monthly": "permno bigint, date date, ret double, retx double, prc double, shrout double, "
    "vol double, bid double, ask double, exchcd int, shrcd int",
    "crsp_delist": "permno bigint, dlstdt date, dlstcd int, dlret double, exit_category string",
    "ccm_link": "gvkey string, lpermno bigint, linkdt date, linkenddt date, linktype string, linkprim string",
    "factor_returns": "date date, mkt_excess double, smb double, hml double, rmw double, cma double, "
    "mom double, rf double",
    "sec_filing_dates": "gvkey string, datadate date, fyear int, filing_timestamp timestamp_ntz",
    "truth": "gvkey string, datadate date, fyear int, latent_axis_1 double, latent_axis_2 double, "
    "latent_axis_3 double, latent_axis_4 double, latent_axis_5 double, latent_axis_6 double, "
    "true_viability double, migration_surprise double, injected_return_alpha double, "
    "availability_date timestamp_ntz, availability_source string, regime_id string, exit_category string",
}
RAW_KEYS = {
    "funda": ["gvkey", "datadate", "fyear"],
    "crsp_monthly": ["permno", "date"],
    "crsp_delist": ["permno", "dlstdt"],
    "ccm_link": ["gvkey", "lpermno", "linkdt"],
    "factor_returns": ["date"],
    "sec_filing_dates": ["gvkey", "datadate", "fyear"],
    "truth": ["gvkey", "datadate", "fyear"],
}
OPTIONAL = ("sec_filing_dates", "truth")


def read_raw_bundle(spark: SparkSession, folder: str, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Read ``<folder>/<table>.parquet`` with the declared schemas.

    A missing required table raises; a missing optional one is left out.
    """
    bundle = {}
    for name in tables or RAW_SCHEMAS:
        reader = spark.read.schema(_schema(RAW_SCHEMAS[name]))
        try:
            frame = reader.parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            if name in OPTIONAL:
                continue
            raise FileNotFoundError(f"required table is missing: {folder}/{name}.parquet") from None
        bundle[name] = clean_doubles(frame)
    return bundle


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN on disk means missing; everything downstream tests for NULL only."""
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def scan(spark: SparkSession, folder: str, table: str, columns: Iterable[str]) -> DataFrame:
    """Column-pruned Parquet scan."""
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def read_small_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV source: dates and booleans come back as such."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def union_scenarios(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Stack the same result of several scenarios, with the scenario name in front."""
    out = None
    for name, frame in frames.items():
        tagged = frame.select(F.lit(name).alias("scenario"), "*")
        out = tagged if out is None else out.unionByName(tagged)
    return out
