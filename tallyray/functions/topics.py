"""The tracked event catalogue: canonical signatures, families, topic hashes.

topic0 of an event is the Keccak-256 of its canonical signature; the hashes are
derived from the signatures below when the module loads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .keccak import topic0

# The 29 tracked events as (name, canonical signature, family).
# Families route a log to its handler; "reserve" is the default route.
EVENTS = [
    ("ReserveInitialized", "ReserveInitialized(address,address,address,address,address)", "reserve"),
    ("ReserveUsedAsCollateralEnabled", "ReserveUsedAsCollateralEnabled(address,address)", "collateral"),
    ("ReserveUsedAsCollateralDisabled", "ReserveUsedAsCollateralDisabled(address,address)", "collateral"),
    ("ReserveDataUpdated", "ReserveDataUpdated(address,uint256,uint256,uint256,uint256,uint256)", "reserve"),
    ("UserEModeSet", "UserEModeSet(address,uint8)", "user_emode"),
    ("ReserveStableRateBorrowing", "ReserveStableRateBorrowing(address,bool)", "reserve"),
    ("ReserveDropped", "ReserveDropped(address)", "reserve"),
    ("ReserveFactorChanged", "ReserveFactorChanged(address,uint256,uint256)", "reserve"),
    ("ReserveInterestRateStrategyChanged", "ReserveInterestRateStrategyChanged(address,address,address)", "reserve"),
    ("CollateralConfigurationChanged", "CollateralConfigurationChanged(address,uint256,uint256,uint256)", "reserve"),
    ("ReserveFrozen", "ReserveFrozen(address)", "reserve"),
    ("ReserveUnfrozen", "ReserveUnfrozen(address)", "reserve"),
    ("ReservePaused", "ReservePaused(address,bool)", "reserve"),
    ("ReserveBorrowing", "ReserveBorrowing(address,bool)", "reserve"),
    ("ReserveActive", "ReserveActive(address,bool)", "reserve"),
    ("BorrowCapChanged", "BorrowCapChanged(address,uint256,uint256)", "reserve"),
    ("SupplyCapChanged", "SupplyCapChanged(address,uint256,uint256)", "reserve"),
    ("LiquidationProtocolFeeChanged", "LiquidationProtocolFeeChanged(address,uint256,uint256)", "reserve"),
    ("DebtCeilingChanged", "DebtCeilingChanged(address,uint256,uint256)", "reserve"),
    ("ReserveFlashLoaning", "ReserveFlashLoaning(address,bool)", "reserve"),
    ("AssetCollateralInEModeChanged", "AssetCollateralInEModeChanged(address,uint8,bool)", "reserve"),
    ("AssetBorrowableInEModeChanged", "AssetBorrowableInEModeChanged(address,uint8,bool)", "reserve"),
    ("AssetLtvzeroInEModeChanged", "AssetLtvzeroInEModeChanged(address,uint8,bool)", "reserve"),
    ("EModeCategoryAdded", "EModeCategoryAdded(uint8,uint256,uint256,uint256,address,string)", "reserve"),
    ("SiloedBorrowingChanged", "SiloedBorrowingChanged(address,bool,bool)", "reserve"),
    ("UnbackedMintCapChanged", "UnbackedMintCapChanged(address,uint256,uint256)", "reserve"),
    ("Mint", "Mint(address,address,uint256,uint256,uint256)", "token"),
    ("Burn", "Burn(address,address,uint256,uint256,uint256)", "token"),
    ("BalanceTransfer", "BalanceTransfer(address,address,uint256,uint256)", "token"),
]

TOPIC = {name: topic0(sig) for name, sig, _ in EVENTS}
NAME_BY_TOPIC = {v: k for k, v in TOPIC.items()}
FAMILY = {name: fam for name, _, fam in EVENTS}

TOPICS_SCHEMA = T.StructType([
    T.StructField("event", T.StringType(), False),
    T.StructField("signature", T.StringType(), False),
    T.StructField("family", T.StringType(), False),
    T.StructField("topic0", T.StringType(), False),
])


def tracked_topics(spark: SparkSession) -> DataFrame:
    """The topic dimension (29 rows, a fixed size, safe to broadcast)."""
    rows = [(n, s, f, TOPIC[n]) for n, s, f in EVENTS]
    return spark.createDataFrame(rows, TOPICS_SCHEMA)
