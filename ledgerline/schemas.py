"""The six input tables: their columns and types, and the bundle the plans take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Wide enough for any amount in a currency, and for parts of a cent: rounding is left to whoever shows a result.
MONEY = T.DecimalType(28, 6)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


_text, _key, _int, _date = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()

# The column names of the input tables.
REVENUE = _schema(
    StoreNo=_key, Month=_date, Revenue_Type=_text, Revenue_Motion=_text,
    Product_Category=_text, Motion=_text, Revenue=MONEY,
)
OPPORTUNITIES = _schema(
    Store_No=_key, Opportunity_Est_Date=_date, Product=_text, Opportunity_ID=_key, Opportunity_Name=_text,
    Project_Status=_text, Opportunity_Status=_text, Opportunity_Stage=_text, Opportunity_Usage=_text,
)
TARGETS = _schema(Store_Number=_key, Service_Comp_Group=_text, Fiscal_Month=_date, Target=MONEY)
CALENDAR = _schema(Date_Value=_date, Fiscal_Month=_text, Fiscal_Quarter=_text, Fiscal_Year=_int, Month_ID=_int)
STORES = _schema(
    AccountNo=_key, Store=_text, Industry=_text, Vertical=_text, Segment=_text,
    Store_Manager_Alias=_text, Potential_Account=_text, Vertical_Manager_Alias=_text,
)
SELLERS = _schema(Store_ID=_key, General_Seller=_text, Services_Seller=_text, Product_Seller=_text)


SCHEMAS = {
    "revenue": REVENUE,
    "opportunities": OPPORTUNITIES,
    "targets": TARGETS,
    "calendar": CALENDAR,
    "stores": STORES,
    "sellers": SELLERS,
}


class Tables:
    """The inputs of the plans, under the names in ``SCHEMAS``.

    Each is a DataFrame, or a function that returns one and is called at first use: opening a table costs a look at
    its files, and most plans need only some.
    """

    revenue: DataFrame
    opportunities: DataFrame
    targets: DataFrame
    calendar: DataFrame
    stores: DataFrame
    sellers: DataFrame

    def __init__(self, **sources: DataFrame | Callable[[], DataFrame]):
        if sources.keys() != SCHEMAS.keys():
            raise TypeError(f"Tables takes {', '.join(SCHEMAS)}; got {', '.join(sources) or 'nothing'}")
        self._sources = sources

    def __getattr__(self, name: str) -> DataFrame:
        # Only called for tables that have not been opened yet.
        if name not in SCHEMAS:
            raise AttributeError(name)
        source = self._sources[name]
        df = source() if callable(source) else source
        setattr(self, name, df)
        return df
