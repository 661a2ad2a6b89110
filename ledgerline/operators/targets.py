from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerline.operators.fiscal import on_day


def rename_targets(targets: DataFrame) -> DataFrame:
    return targets.withColumnsRenamed({"Store_Number": "Account_No", "Service_Comp_Group": "Product_Category"})


def align_targets(targets: DataFrame, calendar: DataFrame) -> DataFrame:
    """Targets with the calendar's name of the month. Their groups are categories already and are not bucketed."""
    dated = rename_targets(targets).withColumnRenamed("Fiscal_Month", "Target_Date")
    return on_day(dated, "Target_Date", calendar, "Fiscal_Month").select(
        "Account_No", "Product_Category", "Fiscal_Month", "Target"
    )
