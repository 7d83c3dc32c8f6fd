"""Inbound shipments: arrivals by service level, and daily units at a node."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.aggregate import conditional_sums, units_by_event_date
from tidemark.operators.clean import clean_text, journey_legs, keep, leg_durations, map_values, rename, to_dates

# Reason codes and the service level each group stands for.
STOCKING_REASONS = (2, 3, 4, 10, 12, 33, 34, 36, 52, 53, 13, 24, 26, 28, 30, 38)
DOMESTIC_REASON, TRANSFER_REASON = 40, 23
LEVEL_NAMES = {
    ("stocking", True): "Freight Collect Stocking Domestic",
    ("stocking", False): "Non Freight Collect Stocking Domestic",
    ("domestic", True): "Freight Collect CG Domestic",
    ("domestic", False): "Non Freight Collect CG Domestic",
}
TRANSFER_NAME, EXCLUDED_LEVEL, REPORT_ELEMENT = "Warehouse Transfer", "ACI", "ISC"
CARTON_TYPES, STORE_TYPES = (1, 2, 3, 4), (1, 6)
# Service levels of the daily series.
SERVICE_LEVELS = ("ACN", "ACI", "NVO", "BCO", "DRA")
# Event dates in travel order, leg names, date column per node.
EVENTS = ("ActualDeliveryCFS", "ActualDepartureCFS", "GateInOriginPort", "DepartureOriginPort",
          "ArrivalDestinationPort", "GateOutDestinationPort", "CompletedTime")
LEGS = ("stay_at_csf", "csf_to_origin_port", "stay_at_origin_port", "origin_port_to_destination_port",
        "stay_at_destination_port", "destination_port_to_fc")
NODE_DATES = {
    "arrival": {"CFSLocation": "ActualDeliveryCFS", "Origin": "GateInOriginPort",
                "Destination": "ArrivalDestinationPort", "WarehouseId": "CompletedTime"},
    "departure": {"CFSLocation": "ActualDepartureCFS", "Origin": "DepartureOriginPort",
                  "Destination": "GateOutDestinationPort"},
}
RENAMED = {
    "SPOID": "SpoID", "servicelevel": "ServiceLevel", "Original_WH": "WarehouseId",
    "Original_WH_Name": "DestinationWarehouse", "OriginPortCode": "Origin", "DestinationPortCode": "Destination",
    "arrivaldate": "CompletedTime", "Total_units": "SpiQty",
}


def journeys(datamart: DataFrame, spo: str = "spoid") -> DataFrame:
    """One row per shipment: last known places, first delivery, last events."""
    ends = {c: F.max for c in ("CFSLocation", "Origin", "Destination", *EVENTS[1:6])} | {EVENTS[0]: F.min}
    return datamart.groupBy(spo).agg(*[f(c).alias(c) for c, f in ends.items()])


def arrivals(report: DataFrame, element: str = REPORT_ELEMENT) -> DataFrame:
    return report.filter(F.col("element") == element).groupBy("spoid").agg(
        F.min("arrivaldate").alias("arrivaldate"), F.sum("qty").alias("arrived"))


def service_level(reason: str = "reasonid", account: str = "own_account", code: str = "levelcode") -> Column:
    """Name by reason code and account; other reasons keep the level code."""
    group = {"stocking": F.col(reason).isin(list(STOCKING_REASONS)), "domestic": F.col(reason) == DOMESTIC_REASON}
    out = F.when(F.col(reason) == TRANSFER_REASON, TRANSFER_NAME)
    for (name, own), label in LEVEL_NAMES.items():
        out = out.when(group[name] & (F.col(account) == own), label)
    return out.otherwise(F.col(code))


def shipment_arrivals(t: Mapping[str, DataFrame], as_of: str, years: int = 2) -> DataFrame:
    """Expected and other arrivals per shipment and service level.

    Items are summed per (shipment, level) before anything wide is attached;
    order, warehouse and journey columns depend on the shipment only.
    Dimensions are expected to be unique by id.
    """
    head = t["purchase_orders"].join(t["levels"], "levelid", "left").join(t["warehouses"], "warehouseid", "left")
    items = t["items"].join(t["products"], "productid", "left").join(t["cartons"], "partid", "left")
    lines = items.join(head, "spoid")
    lines = lines.withColumn("servicelevel", service_level())
    recent = F.col("created").cast("date") > F.add_months(F.lit(as_of).cast("date"), -12 * years)
    eligible = (
        (F.col("spoid") == F.col("parentid")) & ~F.col("cancelled")
        & (F.col("levelcode").isNull() | (F.col("levelcode") != EXCLUDED_LEVEL)) & recent
        & F.col("storetype").isin(list(STORE_TYPES)) & (F.col("spo_enabled") | F.col("breakbulk"))
        & (F.col("reasonid").isin([*STOCKING_REASONS, DOMESTIC_REASON, TRANSFER_REASON]) | F.col("levelcode").isNotNull())
        & (F.col("qty") > 0))
    # Both parts come from one pass over the items: sums of the eligible items
    # and sums of all items, side by side.
    lines = lines.withColumn("__kept", F.when(eligible, F.col("qty")))
    names = [f"Type_{k}_Units" for k in CARTON_TYPES] + ["No_Type_Units"]
    # What depends on the shipment only rides along: its tables are joined once.
    attributes = ["warehouseid", "warehousename", "created", "breakbulk"]
    by_level = lines.groupBy("spoid", "servicelevel").agg(
        *conditional_sums("qty", "cartontype", CARTON_TYPES),
        *conditional_sums("__kept", "cartontype", CARTON_TYPES, "__kept_Type_{}_Units", "__kept_No_Type_Units"),
        F.sum("__kept").alias("__kept_units"), F.count("__kept").alias("__kept_items"),
        *[F.any_value(c).alias(c) for c in attributes])
    both = by_level.join(arrivals(t["report"]), "spoid")
    # A shipment with any eligible item counts only those; the others count all
    # items. A shipment has few service levels, so this window is short.
    expected = F.max("__kept_items").over(Window.partitionBy("spoid")) > 0
    both = both.withColumn("__expected", expected).filter("NOT __expected OR __kept_items > 0")
    pick = lambda kept, every: F.when(F.col("__expected"), kept).otherwise(every)
    both = both.select(
        "spoid", "servicelevel", "arrivaldate",
        pick(F.coalesce("arrived", "__kept_units"), F.col("arrived")).alias("Total_units"),
        *[pick(F.col(f"__kept_{c}"), F.col(c)).alias(c) for c in names], *attributes)
    # Each (shipment, level) appears once, so no distinct is needed.
    out = both.join(journeys(t["journey"]), "spoid", "left")
    return out.withColumnsRenamed({
        "warehouseid": "Original_WH", "warehousename": "Original_WH_Name", "Origin": "OriginPortCode",
        "Destination": "DestinationPortCode", "created": "DateEntered"})


def tidy_shipments(df: DataFrame, levels: Sequence[str] | None = SERVICE_LEVELS, ports: DataFrame | None = None) -> DataFrame:
    """Renamed, trimmed rows with positive quantity, dates and leg durations."""
    df = keep(rename(df, RENAMED), "SpiQty", "ServiceLevel", levels)
    df = to_dates(df, EVENTS)
    df = clean_text(df, ["CFSLocation", "Origin", "Destination", "DestinationWarehouse"], ["WarehouseId"])
    df = leg_durations(df, journey_legs(EVENTS, LEGS))
    return map_values(df, "Origin", ports, "port", "region") if ports is not None else df


def daily_units(df: DataFrame, leg: str = "WarehouseId", move: str = "arrival", keep_node: bool = False) -> DataFrame:
    """Units per day at one kind of node."""
    return units_by_event_date(df, leg, move, NODE_DATES, "SpiQty", keep_node)
