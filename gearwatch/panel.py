"""The panel contract: which column plays which role.

A panel has one row per (entity, member, date) with a 0/1 flag, a criticality
grade and measures that are equal for all members of an entity-day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class PanelSpec:
    date: str = "d"
    entity: str = "entity"
    etype: str = "etype"
    site: str = "site"
    member: str = "member"
    family: str = "family"
    grade: str = "grade"
    flag: str = "flag"
    qty: str = "qty"
    cost: str = "cost"
    amount: str = "amount"
    category: str = "category"
    measures: tuple[str, ...] = ("m1", "m2", "m3", "m4")

    @property
    def entity_day(self) -> list[str]:
        return [self.date, self.entity]

    @property
    def key(self) -> list[str]:
        return [self.date, self.entity, self.member]

    @property
    def family_key(self) -> list[str]:
        return [self.date, self.entity, self.family]

    @property
    def required(self) -> list[str]:
        return [
            self.date, self.entity, self.etype, self.site, self.member,
            self.family, self.grade, self.flag, *self.measures,
        ]


PANEL = PanelSpec()

# Names of the equipment table's columns.
EQUIPMENT = PanelSpec(
    date="transaction_date",
    entity="asset_tag",
    etype="machine_type",
    site="plant_code",
    member="part_no",
    family="part_family",
    grade="criticality",
    flag="breakdown_flag",
    qty="qty_issued",
    cost="unit_cost_inr",
    amount="issue_value_inr",
    category="wo_type",
    measures=(
        "temp_bearing_degC", "temp_motor_degC", "vibration_h_mms", "vibration_v_mms",
        "oil_pressure_bar", "load_pct", "shaft_rpm", "power_consumption_kw",
    ),
)

# Measures that describe health and operating condition of a machine.
HEALTH_MEASURES = (
    "temp_bearing_degC", "temp_motor_degC", "vibration_h_mms", "vibration_v_mms", "oil_pressure_bar",
)
OPERATING_MEASURES = ("load_pct", "shaft_rpm", "power_consumption_kw")


def equipment_schema() -> T.StructType:
    """Declared schema of the equipment table (22 columns, file order)."""
    text, number = T.StringType(), T.DoubleType()
    return T.StructType(
        [
            T.StructField("transaction_date", T.DateType()),
            *(T.StructField(c, text) for c in (
                "asset_tag", "machine_type", "plant_code", "part_no",
                "part_description", "part_family", "criticality", "uom")),
            *(T.StructField(c, number) for c in ("unit_cost_inr", "qty_issued", "issue_value_inr")),
            *(T.StructField(c, number) for c in EQUIPMENT.measures),
            T.StructField("breakdown_flag", T.IntegerType()),
            T.StructField("wo_type", text),
        ]
    )
