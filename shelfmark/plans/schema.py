"""Fixed values of the data model: table names, columns, labels."""

from __future__ import annotations

from shelfmark.operators.lookup import Dimension

# Raw columns that are renamed on the way into the star schema.
CONFORMED = {"country/region": "country", "state/province": "state"}

CUSTOMER = Dimension(
    table="dim_customer",
    key="customer_key",
    business=("customer_id",),
    attributes=("customer_id", "customer_name", "segment"),
)
PRODUCT = Dimension(
    table="dim_product",
    key="product_key",
    business=("product_id",),
    attributes=("product_id", "category", "sub_category", "product_name"),
)
GEOGRAPHY = Dimension(
    table="dim_geography",
    key="geography_key",
    business=("country", "state", "city", "postal_code"),
    attributes=("country", "state", "city", "postal_code", "region"),
)
SHIP_MODE = Dimension(
    table="dim_ship_mode",
    key="ship_mode_key",
    business=("ship_mode",),
    attributes=("ship_mode",),
)
MANAGER = Dimension(
    table="dim_regional_manager",
    key="manager_key",
    business=("region",),
    attributes=("manager_name", "region"),
)
LINE_DIMENSIONS = (CUSTOMER, PRODUCT, GEOGRAPHY, SHIP_MODE)

# What each ship mode promises.
SHIP_MODE_TEXT = {
    "First Class": "Priority shipping (1-2 business days)",
    "Second Class": "Standard priority (2-4 business days)",
    "Standard Class": "Regular shipping (4-7 business days)",
    "Same Day": "Same day delivery",
}
UNKNOWN_SHIP_MODE = "Unknown"

# Lifetime revenue from which a customer is in a tier.
LTV_TIERS = (("Platinum", 5000), ("Gold", 2000), ("Silver", 500))
LOWEST_TIER = "Bronze"

SALES_COLUMNS = (
    "sales_key",
    "order_id",
    "order_date_key",
    "ship_date_key",
    "customer_key",
    "product_key",
    "geography_key",
    "ship_mode_key",
    "revenue",
    "quantity",
    "discount",
    "profit",
    "cost",
    "profit_margin",
)
RETURN_COLUMNS = ("return_key", "order_id", "order_date_key", "customer_key", "product_key")
