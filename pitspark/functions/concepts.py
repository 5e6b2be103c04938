"""The reviewed financial vocabulary and the unit of each concept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Concepts (fixed values).
CONCEPTS = (
    "revenue", "cost_of_revenue", "gross_profit", "research_and_development_expense", "selling_general_and_administrative_expense", "operating_expenses", "operating_income", "interest_expense", "pretax_income", "income_tax_expense",
    "net_income_parent", "net_income_consolidated", "eps_basic", "eps_diluted", "weighted_average_shares_basic", "weighted_average_shares_diluted", "common_shares_outstanding", "cash_and_cash_equivalents", "short_term_investments", "accounts_receivable_net",
    "inventory_net", "current_assets", "property_plant_equipment_net", "goodwill", "intangible_assets_net_excluding_goodwill", "total_assets", "accounts_payable_current", "current_debt", "long_term_debt_noncurrent", "current_liabilities",
    "total_liabilities", "equity_parent", "equity_including_noncontrolling_interests", "noncontrolling_interests", "cash_from_operating_activities", "capital_expenditures_ppe", "depreciation_and_amortization", "share_based_compensation", "dividends_paid", "share_repurchases",
)
#: Concepts that are counts of shares, and amounts for each share (fixed values).
SHARES = ("weighted_average_shares_basic", "weighted_average_shares_diluted", "common_shares_outstanding")
FOR_EACH_SHARE = ("eps_basic", "eps_diluted")


def expected_unit(concept: Column, currency: Column) -> Column:
    """The unit that a concept has to be in; null for what is not in the vocabulary."""
    unit = F.when(concept.isin(*SHARES), "shares").when(concept.isin(*FOR_EACH_SHARE), F.concat(currency, F.lit("/shares"))).otherwise(currency)
    return F.when(concept.isin(*CONCEPTS), unit)
