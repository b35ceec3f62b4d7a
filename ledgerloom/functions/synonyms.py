"""What different spellings of a category mean. Fixed values throughout: phrase in lower case → canonical value, in the order in which they are tried."""

from __future__ import annotations

LEVERAGE_BASIS = {
    "asset coverage": "asset_coverage", "asset coverage ratio": "asset_coverage", "300%": "asset_coverage", "300% coverage": "asset_coverage", "300 percent": "asset_coverage",
    "1940 act": "asset_coverage", "investment company act": "asset_coverage", "section 18": "asset_coverage",
    "total assets": "total_assets", "gross assets": "total_assets", "total fund assets": "total_assets",
    "net assets": "net_assets", "net asset value": "net_assets", "nav": "net_assets",
    "debt to equity": "debt_to_equity", "debt-to-equity": "debt_to_equity", "debt/equity": "debt_to_equity", "leverage ratio": "debt_to_equity",
}
REPURCHASE_BASIS = {
    "outstanding shares": "shares", "number of shares": "shares", "shares outstanding": "shares", "total shares": "shares", "of shares": "shares",
    "net assets": "nav", "net asset value": "nav", "of nav": "nav", "total assets": "total_assets", "gross assets": "total_assets",
}
DISTRIBUTION_FREQUENCY = {
    "monthly": "monthly", "each month": "monthly", "per month": "monthly", "every month": "monthly", "paid monthly": "monthly",
    "quarterly": "quarterly", "each quarter": "quarterly", "per quarter": "quarterly", "every quarter": "quarterly", "paid quarterly": "quarterly", "four times per year": "quarterly",
    "annually": "annually", "annual": "annually", "yearly": "annually", "once per year": "annually", "paid annually": "annually",
    "daily": "daily", "each day": "daily", "per day": "daily",
    "semi-annually": "semi_annually", "semi-annual": "semi_annually", "twice per year": "semi_annually", "two times per year": "semi_annually",
}
REPURCHASE_FREQUENCY = {
    "quarterly": "quarterly", "each quarter": "quarterly", "per quarter": "quarterly", "every quarter": "quarterly", "four times per year": "quarterly", "quarterly basis": "quarterly",
    "monthly": "monthly", "each month": "monthly", "annually": "annually", "annual": "annually", "yearly": "annually", "semi-annually": "semi_annually", "semi-annual": "semi_annually",
}
HURDLE_FREQUENCY = {
    "quarterly": "quarterly", "per quarter": "quarterly", "each quarter": "quarterly", "calendar quarter": "quarterly", "quarterly basis": "quarterly",
    "annually": "annual", "annual": "annual", "per annum": "annual", "per year": "annual", "annualized": "annual", "yearly": "annual",
}
DISTRIBUTION_POLICY = {
    "reinvested": "drip", "reinvestment": "drip", "drip": "drip", "dividend reinvestment": "drip", "dividend reinvestment plan": "drip", "automatically reinvested": "drip", "reinvest": "drip",
    "cash": "cash", "cash distribution": "cash", "paid in cash": "cash",
}
#: What counts as equal when an extracted value is compared with an expected one, whatever the field.
VALUES = {
    "reinvested": "drip", "drip": "drip", "dividend reinvestment": "drip", "dividend reinvestment plan": "drip", "reinvestment": "drip", "automatically reinvested": "drip", "reinvest": "drip",
    "cash": "cash", "cash distribution": "cash", "paid in cash": "cash",
    "nav": "nav", "net_assets": "nav", "net assets": "nav", "net asset value": "nav", "of nav": "nav",
    "number_of_shares": "shares", "shares": "shares", "outstanding shares": "shares", "shares outstanding": "shares", "total shares": "shares", "of shares": "shares",
    "total assets": "total_assets", "gross assets": "total_assets",
    "asset_coverage": "asset_coverage", "asset coverage": "asset_coverage", "asset coverage ratio": "asset_coverage", "300%": "asset_coverage", "300% coverage": "asset_coverage", "300 percent": "asset_coverage",
    "1940 act": "asset_coverage", "investment company act": "asset_coverage", "section 18": "asset_coverage", "total_assets": "total_assets", "total fund assets": "total_assets",
    "debt_to_equity": "debt_to_equity", "debt to equity": "debt_to_equity", "debt-to-equity": "debt_to_equity", "debt/equity": "debt_to_equity", "leverage ratio": "debt_to_equity",
    "monthly": "monthly", "each month": "monthly", "per month": "monthly", "every month": "monthly", "paid monthly": "monthly",
    "quarterly": "quarterly", "each quarter": "quarterly", "per quarter": "quarterly", "every quarter": "quarterly", "paid quarterly": "quarterly", "four times per year": "quarterly", "quarterly basis": "quarterly", "calendar quarter": "quarterly",
    "annually": "annually", "annual": "annually", "yearly": "annually", "once per year": "annually", "paid annually": "annually", "per annum": "annually", "per year": "annually", "annualized": "annually",
    "daily": "daily", "each day": "daily", "per day": "daily", "semi-annually": "semi_annually", "semi-annual": "semi_annually", "twice per year": "semi_annually", "two times per year": "semi_annually",
    "net_profits": "net_profits", "net profits": "net_profits", "total_return": "total_return", "total return": "total_return", "net_investment_income": "net_investment_income", "net investment income": "net_investment_income",
    "realized_gains": "realized_gains", "realized gains": "realized_gains", "nav_appreciation": "nav_appreciation",
}
