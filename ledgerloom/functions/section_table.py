"""The standard sections of a registration form: what they are called and which fields they hold."""

from __future__ import annotations

import re

# Section → (patterns of its title in any case, fields, priority), in the order in which they are tried.
STANDARD_SECTIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...], int]] = {
    "table_of_contents": ((r"TABLE\s+OF\s+CONTENTS",), (), 3),
    "prospectus_summary": ((r"PROSPECTUS\s+SUMMARY", r"SUMMARY\s+OF\s+(?:THE\s+)?(?:FUND|PROSPECTUS)"), ("fund_type", "investment_objective", "strategy_description"), 1),
    "summary_of_fund_expenses": ((r"SUMMARY\s+OF\s+FUND\s+EXPENSES", r"FEES?\s+AND\s+EXPENSES", r"FEE\s+TABLE"), ("management_fee", "incentive_fee", "expense_cap", "share_classes"), 1),
    "financial_highlights": ((r"FINANCIAL\s+HIGHLIGHTS",), ("nav_history", "expense_ratio", "performance"), 2),
    "the_fund": ((r"THE\s+FUND", r"ABOUT\s+THE\s+FUND"), ("fund_type", "legal_structure", "fund_name"), 2),
    "use_of_proceeds": ((r"USE\s+OF\s+PROCEEDS",), ("use_of_proceeds",), 2),
    "investment_objective": ((r"INVESTMENT\s+OBJECTIVE", r"INVESTMENT\s+GOAL"), ("investment_objective",), 1),
    "investment_strategies": ((r"INVESTMENT\s+STRATEG(?:Y|IES)", r"PRINCIPAL\s+INVESTMENT\s+STRATEG"), ("strategy_description", "allocation_targets"), 1),
    "investment_policies": ((r"INVESTMENT\s+POLICIES", r"FUNDAMENTAL\s+POLICIES"), ("investment_policies", "concentration_limits"), 2),
    "risk_factors": ((r"RISK\s+FACTORS?", r"PRINCIPAL\s+RISKS?", r"CERTAIN\s+RISKS"), ("key_risks",), 1),
    "management_of_fund": ((r"MANAGEMENT\s+OF\s+THE\s+FUND", r"INVESTMENT\s+ADVISER", r"THE\s+ADVISER"), ("manager_name", "subadvisor", "gp_commitment"), 1),
    "management_and_incentive_fees": ((r"MANAGEMENT\s+AND\s+INCENTIVE\s+FEES?", r"INCENTIVE\s+FEE", r"PERFORMANCE\s+FEE", r"MANAGEMENT\s+FEE"), ("management_fee", "incentive_fee", "hurdle_rate", "high_water_mark", "catch_up"), 1),
    "capital_stock": ((r"CAPITAL\s+STOCK", r"DESCRIPTION\s+OF\s+(?:SHARES|SECURITIES|CAPITAL)"), ("share_classes", "voting_rights"), 1),
    "plan_of_distribution": ((r"PLAN\s+OF\s+DISTRIBUTION",), ("minimum_investment", "share_classes", "distribution_channels"), 1),
    "purchases_of_shares": ((r"PURCHASES?\s+OF\s+SHARES", r"PURCHASING\s+SHARES", r"HOW\s+TO\s+PURCHASE"), ("minimum_investment", "share_classes", "purchase_terms"), 1),
    "repurchase_of_shares": ((r"REPURCHASES?\s+OF\s+SHARES", r"REPURCHASE\s+OFFERS?", r"TENDER\s+OFFERS?", r"Repurchases?\s+and\s+Transfers?\s+of\s+Shares", r"PERIODIC\s+REPURCHASE"), ("repurchase_terms", "repurchase_frequency", "lock_up_period", "early_repurchase_fee"), 1),
    "distribution_policy": ((r"DISTRIBUTION\s+POLICY", r"DIVIDEND\s+POLICY", r"DISTRIBUTIONS"), ("distribution_terms", "distribution_frequency"), 2),
    "dividend_reinvestment": ((r"DIVIDEND\s+REINVESTMENT", r"DISTRIBUTION\s+REINVESTMENT", r"DRIP"), ("dividend_reinvestment",), 3),
    "tax_considerations": ((r"TAX\s+CONSIDERATIONS", r"FEDERAL\s+INCOME\s+TAX", r"TAX\s+MATTERS", r"TAXATION"), ("tax_treatment",), 2),
    "legal_matters": ((r"LEGAL\s+MATTERS", r"LEGAL\s+COUNSEL"), ("legal_counsel",), 3),
    "experts": ((r"EXPERTS?", r"INDEPENDENT\s+(?:REGISTERED\s+)?PUBLIC\s+ACCOUNT", r"AUDITORS?"), ("auditor",), 3),
    "additional_information": ((r"ADDITIONAL\s+INFORMATION", r"WHERE\s+YOU\s+CAN\s+FIND", r"AVAILABLE\s+INFORMATION"), (), 3),
    "eligible_investors": ((r"ELIGIBLE\s+INVESTORS?", r"WHO\s+MAY\s+INVEST", r"INVESTOR\s+SUITABILITY"), ("minimum_investment", "investor_requirements"), 1),
    "erisa_considerations": ((r"ERISA\s+CONSIDERATIONS", r"ERISA\s+AND\s+TAX", r"BENEFIT\s+PLAN\s+INVESTORS"), ("erisa_eligible",), 2),
    "conflicts_of_interest": ((r"CONFLICTS?\s+OF\s+INTEREST", r"POTENTIAL\s+CONFLICTS"), ("conflicts_of_interest",), 2),
    "valuation": ((r"VALUATION", r"NET\s+ASSET\s+VALUE", r"CALCULATION\s+OF\s+NAV", r"DETERMINATION\s+OF\s+NAV"), ("valuation_methodology", "nav_frequency"), 2),
    "leverage": ((r"LEVERAGE", r"USE\s+OF\s+LEVERAGE", r"BORROWINGS?", r"EFFECTS\s+OF\s+LEVERAGE"), ("leverage_limits", "uses_leverage", "max_leverage"), 2),
    "expense_limitation": ((r"EXPENSE\s+CAP", r"EXPENSE\s+LIMITATION", r"FEE\s+WAIVER", r"WAIVER\s+AND\s+REIMBURSEMENT"), ("expense_cap", "expense_cap_expiration"), 2),
    "custodian": ((r"CUSTODIAN", r"CUSTODY\s+OF\s+ASSETS"), ("custodian",), 3),
    "transfer_agent": ((r"TRANSFER\s+AGENT", r"REGISTRAR\s+AND\s+TRANSFER"), ("transfer_agent",), 3),
    "anti_takeover": ((r"ANTI-?TAKEOVER\s+PROVISIONS?", r"CERTAIN\s+PROVISIONS\s+OF.*CHARTER"), ("anti_takeover_provisions",), 3),
    "privacy_notice": ((r"PRIVACY\s+(?:POLICY|NOTICE)",), (), 3),
    "brokerage": ((r"BROKERAGE\s+ALLOCATION", r"BROKERAGE\s+PRACTICES"), ("brokerage_practices",), 3),
    "closed_end_structure": ((r"CLOSED-?END\s+FUND\s+STRUCTURE", r"INTERVAL\s+FUND\s+RISKS?", r"LIMITED\s+LIQUIDITY"), ("fund_type", "liquidity_terms"), 2),
    "portfolio_managers": ((r"PORTFOLIO\s+MANAGERS?", r"INVESTMENT\s+PERSONNEL"), ("portfolio_managers",), 2),
}
#: Every pattern's first group-free alternative in one expression per section, and those of all sections.
TITLE_PATTERNS = {name: "(?i)(?:" + "|".join(patterns) + ")" for name, (patterns, _, _) in STANDARD_SECTIONS.items()}


def section_of_title(title: str) -> str | None:
    """The first standard section that a title names; for use outside of Spark."""
    return next((name for name, p in TITLE_PATTERNS.items() if re.search(p, title)), None)
