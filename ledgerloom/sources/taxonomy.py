"""What the tags of inline-tagged registration forms stand for. Fixed values throughout."""

from __future__ import annotations

#: Numeric tag → field, in the order of the form.
TAG_FIELDS = {
    "dei:EntityRegistrantName": "fund_name",
    "dei:EntityCentralIndexKey": "cik",
    "cef:IntervalFundFlag": "is_interval_fund",
    "cef:RegisteredClosedEndFundFlag": "is_registered_cef",
    "cef:BusinessDevelopmentCompanyFlag": "is_bdc",
    "cef:PrimaryShelfFlag": "is_primary_shelf",
    "cef:PrimaryShelfQualifiedFlag": "is_primary_shelf_qualified",
    "cef:NewCefOrBdcRegistrantFlag": "is_new_registrant",
    "cef:ManagementFeesPercent": "management_fee_pct",
    "cef:IncentiveFeesPercent": "incentive_fee_pct",
    "cef:SalesLoadPercent": "sales_load_pct",
    "cef:DistributionServicingFeesPercent": "distribution_servicing_fee_pct",
    "cef:AcquiredFundFeesAndExpensesPercent": "affe_pct",
    "cef:InterestExpensesOnBorrowingsPercent": "interest_expense_pct",
    "cef:OtherAnnualExpensesPercent": "other_expenses_pct",
    "cef:OtherAnnualExpense1Percent": "other_expense_1_pct",
    "cef:OtherAnnualExpense2Percent": "other_expense_2_pct",
    "cef:TotalAnnualExpensesPercent": "total_expense_ratio_pct",
    "cef:NetExpenseOverAssetsPercent": "net_expense_ratio_pct",
    "cef:WaiversAndReimbursementsOfFeesPercent": "fee_waiver_pct",
    "cef:OtherTransactionExpensesPercent": "other_transaction_fee_pct",
    "cef:OtherTransactionExpense1Percent": "early_repurchase_fee_pct",
    "cef:DividendReinvestmentAndCashPurchaseFees": "drip_fee",
    "cef:ExpenseExampleYear01": "expense_example_1yr",
    "cef:ExpenseExampleYears1to3": "expense_example_3yr",
    "cef:ExpenseExampleYears1to5": "expense_example_5yr",
    "cef:ExpenseExampleYears1to10": "expense_example_10yr",
    "us-gaap:NetAssetValuePerShare": "nav_per_share",
    "cef:OutstandingSecurityHeldShares": "shares_outstanding",
    "cef:OutstandingSecurityNotHeldShares": "shares_not_held",
    "cef:SeniorSecuritiesAmt": "leverage_amount",
    "cef:SeniorSecuritiesCvgPerUnit": "asset_coverage_ratio",
    "cef:AnnualCoverageReturnRatePercent": "annual_coverage_return_pct",
    "cef:ReturnAtMinusTenPercent": "leverage_return_minus_10",
    "cef:ReturnAtMinusFivePercent": "leverage_return_minus_5",
    "cef:ReturnAtZeroPercent": "leverage_return_zero",
    "cef:ReturnAtPlusFivePercent": "leverage_return_plus_5",
    "cef:ReturnAtPlusTenPercent": "leverage_return_plus_10",
}

#: Text block tag → what it is.
TEXT_BLOCKS = {
    "cef:RiskTextBlock": "risk_factors",
    "cef:RiskFactorsTableTextBlock": "risk_factors_table",
    "cef:InvestmentObjectivesAndPracticesTextBlock": "investment_objectives",
    "cef:AnnualExpensesTableTextBlock": "annual_expenses_table",
    "cef:ShareholderTransactionExpensesTableTextBlock": "shareholder_fees_table",
    "cef:ExpenseExampleTableTextBlock": "expense_example_table",
    "cef:PurposeOfFeeTableNoteTextBlock": "fee_table_purpose_note",
    "cef:OtherExpensesNoteTextBlock": "other_expenses_note",
    "cef:OtherTransactionFeesNoteTextBlock": "repurchase_fee_note",
    "cef:ManagementFeeNotBasedOnNetAssetsNoteTextBlock": "mgmt_fee_methodology_note",
    "cef:AcquiredFundFeesAndExpensesNoteTextBlock": "affe_note",
    "cef:AcquiredFundFeesEstimatedNoteTextBlock": "affe_estimated_note",
    "cef:BasisOfTransactionFeesNoteTextBlock": "transaction_fees_basis_note",
    "cef:EffectsOfLeverageTextBlock": "leverage_effects",
    "cef:EffectsOfLeverageTableTextBlock": "leverage_effects_table",
    "cef:EffectsOfLeveragePurposeTextBlock": "leverage_purpose",
    "cef:SeniorSecuritiesAveragingMethodNoteTextBlock": "senior_securities_method_note",
    "cef:CapitalStockTableTextBlock": "capital_stock_description",
    "cef:OutstandingSecuritiesTableTextBlock": "outstanding_shares_table",
    "cef:OutstandingSecurityTitleTextBlock": "share_class_title",
    "cef:SecurityTitleTextBlock": "security_title",
    "cef:SecurityDividendsTextBlock": "dividend_policy",
    "cef:SecurityVotingRightsTextBlock": "voting_rights",
    "cef:SecurityLiquidationRightsTextBlock": "liquidation_rights",
    "cef:SecurityPreemptiveAndOtherRightsTextBlock": "preemptive_rights",
}

#: Text block tag → fields that a section made of it can hold.
BLOCK_FIELDS = {
    "cef:RiskTextBlock": ("key_risks",),
    "cef:RiskFactorsTableTextBlock": ("key_risks",),
    "cef:InvestmentObjectivesAndPracticesTextBlock": ("investment_objective", "strategy_description", "allocation_targets"),
    "cef:AnnualExpensesTableTextBlock": ("fee_table", "share_classes", "incentive_fee"),
    "cef:EffectsOfLeverageTextBlock": ("leverage_limits",),
    "cef:ShareholderTransactionExpensesTableTextBlock": ("transaction_fees", "share_classes"),
    "cef:ExpenseExampleTableTextBlock": ("expense_example",),
    "cef:OutstandingSecuritiesTableTextBlock": ("share_classes",),
    "cef:CapitalStockTableTextBlock": ("share_classes",),
    "cef:OtherTransactionFeesNoteTextBlock": ("share_classes", "transaction_fees"),
    "cef:ManagementFeeNotBasedOnNetAssetsNoteTextBlock": ("management_fee", "share_classes", "incentive_fee"),
    "cef:PurposeOfFeeTableNoteTextBlock": ("incentive_fee", "expense_cap"),
    "cef:OtherExpensesNoteTextBlock": ("incentive_fee", "expense_cap"),
    "cef:AcquiredFundFeesAndExpensesNoteTextBlock": ("incentive_fee",),
    "ix:footnote:FeeStructure": ("incentive_fee", "expense_cap"),
}

#: Fields of a fee table that has a column per share class.
CLASS_FEES = (
    "management_fee_pct", "incentive_fee_pct", "sales_load_pct", "distribution_servicing_fee_pct", "affe_pct", "interest_expense_pct", "other_expenses_pct",
    "other_expense_1_pct", "other_expense_2_pct", "total_expense_ratio_pct", "net_expense_ratio_pct", "fee_waiver_pct", "other_transaction_fee_pct",
    "early_repurchase_fee_pct", "expense_example_1yr", "expense_example_3yr", "expense_example_5yr", "expense_example_10yr", "nav_per_share",
)

#: How a context names a share class, in the order in which the patterns are tried: pattern (in any case), what stands before and after its group.
CLASS_PATTERNS = (
    (r"Class([A-Z])Advisory(?:Shares?)?Member", "Class ", " Advisory"),
    (r"Class([A-Z])Institutional(?:Shares?)?Member", "Class ", " Institutional"),
    (r"Class([A-Z])Retail(?:Shares?)?Member", "Class ", " Retail"),
    (r"Class([A-Z])Shares?Member", "Class ", ""),
    (r"Class([A-Z])CommonStock", "Class ", ""),
    (r"Class_([A-Z])_", "Class ", ""),
    (r"_Class([A-Z])_", "Class ", ""),
    (r"_Class([A-Z])$", "Class ", ""),
    (r"()InstitutionalShares?Member", "Institutional", ""),
    (r"()RetailShares?Member", "Retail", ""),
    (r"()AdvisoryShares?Member", "Advisory", ""),
    (r"()InvestorShares?Member", "Investor", ""),
    (r"()CommonShares?Member", "Common", ""),
    (r"()PreferredShares?Member", "Preferred", ""),
    (r"Class([A-Z])_?Advisory_?Member", "Class ", " Advisory"),
    (r"(Premier|Select|Plus)Shares?Member", "", ""),
)
#: Words of a member that is no share class, in any case.
NOT_A_CLASS = ("Risk", "Sector", "Investment", "Strategy", "Contact", "Repurchased", "Concentration", "Tax", "Leverage", "Valuation", "Market", "Economic", "Geographic", "Currency")

#: Kind of section → (patterns of its heading in any case, fields), in the order in which they are tried.
HEADING_FIELDS = {
    "repurchase_terms": ((r"repurchase.*shares", r"repurchases\s+of\s+shares", r"periodic\s+repurchase", r"liquidity", r"tender\s+offer", r"repurchase\s+offer"), ("repurchase_frequency", "repurchase_pct_nav", "repurchase_notice_days", "repurchase_pricing")),
    "investment_strategy": ((r"principal\s+investment\s+strateg", r"investment\s+objective", r"investment\s+policies", r"use\s+of\s+proceeds", r"allocation\s+target", r"asset\s+allocation", r"portfolio\s+allocation", r"target\s+allocation", r"what\s+are.*allocation"), ("allocation_targets", "concentration_limits", "investment_restrictions")),
    "distribution": ((r"plan\s+of\s+distribution", r"purchasing\s+shares", r"how\s+to\s+purchase", r"distribution\s+arrangements", r"minimum.*investment", r"initial\s+investment", r"what\s+is.*minimum", r"distribution.*fee", r"service\s+fee", r"shareholder\s+servicing", r"what\s+are.*fees.*investor", r"fees.*shares?\s+purchase", r"sales\s+(load|charge)"), ("minimum_investment", "share_classes", "distribution_channels")),
    "fees": ((r"fees?\s+and\s+expenses", r"fund\s+expenses", r"management\s+fee", r"advisory\s+fee", r"incentive\s+fee", r"fee\s+table", r"summary\s+of\s+fund\s+expenses"), ("management_fee", "incentive_fee", "performance_fee", "expense_cap", "share_classes")),
    "management": ((r"management\s+of\s+the\s+fund", r"investment\s+advis[eo]r", r"board\s+of\s+(directors|trustees)", r"portfolio\s+manager"), ("manager_name", "subadvisor", "gp_commitment")),
    "risks": ((r"risk\s+factors", r"principal\s+risks", r"certain\s+risks"), ("key_risks",)),
    "leverage": ((r"leverage", r"borrowing", r"credit\s+facility", r"line\s+of\s+credit", r"debt\s+financing"), ("leverage_limits",)),
    "tax": ((r"tax\s+considerations", r"federal\s+income\s+tax", r"tax\s+matters"), ("tax_treatment",)),
    "qa_summary": ((r"^is\s+there\s+any\s+minimum", r"^is\s+there\s+a\s+minimum", r"^what\s+is\s+the\s+minimum", r"^will\s+i\s+receive\s+distributions", r"^how\s+often\s+will\s+.*distribut", r"^can\s+i\s+request\s+.*repurchas", r"^how\s+can\s+i\s+.*redeem", r"^will\s+you\s+use\s+leverage", r"^what\s+is\s+.*fund", r"^what\s+type\s+of\s+fund"), ("share_classes", "minimum_investment", "distribution_terms", "repurchase_terms", "leverage_limits", "fund_type")),
}
