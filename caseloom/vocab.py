"""Field lists, word lists and thresholds the results depend on.

Everything here is data.  Vocabularies that a deployment wants to change are
passed as a :class:`caseloom.codebook.Codebook`.
"""

EXPECTED_QUESTIONS = 68
PARSER_VERSION = "1.1.0"

# Every character Python's ``str.strip``/``\s`` treats as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex character class (java.util.regex escapes).
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ZERO_WIDTH_CLASS = r"[\u200b\u200c\u200d\ufeff]"
ZERO_WIDTH_SPACE = "\u200b"

# --- typed missingness -------------------------------------------------------
DATE_STATUS_TOKENS = ("NOT_DISCUSSED", "NOT_MENTIONED", "NOT_APPLICABLE")
NUMBER_STATUS_TOKENS = ("NOT_DISCUSSED", "NOT_MENTIONED", "NOT_APPLICABLE", "NONE")
EXCLUSIVE_MARKERS = ("NOT_APPLICABLE", "NONE_MENTIONED", "NONE_DISCUSSED", "NONE", "NOT_DETERMINED")
ECHO_PREFIXES = ("TYPE:", "ENUM:", "MULTI_SELECT:")
ABSENCE_TOKENS = (
    "NOT_MENTIONED", "NOT_DISCUSSED", "NOT_APPLICABLE", "UNCLEAR", "NONE", "NONE_MENTIONED",
    "NONE_DISCUSSED", "NONE_VIOLATED", "NOT_DETERMINED", "NO_FINE_IMPOSED", "NOT_SPECIFIED", "NO_DEADLINE_SPECIFIED",
    "FIGURE_UNCLEAR", "NO_BASIS_CLAIMED", "NO_ISSUES_FOUND", "NEITHER",
)

# --- geography ---------------------------------------------------------------
COUNTRY_PREFIX = "ISO_3166-1_ALPHA-2:"
EU_CODES = (
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL",
    "PT", "RO", "SK", "SI", "ES", "SE",
)
EEA_ONLY_CODES = ("IS", "LI", "NO")
COUNTRY_WHITELIST = EU_CODES + EEA_ONLY_CODES + ("EU", "UNCLEAR")

# --- money -------------------------------------------------------------------
FINE_OUTLIER = 1e10
TURNOVER_OUTLIER = 1e12

SEVERITY_MEASURES = (
    "WARNING", "REPRIMAND", "LIMITATION_PROHIBITION_OF_PROCESSING", "PROCESSING_BAN",
    "DATA_DELETION_ORDER", "ADMINISTRATIVE_FINE",
)

# --- fields ------------------------------------------------------------------
# (question, column prefix) of the multi-select fields of the wide table.
WIDE_FIELDS = (
    ("Q30", "q30_discussed"),
    ("Q31", "q31_violated"),
    ("Q32", "q32_bases"),
    ("Q41", "q41_aggrav"),
    ("Q42", "q42_mitig"),
    ("Q46", "q46_vuln"),
    ("Q47", "q47_remedial"),
    ("Q50", "q50_other_measures"),
    ("Q53", "q53_powers"),
    ("Q54", "q54_scopes"),
    ("Q56", "q56_rights_discussed"),
    ("Q57", "q57_rights_violated"),
    ("Q58", "q58_access_issues"),
    ("Q59", "q59_adm_issues"),
    ("Q61", "q61_dpo_issues"),
    ("Q64", "q64_transfer_violations"),
)
# (role, question) of the long tables.
LONG_ROLES = (
    ("article_5_discussed", "Q30"),
    ("article_5_violated", "Q31"),
    ("article_6_discussed", "Q32"),
    ("legal_basis_relied_on", "Q33"),
    ("consent_issues", "Q34"),
    ("li_test_outcome", "Q35"),
    ("breach_types", "Q21"),
    ("vulnerable_groups", "Q46"),
    ("corrective_powers", "Q53"),
    ("corrective_scopes", "Q54"),
    ("rights_discussed", "Q56"),
    ("rights_violated", "Q57"),
    ("access_issues", "Q58"),
    ("adm_issues", "Q59"),
    ("dpo_issues", "Q61"),
    ("transfer_violations", "Q64"),
    ("aggravating_factors", "Q41"),
    ("mitigating_factors", "Q42"),
)
SINGLE_VALUE_ROLES = ("li_test_outcome",)
TEXT_QUESTIONS = ("Q36", "Q52", "Q67", "Q68")

# --- multi-select vocabularies ----------------------------------------------
PRINCIPLES = (
    "LAWFULNESS_FAIRNESS_TRANSPARENCY", "PURPOSE_LIMITATION", "DATA_MINIMISATION", "ACCURACY",
    "STORAGE_LIMITATION", "SECURITY", "ACCOUNTABILITY",
)
LEGAL_BASES = (
    "CONSENT", "CONTRACT", "LEGAL_OBLIGATION", "VITAL_INTERESTS", "PUBLIC_TASK", "LEGITIMATE_INTERESTS",
)
RIGHTS = (
    "ACCESS", "RECTIFICATION", "ERASURE", "RESTRICTION_OF_PROCESSING", "DATA_PORTABILITY", "OBJECTION",
    "AUTOMATED_DECISION_MAKING", "INFORMATION_OBLIGATIONS",
)
FINE_FACTORS = (
    "NATURE_GRAVITY_DURATION", "INTENT_NEGLIGENCE", "MITIGATION_ACTIONS",
    "TECHNICAL_ORGANIZATIONAL_MEASURES", "PREVIOUS_INFRINGEMENTS", "COOPERATION_WITH_AUTHORITY",
    "DATA_CATEGORIES_AFFECTED", "MANNER_BECAME_KNOWN", "COMPLIANCE_PRIOR_ORDERS",
    "CODES_CERTIFICATION", "OTHER_CIRCUMSTANCES", "NONE",
)
MULTI_SELECT_OPTIONS = {
    "Q21": ("TECHNICAL_FAILURE", "ORGANIZATIONAL_FAILURE", "CYBER_ATTACK", "HUMAN_ERROR",
            "SYSTEM_MALFUNCTION", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q30": PRINCIPLES + ("NONE_DISCUSSED",),
    "Q31": PRINCIPLES + ("NONE_VIOLATED", "NOT_DETERMINED"),
    "Q32": LEGAL_BASES + ("NONE_DISCUSSED",),
    "Q33": LEGAL_BASES + ("NO_BASIS_CLAIMED", "UNCLEAR"),
    "Q34": ("NOT_FREELY_GIVEN", "NOT_SPECIFIC", "NOT_INFORMED", "NOT_UNAMBIGUOUS", "CONDITIONAL",
            "WITHDRAWAL_PROBLEMS", "NO_ISSUES_FOUND", "NOT_APPLICABLE"),
    "Q35": ("LEGITIMATE_INTERESTS_PREVAIL", "DATA_SUBJECT_INTERESTS_PREVAIL", "BALANCING_INADEQUATE",
            "TEST_NOT_CONDUCTED", "NOT_APPLICABLE"),
    "Q41": FINE_FACTORS,
    "Q42": FINE_FACTORS,
    "Q46": ("CHILDREN", "ELDERLY", "PATIENTS", "EMPLOYEES", "FINANCIALLY_VULNERABLE",
            "NONE_MENTIONED", "NOT_DISCUSSED"),
    "Q47": ("IMMEDIATE_CESSATION", "SYSTEM_UPGRADES", "POLICY_CHANGES", "STAFF_TRAINING",
            "EXTERNAL_AUDIT", "DPO_APPOINTMENT", "COMPENSATION_TO_SUBJECTS", "NONE_MENTIONED"),
    "Q50": ("PROCESSING_BAN", "DATA_DELETION_ORDER", "COMPLIANCE_ORDER", "CERTIFICATION_WITHDRAWAL",
            "PERIODIC_REPORTING", "AUDIT_REQUIREMENT", "NONE"),
    "Q53": ("WARNING", "REPRIMAND", "COMPLY_WITH_DATA_SUBJECT_REQUESTS",
            "BRING_PROCESSING_INTO_COMPLIANCE", "COMMUNICATE_BREACH_TO_SUBJECTS",
            "LIMITATION_PROHIBITION_OF_PROCESSING", "RECTIFICATION_ERASURE_RESTRICTION",
            "CERTIFICATION_WITHDRAWAL", "ADMINISTRATIVE_FINE", "SUSPENSION_DATA_FLOWS", "NONE"),
    "Q54": ("COMPLETE_PROCESSING_BAN", "SPECIFIC_PURPOSE_LIMITATION", "DATA_CATEGORY_LIMITATION",
            "GEOGRAPHICAL_LIMITATION", "TEMPORAL_LIMITATION", "NOT_APPLICABLE"),
    "Q56": RIGHTS + ("NONE_DISCUSSED",),
    "Q57": RIGHTS + ("NONE_VIOLATED", "NOT_DETERMINED"),
    "Q58": ("EXCESSIVE_DELAY", "EXCESSIVE_FEES", "INADEQUATE_RESPONSE", "IDENTITY_VERIFICATION_ISSUES",
            "SCOPE_LIMITATIONS", "NO_ISSUES_FOUND", "NOT_APPLICABLE"),
    "Q59": ("LACK_OF_HUMAN_INTERVENTION", "INADEQUATE_SAFEGUARDS", "PROFILING_WITHOUT_CONSENT",
            "NO_EXPLANATION_PROVIDED", "NO_ISSUES_FOUND", "NOT_APPLICABLE"),
    "Q61": ("NO_DPO_APPOINTED", "INADEQUATE_QUALIFICATIONS", "INSUFFICIENT_INDEPENDENCE",
            "LACK_OF_RESOURCES", "INADEQUATE_INVOLVEMENT", "CONFLICT_OF_INTEREST", "NO_ISSUES_FOUND",
            "NOT_APPLICABLE"),
    "Q64": ("NO_ADEQUATE_SAFEGUARDS", "INVALID_TRANSFER_MECHANISM", "SCHREMS_II_ISSUES",
            "NO_IMPACT_ASSESSMENT", "INADEQUATE_CONTRACTUAL_CLAUSES", "NOT_APPLICABLE"),
}

# Multi-select questions that no wide or long table takes.
OTHER_MULTI_SELECT_OPTIONS = {
    "Q10": ("SME", "LARGE_ENTERPRISE", "MULTINATIONAL", "NON_PROFIT", "PUBLIC_SECTOR_BODY", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q25": ("ARTICLE_9_SPECIAL_CATEGORY", "ARTICLE_10_CRIMINAL", "NEITHER", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q28": ("IMMEDIATE_CONTAINMENT", "SYSTEM_FIXES", "SECURITY_IMPROVEMENTS", "STAFF_TRAINING", "EXTERNAL_AUDIT", "LEGAL_ADVICE",
            "COOPERATION_WITH_DPA", "NONE_MENTIONED", "NOT_APPLICABLE", "UNCLEAR"),
}

# --- single-choice vocabularies (fixed values; Q35 stands above) --------------
ENUM_OPTIONS = {
    "Q4": ("YES", "NO", "UNCLEAR", "NOT_DISCUSSED"),
    "Q5": ("UPHELD", "OVERTURNED", "MODIFIED", "REFERRED_BACK", "NOT_APPLICABLE", "NOT_DISCUSSED"),
    "Q6": ("YES", "NO"),
    "Q8": ("ORGANIZATION", "NATURAL_PERSON", "NOT_MENTIONED", "UNCLEAR"),
    "Q9": ("CONTROLLER", "PROCESSOR", "JOINT_CONTROLLER", "BOTH_CONTROLLER_AND_PROCESSOR", "NOT_MENTIONED", "UNCLEAR"),
    "Q11": ("LOCAL_MUNICIPAL", "REGIONAL_PROVINCIAL", "NATIONAL_FEDERAL", "SUPRANATIONAL", "NOT_APPLICABLE", "UNCLEAR"),
    "Q13": ("YES", "NO", "UNCLEAR"),
    "Q14": ("UNDER_2M", "2M_TO_10M", "10M_TO_50M", "50M_TO_250M", "250M_TO_1B", "OVER_1B", "NOT_APPLICABLE", "FIGURE_UNCLEAR"),
    "Q15": ("COMPLAINT", "BREACH_NOTIFICATION", "EX_OFFICIO_DPA_INITIATIVE", "REFERRAL_FROM_OTHER_AUTHORITY", "MEDIA_PUBLIC_ATTENTION",
            "JOINT_INVESTIGATION", "FOLLOW_UP_PRIOR_CASE", "OTHER", "NOT_MENTIONED", "UNCLEAR"),
    "Q16": ("YES", "NO", "UNCLEAR"),
    "Q17": ("YES_REQUIRED", "NO_NOT_REQUIRED", "DEFENDANT_DISPUTED_REQUIREMENT", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q18": ("YES_SUBMITTED", "NO_NOT_SUBMITTED", "PARTIALLY_SUBMITTED", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q19": ("YES_WITHIN_72H", "NO_LATE", "TIMING_DISPUTED", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q20": ("1_TO_7_DAYS", "1_TO_4_WEEKS", "1_TO_6_MONTHS", "OVER_6_MONTHS", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q22": ("INTERNAL_CAUSE", "EXTERNAL_CAUSE", "MIXED_CAUSES", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q23": ("YES_MATERIALIZED", "NO_RISK_ONLY", "MIXED_SOME_HARM", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q24": ("UNDER_100", "100_TO_1000", "1000_TO_10000", "10000_TO_100000", "OVER_100000", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q26": ("YES_NOTIFIED", "NO_NOT_NOTIFIED", "PARTIALLY_NOTIFIED", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q27": ("YES_REQUIRED", "NO_NOT_REQUIRED", "DISPUTED_REQUIREMENT", "NOT_APPLICABLE", "NOT_MENTIONED", "UNCLEAR"),
    "Q29": ("YES_AGGRAVATING_FACTOR", "YES_MITIGATING_FACTOR", "MENTIONED_NO_CLEAR_IMPACT", "NOT_MENTIONED", "NO_FINE_IMPOSED", "NOT_APPLICABLE"),
    "Q39": ("HIT_4PCT_TURNOVER_CAP", "HIT_20M_ADMIN_CAP", "HIT_10M_ADMIN_CAP", "BELOW_ALL_CAPS", "NOT_APPLICABLE"),
    "Q40": ("DAYS", "WEEKS", "MONTHS", "YEARS", "ONGOING", "NOT_SPECIFIED"),
    "Q43": ("YES_MATERIAL_HARM", "YES_NON_MATERIAL_HARM", "YES_BOTH_TYPES", "NO_HARM_DOCUMENTED", "NOT_DISCUSSED"),
    "Q44": ("YES_QUANTIFIED", "YES_MENTIONED_UNQUANTIFIED", "NO_BENEFIT", "NOT_DISCUSSED"),
    "Q45": ("FULL_COOPERATION", "PARTIAL_COOPERATION", "NON_COOPERATIVE", "OBSTRUCTIVE", "NOT_DISCUSSED"),
    "Q48": ("YES_FIRST_TIME", "NO_REPEAT_OFFENDER", "UNCLEAR", "NOT_DISCUSSED"),
    "Q49": ("YES_LEAD_AUTHORITY_CASE", "YES_MULTIPLE_DPAS_INVOLVED", "NO_SINGLE_JURISDICTION", "NOT_DISCUSSED"),
    "Q51": ("ABILITY_TO_PAY_CONSIDERED_REDUCING", "ABILITY_TO_PAY_NOT_AFFECTING", "SME_CONSIDERATION_APPLIED", "FINANCIAL_DISTRESS_NOTED",
            "NOT_DISCUSSED"),
    "Q55": ("IMMEDIATE", "WITHIN_MONTH", "1_TO_6_MONTHS", "OVER_6_MONTHS", "NO_DEADLINE_SPECIFIED", "NOT_APPLICABLE"),
    "Q60": ("YES_REQUIRED_AND_APPOINTED", "YES_REQUIRED_NOT_APPOINTED", "YES_VOLUNTARY_APPOINTMENT", "NO_REQUIREMENT", "NOT_DISCUSSED"),
    "Q62": ("SINGLE_JURISDICTION_DOMESTIC", "LEAD_SUPERVISORY_AUTHORITY_CASE", "CONCERNED_AUTHORITY_CASE", "JOINT_INVESTIGATION",
            "NON_EU_ENTITY_INVOLVED", "UNCLEAR"),
    "Q63": ("YES_VIOLATIONS_FOUND", "YES_COMPLIANT_TRANSFERS", "YES_MENTIONED_NO_ASSESSMENT", "NOT_DISCUSSED"),
    "Q65": ("YES_SIGNIFICANT_PRECEDENT", "YES_CLARIFIES_EXISTING_LAW", "ROUTINE_APPLICATION", "UNCLEAR"),
    "Q66": ("YES_EXTENSIVE_REFERENCES", "YES_SOME_REFERENCES", "NO_REFERENCES", "UNCLEAR"),
}
# Questions without options, by kind.
OPEN_QUESTIONS = {"Q1": "RAW", "Q2": "TYPE", "Q3": "FORMAT", "Q7": "TYPE", "Q12": "TYPE", "Q36": "TYPE", "Q37": "TYPE", "Q38": "TYPE",
                  "Q52": "TYPE", "Q67": "TYPE", "Q68": "TYPE"}

# --- ordinal scales and imputation ------------------------------------------
ORDINALS = {
    "Q40": {"DAYS": 1, "WEEKS": 2, "MONTHS": 3, "YEARS": 4, "ONGOING": 5},
    "Q45": {"OBSTRUCTIVE": 0, "NON_COOPERATIVE": 1, "PARTIAL_COOPERATION": 2, "FULL_COOPERATION": 3},
    "Q55": {"IMMEDIATE": 0, "WITHIN_MONTH": 1, "1_TO_6_MONTHS": 2, "OVER_6_MONTHS": 3},
    "Q65": {"ROUTINE_APPLICATION": 0, "YES_CLARIFIES_EXISTING_LAW": 1, "YES_SIGNIFICANT_PRECEDENT": 2},
}
TURNOVER_MIDPOINTS = {
    "UNDER_2M": 1.0e6, "2M_TO_10M": 6.0e6, "10M_TO_50M": 3.0e7, "50M_TO_250M": 1.5e8,
    "250M_TO_1B": 6.25e8, "OVER_1B": 1.0e9,
}
