"""Closed vocabularies; status columns are compared by value.

Fixed values: all words below are part of the results.
"""

COORD_STATES = ("observed", "NA_struct", "NA_fuse", "NA_topo", "residual_NA")
ELIGIBILITY = ("eligible", "ineligible", "unresolved", "not_applicable")
ELIGIBILITY_REASONS = (
    "eligible_declared", "analysis_domain_excluded", "taxon_domain_excluded", "measurement_qc_excluded", "user_predeclared_excluded", "authority_unresolved", "coordinate_not_observed",
)
CALIBRATION_STATUSES = (
    "CALIBRATED", "OBSERVED_ASSOCIATION_NONESTIMABLE", "OBSERVED_DIAGNOSTIC_NONESTIMABLE", "NULL_DOMAIN_MISMATCH", "NULL_REPLICATE_NONESTIMABLE", "NULL_CALIBRATION_INCOMPLETE", "NUMERICALLY_INDETERMINATE",
    "TOO_FEW_LABELLINGS",  # of this package: fewer labellings than worlds
)
RATE_REASONS = (
    "available", "input_zero_log_undefined", "baseline_zero", "baseline_unavailable", "numeric_indeterminate", "measurement_ineligible",
    "measurement_unresolved", "coordinate_unavailable", "observed_payload_unavailable", "cross_component_baseline_unavailable",
)
RATIO_STATES = ("POSITIVE", "EXACT_ZERO_BOUNDARY", "UNAVAILABLE")
ASSOCIATION_STATUSES = (
    "ESTIMABLE", "NO_ELIGIBLE_BRANCHES", "INSUFFICIENT_BRANCHES", "NO_TRAIT_VARIATION", "BINARY_REFERENCE_ABSENT", "BINARY_FOCAL_ABSENT", "NUMERICALLY_INDETERMINATE",
)
