"""Dataset readiness metrics as Spark DataFrame queries."""

from .operators.anonymity import (
    anonymity_guards,
    class_distances,
    entropy_risk,
    entropy_risk_histogram,
    equivalence_classes,
    k_anonymity,
    k_anonymity_histogram,
    l_diversity,
    l_diversity_histogram,
    t_closeness,
    t_closeness_histogram,
)
from .operators.association import correlations, pearson_matrix, theil_u_matrix
from .operators.fairness import (
    compare_representation,
    demographic_disparity,
    disparity_guards,
    rate_deviation,
    real_representation_rates,
    representation_rates,
    representation_shares,
    statistical_rates,
)
from .operators.imbalance import class_distribution, imbalance_degree, imbalance_guards
from .operators.metadata import (
    datacite_checks,
    datacite_scores,
    dcat_checks,
    dcat_scores,
    document_status,
    fair_scores,
    flatten_documents,
    other_keys,
)
from .operators.noise import add_laplace_noise, noise_box_plot, noise_statistics
from .operators.profile import class_candidates, density, feature_types, summary_statistics
from .operators.quality import (
    completeness_by_column,
    duplicity,
    outlier_rates,
    outlier_score,
    overall_completeness,
)
from .operators.reidentification import (
    attribute_risk_statistics,
    attribute_risks,
    box_summary,
    combination_risk_statistics,
    combination_risks,
    dataset_risk,
    reidentification_guards,
    risk_box_plot,
    risk_fliers,
    row_attribute_risks,
    row_risks,
)
from .operators.relevance import (
    chi_square_independence,
    feature_relevance,
    impute_categorical,
    impute_mean,
    label_codes,
    label_encode,
    one_hot,
    one_hot_long,
)
from .report import readiness_report, tidy
from .sources.missing import normalize_missing
from .sources.readers import (
    decode_npz,
    json_keys,
    json_rows,
    keep_keys,
    read_csv,
    read_documents,
    read_json_rows,
    read_npz,
)
from .sources.writers import write_report, write_table

__all__ = [name for name in dir() if not name.startswith("_")]
