"""Names, templates, word lists, labels and limits that results depend on."""

# Report sections and the checks on an extracted document.
SECTIONS = [
    "glomerular_lesions",
    "tubulointerstitial_lesions",
    "vascular_lesions",
    "immunofluorescence",
]
REQUIRED_SECTIONS = [
    "MEST_C_score",
    "glomerular_lesions",
    "tubulointerstitial_lesions",
    "vascular_lesions",
    "immunofluorescence",
    "key_pathology_terms",
]
SCORE_SECTION = "MEST_C_score"
SCORE_KEYS = ["M", "E", "S", "T", "C"]
REMOVED_KEY = "complement_membrane_attack_complex_C5b-9"
FILE_PREFIX = "pathology_features_"
MIN_REPORT_CHARS = 10

# The report template with its defaults.
_DEPOSIT = {"present": False, "intensity": "", "distribution": ""}
TEMPLATE = {
    "MEST_C_score": {"M": "", "E": "", "S": "", "T": "", "C": ""},
    "glomerular_lesions": {
        "quantitative": {
            "total_glomeruli": 0,
            "global_sclerosis_ratio": "",
            "segmental_sclerosis_ratio": "",
            "cellular_crescents_ratio": "",
            "fibrocellular_crescents_ratio": "",
            "fibrous_crescents_ratio": "",
        },
        "qualitative": {
            "endocapillary_hypercellularity_degree": "",
            "mesangial_hypercellularity_degree": "",
            "neutrophil_infiltration_present": False,
            "fibrinoid_necrosis_present": False,
            "capillary_loop_abnormalities": "",
        },
    },
    "tubulointerstitial_lesions": {
        "chronic_features": {
            "tubular_atrophy_degree": "",
            "tubular_atrophy_percentage": "",
            "interstitial_fibrosis_degree": "",
            "interstitial_fibrosis_percentage": "",
        },
        "active_inflammatory_features": {
            "inflammatory_infiltration_present": False,
            "inflammatory_infiltration_degree": "",
            "inflammatory_infiltration_distribution": "",
            "inflammatory_cell_composition": {
                "lymphocytes": "",
                "plasma_cells": "",
                "neutrophils": "",
                "eosinophils": "",
            },
            "tubulitis_present": False,
            "tubulitis_degree": "",
            "edema_present": False,
        },
        "tubular_dilatation_degree": "",
        "tubular_regeneration_present": False,
    },
    "vascular_lesions": {
        "chronic_changes": {
            "arteriolosclerosis_severity": "",
            "intimal_fibrosis_severity": "",
            "medial_hypertrophy_severity": "",
        },
        "active_vascular_lesions": {
            "vasculitis_present": False,
            "vasculitis_type": "",
            "thrombotic_microangiopathy_acute_present": False,
            "thrombotic_microangiopathy_acute_features": "",
            "vascular_inflammatory_infiltrate_present": False,
            "vascular_inflammatory_infiltrate_cell_type": "",
        },
        "hyaline_arteriolosclerosis_description": "",
    },
    "immunofluorescence": {
        "IgA_deposition": {"intensity": "", "distribution_pattern": "", "location": ""},
        "co_deposits": {
            "IgG": dict(_DEPOSIT),
            "IgM": dict(_DEPOSIT),
            "C3": dict(_DEPOSIT),
            "C1q": dict(_DEPOSIT),
            "kappa_light_chain": dict(_DEPOSIT),
            "lambda_light_chain": dict(_DEPOSIT),
        },
        "fibrinogen_deposition": dict(_DEPOSIT),
    },
    "inflammation_activity_summary": {
        "glomerular_activity_score": "",
        "tubulointerstitial_activity_score": "",
        "vascular_activity_score": "",
        "overall_inflammatory_burden": "",
    },
    "key_pathology_terms": [],
}

# Feature-name prefixes, groups and abbreviations.
FEATURE_SECTIONS = [
    "tubulointerstitial_lesions",
    "glomerular_lesions",
    "vascular_lesions",
    "immunofluorescence",
    "inflammation_activity_summary",
]
MAIN_GROUPS = {
    "tubulointerstitial_lesions_": "Tubulointerstitial",
    "glomerular_lesions_": "Glomerular",
    "vascular_lesions_": "Vascular",
    "immunofluorescence_": "Immunofluorescence",
    "inflammation_activity_summary_": "Inflammation summary",
}
SUBGROUPS = {
    "tubulointerstitial_lesions_chronic_tubular_": "TI chronic tubular",
    "tubulointerstitial_lesions_chronic_interstitial_": "TI chronic interstitial",
    "tubulointerstitial_lesions_active_inflammatory_": "TI active inflammatory",
    "glomerular_lesions_qualitative_": "Glom qualitative",
    "glomerular_lesions_quantitative_": "Glom quantitative",
    "vascular_lesions_chronic_changes_": "Vasc chronic changes",
    "vascular_lesions_hyaline_": "Vasc hyaline",
    "immunofluorescence_": "IF",
    "inflammation_activity_summary_": "Inflam summary",
}
ABBREVIATIONS = {
    "tubulointerstitial_lesions_": "TI ",
    "glomerular_lesions_": "Glom ",
    "vascular_lesions_": "Vasc ",
    "immunofluorescence_": "IF ",
    "inflammation_activity_summary_": "Inflam ",
    "_features_": " ",
    "_quantitative_": " ",
    "_qualitative_": " ",
    "_chronic_changes_": " ",
    "_": " ",
}
OTHER_GROUP = "Other"
RANK_MISSING = 999

# Category markers and patterns.
MISSING = "missing"
RARE = "__RARE__"
RARE_SUFFIX = "(?:__RARE__|__RARE_|_RARE__|_RARE_)$"
NESTED_JSON = r"\{[^{}]*\{[^{}]*\}[^{}]*\}"
ANY_JSON = r"(?s)\{.*\}"

# Id columns by priority, names of methods.
ID_COLUMNS = ["phID", "bio_id", "source_file"]
COMMON_IDS = [
    "phID", "bio_id", "id", "ID", "sample_id", "sample_name",
    "patient_id", "subject_id", "case_id", "record_id",
]
NON_FEATURES = [
    "timestamp", "total_embedding_dim", "source_file", "phID", "bio_id", "row_id",
]
METHOD_NAMES = {
    "kmeans": "K-means",
    "gmm": "Gaussian mixture modeling",
    "spectral": "Spectral clustering",
    "hierarchical": "Hierarchical clustering",
    "dbscan": "DBSCAN",
    "hdbscan": "HDBSCAN",
}

# Row labels of the baseline table.
ROW_LABELS = {
    "n": "n",
    "age (mean (SD))": "Age (years)",
    "Gender = 女 (%)": "Female",
    "systolic_bp (mean (SD))": "Systolic blood pressure (mmHg)",
    "diastolic_bp (mean (SD))": "Diastolic blood pressure (mmHg)",
    "hypertentsion = 1 (%)": "Hypertension",
    "diabetic = 1 (%)": "Diabetes",
    "rapid_up24 = Yes (%)": "high-risk IgAN",
    "s_alb (mean (SD))": "Serum albumin (g/L)",
    "s_cr (mean (SD))": "Serum creatinine (μmol/L)",
    "s_cr (median [IQR])": "Serum creatinine (μmol/L)",
    "s_ua (mean (SD))": "Serum uric acid (μmol/L)",
    "s_hb (mean (SD))": "Hemoglobin (g/L)",
    "up24 (mean (SD))": "24-hour urine protein (g/24h)",
    "up24 (median [IQR])": "24-hour urine protein (g/24h)",
    "eGFR_onset (mean (SD))": "eGFR (ml/min/1.73m²)",
    "eGFR_onset (median [IQR])": "eGFR (ml/min/1.73m²)",
    "eGFR_category_onset (%)": "eGFR category",
    "s_iga (mean (SD))": "Serum IgA (g/L)",
    "s_igg (mean (SD))": "Serum IgG (g/L)",
    "s_igm (mean (SD))": "Serum IgM (g/L)",
    "MEST_C_score_M = 1 (%)": "MEST-C M1",
    "MEST_C_score_E = 1 (%)": "MEST-C E1",
    "MEST_C_score_S = 1 (%)": "MEST-C S1",
    "MEST_C_score_T (%)": "MEST-C T score",
    "MEST_C_score_C = 1 (%)": "MEST-C C1",
    "steroid = Yes (%)": "Corticosteroid therapy",
    "rasb = Yes (%)": "RAS blockade therapy",
    "mmf = Yes (%)": "Mycophenolate mofetil",
    "ctx = Yes (%)": "Cyclophosphamide",
    "fk506 = Yes (%)": "Tacrolimus",
    "aza = Yes (%)": "Azathioprine",
    "leflunomide = Yes (%)": "Leflunomide",
    "immuno = Yes (%)": "Immunosuppressive therapy",
}
