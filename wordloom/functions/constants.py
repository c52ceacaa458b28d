"""Fixed values shared by the operators and their SQL oracles."""

from __future__ import annotations

# The six cognitive levels in their natural order, lower case.
LEVELS = ["remember", "understand", "apply", "analyze", "evaluate", "create"]

# Word token that marks each level in the driver's synthetic
# objectives view (remember, understand, apply, analyze, evaluate, create).
LEVEL_TOKENS = {
    "remember": "tion",
    "understand": "ou",
    "apply": "er",
    "analyze": "st",
    "evaluate": "nd",
    "create": "th",
}

# Event type -> level of the question-bank view; "error" is unmapped.
BANK_OBJECTIVE_TO_LEVEL = {
    "signup": "remember",
    "view": "understand",
    "click": "apply",
    "purchase": "analyze",
}

# Seeds of the hash-ordered splits (string prefixes of the md5 key).
SPLIT_SEED = "666"
SECOND_SPLIT_SEED = "667"
FOLD_SEED = "668"
UNDERSAMPLE_SEED = "0"
HALVING_SEED = "669"

# Share of rows in the test part of every two-way cut.
TEST_SHARE = 0.2
# Number of cross-validation folds and the successive-halving factor.
N_FOLDS = 3
HALVING_FACTOR = 3
HALVING_RUNGS = 3

# Vocabulary sizes.
MAX_FEATURES = 1000
SEQ_MAX_LENGTH = 55
TOP_FEATURES_PER_LEVEL = 20
TOP_FEATURE_FREQUENCY = 10

# Decimal places of every double in query results.
ROUND_DIGITS = 6

# The hyper-parameter grids of the reference's training script, per model, in its
# order.  Expand a grid with operators.search.expand_grid; operators.fits fits every candidate.
# The SVM kernels other than "linear" run as feature maps (operators.kernels).
REFERENCE_GRIDS = {
    "nb": {"var_smoothing": [1e-8, 1e-9, 1e-10]},
    "svm": {"C": [0.1, 1, 10, 100], "gamma": ["scale", "auto"], "kernel": ["linear", "poly", "rbf"]},
    "logreg": {"penalty": ["l1", "l2", "none"], "C": [0.1, 1, 10], "solver": ["saga"],
               "tol": [0.01, 0.001, 0.0001], "max_iter": [200, 500]},
    "rf": {"n_estimators": [50, 100, 250], "max_depth": [None, 5, 10], "max_features": ["auto", "sqrt"],
           "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4], "bootstrap": [True, False]},
    "gbt": {"gamma": [0.1, 0.5], "learning_rate": [0.1, 0.5], "max_depth": [5, 7, 10], "n_estimators": [50, 100]},
}
