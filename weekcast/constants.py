"""Fixed values the forecasting contract depends on."""

from __future__ import annotations

import datetime as dt

# --- Fixed values: forecasting protocol -------------------------------------
HORIZONS = (13, 26)
MIN_HISTORY = 104
GRID_WEEKS = 4
GRID_ANCHOR = dt.date(1970, 1, 3)  # a Saturday
MIN_TRAIN_ROWS = 40
MIN_TRAIN_FAMILIES = 4
MIN_TRAIN_ORIGINS = 4
MIN_CALIBRATION = 20
MIN_SELECTION_CASES = 20
MIN_SELECTION_ORIGINS = 2
SELECTION_GATE = 0.95
SEALED_WEEKS = 52
RIDGE_ALPHA = 10.0
CLIP_LOW, CLIP_HIGH = -20.0, 30.0
DIRECTION_BAND = 0.1
INTERVAL_QUANTILES = (0.1, 0.9)
HOLDOUT_MODULUS = 5

AMAZON_FEATURES = (
    "level_log",
    "short_momentum",
    "quarter_momentum",
    "halfyear_momentum",
    "seasonal_momentum",
    "volatility",
)
ABA_FEATURES = ("rank_log", "rank_momentum")
GOOGLE_FEATURES = ("google_level", "google_short", "google_quarter")
FEATURES = AMAZON_FEATURES + ABA_FEATURES + GOOGLE_FEATURES

RIDGE_MODELS = {
    "ridge_amazon": AMAZON_FEATURES,
    "ridge_google": AMAZON_FEATURES + GOOGLE_FEATURES,
    "ridge_aba": AMAZON_FEATURES + ABA_FEATURES,
    "ridge_all": FEATURES,
}
BASELINE = "last13mean"
MODELS = (BASELINE, "seasonal", "ridge_amazon", "ridge_google", "ridge_aba", "ridge_all")
ABLATIONS = {
    "google_ablation_matched_cases": ("ridge_amazon", "ridge_google"),
    "aba_ablation_matched_cases": ("ridge_amazon", "ridge_aba"),
    "google_ablation_with_aba_matched_cases": ("ridge_aba", "ridge_all"),
    "aba_ablation_with_google_matched_cases": ("ridge_google", "ridge_all"),
}
SEALED_SPLITS = ("sealed_test", "group_sealed_test")

# --- Fixed values: vendors, tools and request shapes -------------------------
VENDOR_A = "sellersprite"
VENDOR_B = "sif"
VENDORS = (VENDOR_A, VENDOR_B)
MARKETPLACE = "US"
VENDOR_A_TOOLS = {"amazon": "aba_research_trend", "google": "google_trend"}
VENDOR_B_TOOL = "market_get_keyword_history"
VENDOR_B_TOOLS = (VENDOR_B_TOOL, "sif_market_get_keyword_history")
BATCH_SIZE = 5
CACHE_DAYS = 7
MIN_OVERLAP_WEEKS = 104

# --- Fixed values: usage ledger ----------------------------------------------
COUNTED_STATUSES = (
    "reserved",
    "calling",
    "received",
    "staged",
    "saved",
    "failed_unknown_charge",
    "failed_provider",
    "failed_invalid_response",
    "failed_storage",
    "corrupt_file",
)
FINAL_FAILURES = (
    "failed_before_send",
    "failed_unknown_charge",
    "failed_provider",
    "failed_invalid_response",
    "failed_storage",
    "corrupt_file",
)

# --- Fixed values: catalog text rules ----------------------------------------
NAME_ALIASES = {
    "trans-resveratrol": "resveratrol",
    "creatine monohydrate": "creatine",
    "hyaluronic acid": "hyaluronic acid",
    "citrus bergamia polyphenols": "bergamot extract",
}
FAMILY_PREFIXES = ("magnesium", "collagen", "omega-3", "probiotics")
PET_CATEGORY = "pet_health"
EXCLUDED_CATEGORIES = ("pet_health", "delivery_innovation")
MIXTURE_MARKS = ("+", "/", "complex")
PINNED_ID = "urolithin-a"
BRAND_OVERRIDES = {"urolithin a": ("Timeline", "Mitopure", "Amazentis")}

# --- Fixed values: news ------------------------------------------------------
REGIONS = {"US": "United States", "CA": "Canada", "MX": "Mexico"}
EVIDENCE = ("verified_primary", "verified_secondary", "unverified")
SOURCE_KINDS = (
    "brand_announcement",
    "brand_education",
    "independent_media",
    "research",
    "official",
)
TRACKING_PARAMETERS = ("fbclid", "gclid", "mc_cid", "mc_eid")
NEWS_WORDS = {
    "en": "news launch research announcement",
    "fr": "actualités lancement recherche communiqué",
    "es": "noticias lanzamiento investigación comunicado",
}
NEWS_MONTHS = 3

# --- Fixed values: two-run compatibility -------------------------------------
COMPATIBLE_TOP_LEVEL = ("schema_version", "as_of", "scope")
COMPATIBLE_METHOD = (
    "target",
    "baseline",
    "horizons_weeks",
    "min_history_weeks",
    "origin_step_weeks",
    "training_step_weeks",
    "sealed_test_start",
    "selection",
    "group_holdout",
    "features",
    "ridge_alpha",
    "target_transform",
)
