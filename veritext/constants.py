"""Fixed values.

Everything in this module must equal a published value for results to match: Python's white-space
and punctuation classes, the feature contract of the served tree model, the category dictionary,
the label map, the special token ids and the blend rule of the hybrid verdict. Sentiment constants
come from the published rule-based sentiment model (Hutto & Gilbert, ICWSM 2014). They are kept
together, in natural order, and used by name everywhere else.
"""

from __future__ import annotations

# --- fixed values: text classes ------------------------------------------------------------------

# The 29 characters Python's str.isspace() accepts, as a regex character-class body. Java's \s and
# \S are ASCII-only, so every white-space rule in this package uses this class instead. Written as
# escapes (Java syntax); DuckDB needs \x{...} for the four-digit code points (see WS_CLASS_RE2).
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CLASS_RE2 = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The same 29 characters as code points (ranges inclusive), for membership tests without a regex.
WS_CODE_POINTS = ([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                   0x2028, 0x2029, 0x202F, 0x205F, 0x3000])

# Python's string.punctuation: the 32 ASCII marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: labels and verdicts -----------------------------------------------------------

LABEL_MAP = {"OR": 1, "CG": 0}  # OR = original (human), CG = computer-generated
CLASS_DISPLAY = {0: "AI", 1: "Human"}
EXTREME_RATINGS = (1.0, 5.0)
DEFAULT_RATING = 5.0
DEFAULT_CATEGORY = "unknown"
TREE_WEIGHT = 0.3
TEXT_WEIGHT = 0.7
AI_THRESHOLD = 0.5
UNCERTAIN_BELOW = 0.7
IMPORTANCE_THRESHOLD = 0.020

# --- fixed values: axes of the parameter search (768 sets) ---------------------------------------

SEARCH_AXES = {
    "n_estimators": [50, 100, 200, 500],
    "learning_rate": [0.1, 0.3, 0.6, 1.0],
    "max_depth": [3, 6, 10],
    "reg_alpha": [0.0, 0.1, 0.5, 1.0],
    "reg_lambda": [0.1, 0.5, 1.0, 1.5],
}

# --- fixed values: feature contract of the served tree model (19 names, in order) ---------------

NUMERIC_FEATURES = [
    "rating", "char_length", "word_count", "punctuation_ct", "is_extreme_star", "sentiment_score",
]
TAG_FEATURES = ["VERB", "ADV", "NOUN"]
FEATURE_CONTRACT = NUMERIC_FEATURES + TAG_FEATURES + [
    "category_Books_5",
    "category_Clothing_Shoes_and_Jewelry_5",
    "category_Electronics_5",
    "category_Home_and_Kitchen_5",
    "category_Kindle_Store_5",
    "category_Movies_and_TV_5",
    "category_Pet_Supplies_5",
    "category_Sports_and_Outdoors_5",
    "category_Tools_and_Home_Improvement_5",
    "category_Toys_and_Games_5",
]

# --- fixed values: category dictionary (display name -> dataset name) ---------------------------

CATEGORY_MAPPING = [
    ("Unknown", "unknown"),
    ("Books", "Books"),
    ("Clothing, Shoes, and Jewelry", "Clothing_Shoes_and_Jewelry"),
    ("Electronics", "Electronics"),
    ("Home and Kitchen", "Home_and_Kitchen"),
    ("Kindle Store", "Kindle_Store"),
    ("Movies and TV", "Movies_and_TV"),
    ("Pet Supplies", "Pet_Supplies"),
    ("Sports and Outdoors", "Sports_and_Outdoors"),
    ("Tools and Home Improvement", "Tools_and_Home_Improvement"),
    ("Toys and Games", "Toys_and_Games"),
]

# --- fixed values: token encoding ----------------------------------------------------------------

PAD_ID = 0
UNK_ID = 100
CLS_ID = 101
SEP_ID = 102
MAX_SEQ_LEN = 512
BATCH_SIZE = 8

# --- fixed values: rule-based sentiment (published constants) -----------------------------------

NEGATION_SCALAR = -0.74
BOOSTER_INCREMENT = 0.293
BOOSTER_DAMPING = (1.0, 0.95, 0.9)  # booster 1, 2 or 3 tokens before the scored token
CONTRAST_BEFORE = 0.5  # tokens before the first contrast word ("but")
CONTRAST_AFTER = 1.5  # tokens after it
EXCLAMATION_INCREMENT = 0.292
EXCLAMATION_MAX = 4
NORMALIZATION_ALPHA = 15.0
LOOKBACK = 3
