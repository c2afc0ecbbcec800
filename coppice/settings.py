"""Column contracts, weights, search ranges and report wording.

Everything here is a constant that callers' data or results depend on; nothing is computed.
"""

# The six input columns; the first two are enough to browse, all six to score.
ITEM_COLUMNS = [
    "technology_name",
    "Technology_Description",
    "Web_of_Science_Category",
    "OECD_Research_Area",
    "emerging_tech_concepts",
    "applied_domain",
]
BROWSE_COLUMNS = ["technology_name", "Technology_Description"]

LEVELS = ["category_level_1", "category_level_2", "category_level_3"]

# Tag metric -> (source column, list syntax, statistic).
TAG_METRICS = {
    "wos_jaccard": ("Web_of_Science_Category", "semicolon", "jaccard"),
    "oecd_coherence": ("OECD_Research_Area", "semicolon", "jaccard"),
    "domain_overlap": ("applied_domain", "list", "jaccard"),
    "concept_coherence": ("emerging_tech_concepts", "list", "dominant"),
}

# Score weights before and after the judge has rated the clusters.
STAGE1_WEIGHTS = {
    "wos_jaccard": 0.30,
    "concept_coherence": 0.25,
    "domain_overlap": 0.20,
    "oecd_coherence": 0.15,
    "silhouette": 0.10,
}
FINAL_WEIGHTS = {
    "judge_coherence": 0.40,
    "wos_jaccard": 0.20,
    "concept_coherence": 0.15,
    "domain_overlap": 0.10,
    "oecd_coherence": 0.10,
    "silhouette": 0.05,
}
JUDGE_DEFAULT = 3
JUDGE_MAX = 5.0

# Cluster-count ranges per level, and density sizes.
L1_KS = list(range(4, 13))
L2_KS = list(range(2, 7))
L3_KS = list(range(2, 5))
SWEEP_MIN_SIZES = [5, 8, 10, 15, 20]
SPECTRAL_MAX_ITEMS = 200

# Acceptance thresholds.
MIN_SPLIT_SIZE = 8
L2_MIN_SCORE = 0.10
L3_MIN_SCORE = 0.05
ACCEPT_QUALITY = 0.40
L1_ATTEMPTS = 3
SHORTLIST_TREE = 10
SHORTLIST_GRID = 20
CONSOLIDATE_COSINE = 0.80
ORPHAN_MAX_LEAF = 3
ORPHAN_DISTANCE_FACTOR = 1.5
ORPHAN_IMPROVEMENT = 0.7
SMALL_LEAF_SIZE = 2

# The experiment grid.
GRID_KS = list(range(3, 13))
GRID_LINKAGES = ["ward", "complete", "average"]
GRID_MIN_SIZES = [5, 8, 10, 15, 20, 25]
GRID_MODELS = {"cohere": 2048, "titan": 8192}  # model -> characters of text embedded
TEXT_VARIANTS = {
    "v1": ["Description"],
    "v2": ["Scientific domains", "Description"],
    "v3": ["Concepts", "Domains", "Description"],
    "v4": ["Scientific domains", "Research areas", "Description"],
    "v5": ["Scientific domains", "Research areas", "Concepts", "Domains", "Description"],
}
TEXT_FIELDS = {
    "Technology": "technology_name",
    "Scientific domains": "Web_of_Science_Category",
    "Research areas": "OECD_Research_Area",
    "Concepts": "emerging_tech_concepts",
    "Domains": "applied_domain",
    "Description": "Technology_Description",
}

# Batch and digest sizes.
EMBED_BATCH = 10
EMBED_CHARS = 2048
LEAF_BATCH = 7
DIGEST_ITEMS = 30
JUDGE_CHARS = 150
NAMING_CHARS = 200
SUMMARY_CHARS = 400
SEARCH_CHARS = 300
PALETTE_SIZE = 20

# Words that say nothing in a group name.
GENERIC_WORDS = [
    "Frontier", "Emerging", "Exotic", "Advanced", "Novel", "Breakthrough", "Cutting-edge",
    "Next-gen", "Innovative", "Future", "Dual-Use", "Other", "Miscellaneous",
    "Unconventional", "Various", "General",
]
UNNAMED = "Unnamed Group"

# Review wording as reviewers see it.
UNCLASSIFIED = "לא מסווג"
ITEM_YELLOW = "⚠️ טכנולוגיה חריגה בקבוצה (אותו בודק)"
ITEM_RED = "⛔ טכנולוגיה לא מתאימה בקבוצה (לבדוק ולשייך ידנית לבודק)"
MIXED_BANNER = "⛔ קבוצה מעורבת — לבדוק ולשייך ידנית לבודקים"
MIXED_MARK = "⛔ "
HOME_NOTE = "↪ הבית הראשי: "
ALSO_NOTE = "רלוונטי גם ל: "
ALT_NOTE = "תת-תחום חלופי"
SUB_TITLE_MARK = "📂  "
REVIEW_HEADERS = {
    "technology_name": "technology_name",
    "Technology_Description": "Technology_Description",
    "category_level_1": "category_level_1",
    "category_level_2": "category_level_2",
    "category_level_3": "category_level_3",
    "leaf_category": "leaf_category",
    "alt_sub_domain": "תת-תחום חלופי",
    "cross_relevance": "רלוונטיות לתחום נוסף",
    "item_flag": "⚠️ חריגה אפשרית",
    "answer_exists": "קיימת? (כן/לא/לא בטוח)",
    "answer_name": "שם נכון/מקובל",
    "answer_notes": "הערות כלליות",
    "answer_local": "מי עובד על זה בישראל?",
}
ANSWER_COLUMNS = ["answer_exists", "answer_name", "answer_notes", "answer_local"]
