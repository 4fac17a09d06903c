"""Fixed values that must equal the published ones for right results."""

from __future__ import annotations

# --- Fixed values: evidence families and the largest score each may give ------
FAMILY_CAPS = {
    "EXACT_IDENTITY": 10.0,
    "FINANCIAL": 7.5,
    "INFRASTRUCTURE": 5.0,
    "CONTENT_NLP": 5.0,
    "STYLOMETRY": 3.0,
    "TEMPORAL": 2.0,
    "SEMANTIC_HANDLE": 2.0,
}
FAMILIES = tuple(FAMILY_CAPS)
DEFAULT_FAMILY = "CONTENT_NLP"
UNKNOWN_CAP_FUSION = 10.0
UNKNOWN_CAP_REPORT = 5.0

# --- Fixed values: feature priors (name, family, group, m, u) ------------------
FEATURE_PRIORS = [
    ("pgp_fingerprint_exact", "EXACT_IDENTITY", "pgp_identity", 0.9999, 0.00000001),
    ("ssh_host_key_fingerprint", "EXACT_IDENTITY", "ssh_identity", 0.999, 0.0000001),
    ("btc_address_reuse", "FINANCIAL", "wallet_cluster_btc", 0.95, 0.00001),
    ("btc_co_input_clustering", "FINANCIAL", "wallet_cluster_btc", 0.90, 0.0001),
    ("favicon_mmh3_hash", "INFRASTRUCTURE", "web_server_fingerprint", 0.92, 0.0001),
    ("ssl_tls_cert_serial", "INFRASTRUCTURE", "web_server_fingerprint", 0.88, 0.0005),
    ("simhash_clone_95", "CONTENT_NLP", "site_content_nlp", 0.85, 0.001),
    ("unique_typo_signature", "CONTENT_NLP", "site_content_nlp", 0.75, 0.005),
    ("stylometry_burrows_delta", "STYLOMETRY", "author_stylometry", 0.82, 0.01),
    ("temporal_diurnal_fit", "TEMPORAL", "post_activity_temporal", 0.70, 0.10),
    ("handle_trigram_fuzzy", "SEMANTIC_HANDLE", "handle_alias", 0.80, 0.05),
]
CONTRADICTION_PRIORS = [
    ("temporal_impossible_overlap", 15.0),
    ("pgp_key_conflict", 20.0),
]
CONTRADICTION_FAMILY = "TEMPORAL"
CONTRADICTION_GROUP = "contradiction"

# --- Fixed values: defaults of rows whose feature has no prior -----------------
ROW_DEFAULTS = {"row": (0.90, 0.01), "factory": (0.80, 0.05)}

# --- Fixed values: weights of contradictions named in legacy rows --------------
LEGACY_CONTRADICTION_WEIGHTS = {
    "temporal_impossible_overlap": 15.0,
    "pgp_key_conflict": 20.0,
    "Temporal Impossibility": 15.0,
    "PGP Key Identity Conflict": 20.0,
    "Wallet Conflict": 8.0,
}
LEGACY_CONTRADICTION_DEFAULT = 10.0

# --- Fixed values: fusion and decision constants ------------------------------
DISCOUNT = 0.25
PRIOR_LOG_ODDS = -2.0
HIGH_PROBABILITY = 0.85
LOW_PROBABILITY = 0.50
RESCORE_FLOOR = 2.0

HIGH = "HIGH_CONFIDENCE_LINK"
LOW = "LOW_CONFIDENCE_LINK"
INSUFFICIENT = "INSUFFICIENT_EVIDENCE"
REJECTED = "CONTRADICTION_REJECTED"

# --- Fixed values: decisions and review verbs to stored statuses ---------------
DECISION_STATUS = {
    HIGH: "ACCEPTED",
    LOW: "PROPOSED",
    INSUFFICIENT: "INSUFFICIENT",
    REJECTED: "INSUFFICIENT",
}
REVIEW_STATUS = {"ACCEPT": "ACCEPTED", "REJECT": "REJECTED", "INSUFFICIENT": "INSUFFICIENT"}

# --- Fixed values: closed sets and length limits of an observation -------------
LAWFUL_BASES = ("passive_osint", "synthetic_seed", "honeypot")
SOURCE_TYPES = ("PASSIVE_ONION", "FORUM_CRAWL", "HONEYPOT", "SYNTHETIC")
OBSERVATION_LIMITS = {"raw_content": 200000, "source_name": 255, "source_uri": 512}

# --- Fixed values: identifier kinds (kind, group, confidence, pattern) ---------
IDENTIFIER_PLAN = [
    ("PGP_FINGERPRINT", "pgp_identity", 0.99,
     r"\b(?:[A-Fa-f0-9]{4}\s?){10}\b|\b[A-Fa-f0-9]{40}\b"),
    ("BTC_ADDRESS", "wallet_cluster_btc", 0.95,
     r"\b(bc1[a-z0-9]{38,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"),
    ("ETH_ADDRESS", "wallet_cluster_eth", 0.95, r"\b0x[a-fA-F0-9]{40}\b"),
    ("XMR_ADDRESS", "wallet_cluster_xmr", 0.50,
     r"\b(4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}|8[0-9AB][1-9A-HJ-NP-Za-km-z]{93})\b"),
    ("ONION_SERVICE", "web_server_fingerprint", 0.90, r"\b[a-z2-7]{56}\.onion\b"),
    ("EMAIL", "semantic_contact", 0.85,
     r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("HANDLE", "handle_alias", 0.80, r"(?:^|\s)@([A-Za-z0-9_]{3,30})\b"),
]

# --- Fixed values: status-page markers ----------------------------------------
STATUS_PAGE_MARKERS = ("Apache Server Status", "Nginx Status", "<title>Apache Status</title>")

# --- Fixed values: mixer name patterns (trace list and shorter risk list) ------
MIXER_PATTERNS = ("mixer", "tumbler", "coinjoin", "chipmixer", "blender", "wasabi", "samourai")
RISK_MIXER_PATTERNS = ("mixer", "tumbler", "coinjoin", "wasabi")
PRIVATE_COIN_ADDRESS = r"^[48][0-9a-zA-B]{94,105}$"

# --- Fixed values: audit chain -------------------------------------------------
GENESIS_HASH = "0" * 64
FIELD_SEPARATOR = "\x1f"

# --- Fixed values: event topics -----------------------------------------------
TOPICS = (
    "stream:page_collected",
    "stream:extraction_completed",
    "stream:relationship_discovered",
    "stream:graph_projected",
)

# --- Fixed values: punctuation marks counted per 100 characters ----------------
PUNCTUATION = (".", ",", "!", "?", ";", ":", "-", '"', "'", "(", ")")

# --- Fixed values: English function words (174, in order) ----------------------
FUNCTION_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are",
    "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both",
    "but", "by", "can't", "cannot", "could", "couldn't", "did", "didn't", "do", "does", "doesn't",
    "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "had", "hadn't",
    "has", "hasn't", "have", "haven't", "having", "he", "he'd", "he'll", "he's", "her", "here",
    "here's", "hers", "herself", "him", "himself", "his", "how", "how's", "i", "i'd", "i'll",
    "i'm", "i've", "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself", "let's",
    "me", "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of", "off", "on",
    "once", "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own",
    "same", "shan't", "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some",
    "such", "than", "that", "that's", "the", "their", "theirs", "them", "themselves", "then",
    "there", "there's", "these", "they", "they'd", "they'll", "they're", "they've", "this",
    "those", "through", "to", "too", "under", "until", "up", "very", "was", "wasn't", "we",
    "we'd", "we'll", "we're", "we've", "were", "weren't", "what", "what's", "when", "when's",
    "where", "where's", "which", "while", "who", "who's", "whom", "why", "why's", "with", "won't",
    "would", "wouldn't", "you", "you'd", "you'll", "you're", "you've", "your", "yours",
    "yourself", "yourselves",
)
# --- Fixed values: padding of stored corpus statistics ------------------------
STATS_MEAN_FILL = 0.002
STATS_STD_FILL = 0.005
STATS_STD_FLOOR = 1e-5

MIN_EPISODE_WORDS = 50
MIN_SHORT_TEXT_TOKENS = 10
SHORT_TEXT_ABSTAIN_BELOW = 0.45
SHORT_TEXT_MATCH_FROM = 0.65

# --- Fixed values: evidence export header --------------------------------------
EVIDENCE_EXPORT_COLUMNS = (
    ("evidence_id", "Evidence ID"),
    ("family", "Family"),
    ("source_uri", "Source URI"),
    ("extraction_method", "Extraction Method"),
    ("value", "Value"),
    ("reliability", "Reliability Weight"),
    ("raw_llr", "Raw LLR"),
    ("contribution", "Contribution"),
    ("is_contradiction", "Is Contradiction"),
    ("dependence_group", "Dependence Group"),
    ("sha256", "SHA256 Hash"),
    ("timestamp", "Timestamp"),
)
