"""Word lists, names and texts that results must agree on.

All of them are defaults.  The operators take a lexicon as an argument, so a
user can pass their own.
"""

from __future__ import annotations

# --- fixed values: the three known sources -------------------------------
SOURCES = ["app_store", "play_store", "reddit"]

# --- fixed values: segment tags, in output order -------------------------
SEGMENT_TERMS = {
    "Premium User": [
        "premium", "subscription", "pay", "paid", "cost", "price", "billing", "subscribe",
    ],
    "Free User": ["free user", "free tier", "ads", "advertisement", "commercials", "sponsor"],
    "Discovery Issue": [
        "recommend", "suggest", "discover", "loop", "same song", "playlist", "shuffle",
        "repeat", "boring", "fatigue", "echo chamber",
    ],
    "UI/UX Issue": ["ui", "ux", "button", "interface", "layout", "design", "navigation"],
    "Performance/Stability Issue": [
        "crash", "freeze", "slow", "bug", "broken", "lag", "stop", "offline",
    ],
}
DEFAULT_SEGMENT = "General Feedback"

# --- fixed values: cluster themes, in order of priority ------------------
THEME_TERMS = {
    "Recommendation Repeat Loop Fatigue": [
        "loop", "repeat", "same song", "shuffle", "boring", "same tracks", "over and over",
        "echo chamber",
    ],
    "Free User Ad Frequency Frustration": [
        "ads", "free", "commercial", "advertisement", "sponsor",
    ],
    "Interface Layout and Navigation Disruption": [
        "ui", "layout", "design", "widget", "navigation", "interface", "home screen",
    ],
    "App Performance and Stability Glitches": [
        "crash", "slow", "bug", "lag", "stop", "freeze", "not working", "broken",
    ],
    "Music Discovery Algorithm Opacity": [
        "discover", "recommend", "algorithm", "suggest", "new music", "find", "explore",
    ],
    "Premium Value Perception Gap": [
        "premium", "subscription", "price", "cost", "pay", "billing", "worth", "expensive",
        "cancel",
    ],
    "Playlist and Daily Mix Staleness": [
        "playlist", "mix", "daily mix", "radio", "station", "curated", "discover weekly",
    ],
    "Offline Mode and Data Usage Friction": [
        "offline", "download", "storage", "data", "internet", "network", "connection", "wifi",
    ],
}
DEFAULT_THEME = "User Experience Insights"
EMPTY_THEME = "General Feedback"
EMPTY_ACTION = "Gather more reviews for detailed analysis."
NOISE_THEME = "Unclustered General Feedback"
NOISE_ACTION = "Monitor for new emerging themes as feedback grows."

# --- fixed values: words in a theme name -------------------------------
FRICTION_TERMS = ["loop", "shuffle", "repeat", "recommend"]
NEGATIVE_NAME_TERMS = [
    "fatigue", "frustration", "disruption", "glitch", "gap", "stale", "friction", "opacity",
]

# --- fixed values: what each segment needs -----------------------------
SEGMENT_NEEDS = {
    "Premium User": "Wants personalized recommendations, true variety in shuffle, and high-quality offline playback without repetitiveness or profile stagnation.",
    "Free User": "Needs reasonable ad frequencies, functional basic player controls (skips), and discovery mixes that do not feel overly restricted.",
    "Discovery Issue": "Requires better recommendation algorithms, less familiarity bias/echo chambers, and controls to reset or adjust their music taste profiles.",
    "UI/UX Issue": "Wants clean navigation layouts, simple playlist/library organization, and functional, responsive player/queue controls.",
    "Performance/Stability Issue": "Needs app stability, fast launch times, reliable offline sync, and battery/storage optimizations.",
}
DEFAULT_NEED = "Needs overall improvements and prompt responses to user feature requests."

# --- our own short playbook: one action of at most 25 words per theme ----
THEME_ACTIONS = {
    "Recommendation Repeat Loop Fatigue": "Test a repeat limit in shuffle that rests each played track for a week, and compare skip rates.",
    "Free User Ad Frequency Frustration": "Test fewer but longer ad breaks for free listeners and compare session length and upgrades.",
    "Interface Layout and Navigation Disruption": "Offer the former layout as an option to half of the affected users and compare task completion.",
    "App Performance and Stability Glitches": "Fix the top crash and freeze reports first and track crash-free sessions before and after.",
    "Music Discovery Algorithm Opacity": "Show why each song is suggested, add a control for novelty, and measure saves of new artists.",
    "Premium Value Perception Gap": "Show subscribers a monthly summary of what their plan gave them and compare cancellation rates.",
    "Playlist and Daily Mix Staleness": "Refresh generated mixes every two days for a test group and compare open rates.",
    "Offline Mode and Data Usage Friction": "Download likely playlists overnight on wifi for a test group and compare offline listening.",
    "User Experience Insights": "Review these comments with design and support each fortnight and rank the three most frequent pains.",
}

# --- fixed values: replacement tokens and patterns of personal data ------
# (?U) makes \d, \w and \b follow Unicode.  Order matters.
PII_PATTERNS = [
    ("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[REDACTED_EMAIL]"),
    ("phone", r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]"),
    ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[REDACTED_IP]"),
    ("handle", r"@\w+", "[REDACTED_HANDLE]"),
]
ALLOWED_CHARACTERS = r"""[a-zA-Z0-9\s.,!?'"()\-]*"""
MAX_CONTENT_LENGTH = 50
ENGLISH_ASCII_SHARE = 0.88

# --- fixed values: TF-IDF tokens and width -------------------------------
TOKEN_PATTERN = r"\b\w\w+\b"
VECTOR_WIDTH = 1536
