"""Platform specifications.

A platform is plain data: where the record array sits in an export document,
which keys hold the text and the time, the keyword rules for classification
and tagging, and the confidence given to its records.  Every read / classify /
tag expression is generated from a spec, so adding a platform means adding a
``PlatformSpec`` to ``PLATFORMS`` -- no new code path and no per-row UDF.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PlatformSpec:
    name: str
    # Keys of an object wrapping the record array, tried in order (an empty
    # array under one key falls through to the next).  Empty = top-level array only.
    wrapper_keys: tuple[str, ...] = ()
    # Keys holding the record text, tried in order; empty string falls through.
    text_keys: tuple[str, ...] = ("memory",)
    # Keys holding the creation time, tried in order.
    time_keys: tuple[str, ...] = ("created_at",)
    # Whether bare strings are accepted as records.
    accept_strings: bool = True
    # Category rules in tie-break order: (category, keywords).
    category_rules: tuple[tuple[str, tuple[str, ...]], ...] = ()
    # Keyword -> tag, in map order.
    tag_map: tuple[tuple[str, str], ...] = ()
    confidence: float = 0.85
    default_category: str = "personal"
    max_tags: int = 5
    extra: dict = field(default_factory=dict)


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical classification and
# tagging.  Keywords are matched as substrings of the lower-cased text exactly
# as written here: a keyword with upper-case letters can therefore never match
# in classification, while tag keywords are lower-cased before matching.
# ---------------------------------------------------------------------------

CHATGPT_CATEGORY_RULES = (
    ("professional", ("engineer", "developer", "scientist", "researcher", "work", "job",
                      "career", "startup", "code", "programming", "software", "data",
                      "AI", "research", "paper", "visa", "machine learning", "backend",
                      "frontend")),
    ("project", ("building", "side project", "working on", "developing", "creating",
                 "launching", "project", "app", "tool", "platform")),
    ("preference", ("prefer", "favourite", "favorite", "love", "hate", "dislike", "like",
                    "enjoy", "dark mode", "coffee", "tea", "music", "food", "annoyed",
                    "find it hard")),
    ("personal", ("live", "lives", "dog", "cat", "pet", "family", "learning", "hobby",
                  "book", "read", "morning", "evening", "named", "called")),
    ("relationship", ("friend", "partner", "spouse", "colleague", "teammate", "mentor",
                      "manager")),
)

CHATGPT_TAG_MAP = (
    ("engineer", "engineering"), ("python", "python"), ("rust", "rust"),
    ("javascript", "javascript"), ("typescript", "typescript"),
    ("coffee", "coffee"), ("music", "music"), ("jazz", "jazz"),
    ("dog", "pets"), ("cat", "pets"), ("book", "reading"),
    ("japanese", "languages"), ("spanish", "languages"), ("french", "languages"),
    ("dark mode", "preferences"), ("remote", "remote-work"),
    ("startup", "startup"), ("AI", "AI"), ("research", "research"),
    ("project", "project"), ("learning", "learning"), ("travel", "travel"),
)

CLAUDE_CATEGORY_RULES = (
    ("professional", ("engineer", "developer", "scientist", "researcher", "work", "job",
                      "career", "startup", "code", "programming", "software", "data",
                      "AI", "ML", "research", "paper", "published", "arXiv", "visa", "EB-1",
                      "pipeline", "model", "embedding", "evaluation", "benchmark", "ETL",
                      "agent")),
    ("project", ("building", "side project", "working on", "developing", "creating",
                 "launching", "project", "app", "tool", "platform", "product")),
    ("preference", ("prefer", "favourite", "favorite", "love", "hate", "dislike", "like",
                    "enjoy", "dark mode", "coffee", "tea", "music", "food", "annoyed",
                    "find it hard", "concise", "direct", "brief")),
    ("personal", ("live", "lives", "dog", "cat", "pet", "family", "learning", "hobby",
                  "book", "read", "morning", "evening", "named", "called", "located",
                  "from")),
    ("relationship", ("friend", "partner", "spouse", "colleague", "teammate", "mentor",
                      "manager")),
)

CLAUDE_TAG_MAP = (
    ("research", "research"), ("arXiv", "arxiv"), ("LLM", "LLM"),
    ("evaluation", "evaluation"), ("benchmark", "benchmark"),
    ("python", "python"), ("data scientist", "data-science"),
    ("engineer", "engineering"), ("coffee", "coffee"), ("music", "music"),
    ("dog", "pets"), ("book", "reading"), ("project", "project"),
    ("startup", "startup"), ("AI", "AI"), ("visa", "visa"),
    ("EB-1", "immigration"), ("embedding", "embeddings"), ("remote", "remote-work"),
)

GEMINI_CATEGORY_RULES = (
    ("professional", ("engineer", "developer", "scientist", "researcher", "work", "job",
                      "career", "startup", "code", "programming", "software", "data",
                      "AI", "ML", "research", "paper", "visa")),
    ("project", ("building", "side project", "working on", "developing", "creating",
                 "launching", "project", "app", "tool", "platform", "product")),
    ("preference", ("prefer", "favourite", "favorite", "love", "hate", "dislike", "like",
                    "enjoy", "dark mode", "coffee", "tea", "music", "food")),
    ("personal", ("live", "lives", "dog", "cat", "pet", "family", "learning", "hobby",
                  "book", "read", "morning", "evening", "named", "called")),
    ("relationship", ("friend", "partner", "spouse", "colleague", "teammate", "mentor",
                      "manager")),
)

GEMINI_TAG_MAP = (
    ("python", "python"), ("AI", "AI"), ("research", "research"),
    ("coffee", "coffee"), ("music", "music"), ("dog", "pets"),
    ("book", "reading"), ("project", "project"), ("startup", "startup"),
    ("learning", "learning"), ("travel", "travel"), ("google", "google"),
)

# Confidence per platform: chatgpt 0.85, claude 0.92, gemini 0.85.
# Record-array wrappers (gemini only): "memories", then "items".
# Text keys: chatgpt "memory"; claude "memory", "content";
#            gemini "memory", "content", "text", "title".
# Time keys: "created_at"; gemini also "timestamp".
# ---------------------------------------------------------------------------

CHATGPT = PlatformSpec(
    name="chatgpt", text_keys=("memory",), time_keys=("created_at",), accept_strings=False,
    category_rules=CHATGPT_CATEGORY_RULES, tag_map=CHATGPT_TAG_MAP, confidence=0.85,
)
CLAUDE = PlatformSpec(
    name="claude", text_keys=("memory", "content"), time_keys=("created_at",),
    category_rules=CLAUDE_CATEGORY_RULES, tag_map=CLAUDE_TAG_MAP, confidence=0.92,
)
GEMINI = PlatformSpec(
    name="gemini", wrapper_keys=("memories", "items"),
    text_keys=("memory", "content", "text", "title"), time_keys=("created_at", "timestamp"),
    category_rules=GEMINI_CATEGORY_RULES, tag_map=GEMINI_TAG_MAP, confidence=0.85,
)

PLATFORMS: dict[str, PlatformSpec] = {p.name: p for p in (CHATGPT, CLAUDE, GEMINI)}


def register_platform(spec: PlatformSpec) -> None:
    """Add or replace a platform in the registry."""
    PLATFORMS[spec.name] = spec


def get_platform(name_or_spec) -> PlatformSpec:
    if isinstance(name_or_spec, PlatformSpec):
        return name_or_spec
    try:
        return PLATFORMS[name_or_spec]
    except KeyError:
        raise ValueError(f"unknown platform {name_or_spec!r}; known: {sorted(PLATFORMS)}") from None
