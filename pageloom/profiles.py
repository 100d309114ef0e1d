"""Option presets of the request modes (2.L) and driver-side specs."""

from __future__ import annotations

from dataclasses import dataclass

# Default / cap of the content length per request mode and
# the other per-mode limits.
PROFILES = {
    "crawl": {"max_length": 5000, "cap": 20000, "word_threshold": 5},
    "crawl_fast": {"max_length": 2000, "cap": 5000, "word_threshold": 3, "skip_images": True, "skip_links": True},
    "crawl_batch": {"max_length": 2000, "cap": 3000, "batch": 5},
    "crawl_get": {"max_length": 1500, "cap": 1500, "word_threshold": 3},
    "content": {"max_length": 5000, "cap": 20000},
    "content_fast": {"max_length": 2000, "cap": 5000},
    "content_batch": {"max_length": 2000, "cap": 4000, "batch": 5},
    "content_get": {"max_length": 1500, "cap": 1500},
    "selective": {"max_length": 5000, "cap": 25000, "selectors": 10, "excludes": 5},
    "selective_batch": {"max_length": 3000, "cap": 10000, "batch": 5, "selectors": 10, "excludes": 5},
    "selective_get": {"max_length": 2000, "cap": 5000, "selectors": 5, "excludes": 3},
    "analyze": {"max_length": 500, "cap": 500, "suggestions": 5, "suggestions_cap": 10},
    "array": {"limit": 50, "limit_cap": 100},
    "array_simple": {"limit": 20, "limit_cap": 20},
    "array_batch": {"limit": 20, "limit_cap": 50, "batch": 3},
}

# Service defaults when no length is given.
SERVICE_DEFAULT_LENGTH = {"basic": 5000, "content": 10000, "selective": 10000}
SERVICE_MAX_SELECTORS = 10
SERVICE_MAX_ARRAYS = 5


def resolve_length(max_length: int | None, service: str) -> int:
    """``max_length or default``: 0 or None means the service default."""
    return max_length if max_length else SERVICE_DEFAULT_LENGTH[service]


def profile_length(profile: str, requested: int | None = None) -> int:
    p = PROFILES[profile]
    if requested is None:
        return p["max_length"]
    return min(requested, p["cap"])


@dataclass(frozen=True)
class SelectiveSpec:
    selectors: tuple = ()
    exclude: tuple = ()
    max_length: int | None = None
    return_sections: bool = False

    def validate(self, max_selectors: int = SERVICE_MAX_SELECTORS, max_excludes: int | None = None):
        if len(self.selectors) > max_selectors:
            raise ValueError(f"Maximum {max_selectors} custom selectors allowed")
        if max_excludes is not None and len(self.exclude) > max_excludes:
            raise ValueError(f"Maximum {max_excludes} exclude selectors allowed")
        return self


@dataclass(frozen=True)
class ArraySpec:
    name: str
    selector: str
    sub_selectors: tuple = ()        # ((name, selector), ...) in request order
    limit: int | None = None

    @staticmethod
    def of(name: str, cfg) -> "ArraySpec":
        """Normalise the ``str or dict`` selector config."""
        if isinstance(cfg, str):
            return ArraySpec(name, cfg)
        subs = tuple((cfg.get("sub_selectors") or {}).items())
        return ArraySpec(name, cfg.get("selector", ""), subs, cfg.get("limit"))


# The preset of the simple array mode.
AUTO_SUB_SELECTORS = (
    ("title", "h1, h2, h3, h4, .title, .headline, .news-title, .article-title"),
    ("content", "p, .content, .summary, .excerpt, .description, .text"),
    ("image", "img"),
    ("link", "a"),
    ("date", ".date, .time, time, .timestamp, .published"),
    ("author", ".author, .by, .writer, .reporter"),
)
AUTO_EXCLUDE = (".ads", ".advertisement", ".sidebar", ".social-share")
AUTO_LIMIT = 20


# What the structure analysis suggests.
SUGGESTED_SELECTORS = (("main", "Main content area", "high"), ("article", "Article content", "high"),
                       (".content", "Content class", "medium"), ("#main-content", "Main content ID", "medium"),
                       (".post-content", "Post content area", "medium"))
SUGGESTED_EXCLUDES = (("nav", "Navigation menus"), (".sidebar", "Sidebar content"), (".advertisement", "Advertisement blocks"),
                      ("footer", "Footer content"), (".comments", "Comment sections"))
