from contactloom.sources.tables import (
    history_from_json,
    history_source,
    listings_source,
    pages_source,
    robots_source,
    search_plan,
    spread,
    with_page_defaults,
)

__all__ = [
    "history_from_json",
    "history_source",
    "listings_source",
    "pages_source",
    "robots_source",
    "search_plan",
    "spread",
    "with_page_defaults",
]
