from contactloom.functions.emails import has_email_shape, is_business_email
from contactloom.functions.urls import (
    base_url,
    domain_label,
    normalize_url,
    page_key,
    quote_plus,
    search_url,
    url_path,
)

__all__ = [
    "base_url",
    "domain_label",
    "has_email_shape",
    "is_business_email",
    "normalize_url",
    "page_key",
    "quote_plus",
    "search_url",
    "url_path",
]
