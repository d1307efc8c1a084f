"""Table schemas, as DDL strings Spark reads directly."""

PAGES = "url string, status int, content_type string, html string, fetched_at timestamp"
LISTINGS = "query string, seq bigint, place_url string, title string, html string"
BUSINESSES = (
    "query string, seq bigint, name string, website string, phone_number string, address string"
)
ROBOTS = "base_url string, status int, body string"
HISTORY = "website string"
QUERIES = "query string"
CONTACTS = (
    "query string, seq bigint, name string, website string, phone_number string, "
    "email_addresses array<string>, skipped boolean"
)
