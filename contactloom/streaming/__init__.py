from contactloom.streaming.runs import (
    first_listings,
    first_listings_writer,
    first_page_visits,
    handled_sites_writer,
    read_first_listings,
    stream_emails,
)

__all__ = [
    "first_listings",
    "first_listings_writer",
    "first_page_visits",
    "handled_sites_writer",
    "read_first_listings",
    "stream_emails",
]
