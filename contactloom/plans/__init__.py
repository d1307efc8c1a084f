from contactloom.plans.contact_run import find_businesses, run_contacts
from contactloom.plans.crawl import first_visits, replay_crawl

__all__ = ["find_businesses", "first_visits", "replay_crawl", "run_contacts"]
