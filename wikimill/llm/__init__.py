"""Operators for preparing training text: scans, deduplication, scoring, counting and mixing. Nothing else imports them."""
