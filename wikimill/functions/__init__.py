"""Column-level building blocks: keys, urls, html, markup, dates, similarity."""
