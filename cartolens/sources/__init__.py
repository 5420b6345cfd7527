"""Readers: crawl tables, robots.txt, sitemaps, portal search pages."""
