"""Whole queries: what is registered with the driver, and the SQL each is held against."""
