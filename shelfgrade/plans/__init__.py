"""Operators put together: cleaning profiles, preset queries, views."""
