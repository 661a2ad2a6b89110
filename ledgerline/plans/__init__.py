"""Whole results: the merged facts, the two reporting views, the objectives built on them."""
