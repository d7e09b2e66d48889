"""Whole flows, SQL transforms and the records they leave."""
