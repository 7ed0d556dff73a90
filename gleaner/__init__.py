"""Spark toolkit that turns page snapshots and embedded JSON into searchable, summarised posting tables."""
