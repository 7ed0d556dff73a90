"""Plan-level building blocks: skew handling, ordering over distributed rows, multi-step jobs."""
