"""Plan-shaping helpers: ordered work inside large groups, seeded draws, lineage cuts."""
