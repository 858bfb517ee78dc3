"""Feature builders, labels, tiers, splits, windows, models and metrics. Builders return (frame, feature names)."""
