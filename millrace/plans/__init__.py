"""Cost estimates over run metrics, expressed as queries."""
