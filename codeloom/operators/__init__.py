"""DataFrame → DataFrame operators (no sessions or globals inside)."""
