"""DataFrame operators of the inventory."""
