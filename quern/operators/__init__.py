"""DataFrame operators of the commerce warehouse."""
