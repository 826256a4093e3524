"""DataFrame transformations that the plans are put together from."""
