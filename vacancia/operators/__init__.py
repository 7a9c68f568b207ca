"""DataFrame operators of the posting engine."""
