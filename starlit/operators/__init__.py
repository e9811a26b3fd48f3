"""DataFrame -> DataFrame operators of the light-curve engine."""
