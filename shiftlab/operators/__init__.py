"""DataFrame steps the analyses are made of."""
