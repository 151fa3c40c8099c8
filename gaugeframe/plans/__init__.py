"""Query shapes shared by the operators: counts, quantiles, pairings, checks."""
