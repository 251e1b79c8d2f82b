"""Native expressions and small Arrow-batched helpers that scores are made of."""
