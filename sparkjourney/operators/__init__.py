"""DataFrame -> DataFrame operators of the customer-journey analysis."""
