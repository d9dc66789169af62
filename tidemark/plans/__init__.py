"""Views as lazy plans: a DataFrame with an identity and an order."""
