"""Training-data operators: one module per operator, queries and oracle SQL in ``queries``."""
