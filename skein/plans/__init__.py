"""Query plans over the tables: transactions from events, the query catalogue, and its SQL."""
