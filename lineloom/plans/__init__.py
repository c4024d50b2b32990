"""From the text of a query to predicates and orders, and the catalogue of queries."""
