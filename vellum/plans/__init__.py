"""Query plans: text queries, filters, requests, and the search that they make up."""
