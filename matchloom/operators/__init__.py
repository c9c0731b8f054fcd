"""DataFrame-to-DataFrame operators: parsing, scoring, judging, ranking and reporting."""
