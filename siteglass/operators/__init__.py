"""DataFrame operators: signals, rules, links, scoring, reports."""
