"""DataFrame operators: element tables, entity extraction, key rules, roll-ups, graph jobs."""
