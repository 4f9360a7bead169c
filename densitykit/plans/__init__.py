"""Plans: fixtures read from the given tables, pipelines that chain operators."""
