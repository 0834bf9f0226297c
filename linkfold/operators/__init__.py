"""Reference, check, exploration, graph and subset operators."""
