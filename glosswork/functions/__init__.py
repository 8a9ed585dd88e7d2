"""Column functions over text: markup, tokens, coverage, guards."""
