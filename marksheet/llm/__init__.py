"""Operators for building training data from text: language, rules, duplicates, mixing, tokens, scores.

Every operator takes a DataFrame with an id and a text column (other columns are ignored, whatever
their names), keeps nothing whole on the driver, and states in its docstring what nulls, empty
texts, ties, repeated rows and empty tables give.
"""
