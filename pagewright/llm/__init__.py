"""Training-data operators: ten corpus-scale components and their registered queries.

Nothing else in the package imports this subpackage; it can be deleted as a whole.
"""
