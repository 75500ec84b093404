"""Training-data operators: ten DataFrame-in, DataFrame-out components.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; ``queries`` derives the registered queries.
"""
