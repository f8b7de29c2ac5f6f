"""Training-data operators: ten corpus operators, their queries and SQL.

Nothing outside this package (but the guarded registration in the driver
entry) imports it.
"""
