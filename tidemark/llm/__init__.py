"""Training-data operators: each module is one operator with a DataFrame interface.

Nothing outside this subpackage imports it.  Every operator selects the
columns it needs first, so extra columns of any name are harmless, and treats
a null text as an empty one unless its docstring says otherwise.
"""
