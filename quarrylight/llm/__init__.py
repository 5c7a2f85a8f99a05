"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage.  Each operator module takes and
returns DataFrames; ``quarrylight.llm.queries`` binds them to the driver tables.
"""
