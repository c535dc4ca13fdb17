"""Operations of a large-scale training-data pipeline on text tables.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
