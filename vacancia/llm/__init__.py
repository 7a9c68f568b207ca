"""Operators for training text: packing, token counts, duplicates, secrets, toxicity.

Nothing else in the library imports this subpackage. Every operator reads the columns it is told
to and leaves out all others, so extra columns of any name do no harm.
"""
