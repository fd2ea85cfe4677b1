"""Training-data operators: ten numbered operators, each with one registered query ``opN_<name>``.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries when it is present.
"""
