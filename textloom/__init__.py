"""A PySpark-native engine that treats a source tree or text corpus as a relation of files.

`textloom.plans.pack` is the whole path from files to one packed text per repository; every stage
is also a function of its own on DataFrames or columns.
"""
