"""Training-data operators: archives, language ID, dedup, mixing, sharding,
decontamination, secret scans and chat formatting, all as Spark jobs.

Nothing else in the library imports this subpackage; ``queries`` registers
its queries and their SQL.
"""
