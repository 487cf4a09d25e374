"""Social-content analytics as Spark DataFrame jobs.

``functions``  column expressions (rules, text, numbers, time)
``operators``  DataFrame -> DataFrame building blocks (nesting, medians, ranks, joins, graph, topics)
``sources``    schemas, readers, media folders, sinks and the manifest
``plans``      the public tables: core tables, rollups, comments, creators, topics, the batch job
``streaming``  the same column expressions on a file stream
"""

__version__ = "0.1.0"
