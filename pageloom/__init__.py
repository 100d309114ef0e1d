"""pageloom: page extraction and content analytics on Spark.

HTML is exploded once into a node table (``operators.dom``); tag removal,
CSS-style selection, text assembly, deduplication, array items, links, batch
summaries, cache lookups and request-rate windows are ordinary DataFrame
operators on top of it.
"""

__version__ = "0.1.0"
