"""Declared schemas (no inference anywhere)."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

ATTRS = T.MapType(T.StringType(), T.StringType())
CLASSES = T.ArrayType(T.StringType())

ANC_ENTRY = T.StructType([
    T.StructField("nid", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id_attr", T.StringType()),
    T.StructField("classes", CLASSES),
    T.StructField("attrs", ATTRS),
])

NODE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("nid", T.IntegerType()),
    T.StructField("post", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id_attr", T.StringType()),
    T.StructField("classes", CLASSES),
    T.StructField("attrs", ATTRS),
    T.StructField("text", T.StringType()),
    T.StructField("anc", T.ArrayType(ANC_ENTRY)),
])

IMAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "alt", "title")])
LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("href", "text")])

SECTION = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("sel_pos", T.IntegerType()),
    T.StructField("section_key", T.StringType()),
    T.StructField("selector", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("element_count", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()),
])

EVENTS_TS = "ts"
