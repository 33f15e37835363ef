"""Schemas of the engine's tables, so that no reader has to infer one."""

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
ANNOTATION = T.StructType([T.StructField("type", T.StringType()), T.StructField("reparandum", SPAN), T.StructField("interregnum", SPAN), T.StructField("repair", SPAN)])
WORDS = T.ArrayType(T.StringType())
UTTERANCE = T.StructType([
    T.StructField("utt_id", T.LongType()), T.StructField("disfluent", T.StringType()), T.StructField("clean", T.StringType()), T.StructField("disfluent_tokens", WORDS), T.StructField("clean_tokens", WORDS),
    T.StructField("alignment", T.ArrayType(T.IntegerType())), T.StructField("annotations", T.ArrayType(ANNOTATION)), T.StructField("source", T.StringType()), T.StructField("conversation", T.StringType()),
    T.StructField("template_id", T.IntegerType()), T.StructField("asked_level", T.IntegerType()), T.StructField("level", T.IntegerType()),
])
TRANSCRIPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("conversation_no", T.StringType())])
