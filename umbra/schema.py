"""Types of the engine's relations."""

from __future__ import annotations

from pyspark.sql import types as T

# The nine categories in report order, and who wins where spans meet (larger wins).
TYPES = ("PERSON", "EMAIL", "PHONE", "ORG", "ADDRESS", "SSN", "CREDIT_CARD", "DOB", "IP")
PRIORITY = {"ADDRESS": 100, "CREDIT_CARD": 98, "SSN": 97, "EMAIL": 96, "IP": 95, "DOB": 94, "PHONE": 90, "ORG": 80, "PERSON": 70}

#: A row of text of a document; seq numbers the rows of a document in reading order.
UNIT = "doc_id long, part string, unit_id string, seq int, text string"
#: A found span of a unit, before and after it is a row of its own.
SPAN = "struct<type:string,start:int,end:int,text:string,score:double,detector:string,identity:string>"
SPANS = f"array<{SPAN}>"
ANNOTATION = "unit_id string, type string, text string, start int, end int, context string"
ENTITY = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("unit_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("detector", T.StringType()),
        T.StructField("identity", T.StringType()),
    ]
)
