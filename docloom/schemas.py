"""Record schemas."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)

ELEMENT = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("elem_idx", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_directory", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
    ]
)

NODE = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("tok_start", T.IntegerType()),
        T.StructField("tok_end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("prev_id", T.StringType()),
        T.StructField("next_id", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("level", T.IntegerType()),
    ]
)

CHAT_REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("req_no", T.LongType()),
        T.StructField("chat_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
    ]
)

OLLAMA_REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("req_no", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("stream", T.BooleanType()),
        T.StructField("options", T.MapType(T.StringType(), T.StringType())),
    ]
)
