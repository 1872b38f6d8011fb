"""Fixed input schemas."""

from pyspark.sql import types as T

HIT = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("engines", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("publishedDate", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)
SEARCH_RESPONSE = T.StructType(
    [
        T.StructField("results", T.ArrayType(HIT)),
        T.StructField("number_of_results", T.LongType()),
        T.StructField("suggestions", T.ArrayType(T.StringType())),
        T.StructField("answers", T.ArrayType(T.StringType())),
        T.StructField("unresponsive_engines", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
SCRAPE_REQUEST = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("formats", T.ArrayType(T.StringType())),
        T.StructField("onlyMainContent", T.BooleanType()),
    ]
)
SEARCH_REQUEST = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("limit", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField(
            "scrapeOptions",
            T.StructType(
                [
                    T.StructField("formats", T.ArrayType(T.StringType())),
                    T.StructField("onlyMainContent", T.BooleanType()),
                ]
            ),
        ),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
#: What a page answer may also have; null where a file lacks it.
ANSWERED_PAGE = T.StructType(
    [*PAGE.fields, T.StructField("status_code", T.IntegerType()), T.StructField("content_type", T.StringType())]
)
