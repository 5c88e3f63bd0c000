"""Nothing here: graphs are immutable once loaded, and all queries are batch queries.
Their results are DataFrames, which Structured Streaming can join streams with."""
