"""The registered queries: input views over the given tables, Spark queries and their SQL counterparts."""
