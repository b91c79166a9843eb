"""Explicit schemas of the input tables.  Nothing in the package infers types."""

from pyspark.sql import types as T

#: Columns that name one tree.
TREE = ["repo", "snapshot"]
#: Columns that name one entry of one tree.
ENTRY = ["repo", "snapshot", "path"]

FILES = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("ctime", T.DoubleType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("uid", T.IntegerType()),
        T.StructField("gid", T.IntegerType()),
        T.StructField("link_target", T.StringType()),
        T.StructField("target_is_dir", T.BooleanType()),
        T.StructField("denied", T.BooleanType()),
    ]
)

#: Host-supplied tree: a list of files with content; directories are implied.
MANIFEST = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField(
            "files",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("path", T.StringType()),
                        T.StructField("content", T.StringType()),
                        T.StructField("mtime", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("now", T.DoubleType()),
    ]
)

#: Version of the node rows written by ``coppice.sinks``.
SCHEMA_VERSION = 1
