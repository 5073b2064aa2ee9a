"""Loaders and stores."""

from relflow.sources.readers import load, load_avro, load_binary, load_clj, load_csv, load_json, load_lazy, load_parquet, load_string, load_tap, load_tsv, register_loader
from relflow.sources.schema import binary, boolean, double, float_, int32, int64, message
from relflow.sources.writers import register_store, store, store_binary, store_clj, store_csv, store_json, store_many, store_parquet, store_string, store_tap, store_tsv

__all__ = [
    "binary", "boolean", "double", "float_", "int32", "int64", "load", "load_avro", "load_binary",
    "load_clj", "load_csv", "load_json", "load_lazy", "load_parquet", "load_string", "load_tap",
    "load_tsv", "message", "register_loader", "register_store", "store", "store_binary",
    "store_clj", "store_csv", "store_json", "store_many", "store_parquet", "store_string",
    "store_tap", "store_tsv",
]
