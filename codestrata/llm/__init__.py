"""Training-data operators. Nothing outside this subpackage imports it except the optional hook of ``__spark_entry__``."""
