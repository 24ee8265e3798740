from .files import concat_files, find_csv, load, read_csv, read_json_columns, write_csv, write_parquet  # noqa: F401
